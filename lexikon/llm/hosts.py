"""Host-level quality rules.

Each document is measured and held against soft rules.  Failures are counted by
host; a host's failure rate for a rule is shrunk towards the rate of all hosts
by a beta prior fitted to the spread of the host rates (method of moments), and
a host whose shrunk rate is above the limit is bad under that rule.  The host
verdicts are joined back: a document that fails a rule under which its host is
bad goes, as does one that fails the base rule by itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexikon.llm.common import Words, append_columns, as_bytes, aside, by_size, text_sums, windows, written

SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_CONTINUES = (np.arange(256) & 0xC0) == 0x80
LIMIT = 0.5
#: Parts of each host's documents in the join with its verdict.
SALTS = 32
#: Bounds of the prior's weight in documents: rates that do not spread shrink fully.
WEAKEST, STRONGEST = 1.0, 1e6

MEASURES = ("n_words bigint, word_chars bigint, n_symbols bigint, n_lines bigint, n_dup_lines bigint, "
            "n_repeat_words bigint")
#: Soft rules on the measures; each is true where a document fails it.
RULES = {
    "short": "n_words < 100",
    "symbols": "2 * n_symbols > n_words",
    "dup_lines": "3 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "repeats": "100 * n_repeat_words > 25 * n_words",
}
BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"


def _repeat_words(words: Words) -> np.ndarray:
    """Words of each text that lie in a three-word window found at least twice in it."""
    counts = np.zeros(len(words.first) - 1, np.int64)
    grams = windows(words.hashes(), 3)
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        if b - a < 4:
            continue
        own = grams[a:b - 2]
        order = np.argsort(own, kind="stable")
        same = own[order][1:] == own[order][:-1]
        if same.any():
            twice = np.zeros(len(own), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(b - a, bool)
            for k in range(3):
                covered[k:k + len(own)] |= twice
            counts[i] = covered.sum()
    return counts


def _dup_lines(text: bytes | None) -> tuple[int, int]:
    """(lines with a word, those equal to an earlier line)."""
    lines = [x for x in (text or b"").split(b"\n") if x.strip()]
    return len(lines), len(lines) - len(set(lines))


def _measures(raw: list[bytes | None]) -> list[list[int]]:
    words = Words(raw)

    def sums(mask: np.ndarray) -> list[int]:
        return text_sums(mask, raw).tolist()

    space = np.isin(words.data, np.frombuffer(b" \t\n\x0b\x0c\r", np.uint8))
    lines = [_dup_lines(t) for t in raw]
    return [np.diff(words.first).tolist(), sums(~space & ~_CONTINUES[words.data]), sums(_SYMBOL[words.data]),
            [a for a, _ in lines], [b for _, b in lines], _repeat_words(words).tolist()]


def _measure():
    def fn(texts):
        raw = as_bytes(texts)
        parts = [_measures(raw[a:b]) for a, b in by_size(raw)]
        return [[x for part in parts for x in part[k]] for k in range(6)]
    return fn


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the measures; a null text counts as empty."""
    return append_columns(docs, [text], MEASURES, _measure)


def host_of(source: Column) -> Column:
    """The host of a URL, else the value itself, lower-cased."""
    return F.lower(F.coalesce(F.nullif(F.regexp_extract(source, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)", 1),
                                       F.lit("")), source))


def host_verdicts(measured: DataFrame, host: str, limit: float = LIMIT) -> DataFrame:
    """(host, bad_<rule> ...) from the failures of all measured documents of each host."""
    fails = measured.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.expr(f"CAST({r} AS BIGINT)")).alias(k) for k, r in RULES.items()])
    mean = fails.agg(F.sum("n").alias("all"), *[(F.sum(k) / F.sum("n")).alias("m_" + k) for k in RULES])
    spread = fails.crossJoin(F.broadcast(mean)).agg(  # one row
        *[F.first("m_" + k).alias("m_" + k) for k in RULES],
        *[(F.sum(F.col("n") * F.pow(F.col(k) / F.col("n") - F.col("m_" + k), 2)) / F.first("all")).alias("v_" + k)
          for k in RULES])
    out = fails.crossJoin(F.broadcast(spread))  # one row
    for k in RULES:
        m, v = F.col("m_" + k), F.col("v_" + k)
        weight = F.least(F.greatest(F.coalesce(m * (1 - m) / F.nullif(v, F.lit(0.0)) - 1, F.lit(STRONGEST)),
                                    F.lit(WEAKEST)), F.lit(STRONGEST))
        out = out.withColumn("bad_" + k, (F.col(k) + m * weight) / (F.col("n") + weight) > limit)
    return out.select("host", *["bad_" + k for k in RULES])


def host_rules(docs: DataFrame, source: str = "source", text: str = "text", limit: float = LIMIT) -> DataFrame:
    """``docs`` without the text, with the measures, base_failed, failed_host_rules and kept.

    A document without a source has no host and is judged by the base rule
    alone; empty and null texts have no words and fail it; repeated rows are
    judged row by row; columns with the names of the new ones are replaced, all
    others kept.  Only hosts that are bad under some rule are joined back, each to
    SALTS parts of its documents, so a host with most documents is many small keys.
    """
    def judged(own: DataFrame) -> DataFrame:
        measured = written(measure(own.withColumn("own_host", host_of(F.col("source"))), "text").drop("text"), "measures")
        bad = ["bad_" + k for k in RULES]
        verdicts = (host_verdicts(measured, "own_host", limit).where(" OR ".join(bad))
                    .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        # of written rows: a task that runs again draws the same numbers
        salted = measured.withColumn("own_salt", (F.rand(0) * SALTS).cast("int"))
        joined = salted.join(verdicts, (F.col("own_host") == F.col("host")) & (F.col("own_salt") == F.col("salt")), "left")
        failed = F.array_compact(F.array(*[F.when(F.expr(f"({r}) AND bad_{k}"), F.lit(k)) for k, r in RULES.items()]))
        return (joined.withColumn("base_failed", F.expr(BASE)).withColumn("failed_host_rules", failed)
                .withColumn("kept", ~F.col("base_failed") & (F.size("failed_host_rules") == 0))
                .drop("own_host", "own_salt", "host", "salt", *bad))
    return aside(docs, {source: "source", text: "text"}, judged)
