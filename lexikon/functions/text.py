"""Scalar text functions as native Column expressions.

All of them stay inside the JVM (whole-stage codegen where Spark has it); no
Python UDF is involved.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word character for our tokenisers: any letter, decimal digit or underscore.
WORD = r"[\p{L}\p{Nd}_]"
NOT_WORD_NOT_SPACE = r"[^\p{L}\p{Nd}_\s]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def repair_mojibake(c: Column | str) -> Column:
    """UTF-8 bytes that were read as Latin-1 are decoded again.

    Like ``t.encode('latin-1').decode('utf-8')`` with the text kept on any
    failure: a text with a character above U+00FF cannot be Latin-1 encoded,
    and bytes that are not valid UTF-8 give NULL from ``try_validate_utf8``.
    """
    t = _c(c)
    latin1_only = ~t.rlike(r"[^\x00-\xFF]")
    redecoded = F.try_validate_utf8(F.encode(t, "ISO-8859-1").cast("string"))
    return F.when(latin1_only, F.coalesce(redecoded, t)).otherwise(t)


def damage_as_latin1(c: Column | str) -> Column:
    """The damage T1 repairs: UTF-8 bytes decoded as Latin-1."""
    return F.decode(F.encode(_c(c), "UTF-8"), "ISO-8859-1")


def collapse_repeats(c: Column | str) -> Column:
    """``..+`` to a space, ``-`` plus blanks to a space, then a word repeated
    right after itself (case-insensitive, Unicode) is kept once, first form."""
    t = F.regexp_replace(_c(c), r"\.\.+", " ")
    t = F.regexp_replace(t, r"\-\s+", " ")
    return F.regexp_replace(t, r"(?iuU)\b(\w+)(?:\W\1\b)+", "$1")


def strip_from(c: Column | str, marker: str) -> Column:
    """Drop from ``marker`` to the end of the line (``\\n`` only)."""
    return F.regexp_replace(_c(c), r"\Q" + marker + r"\E[^\n]*", "")


def strip_signature(c: Column | str, markers: tuple[str, ...] = ("Mit freundlich", "Prof.")) -> Column:
    t = _c(c)
    for m in markers:
        t = strip_from(t, m)
    return t


def normalise_punct(c: Column | str) -> Column:
    """T4: remove ``\\n\\r\\n`` and ``\\r``; dot runs to one dot, dash runs to one
    dash, comma runs removed."""
    t = F.replace(_c(c), F.lit("\n\r\n"), F.lit(""))
    t = F.replace(t, F.lit("\r"), F.lit(""))
    t = F.regexp_replace(t, r"\.+", ".")
    t = F.regexp_replace(t, r"\-+", "-")
    return F.regexp_replace(t, r",+", "")


def slice_text(c: Column | str, start: int = 0, stop: int | None = None) -> Column:
    """Python-style ``t[start:stop]`` on code points (negative bounds too)."""
    t = _c(c)
    n = F.length(t)
    lo = F.lit(start) if start >= 0 else F.greatest(n + start, F.lit(0))
    if stop is None:
        hi = n
    else:
        hi = F.least(F.lit(stop), n) if stop >= 0 else F.greatest(n + stop, F.lit(0))
    return F.when(hi > lo, F.substring(t, lo + 1, hi - lo)).otherwise(F.lit(""))


def word_tokens(c: Column | str) -> Column:
    """Words and single punctuation characters."""
    return F.regexp_extract_all(_c(c), F.lit(f"{WORD}+|{NOT_WORD_NOT_SPACE}"), 0)


def pre_tokens(c: Column | str) -> Column:
    """Word runs and punctuation runs (pre-tokenisation for subword training)."""
    return F.regexp_extract_all(_c(c), F.lit(f"{WORD}+|{NOT_WORD_NOT_SPACE}+"), 0)


def lossless_tokens(c: Column | str) -> Column:
    """Pre-tokens that joined give the text back: word and punctuation runs with the
    space before them, and other white space."""
    return F.regexp_extract_all(_c(c), F.lit(f" ?{WORD}+| ?{NOT_WORD_NOT_SPACE}+|\\s+"), 0)


def space_tokens(c: Column | str) -> Column:
    """Tokens by a single space, empty strings kept (``str.split(' ')``)."""
    return F.split(_c(c), " ", -1)


def base_name(c: Column | str) -> Column:
    return F.element_at(F.split(_c(c), "/", -1), -1)


def parent_dir(c: Column | str) -> Column:
    return F.regexp_extract(_c(c), r"^(.*)/[^/]*$", 1)


def clean_path(c: Column | str) -> Column:
    """The report folder becomes the clean folder, ``Nr`` becomes ``#``."""
    return F.replace(F.replace(_c(c), F.lit("reports"), F.lit("clean")), F.lit("Nr"), F.lit("#"))


def title_of(c: Column | str, width: int = 16) -> Column:
    """The last ``width`` characters (the dedup title)."""
    return F.right(_c(c), F.lit(width))


def padded_id(n: Column | str, width: int = 6, prefix: str = "textNr", left: bool = True) -> Column:
    """``prefix`` + number padded with zeros to ``width`` digits (left or
    right); longer numbers are kept whole."""
    s = _c(n).cast("string")
    pad = F.lpad(s, width, "0") if left else F.rpad(s, width, "0")
    return F.concat(F.lit(prefix), F.when(F.length(s) >= width, s).otherwise(pad))


def parse_checkpoint_name(c: Column | str) -> list[Column]:
    """``...epoch=08-val_loss=0.27-train_loss=0.24.ckpt`` to three numbers."""
    t = _c(c)
    return [F.regexp_extract(t, r"epoch=(\d+)", 1).cast("int").alias("epoch"),
            F.regexp_extract(t, r"val_loss=(\d+(?:\.\d+)?)", 1).cast("double").alias("val_loss"),
            F.regexp_extract(t, r"train_loss=(\d+(?:\.\d+)?)", 1).cast("double").alias("train_loss")]


def parse_run_name(c: Column | str) -> list[Column]:
    """A run folder ``<training>_<tokenizer>_..._<NN>`` (optionally followed
    by ``/checkpoint-…`` or a trailing slash): best epoch = last two
    characters of the run folder, training and tokenizer type from ``_`` parts."""
    t = _c(c)
    parts = F.split(t, "/", -1)
    last = F.element_at(parts, -1)
    run = F.when(last.contains("checkpoint") | (last == ""), F.element_at(parts, -2)).otherwise(last)
    bits = F.split(run, "_", -1)
    return [run.alias("run_folder"), F.right(run, F.lit(2)).cast("int").alias("best_epoch"),
            F.element_at(bits, 1).alias("training_type"), F.element_at(bits, 2).alias("tokenizer_type"),
            last.contains("checkpoint").alias("is_checkpoint")]


def compose_label(*parts: Column | str) -> Column:
    """``tokenizer_training_vocab`` label."""
    return F.concat_ws("_", *[_c(p) for p in parts])


#: Neighbouring values that one block of running sums holds, and levels of blocks.
BLOCK, LEVELS = 64, 2


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where the body reads it in a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sums_before(values: Column, levels: int = LEVELS) -> Column:
    """For each value of an ``array<bigint>`` the sum of those before it.

    The sums of blocks of values are summed first (by the same rule), then the values
    inside a block: a bounded number of additions for each value, and no list that
    grows value by value.
    """
    def total(v: Column, lo: Column, hi: Column) -> Column:
        some = F.aggregate(F.sequence(lo, hi - 1), F.lit(0).cast("long"), lambda acc, i: acc + F.get(v, i))
        return F.when(hi > lo, some).otherwise(F.lit(0).cast("long"))

    def direct(v: Column) -> Column:
        return F.transform(v, lambda _, i: total(v, F.lit(0), i))

    def blocked(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")),
                             lambda k: total(v, k * BLOCK, F.least((k + 1) * BLOCK, F.size(v))))
        return let(sums_before(blocks, levels - 1), lambda offsets: F.transform(
            v, lambda _, i: F.get(offsets, F.floor(i / BLOCK).cast("int")) + total(v, i - i % BLOCK, i)))

    return let(values, lambda v: F.when(F.size(v) <= BLOCK, direct(v)).otherwise(blocked(v)) if levels else direct(v))


def match_spans(t: Column, pattern: str, lengths: Column) -> Column:
    """0-based ``(start, stop)`` of every match, from the pieces between matches and the
    match ``lengths``, by running sums."""
    pieces = F.split(t, pattern, -1)
    steps = F.zip_with(F.slice(pieces, 1, F.size(pieces) - 1), lengths,
                       lambda p, m: F.struct(F.length(p).cast("long").alias("gap"), m.cast("long").alias("own")))
    return let(steps, lambda x: F.zip_with(
        x, sums_before(F.transform(x, lambda s: s["gap"] + s["own"])),
        lambda s, before: F.struct((before + s["gap"]).alias("start"), (before + s["gap"] + s["own"]).alias("stop"))))


def find_all(df: DataFrame, key: str, text: str, keyword: str, regex: bool = False) -> DataFrame:
    """Every non-overlapping match of ``keyword`` as ``(key, n, start, stop)``,
    0-based like Python; literal by default.  Positions are computed inside the
    row and exploded once: no shuffle, no window."""
    t = F.col(text)
    pattern = keyword if regex else re.escape(keyword)
    if regex:
        lengths = F.transform(F.regexp_extract_all(t, F.lit(pattern), 0), lambda m: F.length(m))
    else:
        lengths = F.array_repeat(F.lit(len(keyword)), F.size(F.split(t, pattern, -1)) - 1)
    spans = df.select(key, F.posexplode(match_spans(t, pattern, lengths)).alias("n", "span"))
    return spans.select(key, F.col("n").cast("int").alias("n"), "span.start", "span.stop")
