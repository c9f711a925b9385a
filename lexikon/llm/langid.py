"""Language identification with segmentation-marginalised unigrams.

The vocabulary is a fixed public one (``pieces``); a language is a probability
for each piece.  A word has the probability that all its segmentations into
pieces have together (forward algorithm); a text is scored as the product over
its words.  Piece probabilities are learned by expectation-maximisation over
the word counts of all training documents.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexikon.llm.common import append_columns, map_rows, written

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
#: Longer runs of letters are summed over in logarithms, as products would fall below the smallest double.
LONGEST = 30
ROUNDS = 2
SMOOTHING = 0.1
PART_CHARS = 1_000_000
CACHED_WORDS = 400_000
MAX_LANGUAGES = 1000


def load_pieces(path: str = PIECES) -> list[str]:
    """The pieces of a sentencepiece model that hold letters only, with and without the word start."""
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    all_pieces = {model.id_to_piece(i).lower() for i in range(model.get_piece_size())
                  if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
    return sorted(p for p in all_pieces if (p.removeprefix(START) or "a").isalpha())


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


class Lattice:
    """Pieces at every place of a word; unknown letters stand as the last piece."""

    def __init__(self, pieces: list[str]):
        self.id = {p: i for i, p in enumerate(pieces)}
        self.unknown = len(pieces)
        self.trie: dict = {}  # letter -> (following letters, piece that ends here or -1)
        for piece, number in self.id.items():
            node = self.trie
            for k, c in enumerate(piece):
                below, own = node.get(c, (None, -1))
                below = {} if below is None else below
                node[c] = below, (number if k == len(piece) - 1 else own)
                node = below

    def edges(self, word: str) -> list[int]:
        """Edges ((to * 64 + from) << 32) + piece, with the word start as letter 0."""
        out = []
        s = START + word
        trie, unknown = self.trie, self.unknown
        for i in range(len(s)):
            node, at = trie, i * 65
            for c in s[i:]:
                step = node.get(c)
                if step is None:
                    break
                node, piece = step
                at += 64
                if piece >= 0:
                    out.append((at << 32) + piece)
            if s[i] not in trie or trie[s[i]][1] < 0:
                out.append(((i * 65 + 64) << 32) + unknown)
        return out

    def groups(self, words: list[str]) -> Iterator[tuple[list[int], int, list]]:
        """Words of one length, up to LONGEST, together: (their numbers, length, for each (from, to) the words' rows and pieces)."""
        by_length = defaultdict(list)
        for k, w in enumerate(words):
            if len(w) <= LONGEST:
                by_length[len(w) + 1].append(k)
        for n, own in by_length.items():
            found, sizes = [], []
            for k in own:
                edges = self.edges(words[k])
                found += edges
                sizes.append(len(edges))
            code = np.array(found, np.int64)
            rows = np.repeat(np.arange(len(own)), sizes)
            order = np.argsort(code >> 32, kind="stable")
            place, ids, rows = (code >> 32)[order], (code & 0xFFFFFFFF)[order], rows[order]
            cut = np.flatnonzero(np.diff(place)) + 1
            steps = [(int(place[a]) % 64, int(place[a]) // 64, rows[a:b], ids[a:b])
                     for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(place)], strict=True)]
            yield own, n, steps

    def steps(self, word: str) -> Iterator[tuple[int, int, int]]:
        """(from, to, piece) for a word of any length, by place, with the word start as letter 0."""
        s = START + word
        for i in range(len(s)):
            node = self.trie
            for e in range(i, len(s)):
                step = node.get(s[e])
                if step is None:
                    break
                node, piece = step
                if piece >= 0:
                    yield i, e + 1, piece
            if s[i] not in self.trie or self.trie[s[i]][1] < 0:
                yield i, i + 1, self.unknown

    def log_probs(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """log P(word | language), all segmentations together: words x languages."""
        out = np.zeros((len(words), p.shape[1]))
        for own, n, steps in self.groups(words):
            alpha = np.zeros((n + 1, len(own), p.shape[1]))
            alpha[0] = 1
            for i, e, rows, ids in steps:
                alpha[e, rows] += alpha[i, rows] * p[ids]
            out[own] = np.log(alpha[n])
        long = [k for k, w in enumerate(words) if len(w) > LONGEST]
        logs = np.log(p) if long else p
        for k in long:
            alpha = np.full((len(words[k]) + 2, p.shape[1]), -np.inf)
            alpha[0] = 0
            for i, e, piece in self.steps(words[k]):
                alpha[e] = np.logaddexp(alpha[e], alpha[i] + logs[piece])
            out[k] = alpha[-1]
        return out

    def expected(self, words: list[str], langs: np.ndarray, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected number of each piece in each language: pieces x languages."""
        total = np.zeros(p.size)
        width = p.shape[1]
        for own, n, steps in self.groups(words):
            lang, times = langs[own], counts[own]
            alpha = np.zeros((n + 1, len(own)))
            beta = np.zeros((n + 1, len(own)))
            alpha[0] = beta[n] = 1
            probs = [p[ids, lang[rows]] for _, _, rows, ids in steps]
            for (i, e, rows, _), q in zip(steps, probs, strict=True):
                alpha[e, rows] += alpha[i, rows] * q
            for s in sorted(range(len(steps)), key=lambda s: -steps[s][0]):
                i, e, rows, _ = steps[s]
                beta[i, rows] += beta[e, rows] * probs[s]
            scale = times / alpha[n]
            where = np.concatenate([ids * width + lang[rows] for _, _, rows, ids in steps])
            weight = np.concatenate([alpha[i, rows] * q * beta[e, rows] * scale[rows]
                                     for (i, e, rows, _), q in zip(steps, probs, strict=True)])
            total += np.bincount(where, weight, minlength=p.size)
        long = [k for k, w in enumerate(words) if len(w) > LONGEST]
        logs = np.log(p) if long else p
        for k in long:
            steps = list(self.steps(words[k]))
            own = logs[:, langs[k]]
            alpha = np.full(len(words[k]) + 2, -np.inf)
            beta = alpha.copy()
            alpha[0] = beta[-1] = 0
            for i, e, piece in steps:
                alpha[e] = np.logaddexp(alpha[e], alpha[i] + own[piece])
            for i, e, piece in reversed(steps):
                beta[i] = np.logaddexp(beta[i], own[piece] + beta[e])
            i, e, ids = np.array(steps).T
            weight = counts[k] * np.exp(alpha[i] + own[ids] + beta[e] - alpha[-1])
            np.add.at(total, ids * width + langs[k], weight)
        return total.reshape(p.shape)


def _blocks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for hi, t in enumerate(texts):
        size += len(t or "")
        if size > PART_CHARS:
            yield lo, hi + 1
            lo, size = hi + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def word_counts(docs: DataFrame, lang: str, text: str) -> DataFrame:
    """(lang, word, n) over whole texts, counted in each batch before the shuffle."""
    def make():
        def fn(batch):
            found: dict[str, Counter] = defaultdict(Counter)
            texts, of = batch.column(1).to_pylist(), batch.column(0).to_pylist()
            for lo, hi in _blocks(texts):
                for i in range(lo, hi):
                    found[of[i]].update(words_of(texts[i] or ""))
                if sum(map(len, found.values())) > CACHED_WORDS:
                    yield from out(found)
            yield from out(found)

        def out(found):
            for k, c in found.items():
                yield {"lang": [k] * len(c), "word": list(c), "n": list(c.values())}
            found.clear()
        return fn

    return (map_rows(docs.where(F.col(lang).isNotNull()).select(lang, text), "lang string, word string, n bigint", make)
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def _maximised(counts: np.ndarray) -> np.ndarray:
    return (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=0)


def learn(counts: DataFrame, languages: list[str], pieces: list[str], rounds: int = ROUNDS) -> np.ndarray:
    """Piece probabilities, pieces x languages, from (lang, word, n)."""
    spark = counts.sparkSession
    p = np.full((len(pieces) + 1, len(languages)), 1 / (len(pieces) + 1))
    number = {k: i for i, k in enumerate(languages)}
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast((pieces, p))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own_pieces, probs = sent.value
            lattice = Lattice(own_pieces)
            total = np.zeros(probs.shape)
            for b in batches:
                langs = np.array([number[k] for k in b.column(0).to_pylist()])
                total += lattice.expected(b.column(1).to_pylist(), langs, b.column(2).to_numpy().astype(float), probs)
            piece, lang = np.nonzero(total)
            if len(piece):
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.int32()), pa.array(piece, pa.int32()),
                                                  pa.array(total[piece, lang])], names=["lang", "piece", "n"])

        summed = (counts.mapInArrow(run, "lang int, piece int, n double").groupBy("lang", "piece")
                  .agg(F.sum("n").alias("n")).toPandas())  # at most pieces x languages rows
        found = np.zeros(p.shape)
        found[summed["piece"], summed["lang"]] = np.round(summed["n"], 6)
        p = _maximised(found)
    return p


def identify(docs: DataFrame, training: DataFrame, lang: str = "lang", text: str = "text",
             pieces_path: str = PIECES, rounds: int = ROUNDS) -> DataFrame:
    """``docs`` with lang_pred and lang_score (its posterior, 0 to 1).

    Learns from ``text`` and ``lang`` of ``training`` alone.  A text that is null
    or has no letter is ``und`` with score 0, as is every text if ``training``
    holds no language; equal scores go to the first language in code point
    order; repeated rows are scored one by one; columns with the names of the
    new ones are replaced.
    """
    pieces = load_pieces(pieces_path)
    counts = written(word_counts(training, lang, text), "word_counts")
    words_in = {r[0]: r[1] for r in counts.groupBy("lang").agg(F.sum("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(words_in) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages = sorted(words_in)
    p = learn(counts, languages, pieces, rounds) if languages else np.ones((len(pieces) + 1, 1))
    sent = docs.sparkSession.sparkContext.broadcast((pieces, p))

    def make():
        own_pieces, probs = sent.value
        lattice = Lattice(own_pieces)
        cache: dict[str, int] = {}
        rows = np.empty((0, probs.shape[1]))

        def score(texts: list[str | None]) -> tuple[list, list]:
            nonlocal rows
            found = [words_of(t or "") for t in texts]
            new = list({w for ws in found for w in ws} - cache.keys())
            if len(cache) + len(new) > CACHED_WORDS:
                cache.clear()
                rows = rows[:0]
                new = list({w for ws in found for w in ws})
            cache.update(zip(new, range(len(rows), len(rows) + len(new)), strict=True))
            rows = np.concatenate([rows, lattice.log_probs(new, probs)])
            preds, scores = [], []
            for ws in found:
                if not languages or not any(c.isalpha() for w in ws for c in w):
                    preds.append("und")
                    scores.append(0.0)
                    continue
                own = rows[np.fromiter(map(cache.__getitem__, ws), np.int64, len(ws))].sum(axis=0)
                best = int(own.argmax())
                preds.append(languages[best])
                scores.append(float(1 / np.exp(own - own[best]).sum()))
            return preds, scores

        def fn(column):
            texts = column.to_pylist()
            preds, scores = [], []
            for lo, hi in _blocks(texts):
                a, b = score(texts[lo:hi])
                preds += a
                scores += b
            return [preds, scores]
        return fn

    return append_columns(docs, [text], "lang_pred string, lang_score double", make)
