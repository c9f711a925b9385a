"""Quality classifier from weak labels.

Heuristic labellers vote on every document or abstain, on two questions: is it
junk (each kind of junk has a labeller that votes bad, and one votes good on
ordinary texts), and is it abusive.  A person's label, where there is one, is
one labeller more.  For each question, expectation-maximisation over the counts
of all vote patterns estimates how often each labeller says what of good and of
bad documents, and so the posterior of each pattern; a document is good if it
is neither junk nor abusive.  The posterior labels of a bounded sample of
documents train a hashed linear scorer, which sees words and heuristic votes
but no person's label, and judges everything.
"""

from __future__ import annotations

import copy
import math

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexikon.llm.common import (Words, append_columns, as_bytes, aside, by_size, map_rows, mix, text_sums, windows,
                                 written)
from lexikon.llm.decontam import NORMAL
from lexikon.llm.hosts import SYMBOLS

#: Documents that train the scorer.
TRAIN_DOCS = 20_000
FEATURES = 1 << 18
ROUNDS = 50
CUT = 0.5
BAD, GOOD, NONE = 0, 1, -1
HEURISTICS = ("repeats", "stutter", "symbols", "shouting", "variety", "ordinary", "abuse", "more_abuse")
LABELLERS = (*HEURISTICS, "person_quality", "person_toxic")
#: How often a person's label is wrong.
PERSON_ERRS = 0.001
#: The labellers of each question, by number; the last is a person.
JUNK, ABUSE = (0, 1, 2, 3, 4, 5, 8), (6, 7, 9)
#: Words count by themselves and by their first so many bytes, marked.
STEM = 6
_MARK = np.uint64(0x5851F42D4C957F2D)
#: An abusive word comes from abusive documents so often; of the words taken so many may be so by chance.
LEAST_SHARE, CHANCE = 0.8, 0.05
#: The word list is a part of the model: those of the clearest evidence.
MOST_WORDS = 100_000
#: Bits of the largest broadcast filter (16 MB): with more ids or words than it tells
#: apart more rows pass it, and the joins behind it settle the rest.
FILTER_BITS = 1 << 27
#: Bytes of text whose words are held at once.
PART_BYTES = 1 << 20

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(SYMBOLS)] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True


def entries(words: list[bytes]) -> set[bytes]:
    """The words, and the stems of the longer ones with a mark behind."""
    own = set(words)
    return own | {w[:STEM] + b"*" for w in own if len(w) > STEM}


class Entries:
    """Words of texts and stems of the longer ones, as hashes: ``doc`` (position of the text),
    ``hash``, ``at`` (number of the word) and, on demand, the neighbours' hash."""

    def __init__(self, raw: list[bytes | None]):
        self.words = words = Words([(t or b"").translate(NORMAL) for t in raw])
        self.own = words.hashes()
        long = np.flatnonzero(words.end - words.start > STEM)
        stems = copy.copy(words)
        stems.start, stems.end = words.start[long], words.start[long] + STEM
        doc = words.doc_of_word()
        self.doc = np.concatenate([doc, doc[long]])
        self.hash = np.concatenate([self.own, mix(stems.hashes() + _MARK)])
        self.at = np.concatenate([np.arange(len(doc)), long])

    def first(self) -> np.ndarray:
        """Positions of the first entry of each (text, hash)."""
        order = np.lexsort((self.at, self.hash, self.doc))
        d, h = self.doc[order], self.hash[order]
        return order[np.concatenate([[True], (d[1:] != d[:-1]) | (h[1:] != h[:-1])])] if len(d) else order

    def contexts(self) -> np.ndarray:
        """One hash of the two neighbours of each word, none beyond the ends of a text."""
        none = np.zeros(1, np.uint64)
        before, after = np.concatenate([none, self.own[:-1]]), np.concatenate([self.own[1:], none])
        some = np.diff(self.words.first) > 0
        before[self.words.first[:-1][some]] = 0
        after[self.words.first[1:][some] - 1] = 0
        return mix(before * _MARK + after)

    def bytes_of(self, i: int) -> bytes:
        k = self.at[i]
        word = self.words.data[self.words.start[k]:self.words.end[k]].tobytes()
        return word if i < len(self.own) else word[:STEM] + b"*"


def _held(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which ``values`` are in the sorted array ``among``."""
    if not len(among):
        return np.zeros(len(values), bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def heuristic_votes(raw: list[bytes | None], abusive: np.ndarray) -> np.ndarray:
    """Votes of the HEURISTICS: texts x labellers; short texts get few.  ``abusive``: sorted hashes of entries."""
    words = Words(raw, lower=True)
    plain = Words(raw)
    n = np.diff(words.first)
    h = words.hashes()
    grams = windows(h, 3)
    repeated, distinct = np.zeros(len(n)), np.zeros(len(n))
    for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)):
        distinct[i] = len(np.unique(h[a:b]))
        if b - a > 3:
            repeated[i] = (b - a - 2) - len(np.unique(grams[a:b - 2]))
    again = np.append(False, h[1:] == h[:-1]) if len(h) else np.zeros(0, bool)
    again[words.first[:-1][n > 0]] = False
    some = np.maximum(n, 1)
    stutter = np.diff(np.concatenate([[0], np.cumsum(again)])[words.first]) / some
    symbols = text_sums(_IS_SYMBOL[plain.data], raw) / some
    letters = text_sums(_LETTER[plain.data], raw)
    upper = text_sums(_UPPER[plain.data], raw) / np.maximum(letters, 1)
    abuse = np.zeros(len(raw), int)
    if len(abusive):
        found = Entries(raw)
        hit = _held(found.hash, abusive)
        pairs = np.unique(np.stack([found.doc[hit].astype(np.uint64), found.hash[hit]]), axis=1)
        abuse = np.bincount(pairs[0].astype(int), minlength=len(raw))
    junk = [(n >= 40) & (repeated > 0.4 * n), (n >= 8) & (stutter > 0.25), (n >= 8) & (symbols > 0.2),
            (letters >= 40) & (upper > 0.4), (n >= 40) & (distinct < 0.4 * n)]
    ordinary = ((n >= 20) & (repeated < 0.15 * n) & (stutter < 0.05) & (symbols < 0.02) & (upper < 0.2)
                & (distinct > 0.5 * n))
    return np.stack([*(np.where(x, BAD, NONE) for x in junk), np.where(ordinary, GOOD, NONE),
                     np.where(abuse > 0, BAD, GOOD), np.where(abuse > 2, BAD, NONE)], axis=1).astype(np.int8)


def with_votes(docs: DataFrame, text: str, abusive: np.ndarray) -> DataFrame:
    """``docs`` with _votes, an array of the heuristic votes."""
    sent = docs.sparkSession.sparkContext.broadcast(abusive)

    def make():
        def fn(texts):
            raw = as_bytes(texts)
            parts = [heuristic_votes(raw[a:b], sent.value) for a, b in by_size(raw, PART_BYTES)]
            return [[v.tolist() for p in parts for v in p]]
        return fn
    return append_columns(docs, [text], "_votes array<int>", make)


def judged(labels: DataFrame, doc_id: str, quality: str, toxic: str) -> DataFrame:
    """(_label_id, person: votes on quality and on abuse) once for each labelled id; bad if any row says so."""
    return (labels.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_label_id"))
            .agg(F.min(quality).alias("q"), F.max(toxic).alias("t"))
            .select("_label_id", F.array(
                F.when(F.col("q").isNull(), NONE).when(F.col("q") == 0, BAD).otherwise(GOOD),
                F.when(F.col("t").isNull(), NONE).when(F.col("t") == 1, BAD).otherwise(GOOD)).alias("person")))


def bounded(ids: DataFrame, key: str, n: int) -> DataFrame:
    """The ``n`` rows of the smallest hashes of ``key``: the same ones in every run."""
    return ids.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(n)


def bit_filter(hashes: DataFrame, count: int) -> np.ndarray:
    """64-bit words of a Bloom filter of the one column of ``hashes``: two bits an entry, at most FILTER_BITS in all."""
    bits = min(FILTER_BITS, 1 << max(10, (10 * count).bit_length()))
    bit = F.explode(F.array(F.col("hash"), F.shiftrightunsigned("hash", 32))).alias("bit")
    words = (hashes.toDF("hash").select(bit).select(F.col("bit").bitwiseAND(F.lit(bits - 1)).alias("bit"))
             .groupBy(F.shiftright("bit", 6).alias("word"))
             .agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("set")).collect())  # bits / 64 rows at most
    out = np.zeros(bits // 64, np.uint64)
    if words:
        at, value = (np.array([r[k] for r in words], np.int64) for k in (0, 1))
        out[at] = value.view(np.uint64)
    return out


def _passes(filter_: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.ones(len(hashes), bool)
    for h in (hashes, hashes >> np.uint64(32)):
        bit = h & np.uint64(64 * len(filter_) - 1)
        out &= (filter_[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
    return out


def _labelled(docs: DataFrame, people: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(text, toxic) of the documents that ``people`` labelled; others mostly go before the shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(
        people.select(F.xxhash64(F.col("_label_id").cast(docs.schema[doc_id].dataType))), people.count()))

    def make():
        def fn(batch):
            kept = _passes(sent.value, batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64))
            rows = batch.filter(pa.array(kept))
            yield {"id": rows.column(0), "text": rows.column(1)}
        return fn

    id_type = docs.schema[doc_id].dataType.simpleString()
    own = map_rows(docs.where(F.col(doc_id).isNotNull()).select(doc_id, F.col(text).cast("binary"), F.xxhash64(doc_id)),
                   f"id {id_type}, text binary", make)
    return own.join(people.select(F.col("_label_id").cast(id_type).alias("id"),
                                  F.expr(f"person[1] = {BAD}").alias("toxic")), "id").select("text", "toxic")


def _uses(labelled: DataFrame, among: np.ndarray | None) -> DataFrame:
    """(word, context, toxic, n): the entries of each document, once each; only those that pass
    ``among``, if given.  Rows without a word hold the number of all entries."""
    sent = labelled.sparkSession.sparkContext.broadcast(among)

    def make():
        def fn(batch):
            raw = as_bytes(batch.column(0))
            toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for a, b in by_size(raw, PART_BYTES):
                found = Entries(raw[a:b])
                first = found.first()
                label = toxic[a:b][found.doc[first]]
                n = np.bincount(label.astype(int), minlength=2)
                word, context = found.hash[first], found.contexts()[found.at[first]] if len(first) else found.hash
                if sent.value is not None:
                    some = _passes(sent.value, word)
                    word, context, label = word[some], context[some], label[some]
                yield {"word": pa.concat_arrays([pa.array(word.view(np.int64)), pa.nulls(2, pa.int64())]),
                       "context": np.append(context.view(np.int64), [0, 1]), "toxic": np.append(label, [False, True]),
                       "n": np.append(np.ones(len(word), np.int64), n)}
        return fn
    return map_rows(labelled, "word bigint, context bigint, toxic boolean, n bigint", make)


def _word_counts(uses: DataFrame) -> DataFrame:
    """(word, n, k): distinct contexts of each word, and those of toxic documents only; of the
    rows without a word the numbers of entries."""
    own = F.when(F.col("word").isNull(), F.col("n")).otherwise(F.lit(1))
    return (uses.groupBy("word", "context").agg(F.min("toxic").alias("toxic"), F.sum("n").alias("n"))
            .groupBy("word").agg(F.sum(own).alias("n"), F.sum(F.when(F.col("toxic"), own).otherwise(0)).alias("k")))


def abusive_hashes(docs: DataFrame, people: DataFrame, doc_id: str, text: str) -> np.ndarray:
    """Sorted hashes of the words (and stems) that go with toxic labels, from all labelled documents.

    A word counts once in a document, and once for all documents where its first
    neighbours are the same, so copies of one toxic text lend no weight to the
    other words in it.  A word is taken if its share of toxic uses is LEAST_SHARE at
    least and its excess over chance is clear among all words: of those taken a share
    of CHANCE at most is expected to be there by chance (Benjamini and Hochberg,
    over the words with enough uses to be clear at all).

    Words that cannot be taken are left out of the large count: those of no toxic
    document, and those with too many clean uses among a part of the clean documents
    already to reach LEAST_SHARE with all uses in toxic ones.
    """
    none = np.zeros(0, np.uint64)
    people = people.where("person[1] >= 0")
    toxic = people.where(f"person[1] = {BAD}")
    n_toxic, n_people = toxic.count(), people.count()
    if not n_toxic or n_toxic == n_people:
        return none
    seen = written(_word_counts(_uses(_labelled(docs, toxic, doc_id, text), None).where("word IS NOT NULL"))
                   .select("word", F.col("k").alias("most")), "toxic_words")
    spare = 1 / LEAST_SHARE - 1
    part = min(1.0, 2 * spare * n_toxic / (n_people - n_toxic))  # twice what an ordinary word needs
    some = people.where(f"person[1] <> {BAD}").where(
        F.pmod(F.xxhash64(F.lit(1), "_label_id"), F.lit(1 << 16)) < int(part * (1 << 16)) + 1)
    others = (_uses(_labelled(docs, some, doc_id, text), bit_filter(seen.select("word"), seen.count()))
              .where("word IS NOT NULL").groupBy("word", "context").count().groupBy("word").agg(F.count(F.lit(1)).alias("others")))
    left = written(seen.join(others, "word", "left").where(F.coalesce("others", F.lit(0)) <= spare * F.col("most"))
                   .select("word"), "open_words")
    n_left = left.count()
    words = written(_word_counts(_uses(_labelled(docs, people, doc_id, text), bit_filter(left, n_left))), "word_uses")
    total = words.where("word IS NULL").first()
    if total is None or not total["k"] or total["k"] == total["n"]:
        return none
    rate = total["k"] / total["n"]
    k, n = F.col("k"), F.col("n")
    excess = k * F.log(k / (n * rate)) + F.when(n > k, (n - k) * F.log((n - k) / (n * (1 - rate)))).otherwise(0.0)
    # a word of n uses shows up in a toxic document by a chance of 1 - (1 - rate) ** n: those that do stand for all
    testable = words.where((k > 0) & F.col("word").isNotNull() & (n * -math.log(rate) >= -math.log(CHANCE)))
    tried = (testable.agg(F.sum(1 / (1 - F.pow(F.lit(1 - rate), n)))).first()[0] or 0.0) + seen.count() - n_left
    clear = testable.where(k >= LEAST_SHARE * n).withColumn("excess", excess)
    steps = clear.groupBy(F.least(F.floor(F.col("excess") * 8), F.lit(8 * 800)).alias("step")).agg(
        F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()  # 6,401 rows at most
    limit, found = None, 0
    for r in steps:
        found += r["words"]
        if found > MOST_WORDS:
            break
        if math.exp(-r["step"] / 8) * tried <= CHANCE * found:
            limit = r["step"] / 8
    if limit is None:
        return none
    taken = clear.where(F.floor(F.col("excess") * 8) >= limit * 8).select("word").collect()  # MOST_WORDS at most
    return np.sort(np.array([r["word"] for r in taken], np.int64).view(np.uint64))


def abusive_words(docs: DataFrame, people: DataFrame, doc_id: str, text: str) -> set[bytes]:
    """The words and stems behind ``abusive_hashes``."""
    hashes = docs.sparkSession.sparkContext.broadcast(abusive_hashes(docs, people, doc_id, text))

    def make():
        def fn(batch):
            raw = as_bytes(batch.column(0))
            for a, b in by_size(raw):
                found = Entries(raw[a:b])
                yield {"word": list({found.bytes_of(i) for i in np.flatnonzero(_held(found.hash, hashes.value))})}
        return fn
    return {bytes(r[0]) for r in map_rows(docs.select(text), "word binary", make).distinct().collect()}  # MOST_WORDS at most


def posteriors(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS, people: tuple[int, ...] = ()) -> np.ndarray:
    """P(good) of each vote pattern by EM; every labeller has a chance of each vote
    (bad, good, none) given the class.  Starts from: bad where any says so.

    Those in ``people`` (columns) are persons: they err at a rate of PERSON_ERRS, which is
    not estimated, and whom they label does not depend on the class.  Else the
    heuristics that miss a few labelled documents would outvote the labels.
    """
    p = np.where((patterns == BAD).any(axis=1), 0.1, 0.9)
    told = np.log([[1 - PERSON_ERRS, PERSON_ERRS], [PERSON_ERRS, 1 - PERSON_ERRS]])  # by class and vote
    for _ in range(rounds):
        log = np.zeros((len(patterns), 2))
        for c, weight in enumerate(((1 - p) * counts, p * counts)):
            log[:, c] = np.log(weight.sum() + 1)
            for j in range(patterns.shape[1]):
                if j in people:
                    log[:, c] += np.where(patterns[:, j] == NONE, 0.0, told[c][np.maximum(patterns[:, j], 0)])
                    continue
                votes = np.bincount(patterns[:, j] + 1, weight, minlength=3) + 0.5
                log[:, c] += np.log(votes / votes.sum())[patterns[:, j] + 1]
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
    return p


def tokens(text: str | Column) -> Column:
    """Distinct words (A-Z lower-cased, cut at everything but digits, letters and non-ASCII)
    and, after them, the heuristic votes as words of their own."""
    text = F.col(text) if isinstance(text, str) else text
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    votes = F.array(*[F.concat(F.lit(f"<{name}="), F.col("_votes")[i].cast("string"), F.lit(">"))
                      for i, name in enumerate(HEURISTICS)])
    return F.concat(F.array_distinct(words), votes)


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
                  quality: str = "quality", toxic: str = "toxic", train_docs: int = TRAIN_DOCS,
                  cut: float = CUT) -> DataFrame:
    """``docs`` with quality_score (the chance to be good) and quality_kept (``quality_score >= cut``).

    Only the fit of the scorer takes a bounded sample (``train_docs``: the documents
    of smallest id hashes); the word list comes from every labelled document, and
    votes, their patterns and scores cover every document.  A null or empty text scores
    1: there is nothing against it.  Without any label the heuristics vote
    alone; if all training documents are of one class, that is everyone's
    score.  A null id is voted on but never sampled; of rows with equal ids each
    is judged; columns with the names of the new ones are replaced, all others kept.
    """
    return aside(docs, {doc_id: "id", text: "text"},
                 lambda own: _scored(own, "id", "text", judged(labels, doc_id, quality, toxic), train_docs, cut))


def _scored(docs: DataFrame, doc_id: str, text: str, people: DataFrame, train_docs: int, cut: float) -> DataFrame:
    spark = docs.sparkSession
    people = written(people, "people")
    abusive = abusive_hashes(docs, people, doc_id, text)
    voted = with_votes(docs, text, abusive)
    votes = written(voted.select(F.col(doc_id).alias("_vote_id"), "_votes")
                    .join(people, F.col("_vote_id") == F.col("_label_id"), "left")
                    .select("_vote_id", F.concat("_votes", F.coalesce("person", F.array(F.lit(NONE), F.lit(NONE))))
                            .alias("votes")),
                    "votes")
    found = votes.groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 3 ** len(LABELLERS) rows
    patterns = np.array([r["votes"] for r in found], int).reshape(-1, len(LABELLERS))
    counts = np.array([r["n"] for r in found], float)
    p = (posteriors(patterns[:, JUNK], counts, people=(len(JUNK) - 1,))
         * posteriors(patterns[:, ABUSE], counts, people=(len(ABUSE) - 1,)))
    known = spark.createDataFrame([(r["votes"], float(x)) for r, x in zip(found, p, strict=True)],
                                  "votes array<int>, p double")
    sample = bounded(votes.where(F.col("_vote_id").isNotNull()).dropDuplicates(["_vote_id"]), "_vote_id", train_docs)
    labelled = F.broadcast(sample.join(F.broadcast(known), "votes").select("_vote_id", "p"))  # train_docs rows at most
    hashing = HashingTF(inputCol="_tokens", outputCol="_features", numFeatures=FEATURES, binary=True)
    train = with_votes(docs.select(F.col(doc_id).alias("_vote_id"), F.col(text).alias("text")).join(labelled, "_vote_id"),
                       "text", abusive).withColumn("_tokens", tokens("text"))
    rows = written(hashing.transform(train).select("_features", "p").repartition(spark.sparkContext.defaultParallelism),
                   "train")
    # a soft label is two rows, one for each class, by weight
    sides = F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")),
                              F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight"))))
    model = _fit(rows.select("_features", sides.alias("s")).select("_features", "s.label", "s.weight").where("weight > 0.001"))
    scored = voted.withColumn("_tokens", tokens(text))
    if isinstance(model, LogisticRegressionModel):
        scored = model.transform(hashing.transform(scored))
        score = vector_to_array("_probability")[1]
    else:
        score = F.lit(model)
    empty = F.coalesce(F.length(F.trim(F.col(text))), F.lit(0)) == 0
    out = scored.withColumn("quality_score", F.when(empty, 1.0).otherwise(score))
    return out.withColumn("quality_kept", F.col("quality_score") >= cut).select(
        *docs.columns, "quality_score", "quality_kept")


def _fit(rows: DataFrame) -> LogisticRegressionModel | float:
    """The scorer, or the one score of everything if there is only one class."""
    sums = {r["label"]: r["w"] for r in rows.groupBy("label").agg(F.sum("weight").alias("w")).collect()}
    if len(sums) < 2:
        return float(max(sums, default=1.0))
    fit = LogisticRegression(featuresCol="_features", labelCol="label", weightCol="weight", maxIter=30, regParam=0.002,
                             standardization=False, rawPredictionCol="_raw", probabilityCol="_probability",
                             predictionCol="_prediction")
    return fit.fit(rows)
