"""Document fingerprints: bottom-k sketches of shingle hashes.

A text's sketch holds the ``k`` smallest distinct hashes of its word shingles,
ascending.  Sketches of parts merge into the sketch of the whole, and two
sketches estimate how alike two texts are, how much of one the other contains
and how many distinct shingles each has; a sketch of fewer than ``k`` hashes is
the whole set, so such estimates are exact.  Everything here is built from
Spark's own functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexikon.llm.common import written
from lexikon.operators.index import with_row_index

K = 128
WIDTH = 5
#: Hashes are the first so many hex digits of an MD5, so they lie below 2 ** (4 * DIGITS).
DIGITS = 15
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NEW = ("next_id", "n_chars", "edited", "sketch", "edited_sketch", "near_edited", "near_next")


def shingle_words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+"), "")


def word_sketch(words: Column, k: int = K, width: int = WIDTH) -> Column:
    """The sketch of a column of words (a column, not an expression: it is read once for each shingle).

    Digests are put in order as they are, and only the ``k`` smallest become numbers.
    """
    def shingle(word: Column, i: Column) -> Column:
        parts = [word] + [x for j in range(1, width) for x in (F.lit(" "), F.get(words, i + j))]
        return F.md5(F.concat(*parts))
    digests = (F.when(F.size(words) >= width, F.slice(F.transform(words, shingle), F.lit(1), F.size(words) - (width - 1)))
               .when(F.size(words) > 0, F.array(F.md5(F.array_join(words, " "))))
               .otherwise(F.array().cast("array<string>")))
    least = F.slice(F.array_distinct(F.sort_array(digests)), 1, k)
    return F.array_distinct(F.transform(least, lambda d: F.conv(F.substring(d, 1, DIGITS), 16, 10).cast("long")))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts together."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of common shingles among all; 1 for two empty sketches."""
    both = merged(a, b, k)
    common = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(common / F.size(both))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: the k-th smallest of n even draws lies near k / n."""
    kth = (F.element_at(sketch, k) + 1) / F.lit(float(16 ** DIGITS))
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / kth)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has too; null if ``a`` has none."""
    common = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k)
    return F.least(F.lit(1.0), common / F.nullif(distinct_shingles(a, k), F.lit(0.0)))


def merge_sketches(parts: DataFrame, keys: list[str], sketch: str, k: int = K) -> DataFrame:
    """One sketch for each group of ``keys`` (null keys are a group), from those of its parts.

    Equal hashes go before the shuffle and every task sends at most ``k`` of a
    group, so a hot group costs no more than its tasks.  A group of empty or
    null sketches gets an empty one; the result is named as the input was.
    """
    names = [f"k{i}" for i in range(len(keys))]
    plain = parts.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(keys, names, strict=True)],
                         F.explode_outer(F.col(f"`{sketch}`")).alias("hash")).distinct()
    least = Window.partitionBy(*names).orderBy(F.col("hash").asc_nulls_last())
    few = plain.withColumn("rank", F.row_number().over(least)).where(F.col("rank") <= k)
    out = few.groupBy(*names).agg(F.sort_array(F.collect_list("hash")).alias("sketch"))
    return out.toDF(*keys, sketch)


def sketched(docs: DataFrame, text: str = "text", k: int = K, width: int = WIDTH, name: str = "sketch") -> DataFrame:
    """``docs`` with the sketch of each whole text, in place of a column of that name.

    A text with fewer than ``width`` words has one shingle, all its words; a null, empty or blank one has none.
    """
    keep = [c for c in docs.columns if c.lower() != name.lower()]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("rest"),
                       shingle_words(F.col(f"`{text}`")).alias("words"))
    return held.select(*[F.col("rest").getField(c).alias(c) for c in keep],
                       word_sketch(F.col("words"), k, width).alias(name))


def followed(docs: DataFrame, k: int = K, width: int = WIDTH) -> DataFrame:
    """``docs`` (id, text, h1, h2[, rest]) with next_id, head and next_sketch: id, as much of
    the beginning as half the row's own text has, and sketch of the next document.

    Documents are rows of the same id and text, told apart by two 64-bit hashes,
    which order the texts of one id.  Only ids, hashes and lengths are put in
    order; each text is dealt out once by its hashes and sends its beginning to
    the document before it.
    """
    order = written(with_row_index(docs.select("h1", "h2", "id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).distinct(),
                                   [F.col("id").asc_nulls_last(), "h1", "h2"], "at", count_name="total"), "id_order")
    before = order.select(F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("at").alias("p_at"),
                          F.expr("n div 2").alias("asked"))
    steps = order.select("h1", "h2", F.expr("(at + total - 1) % total").alias("p_at")).join(before, "p_at").drop("p_at")
    # with next_id in use, this join and the last one take the same columns, and Spark deals the texts out only once
    asked = (docs.join(steps, ["h1", "h2"])
             .select("p1", "p2", F.col("id").alias("next_id"), F.expr("coalesce(substring(text, 1, asked), '')").alias("head"),
                     shingle_words(F.col("text")).alias("words"))
             .select("p1", "p2", "next_id", "head", word_sketch(F.col("words"), k, width).alias("next_sketch")))
    # repeated rows send the same thing
    heads = asked.groupBy(F.col("p1").alias("h1"), F.col("p2").alias("h2")).agg(
        *[F.first(c).alias(c) for c in ("next_id", "head", "next_sketch")])
    return docs.join(heads, ["h1", "h2"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = K,
                 width: int = WIDTH) -> DataFrame:
    """``docs`` with n_chars, sketch, and how alike it is to two other texts.

    ``edited`` is the text whose last ``n_chars // 2`` code points gave way to the
    first as many (or all) of the next document, by ascending id; the last one
    is followed by the first (``next_id``).  near_edited and near_next are the
    estimated resemblance to the edited text and to the next document's text.
    Null texts count as empty; null ids come last; texts of one id follow each
    other in an arbitrary but fixed order, and rows of the same id and text are
    one document; a single document is its own next.  Columns with the names of
    the new ones are replaced; an empty table stays empty.
    """
    keep = [c for c in docs.columns if c.lower() not in NEW]
    rest = [c for c in keep if c not in (doc_id, text)]
    own, raw = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    held = docs.select(own.alias("id"), raw.alias("text"), F.xxhash64(own, raw).alias("h1"),
                       F.xxhash64(F.lit(1), raw, own).alias("h2"),
                       *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []))
    edited = followed(held, k, width).withColumn("edited", F.expr(
        "concat(coalesce(substring(text, 1, length(text) - length(text) div 2), ''), head)"))
    words = edited.withColumn("words", shingle_words(F.col("text"))).withColumn(
        "edited_words", shingle_words(F.col("edited")))
    out = words.withColumn("sketch", word_sketch(F.col("words"), k, width)).withColumn(
        "edited_sketch", word_sketch(F.col("edited_words"), k, width))
    new = {"next_id": F.col("next_id"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long"), "edited": F.col("edited"), "sketch": F.col("sketch"),
           "edited_sketch": F.col("edited_sketch"), "near_edited": resemblance(F.col("sketch"), F.col("edited_sketch"), k),
           "near_next": resemblance(F.col("sketch"), F.col("next_sketch"), k)}
    back = {doc_id: F.col("id"), text: F.col("text")}
    return out.select(*[back[c].alias(c) if c in back else F.col("rest").getField(c).alias(c) for c in keep],
                      *[v.alias(c) for c, v in new.items()])
