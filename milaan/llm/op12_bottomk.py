"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions only.

The sketch of a text is the sorted array of the ``K`` least 64-bit hashes of its distinct shingles (five words, lower case; a
shorter text that has words is one shingle).  A text is taken in blocks of ``BLOCK`` shingles whose sketches are merged, so that beside
the words only a block of hashes is held, however long the text is.  Sketches of parts merge into the sketch of the whole
(``merged``), and estimate the resemblance and containment of two shingle sets and the number of distinct shingles.

``neighbours`` finds the next document in descending order without a window over all rows: slim keys are sorted over all tasks,
each task's range is linked by a window of its own, and the ranges by a table of one row per range.  Texts are shuffled once, by key;
then each document sends the head that is wanted, and its sketch, to the one before it.

Defined results: a null text is empty; a text without words has an empty sketch and the empty fingerprint; two empty sketches have
resemblance 1, an empty and another one 0.  A null doc_id comes after all others; equal ids are in order of a hash of the text; rows that
repeat id and text are one document in that order, and come back as often as they occur.  The only document is its own next one.
An empty table has no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from milaan.llm.common import table
from milaan.sources.writers import materialized

K = 128
SHINGLE = 5
BLOCK = 4096
SALTS = 32
# What parts words: all of ASCII but digits and letters (letters are in lower case by then).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def with_sketch(rows: DataFrame, text: str, name: str, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """Add the sketch of a text column; columns named ``__words`` and ``__shingles`` must not be there."""
    count = F.greatest(F.size("__words") - (shingle - 1), F.least(F.size("__words"), F.lit(1)))

    def merge(held: Column, block: Column) -> Column:
        places = F.sequence(block * BLOCK + 1, F.least((block + 1) * BLOCK, F.col("__shingles")))
        # Beyond the last word there is null, which the hash passes over.
        return bottom(F.concat(held, F.transform(places, lambda i: F.xxhash64(*[F.get("__words", i + (j - 1)) for j in range(shingle)]))), k)

    none = F.array().cast("array<bigint>")
    blocks = F.sequence(F.lit(0), F.floor((F.col("__shingles") - 1) / BLOCK).cast("int"))
    sketch = F.when(F.col("__shingles") == 0, none).otherwise(F.aggregate(blocks, none, merge))
    return rows.withColumn("__words", words(F.col(text))).withColumn("__shingles", count).withColumn(name, sketch).drop("__words", "__shingles")


def fingerprint(sketch: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits for each hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """The share of the least k hashes of the union that both sketches hold; exact when both hold all their hashes."""
    least = bottom(F.array_union(a, b), k)
    both = F.size(F.array_intersect(F.array_intersect(a, b), least))
    return F.when(F.size(least) == 0, F.lit(1.0)).otherwise(F.try_divide(both.cast("double"), F.size(least)))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """The estimated number of distinct shingles: (k - 1) over the k-th least hash on the scale from 0 to 1; exact below k."""
    place = (F.element_at(sketch, -1).cast("double") + 2.0**63) / 2.0**64
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated share of a's shingles that b has too; null for an empty a."""
    union = bottom(F.array_union(a, b), k)
    return F.least(F.lit(1.0), F.try_divide(resemblance(a, b, k) * distinct_shingles(union, k), distinct_shingles(a, k)))


def merged(sketches: DataFrame, by: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """One sketch per group: of the whole whose parts have these sketches.  A hot group's hashes are ranked by salt first."""
    hashes = sketches.select(*by, F.explode(sketch).alias("__hash")).distinct()
    salted = hashes.withColumn("__salt", F.pmod(F.xxhash64("__hash"), F.lit(SALTS)))
    top = lambda rows, *keys: rows.withColumn("__at", F.row_number().over(Window.partitionBy(*keys).orderBy("__hash"))).filter(F.col("__at") <= k)
    least = top(top(salted, *by, "__salt").drop("__at"), *by)
    held = least.groupBy(*by).agg(F.sort_array(F.collect_list("__hash")).alias("__held"))
    same = held.withColumnsRenamed({c: f"__by_{c}" for c in by})
    groups = sketches.select(*by).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
    return groups.join(same, on, "left").select(*by, F.coalesce("__held", F.array().cast("array<bigint>")).alias(sketch))


KEY = ("__id", "__tie")


def _keyed(docs: DataFrame) -> DataFrame:
    """Keys without nulls: the id, and a hash that tells texts apart and null ids from 0."""
    text = F.coalesce(F.col("text"), F.lit(""))
    at = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(at, F.lit(0)).cast("long").alias("__id"), F.xxhash64(text, at.isNull()).alias("__tie"), at.isNull().alias("__none"), text.alias("text"))


def neighbours(docs: DataFrame) -> DataFrame:
    """For each distinct document (by key): key, doc_id, number of copies and half length of the one before it in descending order."""
    keys = _keyed(docs).groupBy(*KEY).agg(
        F.max("__none").alias("__none"), F.count("text").alias("__copies"), F.floor(F.max(F.length("text")) / 2).cast("int").alias("__half"))
    order = ("__none", "__down", "__tie")
    parted = keys.withColumn("__down", F.bitwise_not("__id")).orderBy(*order).withColumn("__part", F.spark_partition_id())
    ranged = materialized(parted, "ranges")
    one = F.struct(*order, "__id", "__copies", "__half")
    ends = ranged.groupBy("__part").agg(F.max(one).alias("__last"))
    # One row per range, and there are no more ranges than shuffle partitions.
    ends = ends.select("__part", F.coalesce(
        F.lag("__last").over(Window.partitionBy().orderBy("__part")),
        F.max_by("__last", "__part").over(Window.partitionBy()),
    ).alias("__end"))
    linked = ranged.withColumn("__before", F.lag(one).over(Window.partitionBy("__part").orderBy(*order)))
    linked = linked.join(F.broadcast(ends), "__part").withColumn("__before", F.coalesce("__before", "__end"))
    return linked.select(*KEY, *[F.col("__before")[c].alias(f"__before{c}") for c in (*KEY, "__none", "__copies", "__half")])


def fingerprints(docs: DataFrame, k: int = K, shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, text, edited text, their sketches, and the sketch of the next document."""
    links = materialized(neighbours(docs), "neighbours")
    # Used twice with the same columns, so that the texts are shuffled once.
    texts = _keyed(docs).groupBy(*KEY).agg(F.first("text").alias("text"))
    giving = with_sketch(texts.join(links, list(KEY)), "text", "next_sketch", k, shingle)
    given = giving.select(
        *[F.col(f"__before{c}").alias(c) for c in (*KEY, "__none", "__copies")],
        F.when(F.col("__before__half") > 0, F.substring(F.col("text"), F.lit(1), F.col("__before__half"))).otherwise("").alias("__head"), "next_sketch")
    met = texts.join(given, list(KEY)).withColumn("n_chars", F.length("text").cast("long"))
    kept = (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int")
    met = met.withColumn("edited_text", F.concat(F.substring(F.col("text"), F.lit(1), kept), F.col("__head")))
    both = with_sketch(with_sketch(met, "text", "sketch", k, shingle), "edited_text", "edited_sketch", k, shingle)
    return both.select(
        F.when(~F.col("__none"), F.col("__id")).alias("doc_id"), "n_chars", "text", "edited_text", "sketch", "edited_sketch", "next_sketch", F.col("__copies").alias("copies"))


def op12_bottomk(spark, sf_dir: str) -> DataFrame:
    rows = fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))
    slim = rows.select(
        "doc_id", "n_chars", F.sha2("edited_text", 256).alias("edited_sha256"), fingerprint(F.col("sketch")).alias("fingerprint"),
        fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"), resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"), distinct_shingles(F.col("sketch")).alias("distinct_shingles"), "copies")
    return slim.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copies")
