"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become lower-case letters with one break between words and at both ends; every run of three such signs around a letter
or an inner break is hashed to one of ``BUCKETS`` places.  Counts per language and place are summed over all labelled rows outside the held-out
quarter, by Spark: no language and no row is left out.  The matrix of log probabilities has languages x ``BUCKETS`` numbers
and does not grow with the rows; it is broadcast, and texts are scored as sparse counts times that matrix.

Defined results: ``und`` with score 0 for null texts, texts without a letter, and when nothing could be learned; a null lang
and a null doc_id are not learned from; a null doc_id is not held out; equal scores go to the language first in code point
order; repeated rows count as often as they are there.  Result columns replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milaan.llm.common import prepare, table, text_slices

BUCKETS = 1 << 14
SMOOTH = 0.5
ROWS_AT_ONCE = 128
UNKNOWN = "und"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


@cache
def _letters() -> np.ndarray:
    """Of every code point the number of its lower-case letter, or 0 if it is no letter."""
    lut = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            low = chr(c).lower()
            lut[c] = (ord(low) if len(low) == 1 else c) * 0x9E3779B1 & 0xFFFFFFFF | 1
    return lut


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of the n-gram around every sign, and where the n-grams of each row begin and end."""
    codes = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = len(offsets) - 1
    ahead = np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)
    edge = np.where(offsets > 0, ahead[offsets - 1] if len(ahead) else 0, 0) + np.arange(rows + 1)
    sign = np.zeros(len(codes) + rows + 1, np.uint32)
    inside = np.ones(len(sign), bool)
    inside[edge] = False
    sign[inside] = _letters()[codes]
    # Several breaks in a row are one.
    keep = sign > 0
    keep[1:] |= keep[:-1].copy()
    keep[0] = True
    at = np.cumsum(keep)[edge] - 1
    sign = sign[keep]
    value = sign[:-2] * np.uint32(0x85EBCA6B)
    value += sign[1:-1]
    value *= np.uint32(0xC2B2AE35)
    value ^= value >> np.uint32(15)
    value += sign[2:]
    value *= np.uint32(0x27D4EB2F)
    value ^= value >> np.uint32(13)
    value *= np.uint32(0x9E3779B1)
    place = (value >> np.uint32(18)).astype(np.int64)
    return place, np.stack([at[:-1], np.maximum(at[:-1], at[1:] - 1)], axis=1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per language the n-grams of each bucket and, in the bucket after the last, the documents."""
    sums: dict[str, np.ndarray] = {}
    for rows, raw, offsets, _ in text_slices(batches):
        place, spans = grams(raw, offsets)
        for lang, (a, b) in zip(rows.column(rows.schema.get_field_index("lang")).to_pylist(), spans, strict=True):
            row = sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            row[:BUCKETS] += np.bincount(place[a:b], minlength=BUCKETS)
            row[BUCKETS] += 1
        if len(sums) > 256:  # hand on what there is, to bound memory
            yield from _summed(sums)
            sums = {}
    yield from _summed(sums)


def _summed(sums: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for name, row in sums.items():
        at = np.flatnonzero(row)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(at), pa.string()), "bucket": at, "n": row[at]})


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, log probability of each bucket (rows) and language, log share of each language."""
    known = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("lang", "text")
    counted = known.mapInArrow(_count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counted.toPandas()
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((BUCKETS + 1, len(langs)))
    counts[rows["bucket"].to_numpy(np.int64), np.searchsorted(np.array(langs, object), rows["lang"])] = rows["n"]
    seen = counts[:BUCKETS] + SMOOTH
    return langs, np.log(seen / seen.sum(0)).astype(np.float32), np.log((counts[BUCKETS] + 1) / (counts[BUCKETS].sum() + len(langs)))


def _predict(model):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, chance, share = model.value
        names = np.array([*langs, UNKNOWN], object)
        for rows, raw, offsets, missing in text_slices(batches):
            n = rows.num_rows
            place, spans = grams(raw, offsets)
            best, score = np.full(n, len(langs)), np.zeros(n)
            counts = np.empty((ROWS_AT_ONCE, BUCKETS), np.float32)
            for a in range(0, n if langs else 0, ROWS_AT_ONCE):
                b = min(n, a + ROWS_AT_ONCE)
                for i in range(a, b):
                    counts[i - a] = np.bincount(place[spans[i, 0] : spans[i, 1]], minlength=BUCKETS)
                like = counts[: b - a] @ chance + share
                best[a:b] = like.argmax(1)
                score[a:b] = 1 / np.exp(like - like.max(1, keepdims=True)).sum(1)
            blank = missing | (spans[:, 0] == spans[:, 1]) | (not langs)
            best[blank], score[blank] = len(langs), 0.0
            kept = {f.name: rows.column(i) for i, f in enumerate(rows.schema) if f.name not in ("lang_pred", "score")}
            yield pa.RecordBatch.from_pydict(kept | {"lang_pred": pa.array(names[best], pa.string()), "score": score})

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """The documents with held_out, lang_pred and score."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop(*[c for c in docs.columns if c in ("held_out", "lang_pred", "score")])
    model = spark.sparkContext.broadcast(fit(docs))
    out = docs.drop("lang").withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)})
    out = out.mapInArrow(_predict(model), out.schema)
    return out.withColumn("held_out", held_out(F.col("doc_id")))


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return identify(docs).select("doc_id", "held_out", "lang_pred", "score")
