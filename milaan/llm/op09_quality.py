"""Quality as a hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Features are words and runs of signs, and pairs of neighbours, hashed to ``DIM`` places; a pair of equal neighbours is one
feature whatever the word.  A document's value of a feature is its share of the document's tokens times ``SCALE``, so length
does not weigh.  The fit uses at most about ``TRAIN_ROWS`` labelled documents (a documented bound), drawn by a hash of id and text
from all labelled rows outside the held-out third.  They are dealt to ``SHARDS`` tasks, each of which makes per-coordinate
updates with its own rates, and the weights are averaged.  All documents are scored: a broadcast vector of fixed size, one
sparse dot product each.

Defined results: null and empty texts have no features and get the score of the bias; null labels are not learned from;
conflicting labels of one id are examples each; documents repeated word for word under one id count once in the fit; a null
doc_id is not held out and has no label; without labels every score is 0.5.  Result columns replace input columns of the
same name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from milaan.llm.common import SMALL_ROWS, prepare, table, text_slices
from milaan.llm.textvec import BASE, Words, mixed, words_and_signs

DIM = 1 << 18
SCALE = 30.0
TRAIN_ROWS = 16_000
SHARDS = 4
EPOCHS = 6
# Follow-the-regularised-leader: learning rate, its offset, and the penalties on size.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.002, 0.01
BIAS = DIM  # the place after the last feature


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The feature places of every token and neighbour pair, and the row of each; rows in order."""
    h, n = w.hash, len(w.hash)
    pair = np.zeros(n, np.uint64)
    joined = np.zeros(n, bool)
    if n > 1:
        joined[1:] = w.doc[1:] == w.doc[:-1]
        pair[1:] = np.where(h[1:] == h[:-1], np.uint64(7), mixed(h[:-1] * BASE + h[1:]))
    place = np.empty((n, 2), np.int64)
    place[:, 0] = (h & np.uint64(DIM - 1)).astype(np.int64)
    place[:, 1] = (pair >> np.uint64(32) & np.uint64(DIM - 1)).astype(np.int64)
    place[pair == np.uint64(7), 1] = 1
    use = np.stack([np.ones(n, bool), joined], axis=1).ravel()
    return place.ravel()[use], np.repeat(w.doc, 2)[use]


def _learn(rows: pd.DataFrame) -> pd.DataFrame:
    """Weights of one shard, example by example in an order of the hash."""
    rows = rows.sort_values(["deal", "doc_id", "quality"], kind="stable")
    z, n = np.zeros(DIM + 1), np.zeros(DIM + 1)
    examples = []
    for text, y in zip(rows["text"], rows["quality"], strict=True):
        raw = np.frombuffer((text or "").encode(), np.uint8)
        place, _ = features(words_and_signs(raw, np.array([0, len(raw)])))
        at, count = np.unique(place, return_counts=True)
        examples.append((np.append(at, BIAS).astype(np.int32), np.append(count * (SCALE / max(1, len(place))), 1.0).astype(np.float32), float(y)))
    for _ in range(EPOCHS):
        for at, x, y in examples:
            w = _weights(z[at], n[at])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    w = _weights(z, n)
    at = np.union1d(np.flatnonzero(w), [BIAS])  # the bias always, so that shards with rows can be counted
    return pd.DataFrame({"place": at, "w": w[at]})


def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """The weight of every feature and, last, of the bias."""
    known = labels.filter("quality IN (0, 1)").select(F.col("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(~held_out(F.col("doc_id"))).distinct()
    total = known.count()
    share = lambda n: F.lit(min(1.0, train_rows / max(1, n)) * (1 << 30))
    drawn = known.filter(F.pmod(F.xxhash64(F.lit("quality"), "doc_id"), F.lit(1 << 30)) < share(total))
    # Labelled rows are drawn before the join, so what is sent to the executors is bounded by the draw.
    side = F.broadcast(drawn) if total <= SMALL_ROWS or train_rows <= SMALL_ROWS else drawn
    joined = docs.select("doc_id", "text").join(side, "doc_id").withColumn("deal", F.xxhash64("doc_id", "text"))
    once = joined.groupBy("doc_id", "quality", "deal").agg(F.first("text").alias("text"))
    once = once.withColumn("shard", F.pmod("deal", F.lit(SHARDS)))
    learned = once.groupBy("shard").applyInPandas(_learn, "place long, w double")
    rows = learned.groupBy("place").agg(F.sum("w").alias("w"), F.count("w").alias("n")).collect()
    shards = max([r["n"] for r in rows if r["place"] == BIAS], default=1)
    weights = np.zeros(DIM + 1, np.float32)
    for r in rows:
        weights[r["place"]] = r["w"] / shards
    return weights


def _scores(weights):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for rows, raw, offsets, _ in text_slices(batches):
            place, doc = features(words_and_signs(raw, offsets))
            total = np.bincount(doc, w[place], rows.num_rows)
            many = np.maximum(1, np.bincount(doc, minlength=rows.num_rows))
            logit = np.clip(total * SCALE / many + w[BIAS], -35, 35)
            kept = {f.name: rows.column(i) for i, f in enumerate(rows.schema) if f.name != "score"}
            yield pa.RecordBatch.from_pydict(kept | {"score": pa.array(1 / (1 + np.exp(-logit)), pa.float64())})

    return score


def quality(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents with held_out, score and predicted."""
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.drop(*[c for c in docs.columns if c in ("held_out", "score", "predicted")])
    weights = spark.sparkContext.broadcast(fit(docs, labels, train_rows))
    out = docs.withColumn("score", F.lit(0.0))
    out = out.mapInArrow(_scores(weights), out.schema)
    return out.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= 0.5).cast("int")})


def op9_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality(docs, table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
