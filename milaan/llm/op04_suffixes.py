"""Exact removal of repeated byte strings by a distributed difference-cover algorithm.

A difference cover D modulo v has, for any two places i and j, a shift d < v for which i + d and j + d are both in D.  So of two
equal strings of ``window`` bytes, some sampled place of each lies at the same shift, with at least ``window - v + 1`` equal bytes
after it.  The steps are those of the difference-cover suffix sort, kept to the depth that matters:

1. sample: the tuples of ``window - v + 1`` bytes at the places of the cover are sorted and named (fingerprints, dealt by range);
2. recurse only where names are not unique: a suffix all of whose sampled neighbours have unique names has no equal;
3. merge: every suffix near an ambiguous name, sampled or not, is sorted by its first ``window`` bytes, again by range;
4. compare adjacent prefixes: of equal ones the first, in order of document and place, stays and the others are removed.

Order among unlike strings is not needed, so names are 64-bit fingerprints and not lexicographic ranks; sorting all suffixes would
shuffle some 16 bytes a byte of text.  Whole texts that occur again are removed beforehand by their digest; they are repeats from
their first byte.  The distinct texts are written once, bucketed, and every pass reads a bucket in one task without a shuffle;
what is exchanged are sorted keys, each once a bucket, and one bit for each in return.  A string that fills a third of the corpus is
thus one key per bucket.

Defined results: a null text is empty; texts shorter than the window stay whole; rows that repeat id and text are one document
and share its result; documents of one id and different texts are ordered by their digests; a null id sorts first; an empty
table gives no rows.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milaan.llm.common import prepare, slices, table, text_bytes
from milaan.llm.textvec import mixed, powers
from milaan.sources.writers import materialized, scratch_path

WINDOW = 100
MODULUS = 31
# Perfect difference sets, by modulus.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27), 57: (0, 1, 3, 13, 32, 36, 43, 52)}
# Text bytes in one bucket, and key bytes in one range.
BUCKET_BYTES = 8 << 20
RANGE_BYTES = 8 << 20
NO_ID = -(1 << 63)
CODE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


class Hashes:
    """Fingerprints of strings anywhere in a slice of texts."""

    def __init__(self, raw: np.ndarray):
        self.up, self.down = powers(len(raw) + 1)
        self.total = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(CODE[raw] * self.up[: len(raw)], out=self.total[1:])

    def of(self, at: np.ndarray, size: int) -> np.ndarray:
        return mixed((self.total[at + size] - self.total[at]) * self.down[at])


class Bucket:
    """The texts of one bucket in order of document, in slices that hashing goes through."""

    def __init__(self, rows: pa.Table):
        ids = rows.column("doc_id").fill_null(NO_ID).to_numpy()
        order = np.lexsort((np.array(rows.column("print").to_pylist(), object).astype(str), ids)) if len(ids) else np.zeros(0, np.int64)
        self.rows = rows.take(pa.array(order))
        self.ids = ids[order]
        self.raw, self.offsets, _ = text_bytes(self.rows.column("text"))

    def slices(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for a, b in slices(self.offsets):
            at = self.offsets[a : b + 1]
            yield a, self.raw[at[0] : at[-1]], at - at[0]


def _sampled(raw: np.ndarray, offsets: np.ndarray, window: int, modulus: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of the cover whose tuple ends inside their text, and the fingerprints of the tuples."""
    size = window - modulus + 1
    at = (np.arange(0, len(raw), modulus)[:, None] + np.array(sorted(COVERS[modulus]))[None, :]).ravel()
    at = at[at < len(raw)]
    end = np.repeat(offsets[1:], np.diff(offsets))
    at = at[at + size <= end[at]]
    return at, Hashes(raw).of(at, size)


def _suffixes(raw: np.ndarray, offsets: np.ndarray, doubtful: np.ndarray, window: int, modulus: int) -> np.ndarray:
    """Where strings of ``window`` bytes start that hold a doubtful tuple at a shift below the modulus."""
    n = len(raw)
    start = np.repeat(offsets[:-1], np.diff(offsets))
    first = np.maximum(doubtful - modulus + 1, start[doubtful]) if len(doubtful) else doubtful
    mark = np.bincount(first, minlength=n + 1) - np.bincount(doubtful + 1, minlength=n + 2)[: n + 1]
    at = np.flatnonzero(np.cumsum(mark[:n]) > 0)
    end = np.repeat(offsets[1:], np.diff(offsets))
    return at[at + window <= end[at]]


def _blobs(bucket: int, keys: np.ndarray, ids: np.ndarray | None, bits: int) -> pa.Table:
    """Sorted distinct keys by range of their top bits, as byte planes; with the id of the document that has each first."""
    part = (keys >> np.uint64(64 - bits)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1], [True]))) if len(keys) else np.zeros(1, np.int64)
    out: dict[str, list] = {"range": [], "keys": [], "places": [], "ids": []}
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        out["range"].append(int(part[a]))
        out["keys"].append(np.ascontiguousarray(keys[a:b].view(np.uint8).reshape(-1, 8)[:, :7].T).tobytes())
        if ids is not None:
            own, place = np.unique(ids[a:b], return_inverse=True)
            out["places"].append(place.astype(np.uint16 if len(own) < 1 << 16 else np.uint32).tobytes())
            out["ids"].append(own.astype(np.int64).tobytes())
        else:
            out["places"].append(b"")
            out["ids"].append(b"")
    return pa.table({
        "range": pa.array(out["range"], pa.int64()), "bucket": pa.array([bucket] * len(out["range"]), pa.int64()),
        "keys": pa.array(out["keys"], pa.binary()), "places": pa.array(out["places"], pa.binary()), "ids": pa.array(out["ids"], pa.binary()),
    })


BLOBS = "range long, bucket long, keys binary, places binary, ids binary"
REPLIES = "bucket long, stage int, range long, n long, bits binary"


def _named(bucket: Bucket, window: int, modulus: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Places by slice; the distinct names in order; which name each place has; which names the bucket has twice."""
    places, names = [], [np.zeros(0, np.uint64)]
    for _, raw, offsets in bucket.slices():
        at, name = _sampled(raw, offsets, window, modulus)
        places.append(at)
        names.append(name)
    found, which, many = np.unique(np.concatenate(names), return_inverse=True, return_counts=True)
    return places, found, which, many > 1


def _answers(replies: pa.Table, stage: int) -> np.ndarray:
    """The bits that came back for the keys of a stage, in order of the keys."""
    own = replies.filter(pa.compute.equal(replies.column("stage"), stage)).sort_by("range")
    parts = [np.unpackbits(np.frombuffer(b, np.uint8))[:n] for b, n in zip(own.column("bits").to_pylist(), own.column("n").to_pylist(), strict=True)]
    return np.concatenate([np.zeros(0, np.uint8), *parts]).astype(bool)


def _merged(bucket: Bucket, replies: pa.Table, window: int, modulus: int) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """(first row, places) by slice; the distinct suffix keys; the first place of each key; which key each place has."""
    places, _, which, twice = _named(bucket, window, modulus)
    doubt = (twice | _answers(replies, 1))[which] if len(which) else np.zeros(0, bool)
    upto, starts, keys = 0, [], [np.zeros(0, np.uint64)]
    for (row, raw, offsets), at in zip(bucket.slices(), places, strict=True):
        here = _suffixes(raw, offsets, at[doubt[upto : upto + len(at)]], window, modulus)
        upto += len(at)
        starts.append((row, offsets, here))
        keys.append(Hashes(raw).of(here, window))
    found, first, which = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    return starts, found, first, which


def _rows_of(bucket: Bucket, starts: list[tuple]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *(row + np.searchsorted(offsets, at, "right") - 1 for row, offsets, at in starts)])


def _passes(window: int, modulus: int, bits: int):
    import pyarrow.compute  # noqa: F401 - workers use pa.compute

    def names(rows: pa.Table) -> pa.Table:
        return _blobs(rows.column("bucket")[0].as_py(), _named(Bucket(rows), window, modulus)[1], None, bits)

    def suffixes(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _blobs(0, np.zeros(0, np.uint64), None, bits)
        bucket = Bucket(rows)
        starts, found, first, _ = _merged(bucket, replies, window, modulus)
        return _blobs(rows.column("bucket")[0].as_py(), found, bucket.ids[_rows_of(bucket, starts)[first]], bits)

    def removed(rows: pa.Table, replies: pa.Table) -> pa.Table:
        out: dict[str, list] = {"print": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        if rows.num_rows:
            bucket = Bucket(rows)
            starts, found, first, which = _merged(bucket, replies, window, modulus)
            again = np.ones(len(which), bool)
            again[first] = _answers(replies, 2)
            upto = 0
            for (row, raw, offsets), (_, _, at) in zip(bucket.slices(), starts, strict=True):
                hit = at[again[upto : upto + len(at)]]
                upto += len(at)
                mark = np.bincount(hit, minlength=len(raw) + 1) - np.bincount(hit + window, minlength=len(raw) + 1)
                gone = np.cumsum(mark[: len(raw)]) > 0
                for i in range(len(offsets) - 1):
                    own = gone[offsets[i] : offsets[i + 1]]
                    out["n_removed"].append(int(np.count_nonzero(own)))
                    out["n_spans"].append(int(own[0]) + int(np.count_nonzero(own[1:] & ~own[:-1])))
                    out["kept_sha256"].append(hashlib.sha256(raw[offsets[i] : offsets[i + 1]][~own].tobytes()).hexdigest())
            out["print"] = bucket.rows.column("print").to_pylist()
        return pa.table({"print": pa.array(out["print"], pa.string()), "n_removed": pa.array(out["n_removed"], pa.int64()), "n_spans": pa.array(out["n_spans"], pa.int64()), "kept_sha256": pa.array(out["kept_sha256"], pa.string())})

    return names, suffixes, removed


def _adjacent(stage: int, bits: int):
    """Sort the keys of one range and compare neighbours: which of a bucket's keys another bucket has (earlier, for suffixes)."""

    def adjacent(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("bucket")
        high = np.uint64((rows.column("range")[0].as_py() >> (bits - 8)) << 56)
        keys, ids, sizes = [], [], []
        for blob, places, own in zip(*(rows.column(c).to_pylist() for c in ("keys", "places", "ids")), strict=True):
            n = len(blob) // 7
            low = np.zeros((n, 8), np.uint8)
            low[:, :7] = np.frombuffer(blob, np.uint8).reshape(7, n).T
            keys.append(low.view(np.uint64)[:, 0] | high)
            sizes.append(n)
            if stage == 2:
                place = np.frombuffer(places, np.uint16 if len(own) // 8 < 1 << 16 else np.uint32)
                ids.append(np.frombuffer(own, np.int64)[place])
        key = np.concatenate(keys)
        order = np.lexsort((np.concatenate(ids), key)) if stage == 2 else np.argsort(key, kind="stable")
        key = key[order]
        same = key[1:] == key[:-1]
        hit = np.zeros(len(key), bool)
        hit[1:] = same  # of equal suffixes all but the earliest
        if stage == 1:  # of equal names all
            hit[:-1] |= same
        back = np.empty(len(key), bool)
        back[order] = hit
        parts = np.split(back, np.cumsum(sizes)[:-1])
        return pa.table({
            "bucket": rows.column("bucket"), "stage": pa.array([stage] * len(parts), pa.int32()), "range": rows.column("range"),
            "n": pa.array(sizes, pa.int64()), "bits": pa.array([np.packbits(p).tobytes() for p in parts], pa.binary()),
        })

    return adjacent


def _distinct(docs: DataFrame, window: int) -> DataFrame:
    """Each text of a window or more once, with the least id that has it."""
    long = docs.filter(F.octet_length("text") >= window)
    return long.groupBy(F.md5("text").alias("print")).agg(F.min(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).alias("doc_id"), F.first("text").alias("text"))


def repeats(docs: DataFrame, window: int = WINDOW, modulus: int = MODULUS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    spark = docs.sparkSession
    prepare(spark)
    # Shuffle files of a finished step go at once; what later steps need has been written.
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, "false")
    spark.conf.set(cleanup, "true")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    tasks = max(1, -(-buckets // 3))
    bits = max(8, int(total // RANGE_BYTES).bit_length())
    name = scratch_path(spark, "texts").rsplit("/", 1)[1].replace("-", "_")
    texts = _distinct(docs, window).withColumn("bucket", F.pmod(F.xxhash64("print"), F.lit(buckets)))
    texts.repartition(tasks, "bucket").write.bucketBy(tasks, "bucket").option("path", scratch_path(spark, "texts")).saveAsTable(name)
    kept = spark.table(name)
    names, suffixes, removed = _passes(window, modulus, bits)
    first = kept.groupBy("bucket").applyInArrow(names, BLOBS).groupBy("range").applyInArrow(_adjacent(1, bits), REPLIES)
    replies = materialized(first, "replies")
    met = lambda step, schema: kept.groupBy("bucket").cogroup(replies.groupBy("bucket")).applyInArrow(step, schema)
    second = materialized(met(suffixes, BLOBS).groupBy("range").applyInArrow(_adjacent(2, bits), REPLIES), "replies")
    replies = replies.unionByName(second)
    found = materialized(met(removed, "print string, n_removed long, n_spans long, kept_sha256 string").join(kept.select("print", F.col("doc_id").alias("first_id")), "print"), "removed")
    spark.sql(f"DROP TABLE {name}")
    spark.conf.set(cleanup, before)
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long")
    slim = docs.select(F.col("doc_id"), size.alias("n_bytes"), F.md5("text").alias("print"), F.when(size < window, F.sha2(text.cast("binary"), 256)).alias("own"))
    met_ = slim.join(found, "print", "left")
    is_first = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)) == F.col("first_id")
    pick = lambda own, copy, short: F.when(F.col("first_id").isNull(), short).when(is_first, F.col(own)).otherwise(copy)
    return met_.select(
        "doc_id", "n_bytes", pick("n_removed", F.col("n_bytes"), F.lit(0).cast("long")).alias("n_removed"),
        pick("n_spans", F.lit(1).cast("long"), F.lit(0).cast("long")).alias("n_spans"),
        pick("kept_sha256", F.sha2(F.lit("").cast("binary"), 256), F.col("own")).alias("kept_sha256"),
    )


def op4_suffixes(spark, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
