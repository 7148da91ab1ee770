"""Benchmark decontamination as a prefix-filtered set join.

A window is ``WINDOW`` consecutive words of an item (all of its words, if fewer).  The windows are the records of the join and
their five-word shingles the tokens, ordered by how rare they are in all documents.  A document can hold a window only if it
holds the window's rarest shingle, so that one is the necessary prefix.  Where a document meets a prefix, the shingle's place
in the window gives the only start the window can have there (positional bound); it must begin and end inside the document
(length bound); then the words themselves are compared.

Everything that grows with the benchmark or the corpus is a table.  Two things of fixed size go through the driver: a bitmap of
the slots (``SLOT_BITS``) that the windows' shingles fall in, for which one scan counts the documents' shingles, and a bitmap of
the prefixes (``PROBE_BITS``), by which a second scan picks the places worth joining, each with the words around it.  Unlike
shingles that share a slot only make an order less exact or a candidate more.  The prefixes are broadcast while they are few
and short (``BROADCAST_WINDOWS``, ``BROADCAST_BYTES``) and joined by a shuffle beyond.  Verdicts are kept by text (its MD5), so
equal texts are judged alike; the documents themselves are shuffled only if more than 100,000 texts are hit.

Defined results: a null text and a null item have no words and no window; rows of one item_id are one item, and a null item_id
counts as the item ''; a document without words has n_hit 0 and is clean; repeated rows and ids are judged one by one; an
empty benchmark leaves every document clean.  Result columns replace input columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from milaan.llm.common import prepare, slices, small, table, text_slices
from milaan.llm.textvec import WORD_BYTE, Words, shingles, whole, words
from milaan.sources.writers import materialized

WINDOW = 13
SHINGLE = 5
SLOT_BITS = 20
PROBE_BITS = 26
BROADCAST_WINDOWS = 100_000
BROADCAST_BYTES = 32 << 20
_GAPS = re.compile(b"\0+")


def _spoken(lower: bytes, start: int, end: int) -> str:
    """The words between two bytes, one space apart."""
    return _GAPS.sub(b" ", lower[start:end]).decode("utf-8", "replace")


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of every item: its words and its shingles."""
    for rows, raw, offsets, _ in text_slices(batches):
        w, lower = words(raw, offsets), WORD_BYTE[raw].tobytes()
        ids = rows.column(rows.schema.get_field_index("item")).to_pylist()
        out: dict[str, list] = {"item": [], "words": [], "n": [], "shingles": []}
        size = 0
        for i, item in enumerate(ids):
            first, last = w.first[i], w.first[i + 1]
            n = int(min(WINDOW, last - first))
            for s in range(first, last - n + 1 if n else first):
                part = w.hash[s : s + n]
                some = Words(np.zeros(n, np.int64), part, part, part, part)
                out["item"].append(item)
                out["words"].append(_spoken(lower, w.start[s], w.end[s + n - 1]))
                out["n"].append(n)
                out["shingles"].append(shingles(some, min(SHINGLE, n)).astype(np.int64))
                size += len(out["words"][-1])
                if size > 1 << 20:
                    yield _window_batch(out)
                    out, size = {k: [] for k in out}, 0
        yield _window_batch(out)


def _window_batch(out: dict[str, list]) -> pa.RecordBatch:
    kinds = {"item": pa.string(), "words": pa.string(), "n": pa.int32(), "shingles": pa.list_(pa.int64())}
    return pa.RecordBatch.from_pydict({k: pa.array(v, kinds[k]) for k, v in out.items()})


def windows(items: DataFrame) -> DataFrame:
    """The windows of all items, each once per item; ``window`` names equal ones."""
    asked = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").alias("text"))
    found = asked.mapInArrow(_windows, "item string, words string, n int, shingles array<long>")
    return found.withColumn("window", F.unhex(F.md5("words"))).dropDuplicates(["window", "item"])


class Bitmap:
    """Which slots (low bits) of 64-bit keys are taken: 2^bits bits, whatever the number of keys."""

    def __init__(self, keys: DataFrame, bits: int):
        self.bits, self.cells = bits, np.zeros(1 << (bits - 6), np.uint64)
        slot = F.col("key").bitwiseAND(F.lit((1 << bits) - 1))
        cells = keys.select(slot.alias("slot")).selectExpr("shiftright(slot, 6) AS cell", "shiftleft(1L, cast(slot & 63 AS int)) AS bit")
        # At most 2^(bits - 6) rows.
        taken = cells.groupBy("cell").agg(F.bit_or("bit").alias("taken")).toArrow()
        self.cells[taken["cell"].to_numpy()] = taken["taken"].to_numpy().astype(np.int64).view(np.uint64)

    def slots(self, values: np.ndarray) -> np.ndarray:
        return (values & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def holds(self, values: np.ndarray) -> np.ndarray:
        slot = self.slots(values)
        return (self.cells[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) > 0


def _slot_counts(asked: Bitmap, lengths: list[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << asked.bits, np.int64)
        for _, raw, offsets, _ in text_slices(batches):
            w = words(raw, offsets)
            for k in lengths:
                own = shingles(w, k)[whole(w, k)]
                np.add.at(sums, asked.slots(own[asked.holds(own)]), 1)
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"slot": seen, "seen": sums[seen]})

    return count


def _prefixes(found: DataFrame, docs: DataFrame, lengths: list[int]) -> DataFrame:
    """Each distinct window with its rarest shingle and that shingle's place; windows with a shingle no document has are out."""
    each = found.dropDuplicates(["window"]).select("window", "words", "n", F.posexplode("shingles").alias("place", "key"))
    asked = Bitmap(each, SLOT_BITS)
    counts = docs.select("text").mapInArrow(_slot_counts(asked, lengths), "slot long, seen long").groupBy("slot").agg(F.sum("seen").alias("seen"))
    # At most 2^SLOT_BITS rows of two numbers.
    known = each.withColumn("slot", F.col("key").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))).join(F.broadcast(counts), "slot", "left")
    rarest = F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "place", "key"))
    picked = known.groupBy("window", "words", "n").agg(rarest.alias("r")).where("r.seen > 0")
    return picked.select("window", "words", "n", F.col("r.place").alias("place"), F.col("r.key").alias("key"))


def _candidates(probe: Bitmap, lengths: list[int]):
    """Every place of a text whose shingle may be a prefix, with the words a window there could span."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, raw, offsets, _ in text_slices(batches):
            w, lower = words(raw, offsets), WORD_BYTE[raw].tobytes()
            texts = rows.column(rows.schema.get_field_index("__key"))
            for k in lengths:
                own = shingles(w, k)
                at = np.flatnonzero(probe.holds(own) & whole(w, k))
                before, after = (WINDOW - k, WINDOW) if k == SHINGLE else (0, k)
                first = w.first[w.doc[at]]
                low, high = np.maximum(first, at - before), np.minimum(w.first[w.doc[at] + 1], at + after)
                start, end = w.start[low], w.end[high - 1] if len(at) else at
                for a, b in slices(np.concatenate(([0], np.cumsum(end - start)))):
                    near = [_spoken(lower, s, e) for s, e in zip(start[a:b], end[a:b], strict=True)]
                    yield pa.RecordBatch.from_pydict({
                        "__key": texts.take(pa.array(w.doc[at[a:b]])), "key": own[at[a:b]].view(np.int64), "at": at[a:b] - first[a:b],
                        "before": (at - low)[a:b].astype(np.int32), "near": pa.array(near, pa.string()),
                    })

    return scan


def _few(prefixes: DataFrame, limit: int) -> DataFrame:
    size = prefixes.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.octet_length("words")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(prefixes) if size["rows"] <= limit and size["bytes"] <= BROADCAST_BYTES else prefixes


def _hits(docs: DataFrame, prefixes: DataFrame, lengths: list[int], limit: int) -> DataFrame:
    """Where which windows occur: text, first word, number of words, window.  Equal texts are listed once."""
    met = docs.select("__key", "text").mapInArrow(
        _candidates(Bitmap(prefixes, PROBE_BITS), lengths), "__key binary, key long, at long, before int, near string"
    ).join(_few(prefixes, limit), "key")
    near, skip = F.split("near", " "), F.col("before") - F.col("place")
    fits = (skip >= 0) & (F.size(near) >= skip + F.col("n"))
    same = F.array_join(F.slice(near, F.greatest(skip, F.lit(0)) + 1, F.col("n")), " ") == F.col("words")
    return met.where(fits & same).select("__key", (F.col("at") - F.col("place")).alias("first"), "n", "window").distinct()


def _verdicts(hits: DataFrame, found: DataFrame) -> DataFrame:
    """Per text that is hit: the words in the union of its hits, and the items."""
    reach = hits.groupBy("__key", "first").agg((F.col("first") + F.max("n")).alias("past"))
    earlier = Window.partitionBy("__key").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.greatest(F.lit(0), F.col("past") - F.greatest("first", F.coalesce(F.max("past").over(earlier), F.lit(0))))
    hit = reach.select("__key", fresh.alias("fresh")).groupBy("__key").agg(F.sum("fresh").alias("n_hit"))
    named = hits.select("__key", "window").distinct().join(found.select("window", "item"), "window")
    items = named.groupBy("__key").agg(F.sort_array(F.collect_set("item")).alias("items"))
    return hit.join(items, "__key").select(
        "__key", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    )


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, raw, offsets, _ in text_slices(batches):
        yield rows.append_column("n_words", pa.array(np.diff(words(raw, offsets).first), pa.int64()))


def decontaminate(docs: DataFrame, items: DataFrame, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The documents with n_words, n_hit, n_items, items_sha256 and contaminated."""
    prepare(docs.sparkSession)
    made = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    docs = docs.drop(*[c for c in docs.columns if c in made]).withColumn("__key", F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit("")))))
    found = materialized(windows(items), "windows")
    # One to SHINGLE.
    lengths = sorted(r["k"] for r in found.select(F.least("n", F.lit(SHINGLE)).alias("k")).distinct().collect())
    prefixes = materialized(_prefixes(found, docs, lengths), "prefixes")
    hits = materialized(_hits(docs, prefixes, lengths, broadcast_windows), "hits")
    verdicts = materialized(_verdicts(hits, found), "verdicts")
    counted = docs.mapInArrow(_word_counts, T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType())]))
    out = counted.join(small(verdicts), "__key", "left").drop("__key")
    none = {"n_hit": F.lit(0), "n_items": F.lit(0), "items_sha256": F.sha2(F.lit(""), 256)}
    out = out.withColumns({c: F.coalesce(c, none[c]) for c in none})
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text")


ORACLE = r"""
WITH dw AS (SELECT doc_id, row_number() OVER () AS k, COALESCE(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
iw AS (SELECT COALESCE(item_id::VARCHAR, '') AS item, COALESCE(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
grams AS (SELECT DISTINCT item, LEAST(13, len(w)) AS n, array_to_string(w[i : i + LEAST(13, len(w)) - 1], ' ') AS g
  FROM (SELECT item, w, unnest(range(1, len(w) - LEAST(13, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM grams),
dg AS (SELECT k, n, i, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT dg.k, dg.i, dg.n, grams.item FROM dg JOIN grams ON dg.n = grams.n AND dg.g = grams.g),
covered AS (SELECT k, count(*) AS n_hit FROM (SELECT DISTINCT k, unnest(range(i, i + n)) AS word FROM hit) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
  sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN covered ON covered.k = dw.k LEFT JOIN named ON named.k = dw.k
"""
