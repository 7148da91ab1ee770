"""N-gram Jaccard join by chosen paths: which documents share at least 0.8 of their five-word shingles.

Documents of equal shingle sets are one class, met once.  Each class is embedded as ``LANES`` min-hash tokens.  A run is a
random tree: at every node a set follows each lane with probability ``1 / (threshold * LANES)``, into the child of the token it
has there, so two sets go on together as often as they share tokens.  Nodes with few sets are leaves at once; larger ones split
again, ``DEPTH`` times at most.  A pair survives a run of that depth with a chance worked out below, and runs are repeated until
the pairs at the threshold are met with ``RECALL``.

Leaves are brute-forced on the tokens, in tiles of ``BLOCK`` sets, with slack for the tokens' sampling error; what is alike
there is joined into candidate groups.  Then every group is brute-forced on the whole shingle sets, again in tiles, which gives
the links and the classes exactly.  No pair is written: a tile gives each set its number of links and its root.

Words are runs of letters and digits, lower-cased (as in the benchmark join); a text of one to four words has one shingle, all
of its words.  Defined results: null texts and texts without words have no links and a class of their own; the class id is the
least doc_id of the class (null if it has none, or if the document has no words and no id); rows with equal id and text are
documents of their own and link to each other; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from milaan.llm.common import Scratch, prepare, table, text_slices
from milaan.llm.components import components
from milaan.llm.textvec import Words, mixed, shingles, words

SHINGLE = 5
THRESHOLD = 0.8
LANES = 64
RECALL = 0.999
DEPTH = 3
SMALL_NODE = 64
BLOCK = 256
BLOCK_SHINGLES = 400_000
# Slack of the token comparison: four standard errors of a share of LANES tokens at the threshold.
SLACK = 4 * math.sqrt(THRESHOLD * (1 - THRESHOLD) / LANES)
_MULTIPLY = (mixed(np.arange(1, LANES + 1, dtype=np.uint64)) | np.uint64(1)).astype(np.uint32) | np.uint32(1)
_FLIP = (mixed(np.arange(1001, LANES + 1001, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def runs_needed(recall: float = RECALL, depth: int = DEPTH) -> int:
    """A pair at the threshold shares one chosen lane on average at each node, and so survives one more level with 1 - exp(-s)."""
    survive = 1.0
    for _ in range(depth):
        survive = 1 - math.exp(-survive)
    return math.ceil(math.log(1 - recall) / math.log(1 - survive))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    w = words(raw, offsets)
    all_ = shingles(w, k)
    for a, b in zip(w.first[:-1], w.first[1:], strict=True):
        if b - a >= k:
            yield np.unique(all_[a : b - k + 1])
        elif b > a:
            own = w.hash[a:b]
            yield shingles(Words(own, own, own, own, own), b - a)
        else:
            yield all_[:0]


def embedded(own: np.ndarray) -> np.ndarray:
    """The least of LANES different hashes over the set."""
    low = (own ^ own >> np.uint64(32)).astype(np.uint32)
    best = np.full(LANES, 0xFFFFFFFF, np.uint32)
    for a in range(0, len(own), 4096):
        part = (low[None, a : a + 4096] ^ _FLIP[:, None]) * _MULTIPLY[:, None]
        part ^= part >> np.uint32(15)
        part *= np.uint32(0x2C1B3C6D)
        np.minimum(best, part.min(1), out=best)
    return best


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, raw, offsets, _ in text_slices(batches):
        keys, sizes, lanes = [], [], []
        for own in shingle_sets(raw, offsets):
            keys.append(blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
            sizes.append(len(own))
            lanes.append(embedded(own).tobytes() if len(own) else None)
        kept = {n: rows.column(rows.schema.get_field_index(n)) for n in ("doc_id", "print")}
        yield pa.RecordBatch.from_pydict(kept | {"set": pa.array(keys, pa.binary()), "n": pa.array(sizes, pa.int64()), "lanes": pa.array(lanes, pa.binary())})


def _children(node: np.ndarray, lanes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and child nodes: every set follows each lane of its node with probability 1 / (threshold * LANES)."""
    seed = mixed(node[:, None] ^ mixed(np.arange(1, LANES + 1, dtype=np.uint64))[None, :])
    chosen = seed < np.uint64(int((1 << 64) / (threshold * LANES)) - 1)
    row, lane = np.nonzero(chosen)
    return row, mixed(seed[row, lane] * np.uint64(0x9E3779B97F4A7C15) + lanes[row, lane].astype(np.uint64) + np.uint64(1))


def _split(threshold: float, runs: int):
    """(node, rid, lanes) -> (node, rid) one level deeper; with ``runs``, from the roots of as many trees."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lanes = np.frombuffer(b"".join(batch.column("lanes").to_pylist()), np.uint32).reshape(-1, LANES)
            rid = batch.column("rid").to_numpy(zero_copy_only=False)
            node = batch.column("node").to_numpy(zero_copy_only=False).astype(np.uint64)
            for r in range(max(1, runs)):
                start = np.full(len(rid), mixed(np.array([r + 17], np.uint64))[0]) if runs else node
                row, child = _children(start, lanes, threshold)
                yield pa.RecordBatch.from_pydict({"node": child.astype(np.int64), "rid": rid[row]})

    return split


def groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Rows that come sorted by ``keys``, one table per key; only one group is held."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        edge = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            here = tuple(c[a] for c in cols)
            if held and here != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = here
    if held:
        yield pa.Table.from_batches(held)


def _roots(alike: np.ndarray) -> np.ndarray:
    """The least index that each one is joined to, step by step."""
    root = np.arange(len(alike))
    while True:
        least = np.minimum(root, np.where(alike, root[None, :], len(root)).min(1))
        least = least[least]
        if (least == root).all():
            return root
        root = least


def _tile_rows(group: pa.Table, names: tuple[str, ...]) -> list[np.ndarray]:
    return [group.column(n).to_numpy() for n in names]


def _same(lanes: np.ndarray) -> np.ndarray:
    """How many tokens each two sets share, some million comparisons at a time."""
    rows = max(1, (1 << 22) // lanes.size)
    strips = [(lanes[a : a + rows, None] == lanes[None]).sum(2, dtype=np.int16) for a in range(0, len(lanes), rows)]
    return strips[0] if len(strips) == 1 else np.concatenate(strips)


def _near_tokens(threshold: float):
    least = (threshold - SLACK) * LANES

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u, v, held = [], [], 0
        for group in groups(batches, ("node", "i", "j")):
            if group.num_rows > 1:
                rid, n = _tile_rows(group, ("rid", "n"))
                order = np.argsort(rid)
                rid, n = rid[order], n[order]
                lanes = np.frombuffer(b"".join(group.column("lanes").to_pylist()), np.uint32).reshape(-1, LANES)[order]
                alike = (_same(lanes) >= least) & (np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]) - 1e-9)
                root = _roots(alike)
                joined = root != np.arange(len(rid))
                block, i, j = (x[order] for x in _tile_rows(group, ("block", "i", "j")))
                if i[0] != j[0]:  # what a block joins by itself, its own tile says; here only what the two blocks join
                    joined &= _roots(alike & (block[:, None] == block[None, :])) == np.arange(len(rid))
                if joined.any():
                    u.append(rid[joined])
                    v.append(rid[root[joined]])
                    held += len(u[-1])
            if held > 50_000:
                yield pa.RecordBatch.from_pydict({"u": np.concatenate(u), "v": np.concatenate(v)})
                u, v, held = [], [], 0
        if u:
            yield pa.RecordBatch.from_pydict({"u": np.concatenate(u), "v": np.concatenate(v)})

    return near


def _shared(at: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """How many tokens each two rows share; only tokens of two rows or more are laid out, some thousands at a time."""
    token, code, many = np.unique(at, return_inverse=True, return_counts=True)
    use = many[code] > 1
    code, row = code[use], row[use]
    _, code = np.unique(code, return_inverse=True)
    order = np.argsort(code, kind="stable")
    code, row = code[order], row[order]
    total = np.zeros((rows, rows), np.float32)
    wide = 4096
    for first in range(0, int(code[-1]) + 1 if len(code) else 0, wide):
        a, b = np.searchsorted(code, [first, first + wide])
        held = np.zeros((rows, wide), np.float32)
        held[row[a:b], code[a:b] - first] = 1
        total += held @ held.T
    return total


def _exact(threshold: float):
    """Per tile: the links of each set, weighed by the copies of the other, and the root each is joined to."""
    part = threshold / (1 + threshold)

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for group in groups(batches, ("root", "i", "j")):
            rid, n, copies, block, i, j = _tile_rows(group, ("rid", "n", "copies", "block", "i", "j"))
            order = np.argsort(rid)
            sets = group.column("shingles").to_pylist()
            sets = [np.frombuffer(sets[o], np.uint64) for o in order]
            rid, n, copies, block = rid[order], n[order], copies[order], block[order]
            shared = _shared(np.concatenate(sets), np.repeat(np.arange(len(rid)), n), len(rid))
            alike = shared >= part * (n[:, None] + n[None, :]) - 1e-6
            np.fill_diagonal(alike, False)
            if i[0] != j[0]:  # pairs inside a block belong to that block's own tile
                alike &= block[:, None] != block[None, :]
            root = _roots(alike)
            links = alike.astype(np.int64) @ copies
            some = links > 0
            if some.any():
                out.append((rid[some], rid[root[some]], links[some]))
                held += len(out[-1][0])
            if held > 50_000:
                yield _linked(out)
                out, held = [], 0
        if out:
            yield _linked(out)

    return exact


def _linked(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({n: np.concatenate([x[k] for x in out]) for k, n in enumerate(("u", "v", "links"))})


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, raw, offsets, _ in text_slices(batches):
        kept = {f.name: rows.column(i) for i, f in enumerate(rows.schema) if f.name != "text"}
        yield pa.RecordBatch.from_pydict(kept | {"shingles": pa.array([s.tobytes() for s in shingle_sets(raw, offsets)], pa.binary())})


def _leaves(classes: DataFrame, threshold: float, runs: int, scratch: Scratch) -> DataFrame:
    """(node, n_node, rid): the sets of every leaf with two sets or more."""
    side = classes.select("rid", "lanes")
    rows = side.withColumn("node", F.lit(0).cast("long")).mapInArrow(_split(threshold, runs), "node long, rid long")
    leaves = None
    for depth in range(1, DEPTH + 1):
        rows = scratch.written(rows, "paths")
        sizes = rows.groupBy("node").agg(F.count("rid").alias("n_node")).filter("n_node > 1")
        sized = rows.join(sizes, "node")
        ends = sized if depth == DEPTH else sized.filter(F.col("n_node") <= SMALL_NODE)
        leaves = ends if leaves is None else leaves.unionByName(ends)
        if depth < DEPTH:
            large = sized.filter(F.col("n_node") > SMALL_NODE).select("node", "rid")
            rows = large.join(side, "rid").mapInArrow(_split(threshold, 0), "node long, rid long")
    return leaves


def _tiles(rows: DataFrame, group: str, blocks) -> DataFrame:
    """Deal the members of a group to blocks, and every block to its tiles with all blocks."""
    dealt = rows.withColumn("blocks", F.greatest(F.lit(1), blocks.cast("int")))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks")
    return dealt.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def described(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, print, set, n, lanes) of every row, written once."""
    prepare(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("print"), "text")
    return scratch.written(slim.mapInArrow(_describe, "doc_id long, print string, set binary, n long, lanes binary"), "described")


def join(docs: DataFrame, rows: DataFrame, scratch: Scratch, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per class of equal sets: set, rid, copies, first (least id and its print), links, root."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "print"))
    classes = rows.filter("set IS NOT NULL").groupBy("set").agg(
        F.first("n").alias("n"), F.first("lanes").alias("lanes"), F.count("n").alias("copies"), first.alias("first")
    )
    classes = scratch.written(classes.withColumn("rid", F.monotonically_increasing_id()), "classes")
    leaves = _leaves(classes, threshold, runs_needed(recall), scratch)
    met = leaves.join(classes.select("rid", "n", "lanes"), "rid")
    near = _tiles(met, "node", F.ceil(F.col("n_node") / BLOCK)).select("node", "i", "j", "block", "rid", "n", "lanes").mapInArrow(_near_tokens(threshold), "u long, v long")
    found = components(near, scratch)
    found = scratch.written(found.unionByName(found.select(F.col("root").alias("id"), "root").distinct()), "candidates")
    scratch.only(rows, classes, found)
    known = classes.select("rid", "n", "copies", F.col("first.doc_id").alias("doc_id"), F.col("first.print").alias("print"))
    known = known.join(found.withColumnRenamed("id", "rid"), "rid")
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), "text")
    asked = texts.join(known, F.col("__id").eqNullSafe(F.col("doc_id")) & (F.md5("text") == F.col("print"))).drop("__id", "doc_id", "print")
    sets = asked.mapInArrow(_sets, "rid long, n long, copies long, root long, shingles binary")
    sets = scratch.written(sets.groupBy("rid", "n", "copies", "root").agg(F.first("shingles").alias("shingles")), "sets")
    sizes = sets.groupBy("root").agg(F.count("rid").alias("sets"), F.sum("n").alias("total"))
    blocks = F.ceil(F.greatest(F.col("sets") / BLOCK, F.col("total") / BLOCK_SHINGLES))
    tiles = _tiles(sets.join(sizes, "root"), "root", blocks)
    linked = tiles.select("root", "i", "j", "rid", "n", "copies", "block", "shingles").mapInArrow(_exact(threshold), "u long, v long, links long")
    linked = scratch.written(linked, "links")
    scratch.only(rows, classes, linked)
    links = linked.groupBy(F.col("u").alias("rid")).agg(F.sum("links").alias("links"))
    roots = components(linked.select("u", "v"), scratch).withColumnRenamed("id", "rid")
    out = classes.drop("lanes", "n").join(links, "rid", "left").join(roots, "rid", "left")
    out = scratch.written(out.withColumns({"links": F.coalesce("links", F.lit(0)), "root": F.coalesce("root", "rid")}), "joined")
    scratch.only(rows, out)
    return out


def classed(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, print, class_id, first_print, n_links, n_shingles): one row per document.

    It reads two tables in the shared folder (the described documents and the joined sets); all others are dropped on the way.
    """
    scratch = Scratch(docs.sparkSession)
    rows = described(docs, scratch)
    sets = join(docs, rows, scratch, threshold, recall)
    least = sets.groupBy("root").agg(F.min("first").alias("least"))
    sets = sets.join(least, "root").select("set", "copies", "links", "least")
    known = rows.select("doc_id", "print", "set", "n").join(sets, "set", "left")
    links = F.when(F.col("set").isNull(), F.lit(0)).otherwise(F.col("copies") - 1 + F.col("links"))
    own = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("least.doc_id"))
    return known.select("doc_id", "print", own.alias("class_id"), F.col("least.print").alias("first_print"), links.cast("long").alias("n_links"), F.col("n").alias("n_shingles"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """The documents but those that link, over any number of steps, to one of lower id; texts without words all stay."""
    names = docs.columns
    seen = classed(docs, threshold, recall).filter("first_print IS NOT NULL")
    kept = seen.select(F.col("class_id").alias("__id"), F.col("first_print").alias("__print")).distinct()
    keyed = docs.withColumns({"__doc": F.col("doc_id").cast("long"), "__text": F.md5("text")})
    word = F.coalesce(F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"), F.lit(False))
    here = keyed.filter(word).join(kept, F.col("__doc").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__print")), "left_semi")
    return here.dropDuplicates(["__doc", "__text"]).select(*names).unionByName(docs.filter(~word))


def op3_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classed(docs).select("doc_id", "class_id", "n_links", "n_shingles")
