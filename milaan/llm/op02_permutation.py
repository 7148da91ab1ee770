"""Approximate nearest neighbours by a permutation index with pivot inverted files.

A sample of the vectors are pivots.  Every vector is represented by the order of the pivots around it, and posted in the lists of
its ``POSTS`` nearest pivots.  A query visits the lists of its ``probes`` nearest pivots; there vectors are ranked by Spearman's
footrule between the two orders, over the query's first pivots, and the best ``KEEP`` of a list (never fewer than ``LEAST``) are
reranked by the inner product in double precision.  The lists of neighbouring pivots are worked on together, so that a vector or a
query is sent once to a neighbourhood and not once to each of its lists, and brings back one result from there.  Large
neighbourhoods are cut into chunks of vectors and blocks of queries, so that a tile is bounded however the data lie; what is sent
is the number of pairs over the side of a tile.

The nearest by inner product are the nearest by distance once every vector gets one more component that makes all lengths equal
(0 for queries); pivots are ordered by that.  Equal vectors are one entry with its 21 least ids, which is all that 20 results and
the query itself can use.  Queries that find fewer than they should visit all lists.

Defined results: null and zero vectors, and those with null or non-finite components, take no part, neither do vectors of another
length than the most common one (of two equally common, the longer); rows that repeat an id and a vector are one; ties go to the
smaller vec_id; a null vec_id takes no part; an empty table has no results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from milaan.llm.common import Scratch, prepare, table
from milaan.llm.op03_jaccard import groups

K = 20
POSTS = 4
# Pivots: the root of the number of vectors between these two; the lists visited are a quarter of them, 48 at least.
PIVOTS = (128, 4096)
PREFIX = 96
KEEP = 0.2
LEAST = 100
NEIGHBOURS = 16  # pivots whose lists are worked on together
CHUNK, QUERY_BLOCK = 16384, 16384
SALTS = 8


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): the vectors that take part, in double precision; those given as floats stay floats, which are the same numbers."""
    v = F.transform("embedding", lambda x: x.cast("double")) if vectors.schema["embedding"].dataType.simpleString() != "array<float>" else F.col("embedding")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL").filter(F.coalesce(whole, F.lit(False)))
    sizes = rows.groupBy(F.size("v").alias("d")).count().agg(F.max(F.struct("count", "d")).alias("top")).first()["top"]
    return rows.filter(F.size("v") == (sizes["d"] if sizes else 0))


def entries(rows: DataFrame, k: int = K) -> DataFrame:
    """(rid, v, ids, asks): one row per distinct vector with its least ids; whether any of its rows is a query."""
    limit = lambda frame, *by: frame.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("vec_id"))).filter(f"n <= {k + 1}").drop("n")
    some = limit(rows.distinct().withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))), "v", "salt")
    least = limit(some.drop("salt"), "v").groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asks = rows.groupBy("v").agg(F.max(F.col("vec_id") % 20 == 0).alias("asks"))
    return least.join(asks, "v").withColumn("rid", F.monotonically_increasing_id())


def neighbourhoods(pivots: np.ndarray, most: int = NEIGHBOURS) -> np.ndarray:
    """The neighbourhood of each pivot: halves along the direction of largest spread until none holds more than ``most``."""
    out, todo, count = np.zeros(len(pivots), np.int32), [np.arange(len(pivots))], 0
    while todo:
        here = todo.pop()
        if len(here) <= most:
            out[here] = count
            count += 1
            continue
        spread = pivots[here] - pivots[here].mean(0)
        along = here[np.argsort(spread @ np.linalg.svd(spread, full_matrices=False)[2][0], kind="stable")]
        todo += [along[: len(along) // 2], along[len(along) // 2 :]]
    return out


def _order(pivots: np.ndarray, place: np.ndarray, reach: float, prefix: int, probes: int, kind: str):
    """Append the nearest pivots, in order, and the lists by neighbourhood: for a vector with its length filled up, and for it as a query."""

    def lists(near: np.ndarray) -> list[dict]:
        where = place[near]
        return [{"area": int(a), "lists": near[where == a].astype(np.int16).tobytes()} for a in np.unique(where)]

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = pa.list_(pa.struct([("area", pa.int32()), ("lists", pa.binary())]))
        for b in batches:
            if not b.num_rows:
                continue
            x = np.array(b.column("v").to_pylist(), float)
            asks = b.column("asks").to_numpy(zero_copy_only=False)
            more = np.sqrt(np.maximum(0, reach**2 - (x * x).sum(1, keepdims=True)))
            cols = {n: b.column(n) for n in ("rid", "ids", "asks")}
            for name, extra, many in (("near", more, POSTS), ("near_query", 0 * more, probes)):
                wanted = np.ones(len(x), bool) if name == "near" else asks
                got = np.argsort(-(np.hstack([x, extra]) @ pivots.T), axis=1, kind="stable")[:, : max(prefix, many)]
                cols[name] = pa.array([g[:prefix].astype(np.int16).tobytes() if w else None for g, w in zip(got, wanted)], pa.binary())
                cols[f"{name}_lists"] = pa.array([lists(g[:many]) if w else None for g, w in zip(got, wanted)], kept)
            yield pa.RecordBatch.from_pydict(cols | {"vec": pa.array([r.tobytes() for r in x.astype(kind)], pa.binary())})

    return order


def _tile(pivots: int, prefix: int, keep: float, k: int, kind: str):
    """The best of each tile for each of its queries."""

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ("area", "chunk", "block")):
            query = group.column("is_query").to_numpy(zero_copy_only=False)
            if query.all() or not query.any():
                continue
            rid, first = group.column("rid").to_numpy(), group.column("first_id").to_numpy()
            near = np.frombuffer(b"".join(group.column("near").to_pylist()), np.int16).reshape(len(rid), -1).astype(np.int64)
            vec = np.frombuffer(b"".join(group.column("vec").to_pylist()), kind).reshape(len(rid), -1).astype(float)
            lists = group.column("lists").to_pylist()
            pivot, row = np.frombuffer(b"".join(lists), np.int16), np.repeat(np.arange(len(rid)), [len(x) // 2 for x in lists])
            ahead = np.arange(prefix, dtype=np.int16)[:, None]
            met: dict[int, list] = {}
            for p in np.unique(pivot):
                here = row[pivot == p]
                q, x = here[query[here]], here[~query[here]]
                if not len(q) or not len(x):
                    continue
                place = np.full((pivots, len(x)), prefix, np.int16)  # a pivot beyond the prefix counts as just after it
                place[near[x], np.arange(len(x))[:, None]] = np.arange(near.shape[1])[None, :]
                many = min(len(x), max(LEAST, math.ceil(keep * len(x))))
                for i in q:
                    rule = np.abs(place[near[i]] - ahead).sum(0, dtype=np.int32)
                    best = x[np.argpartition(rule, many - 1)[:many]] if many < len(x) else x
                    score = (vec[best] * vec[i]).sum(1)
                    top = np.lexsort((first[best], -score))[: k + 1]
                    met.setdefault(int(i), []).append((best[top], score[top]))
            out: list[tuple] = []
            for i, found in met.items():
                best, at = np.unique(np.concatenate([b for b, _ in found]), return_index=True)
                score = np.concatenate([c for _, c in found])[at]
                top = np.lexsort((first[best], -score))[: k + 1]
                out.append((np.full(len(top), rid[i]), rid[best[top]], first[best[top]], score[top]))
            if out:
                yield pa.RecordBatch.from_pydict({n: np.concatenate([o[c] for o in out]) for c, n in enumerate(("q", "rid", "first_id", "score"))})

    return tile


def _search(scratch: Scratch, shown: DataFrame, asking: DataFrame, pivots: int, prefix: int, keep: float, k: int, kind: str) -> DataFrame:
    """(q, rid, score): the k + 1 best entries that each asking entry finds."""
    row = lambda frame, near, is_query: frame.select(
        F.inline(f"{near}_lists"), "rid", F.element_at("ids", 1).alias("first_id"), F.col(near).alias("near"), "vec", F.lit(is_query).alias("is_query")
    )
    vectors, queries = row(shown, "near", False), row(asking, "near_query", True)
    # One row per neighbourhood: bounded by the number of pivots.
    sizes = vectors.groupBy("area").agg(F.count("rid").alias("n")).join(queries.groupBy("area").agg(F.count("rid").alias("m")), "area")
    sizes = F.broadcast(scratch.written(sizes.select("area", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"), F.ceil(F.col("m") / QUERY_BLOCK).cast("int").alias("blocks")), "lists"))
    part = lambda n, seed: F.pmod(F.xxhash64("rid", F.lit(seed)), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = vectors.join(sizes, "area").withColumn("chunk", part("chunks", 1)).withColumn("block", each("blocks"))
    right = queries.join(sizes, "area").withColumn("block", part("blocks", 2)).withColumn("chunk", each("chunks"))
    names = ["area", "chunk", "block", "rid", "first_id", "near", "lists", "vec", "is_query"]
    dealt = left.select(*names).unionByName(right.select(*names)).repartition("area", "chunk", "block").sortWithinPartitions("area", "chunk", "block")
    met = dealt.mapInArrow(_tile(pivots, prefix, keep, k, kind), "q long, rid long, first_id long, score double").groupBy("q", "rid").agg(F.first("first_id").alias("first_id"), F.max("score").alias("score"))
    best = Window.partitionBy("q").orderBy(F.desc("score"), "first_id")
    return met.withColumn("n", F.row_number().over(best)).filter(f"n <= {k + 1}").select("q", "rid", "score")


def search(vectors: DataFrame, k: int = K, keep: float = KEEP) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows whose vec_id is divisible by 20."""
    spark = vectors.sparkSession
    prepare(spark)
    rows = usable(vectors)
    scratch = Scratch(spark)
    own = scratch.written(entries(rows, k), "entries")
    kind = "f4" if rows.schema["v"].dataType.simpleString() == "array<float>" else "f8"
    total = own.count()
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    reach = own.agg(F.max(length)).first()[0] or 0.0
    m = min(total, max(PIVOTS[0], min(PIVOTS[1], math.isqrt(total))))
    drawn = [r["v"] for r in own.select("v", F.xxhash64(F.col("v").cast("array<double>")).alias("h")).orderBy("h").limit(m).collect()]
    pivots = np.array(drawn, float).reshape(m, len(drawn[0]) if drawn else 1)
    pivots = np.hstack([pivots, np.sqrt(np.maximum(0, reach**2 - (pivots**2).sum(1, keepdims=True)))])
    probes = min(m, max(48, m // 4))
    prefix = min(m, PREFIX)
    place = neighbourhoods(pivots)
    ordered = own.mapInArrow(
        _order(pivots, place, reach, prefix, probes, kind),
        "rid long, ids array<long>, asks boolean, near binary, near_lists array<struct<area int, lists binary>>, near_query binary, near_query_lists array<struct<area int, lists binary>>, vec binary",
    )
    shown = scratch.written(ordered, "orders")
    asking = shown.filter("asks")
    found = scratch.written(_search(scratch, shown, asking, m, prefix, keep, k, kind), "found")
    lacking = found.groupBy("q").count().filter(F.col("count") < min(k + 1, total)).select(F.col("q").alias("rid"))
    unmet = asking.join(found.select(F.col("q").alias("rid")).distinct(), "rid", "left_anti").select("rid")
    again = scratch.written(lacking.unionByName(unmet), "lacking")
    if total and again.take(1):
        # All lists with every vector in each are one list.
        whole = F.array(F.struct(F.lit(0).alias("area"), F.lit(bytes(2)).alias("lists")))
        rest = asking.join(again, "rid").withColumn("near_query_lists", whole)
        more = _search(scratch, shown.withColumn("near_lists", whole), rest, m, prefix, keep, k, kind)
        found = found.join(again.withColumnRenamed("rid", "q"), "q", "left_anti").unionByName(more)
    ids = found.join(shown.select("rid", F.explode("ids").alias("vec_id")), "rid").drop("rid")
    named = rows.filter("vec_id % 20 = 0").distinct().select(F.col("vec_id").alias("query_id"), "v")
    asked = named.join(own.filter("asks").select(F.col("rid").alias("q"), "v"), "v").select("query_id", "q")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    pairs = asked.join(ids, "q").filter("vec_id <> query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    ranked = pairs.withColumn("rank", F.row_number().over(order)).filter(f"rank <= {k}")
    return ranked.select("query_id", "rank", "vec_id", "score")


def op2_permutation(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"))
