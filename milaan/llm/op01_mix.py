"""Mixing sources to target weights by Pareto order sampling.

Every source gets a number of words to give (its target).  ``target / source size`` is how often each of its documents is
wanted; the whole part is given to every document for certain, the rest is the inclusion probability of one more copy.  That
copy goes to the documents of lowest ``odds(random) / odds(inclusion)``: Pareto order sampling.  Probabilities differ from
source to source, and the sample has a fixed size, which is counted in words here, since targets are words: documents are
taken in rank order up to the one that brings the words nearest to the target.

The cut is found without sorting a source in one task: words are added up by rank bucket, then by sub-bucket of the bucket
the cut falls in, and only that sub-bucket is ordered.  Everything is DataFrame functions.

Rows that repeat id and text are one tie in the order.  The tie the cut falls in gives as many of its rows as the target asks for:
they are numbered task by task, so no tie is sorted in one task either.

Defined results: a null text has no words; a null source is a source of its own, last in order; a source without words has
target 0; a document without words takes 0; rows of one id are told apart by their text, rows without an id draw by their text,
and which of several equal rows get a copy is left open, how many is not; an empty table gives an empty mix.  Columns of the mix
replace input columns of the same name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from milaan.llm.common import small, table
from milaan.sources.writers import materialized

WEIGHTS = (5.0, 2.0, 1.0)
MOST_COPIES = 3
BUCKETS = 1024
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_draws(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Add the size in words and the random number of each document, a function of seed and id alone (of the text, if there is no id)."""
    named = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce("text", F.lit("")))))
    key = F.md5(F.concat(F.lit(f"{seed}:"), named))
    number = F.conv(F.substring(key, 1, 13), 16, 10).cast("double")
    return docs.withColumns(
        {"__size": words(F.col("text")), "__draw": (number + 0.5) / F.lit(float(1 << 52)), "__print": F.coalesce(F.xxhash64("text"), F.lit(0))}
    )


def targets(drawn: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """One row per source: its size and its target.  Shares above ``most`` sizes stop there, and the rest is shared again.

    Filling by weight stops a source at the water level ``most * size / weight``; sources in order of that level give the
    final level in one pass.
    """
    every = Window.partitionBy()
    sources = drawn.groupBy("source").agg(F.sum("__size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sources.withColumn("ord", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(cycle, (F.col("ord") % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("cap", (most * F.col("source_size")).cast("double"))
    filled = every.orderBy(F.col("cap") / F.col("weight"), "ord")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    levels = ranked.withColumns(
        {
            "left_words": F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "left_weight": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)),
        }
    ).withColumn("level", F.col("left_words") / F.col("left_weight"))
    # The first source that its share does not fill fixes the level of all that follow.
    fixed = levels.withColumn("final", F.first(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level")), True).over(
        filled.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))
    return fixed.select("source", F.col("source_size"), F.least("cap", share).alias("target"))


def _wanted(sources: DataFrame) -> DataFrame:
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return sources.withColumn("__whole", F.floor(times)).withColumns(
        {"__part": times - F.col("__whole"), "__budget": F.col("target") - F.col("__whole") * F.col("source_size")}
    )


def _ranked(drawn: DataFrame, sources: DataFrame) -> DataFrame:
    """Put each document's Pareto rank, and its bucket on the scale from 0 to 1, beside it."""
    odds = lambda p: p / (1 - p)
    side = sources.withColumnRenamed("source", "__source")
    joined = drawn.join(side, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    rank = F.when(F.col("__part") > 0, odds(F.col("__draw")) / odds(F.col("__part")))
    return joined.withColumn("__rank", rank).withColumn(
        "__cell", F.least(F.floor(F.col("__rank") / (1 + F.col("__rank")) * (BUCKETS * BUCKETS)), F.lit(BUCKETS * BUCKETS - 1))
    )


ORDER = ("__rank", "doc_id", "__print")


def _crossing(sums: DataFrame, cell: str, start: Column) -> DataFrame:
    """Per source the bucket in which its budget runs out, and the words before that bucket."""
    run = Window.partitionBy("source").orderBy(cell)
    ended = sums.withColumn("end", start + F.sum("words").over(run)).filter(F.col("end") > F.col("__budget"))
    first = ended.groupBy("source").agg(F.min(F.struct(F.col(cell), (F.col("end") - F.col("words")).alias("start"))).alias("at"))
    return first.select("source", F.col("at")[cell].alias("hit"), F.col("at")["start"].alias("start"))


def cuts(drawn: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per source: how many whole copies, and up to which rank one more."""
    wanted = _wanted(sources)
    ranked = _ranked(drawn, small(wanted)).filter("__rank IS NOT NULL").withColumn("coarse", F.floor(F.col("__cell") / BUCKETS))
    coarse = ranked.groupBy("source", "coarse", "__budget").agg(F.sum("__size").alias("words"))
    crossed = small(materialized(_crossing(coarse, "coarse", F.lit(0)), "mix-coarse"))
    meet = lambda rows, side, cell: rows.join(
        side.withColumnsRenamed({"source": "__s", "hit": "__hit"}), F.col("source").eqNullSafe(F.col("__s")) & (F.col(cell) == F.col("__hit"))
    ).drop("__s", "__hit")
    inside = meet(ranked, crossed, "coarse")
    fine = inside.groupBy("source", "__cell", "__budget", "start").agg(F.sum("__size").alias("words"))
    at = small(materialized(_crossing(fine, "__cell", F.col("start")), "mix-fine"))
    # Equal rows are one entry here; ``many`` rows of a tie are taken while each brings the sum nearer to the budget.
    last = meet(ranked, at, "__cell").groupBy("source", *ORDER, "__budget", "start").agg(F.count(F.lit(1)).alias("rows"), F.max("__size").alias("__size"))
    run = Window.partitionBy("source").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    lead = F.col("__budget") - F.col("start") - F.coalesce(F.sum(F.col("__size") * F.col("rows")).over(run), F.lit(0))
    many = F.when(F.col("__size") == 0, F.when(lead >= 0, F.col("rows")).otherwise(0)).otherwise(F.floor(lead / F.col("__size") + 0.5))
    taken = last.withColumn("many", F.least(many, F.col("rows"))).filter("many > 0")
    edge = taken.groupBy("source").agg(F.max(F.struct(*ORDER, "many", "rows")).alias("__edge")).withColumnRenamed("source", "__s")
    ends = at.join(edge, F.col("source").eqNullSafe(F.col("__s")), "left").select(
        F.col("source").alias("__e"), F.col("hit").alias("__edge_cell"), "__edge"
    )
    return wanted.join(ends, F.col("source").eqNullSafe(F.col("__e")), "left").drop("__e")


def _numbered(tied: DataFrame) -> DataFrame:
    """Number the rows of each source from 1: by task, then inside it."""
    parted = materialized(tied.withColumns({"__task": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}), "mix-ties")
    sums = parted.groupBy("source", "__task").agg(F.count(F.lit(1)).alias("__n"))
    # One row per source and task that has rows of its tie.
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("source").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("source").alias("__s"), F.col("__task").alias("__t"), before.alias("__offset"))
    met = parted.join(small(materialized(offsets, "mix-offsets")), F.col("source").eqNullSafe(F.col("__s")) & (F.col("__task") == F.col("__t")))
    inside = F.row_number().over(Window.partitionBy("source", "__task").orderBy("__row"))
    return met.withColumn("__number", F.col("__offset") + inside).drop("__task", "__row", "__s", "__t", "__offset")


def apply_cuts(drawn: DataFrame, cut: DataFrame) -> DataFrame:
    """Add size, source_size, target, copies and taken to every document; one narrow pass when the sources are few.

    Only the rows of a tie that the cut splits are numbered, in a table of their own.
    """
    ranked = _ranked(drawn, small(cut))
    here = F.struct(*ORDER)
    edge = F.struct(*[F.col("__edge")[c].alias(c) for c in ORDER])
    at_edge = F.coalesce((F.col("__cell") == F.col("__edge_cell")) & (here == edge), F.lit(False))
    inside = F.coalesce((F.col("__cell") == F.col("__edge_cell")) & (here <= edge), F.lit(False))
    below = F.col("__edge_cell").isNull() | (F.col("__cell") < F.col("__edge_cell"))
    split = at_edge & (F.col("__edge")["many"] < F.col("__edge")["rows"])

    def made(rows: DataFrame, more) -> DataFrame:
        copies = F.col("__whole") + F.when(F.col("__rank").isNotNull() & more, 1).otherwise(0)
        out = rows.withColumn("size", F.col("__size")).withColumn("copies", copies.cast("int"))
        out = out.withColumn("taken", (F.col("copies") * F.col("__size")).cast("long"))
        return out.drop(*[c for c in out.columns if c.startswith("__")])

    if not cut.filter("__edge.many < __edge.rows").take(1):
        return made(ranked, below | inside)
    tied = _numbered(ranked.filter(split))
    return made(ranked.filter(~split), below | inside).unionByName(made(tied, F.col("__number") <= F.col("__edge")["many"]))


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: int = MOST_COPIES, seed: str = SEED) -> DataFrame:
    """The documents with their size, source_size, target, copies and taken words."""
    docs = docs.drop(*[c for c in docs.columns if c in ("size", "source_size", "target", "copies", "taken")])
    drawn = with_draws(docs, seed)
    slim = materialized(drawn.select("doc_id", "source", "__size", "__draw", "__print"), "mix-draws")
    cut = materialized(cuts(slim, materialized(targets(slim, weights, most), "mix-targets")), "mix-cuts")
    narrow = set(docs.columns) <= {"doc_id", "source", "text"} and "text" not in docs.columns
    return apply_cuts(slim if narrow else drawn, cut)


def op1_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = materialized(with_draws(docs).select("doc_id", "source", "__size", "__draw", "__print"), "mix-draws")
    cut = materialized(cuts(slim, materialized(targets(slim), "mix-targets")), "mix-cuts")
    return apply_cuts(slim, cut).select("doc_id", "size", "source_size", "target", "taken", "copies")


ORACLE = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^ \\t-\\r]+')), 0)::BIGINT AS size,
    (('0x' || substr(md5('mix-1:' || COALESCE(doc_id::VARCHAR, 'text:' || md5(COALESCE(text, '')))), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ord FROM d GROUP BY source),
w AS (SELECT source, n, CASE ord % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, 3 * n AS cap FROM s),
-- The whole is shared by weight; what is above its cap stops there and the rest is shared again, until none is above.
fill(step, source, n, w, cap, full_) AS (
  SELECT 0, source, n, w, cap, false FROM w
  UNION ALL
  SELECT step + 1, source, n, w, cap, full_ OR w * (total - held) / NULLIF(open_w, 0) > cap
  FROM (SELECT *, sum(n) OVER () AS total, sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER () AS held,
          sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () AS open_w FROM fill) WHERE step < 64),
t AS (
  SELECT source, n, CASE WHEN full_ THEN cap ELSE LEAST(cap, w * (total - held) / open_w) END AS target
  FROM (SELECT *, sum(n) OVER () AS total, sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER () AS held,
          sum(CASE WHEN full_ THEN 0 ELSE w END) OVER () AS open_w FROM fill WHERE step = 64)),
f AS (SELECT *, CASE WHEN n > 0 THEN target / n ELSE 0 END AS times FROM t),
r AS (
  SELECT d.doc_id, d.size, f.n, f.target, floor(f.times) AS whole, f.times - floor(f.times) AS part,
    f.target - floor(f.times) * f.n AS budget, d.source, u
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY u, doc_id) AS upto FROM r)
SELECT doc_id, size, n::BIGINT AS source_size, target,
  (whole + CASE WHEN part > 0 AND upto - size / 2.0 <= budget THEN 1 ELSE 0 END)::INTEGER AS copies,
  ((whole + CASE WHEN part > 0 AND upto - size / 2.0 <= budget THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM c
"""
