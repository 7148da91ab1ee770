"""Cross-document comparison.

The work unit is not the document but the *value group*: one row per distinct (case, field, document type, value) with
the number of documents that carry it.  Copies collapse in the map-side combine before anything is shuffled, so a case
with a huge number of copies costs no more than its distinct values.  A comparison row stands for ``n_pairs`` document
pairs; each row repeated that often gives the plain pair list.

Pairs within a case come from an equi-join that is spread by document position: a row is keyed by its block of
``BLOCK`` positions, and its partners are replicated to the blocks at or before their own.  Ordinary cases fit in block
0 and are replicated to nothing; a giant case is cut over many tasks without any counting pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from milaan.functions import compare, text
from milaan.operators.documents import field_ord, readable_only, unpivot_fields

BLOCK = 256


def value_groups(long_docs: DataFrame) -> DataFrame:
    """Distinct values per (case, field, document type): how many documents, and the first position.

    A ``std`` column goes along as a key: it is then worked out once per source row, before the shuffle both sides of the
    self-join read.
    """
    keys = [c for c in ("case_id", "field", "doc_type", "value", "std") if c in long_docs.columns]
    return long_docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_ord").alias("first_ord"))


def standardized(rows: DataFrame) -> DataFrame:
    return rows.withColumn("std", text.standard_form_of("field", "value"))


def readable_groups(docs: DataFrame) -> DataFrame:
    """Standardised value groups of the readable identity values of ``docs``."""
    return value_groups(standardized(readable_only(unpivot_fields(docs))))


def _side(groups: DataFrame, side: str) -> DataFrame:
    names = {"doc_type": "doc", "value": "value", "std": "std", "n_docs": "n", "first_ord": "ord"}
    return groups.select(
        "case_id", "field", *[F.col(c).alias(f"{new}_{side}") for c, new in names.items() if c in groups.columns]
    )


def within_case_pairs(groups: DataFrame, condition: Column | None = None, with_self: bool = False) -> DataFrame:
    """Pairs of value groups of one (case, field), earlier position first, with ``n_pairs`` document pairs each.

    A group with several documents also pairs with itself; ``with_self`` keeps that row for single documents too (with
    ``n_pairs`` 0).
    """
    left = _side(groups, "a").withColumn("block", F.expr(f"ord_a div {BLOCK}"))
    right = _side(groups, "b").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"ord_b div {BLOCK}"))))
    same = F.col("ord_a") == F.col("ord_b")
    ordered = (F.col("ord_a") < F.col("ord_b")) | (same if with_self else same & (F.col("n_a") > 1))
    # Both sides grow with the data and size estimates miss the unpivot, so a broadcast is ruled out.
    joined = left.join(right, ["case_id", "field", "block"]).where(ordered if condition is None else ordered & condition)
    twice = F.col("n_a") * (F.col("n_a") - 1)
    return joined.withColumn(
        "n_pairs", F.when(same, F.shiftright(twice, 1)).otherwise(F.col("n_a") * F.col("n_b"))
    ).drop("block")


def judged(pairs: DataFrame) -> DataFrame:
    """Add status and detail to rows with field, value_a/b and std_a/b.

    The verdict comes out of a generator, so later filters on the status do not evaluate it a second time.
    """
    return pairs.select("*", F.inline(F.array(compare.pair_verdict())))


# ID numbers of different document types are never compared with each other.
_COMPARABLE = "field <> 'id_number' OR doc_a = doc_b"

COMPARISON_COLUMNS = [
    "case_id", "field", "doc_a", "doc_b", "value_a", "value_b", "status", "detail", "n_pairs", "ord_a", "ord_b",
]


def cross_doc_pairs(docs: DataFrame) -> DataFrame:
    """The comparisons of every case: all readable value pairs per field, with verdict and multiplicity."""
    pairs = within_case_pairs(readable_groups(docs), F.expr(_COMPARABLE))
    return judged(pairs).select(*COMPARISON_COLUMNS)


def classify_pairs(pairs: DataFrame) -> DataFrame:
    """Verdict on any table with field, value_a, value_b (extra columns pass through)."""
    both = [text.standard_form_of("field", f"value_{s}").alias(f"std_{s}") for s in "ab"]
    return judged(pairs.select("*", *both)).drop("std_a", "std_b")


# --- summaries ---------------------------------------------------------------------------------------------------------


def _count(condition: Column) -> Column:
    return F.sum(F.when(condition, F.col("n_pairs")).otherwise(0)).cast("long")


def verdict_summary(comparisons: DataFrame) -> DataFrame:
    names = {"matches": "MATCH", "variants": "VARIANT", "blockers": "CRITICAL", "uncertain": "UNCERTAIN"}
    counts = [_count(F.col("status") == status).alias(name) for name, status in names.items()]
    return comparisons.groupBy("case_id").agg(*counts)


def verdict_by_field(comparisons: DataFrame) -> DataFrame:
    return comparisons.groupBy("case_id", "field", "status").agg(F.sum("n_pairs").cast("long").alias("pairs"))


# --- who is wrong: votes and blocker counts ----------------------------------------------------------------------------


def judged_pairs(docs: DataFrame) -> DataFrame:
    """Every pair of readable values with its verdict: comparisons (see :func:`comparisons_of`) and what voting needs."""
    return judged(within_case_pairs(readable_groups(docs), with_self=True))


def comparisons_of(verdicts: DataFrame) -> DataFrame:
    return verdicts.where(_COMPARABLE).where("n_pairs > 0").select(*COMPARISON_COLUMNS)


VOTE_COLUMNS = ["case_id", "field", "doc_a", "doc_b", "n_pairs", "ord_a", "ord_b"]


def majority_vote(verdicts: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Each CRITICAL comparison with the number of documents that agree with either side.

    ``verdicts`` comes from :func:`judged_pairs`.  Every readable value of the case votes, whatever its document type.
    One pass: a pair in agreement sends a ballot to both sides, a critical pair asks both sides for their tally, and a
    window per value adds up.  Nothing is compared a second time.
    """
    columns = columns or VOTE_COLUMNS
    agree = F.col("status").isin("MATCH", "VARIANT")
    critical = (F.col("status") == "CRITICAL") & F.expr(_COMPARABLE)

    def ballot(ord_: str, votes: Column, side: Column) -> Column:
        return F.struct(F.col(ord_).alias("ord"), votes.alias("votes"), side.alias("side"))

    nobody = F.lit(None).cast("int")
    none, n_a, n_b = F.lit(0).cast("long"), F.col("n_a"), F.col("n_b")
    ballots = (
        F.when(critical, F.array(ballot("ord_a", none, F.lit(0)), ballot("ord_b", none, F.lit(1))))
        .when(F.col("ord_a") == F.col("ord_b"), F.array(ballot("ord_a", n_a, nobody)))
        .otherwise(F.array(ballot("ord_a", n_b, nobody), ballot("ord_b", n_a, nobody)))
    )
    payload = [c for c in columns if c not in ("case_id", "field")]
    asked = [F.when(critical, F.col(c)).alias(c) for c in payload]
    rows = verdicts.where(agree | critical).select("case_id", "field", *asked, F.inline(ballots))
    one_value = Window.partitionBy("case_id", "field", "ord")
    tallied = rows.withColumn("tally", F.sum("votes").over(one_value)).where("side IS NOT NULL")
    return tallied.groupBy(*columns).agg(
        *[F.max(F.when(F.col("side") == n, F.col("tally"))).alias(f"votes_{s}") for n, s in enumerate("ab")]
    )


def charged_documents(voted: DataFrame) -> DataFrame:
    """One row per document type charged with a critical comparison: the side with fewer votes, both on a tie."""
    a_is_odd, b_is_odd = F.col("votes_a") <= F.col("votes_b"), F.col("votes_b") <= F.col("votes_a")
    sides = F.array_compact(
        F.array(
            F.when(a_is_odd, F.struct(F.col("doc_a").alias("doc_type"), F.lit(0).alias("side"))),
            F.when(b_is_odd, F.struct(F.col("doc_b").alias("doc_type"), F.lit(1).alias("side"))),
        )
    )
    return voted.select("case_id", "field", "ord_a", "ord_b", "n_pairs", F.inline(sides))


def blocker_counts(voted: DataFrame) -> DataFrame:
    """Critical comparisons charged per case and document type, with the place of the first charge."""
    place = F.struct("ord_a", "ord_b", field_ord(F.col("field")).alias("field_ord"), "side")
    return (
        charged_documents(voted)
        .groupBy("case_id", "doc_type")
        .agg(F.sum("n_pairs").cast("long").alias("blockers"), F.min(place).alias("first_charge"))
    )


def primary_blocker(counts: DataFrame) -> DataFrame:
    """The document type with most blockers; among equals the one charged first."""
    best = F.min(F.struct((-F.col("blockers")).alias("rank"), "first_charge", "doc_type"))
    return (
        counts.groupBy("case_id")
        .agg(best.alias("best"))
        .select("case_id", F.col("best.doc_type").alias("primary_doc"), (-F.col("best.rank")).alias("blocker_count"))
    )


def other_doc_values(docs: DataFrame) -> DataFrame:
    """For each (document type, field): the readable values found on the other documents, as rows.

    Values of one document type collapse first; a value on several documents of the same type is listed as one row with
    its count, and a document lists the other values of its own type too.
    """
    groups = value_groups(readable_only(unpivot_fields(docs)))
    pairs = within_case_pairs(groups)
    side = lambda here, there, n: F.struct(
        F.col(f"doc_{here}").alias("doc_type"), F.col(f"value_{here}").alias("value"), F.col(f"doc_{there}").alias("other_doc"),
        F.col(f"value_{there}").alias("other_value"), n.alias("n_docs"),
    )
    both = F.array(side("a", "b", F.col("n_b")), side("b", "a", F.col("n_a")))
    own = F.array(side("a", "a", F.col("n_a") - 1))
    return pairs.select("case_id", "field", F.inline(F.when(F.col("ord_a") == F.col("ord_b"), own).otherwise(both)))
