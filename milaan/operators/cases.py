"""The case table: defaults for new rows, updates, recent rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PATCHABLE = ["service_id", "citizen_label", "step", "answers", "extractions", "verify_result", "notes",
             "form_reviewed", "ocr_reviewed", "status"]


def new_case_defaults(payloads: DataFrame, now: Column) -> DataFrame:
    """Fill what a new case leaves out."""
    defaults = {
        "step": F.lit(0), "answers": F.lit("{}"), "extractions": F.lit("[]"), "notes": F.lit(""),
        "form_reviewed": F.lit(False), "ocr_reviewed": F.lit(False), "status": F.lit("draft"),
    }
    filled = {}
    for name, default in defaults.items():
        given = F.col(name) if name in payloads.columns else F.lit(None)
        if name in ("answers", "extractions", "status"):
            given = F.nullif(given.cast("string"), F.lit(""))
        filled[name] = F.coalesce(given, default)
    return payloads.withColumns({**filled, "created_at": now, "updated_at": now})


def folded_patches(patches: DataFrame) -> DataFrame:
    """Per case and user the last non-null value of every column by (ts, patch_id).  One map-side-combined aggregation.

    Works on a batch and on a stream (streaming aggregation keeps one row of state per case and user).
    """
    place = F.struct("ts", "patch_id")
    columns = [c for c in PATCHABLE if c in patches.columns]
    last = [F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns]
    return patches.groupBy("case_id", "user_id").agg(*last, F.max("ts").alias("patched_at"))


def apply_case_patches(cases: DataFrame, patches: DataFrame) -> DataFrame:
    """Current case rows after the updates.  A patch counts only for a known case and only from its owner; keys never change."""
    return merge_folded(cases, folded_patches(patches))


def merge_folded(cases: DataFrame, folded: DataFrame) -> DataFrame:
    """Case rows with folded patches (one row per case and user) merged in."""
    columns = [c for c in folded.columns if c not in ("case_id", "user_id", "patched_at")]
    merged = cases.alias("c").join(folded.alias("p"), ["case_id", "user_id"], "left")
    out = []
    for name in cases.columns:
        if name in columns:
            out.append(F.coalesce(f"p.{name}", f"c.{name}").alias(name))
        elif name == "updated_at":
            out.append(F.coalesce("p.patched_at", "c.updated_at").alias(name))
        else:
            out.append(F.col(name) if name in ("case_id", "user_id") else F.col(f"c.{name}").alias(name))
    return merged.select(*out)


def with_places(known: DataFrame) -> DataFrame:
    """Case rows as they are stored between batches: beside every patchable value the (ts, patch_id) it came from, null at first."""
    columns = [c for c in PATCHABLE if c in known.columns]
    place = F.lit(None).cast("struct<ts:timestamp,patch_id:bigint>")
    return known.withColumns({**{f"{c}_from": place for c in columns}, "patched_at": F.lit(None).cast("timestamp")})


def folded_places(patches: DataFrame) -> DataFrame:
    """Per case and user the last non-null value of every column, with its place.  One map-side-combined aggregation."""
    place = F.struct(F.col("ts").cast("timestamp").alias("ts"), F.col("patch_id").cast("bigint").alias("patch_id"))
    columns = [c for c in PATCHABLE if c in patches.columns]
    last = [F.max_by(F.struct(F.col(c).alias("v"), place.alias("at")), F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns]
    return patches.groupBy("case_id", "user_id").agg(*last, F.max(F.col("ts").cast("timestamp")).alias("patched_at"))


def merge_places(held: DataFrame, folded: DataFrame) -> DataFrame:
    """Stored rows after folded patches: a value gives way to one from a later place, so merging twice is merging once."""
    columns = [c for c in folded.columns if c not in ("case_id", "user_id", "patched_at")]
    met = held.alias("c").join(folded.alias("p"), ["case_id", "user_id"], "left")
    out = {c: F.col(c) if c in ("case_id", "user_id") else F.col(f"c.{c}") for c in held.columns}
    for c in columns:
        later = F.col(f"p.{c}.at").isNotNull() & (F.col(f"c.{c}_from").isNull() | (F.col(f"p.{c}.at") > F.col(f"c.{c}_from")))
        out[c] = F.when(later, F.col(f"p.{c}.v")).otherwise(F.col(f"c.{c}"))
        out[f"{c}_from"] = F.when(later, F.col(f"p.{c}.at")).otherwise(F.col(f"c.{c}_from"))
    out["patched_at"] = F.greatest("c.patched_at", "p.patched_at")
    return met.select(*[out[c].alias(c) for c in held.columns])


def without_places(stored: DataFrame, columns: list[str]) -> DataFrame:
    """Case rows out of stored ones."""
    return stored.withColumn("updated_at", F.coalesce("patched_at", "updated_at")).select(*columns)


def recent_cases(cases: DataFrame, limit: int = 20) -> DataFrame:
    """The latest cases of each user .  Spark trims every partition to the limit before the shuffle."""
    latest = Window.partitionBy("user_id").orderBy(F.col("updated_at").desc(), F.col("case_id"))
    return cases.withColumn("place", F.row_number().over(latest)).where(F.col("place") <= limit)
