"""The table jobs on streams.

Batch and stream share the same column expressions.  Sinks write one folder per micro-batch and overwrite it on a
replay, so a restarted query does not duplicate rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from milaan.operators import cases, dialogue
from milaan.plans.verify import Verification
from milaan.sources.readers import with_outcome
from milaan.sources.writers import materialized
from milaan.streaming.processors import FilledFields, FirstUpload, packed_uploads


def read_stream(spark: SparkSession, folder: str, table: str, files_per_batch: int = 1) -> DataFrame:
    """A parquet table as a stream, be it one file or a folder of part files; the schema is taken from the files."""
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    # A pattern, because a stream's path itself must not be a file.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/{table}.parque[t]")


def _write_batch(path: str) -> Callable[[DataFrame, int], None]:
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def run_to_end(
    stream: DataFrame, path: str, mode: str = "append", each: Callable | None = None, schema: T.StructType | None = None
) -> DataFrame:
    """Process everything available, then give back what was written (with its ``batch_id``), of ``schema`` if not the stream's own."""
    query = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(each or _write_batch(f"{path}/out"))
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return written(stream.sparkSession, f"{path}/out", schema or stream.schema)


def written(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The batches under a folder; an empty frame when none came."""
    known = T.StructType([f for f in schema.fields if f.name != "batch_id"] + [T.StructField("batch_id", T.LongType())])
    try:
        return spark.read.schema(known).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], known)


CASE_BUCKETS = 64


def case_patch_stream(patches: DataFrame, path: str, known: DataFrame, buckets: int = CASE_BUCKETS) -> DataFrame:
    """Case updates merged into a case table that is partitioned by key bucket; gives back the current case rows.

    A batch folds its patches, reads the buckets they fall in, and rewrites those alone (dynamic partition overwrite); the rest of
    the table is not touched.  Every value is stored with the place (time, patch id) it came from, so late patches lose to later
    ones of any batch, and a replayed batch changes nothing.  Patches of unknown cases or by others than the owner change no row.
    """
    spark = patches.sparkSession
    table = f"{path}/cases"
    stored = cases.with_places(known).withColumn("bucket", F.pmod(F.xxhash64("case_id"), F.lit(buckets)).cast("int"))
    try:
        spark.read.schema(stored.schema).parquet(table)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored.repartition("bucket").write.partitionBy("bucket").parquet(table)

    def upsert(batch: DataFrame, batch_id: int) -> None:
        folded = materialized(cases.folded_places(batch).withColumn("bucket", F.pmod(F.xxhash64("case_id"), F.lit(buckets)).cast("int")), "patches")
        touched = [r["bucket"] for r in folded.select("bucket").distinct().collect()]  # never more than ``buckets`` numbers
        if not touched:
            return
        held = spark.read.schema(stored.schema).parquet(table).where(F.col("bucket").isin(touched))
        merged = cases.merge_places(held, folded.drop("bucket"))
        merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)

    run_to_end(patches, path, each=upsert)
    return cases.without_places(spark.read.schema(stored.schema).parquet(table), known.columns)


UPLOAD_KEY = ["case_id", "file_name", "size"]
# How long an upload is remembered, in event time; older ones that still arrive are late.
UPLOAD_HOLD = "30 days"
# Groups of keys that are one value of the state store each.  It is part of a checkpoint: a running stream keeps its number.
UPLOAD_PAGES = 1 << 14
# Stands for no time while a number must; no timestamp is as early.
NEVER = -(1 << 63)


def dedupe_upload_stream(uploads: DataFrame, hold: str = UPLOAD_HOLD) -> DataFrame:
    """Uploads (ts and the key) with an ``outcome``: ``kept`` for the first of its key, ``late`` for those behind the watermark.

    Repeats of a key that is remembered come out in neither.  A key is state until the watermark, which follows the newest upload at
    the distance ``hold``, has passed its newest upload; then a timer removes it.  A late upload of no remembered key may be a
    repeat or not, so it is given back as late instead of being dropped unseen or kept for ever.

    A batch reads and writes the pages of its own keys only, each once, however many keys it has of a page.
    """
    seen = uploads.withWatermark("ts", hold)
    key = seen.select(*UPLOAD_KEY).schema
    # The watermark column ends here: Spark would drop late rows of it before the processor sees them.
    plain = seen.select(
        F.pmod(F.xxhash64(*UPLOAD_KEY), F.lit(UPLOAD_PAGES)).cast("int").alias("page"),
        F.to_json(F.struct(*UPLOAD_KEY)).alias("upload"),
        F.coalesce(F.unix_micros("ts"), F.lit(NEVER)).alias("at"),
    )
    rows = plain.mapInArrow(packed_uploads, "page int, uploads string, times binary")
    marked = rows.groupBy("page").transformWithStateInPandas(FirstUpload(), "upload string, at bigint, outcome string", "append", "EventTime")
    told = marked.select(F.timestamp_micros(F.nullif("at", F.lit(NEVER))).alias("ts"), F.from_json("upload", key).alias("key"), "outcome")
    return told.select("ts", "key.*", "outcome")


def split_uploads(uploads: DataFrame, path: str, hold: str = UPLOAD_HOLD) -> tuple[DataFrame, DataFrame]:
    """(kept, late): the two tables a stream of uploads is written to."""
    out = run_to_end(dedupe_upload_stream(uploads, hold), path)
    return tuple(out.where(F.col("outcome") == name).drop("outcome", "batch_id") for name in ("kept", "late"))


def verify_stream(cases_stream: DataFrame, path: str, today: Column) -> DataFrame:
    """Verify each arriving batch of complete cases (case_id, service_id, answers, documents array)."""

    def verify(batch: DataFrame, batch_id: int) -> None:
        # Forms and documents are read many times below: the arrivals are worked out once.
        held = materialized(batch, "arrivals")
        docs = held.select("case_id", F.posexplode("documents").alias("doc_ord", "d")).select("case_id", "doc_ord", "d.*")
        forms = held.select("case_id", "service_id", "answers")
        # Pair verdicts, checks and scores are written once per batch; counts and votes both read them.
        Verification(forms, docs, today, keep=True).verdicts.write.mode("overwrite").parquet(f"{path}/out/batch_id={batch_id}")

    spark = cases_stream.sparkSession
    empty = spark.createDataFrame([], cases_stream.schema)
    docs = empty.select("case_id", F.posexplode("documents").alias("doc_ord", "d")).select("case_id", "doc_ord", "d.*")
    shape = Verification(empty.select("case_id", "service_id", "answers"), docs, today).verdicts.schema
    return run_to_end(cases_stream, path, each=verify, schema=shape)


def quarantine_stream(scans: DataFrame, path: str) -> tuple[DataFrame, DataFrame]:
    """Scans split into a good sink and a quarantine sink, batch by batch."""

    def split(batch: DataFrame, batch_id: int) -> None:
        # One pass over the batch: the outcome is a column, and the sink splits by it.
        with_outcome(batch).write.mode("overwrite").partitionBy("outcome").parquet(f"{path}/out/batch_id={batch_id}")

    marked = with_outcome(scans.sparkSession.createDataFrame([], scans.schema))
    out = run_to_end(scans, path, each=split, schema=marked.schema)
    good = out.where("outcome = 'good'").drop("outcome", "error")
    failed = out.where("outcome = 'failed'").select("case_id", F.col("source_file").alias("file"), "doc_type", "error")
    return good, failed


# How long a conversation may rest, in event time, before its state is dropped and it starts anew.
IDLE = "30 days"


def form_fill_stream(turns: DataFrame, path: str, idle: str = IDLE) -> DataFrame:
    """Form dialogue on a stream: every batch continues the conversations where the batches before left them.

    The state of a conversation is its number of filled fields, one value in Spark's state store; a batch reads and writes that of its
    own conversations only.  Where turns have a time ``ts``, a timer drops the state of a conversation that has rested for ``idle``;
    without one it stays.  No turn is dropped for being late.
    """
    timed = "ts" in turns.columns
    moved = dialogue.with_moves(turns.withWatermark("ts", idle) if timed else turns).drop("required")
    # As with uploads, the watermark column ends before the processor.
    plain = moved.withColumn("at", F.unix_micros("ts") if timed else F.lit(0).cast("long")).drop("ts")
    shape = T.StructType([*plain.schema.fields, T.StructField("before", T.IntegerType())])
    run = plain.groupBy("conv_id").transformWithStateInPandas(FilledFields(timed), shape, "append", "EventTime" if timed else "None")
    return run_to_end(dialogue.outcomes(run.join(dialogue.required_fields(turns.sparkSession), "service_id")), path).drop("batch_id")
