"""Writing result packs and intermediate tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from milaan.session import shared_dir


def scratch_path(spark, name: str) -> str:
    return f"{shared_dir(spark)}/milaan/{name}-{uuid.uuid4().hex}"


def materialized(table: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back: cuts lineage, and outlives lost executors."""
    spark = table.sparkSession
    path = scratch_path(spark, name)
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def write_result_packs(packs: DataFrame, path: str) -> None:
    """JSON packs, one folder per service."""
    packs.write.partitionBy("service_id").mode("overwrite").json(path)
