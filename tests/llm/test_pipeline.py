"""The pipeline's stages: columns, order of work, awkward rows, and an empty table."""

import os

import pytest

import corpus_pipeline
from milaan.sources.writers import scratch_path
from tests.llm import brute
from tests.llm.test_operators import ROWS, SCHEMA

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark):
    """The small tables, but with awkward rows, extra columns and clashing names among the documents."""
    path = scratch_path(spark, "pipeline-test")
    docs = spark.createDataFrame([*ROWS, ROWS[6], (None, None, None, None, None, None, None, None, None)], SCHEMA)
    docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").selectExpr("doc_id + 1000 AS doc_id", "text", "lang", "source", "n_chars"), allowMissingColumns=True).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").selectExpr("doc_id + 1000 AS doc_id", "quality", "toxic").write.parquet(f"{path}/labels.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_keep_columns_and_only_drop(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    held = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, held, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        path = scratch_path(spark, f"test-{name}")
        out.write.parquet(path)
        held = spark.read.parquet(path)
        assert held.count() <= docs.count() and held.filter("score <> 'own'").count() == 0
    kept = [(r["doc_id"], r["text"]) for r in held.collect()]
    own = [r for r in brute.jaccard_classes(kept) if r[2]]
    assert not own
    mixed = corpus_pipeline.mix_sources(spark, held, folder)
    assert mixed.count() == len(kept) and {"size", "target", "taken", "copies"} <= set(mixed.columns)


def test_empty_tables_run_through(spark, folder):
    path = scratch_path(spark, "pipeline-empty")
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{path}/{t}.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_entry_survives_without_the_folder(tmp_path):
    """A copy of the repository without the folder still imports, with all other queries."""
    import shutil
    import subprocess
    import sys

    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    away = tmp_path / "repo"
    shutil.copytree(home, away, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "spark-warehouse", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), [n for n in e.queries() if n.startswith('op') and n[2].isdigit()], 'pipeline' in e.queries())"
    said = subprocess.run([sys.executable, "-c", code], cwd=away, capture_output=True, text=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert said.returncode == 0 and said.stdout.split()[1:] == ["[]", "False"], said.stderr
