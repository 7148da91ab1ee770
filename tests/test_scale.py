"""Hot groups: one case or conversation with most of the rows, checked against brute force."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from milaan.operators import dialogue, pairs, views
from milaan.sources import bridge

DDL = "case_id long, doc_ord int, doc_type string, source_file string, fields map<string,string>"


@pytest.fixture(scope="module")
def hot_docs(spark):
    rng = random.Random(3)
    rows = []
    for case, n in ((1, 3), (2, 700), (3, 5)):
        for i in range(n):
            fields = {
                "full_name": rng.choice(["Ravi Kumar", "Ravi Kr", "R Kumar", "Sita Devi", "UNCERTAIN"]),
                "dob": rng.choice(["14/06/1992", "14-06-1992", "15/06/1992", "N/A"]),
                "id_number": str(rng.choice([111, 222, 333])) if i % 3 else f"{case}-{i}",
                "gender": rng.choice(["M", "Male", "F"]),
            }
            rows.append((case, i, rng.choice(["Aadhaar Card", "PAN Card", "Voter ID"]), f"{i}.jpg", fields))
    return spark.createDataFrame(rows, DDL).repartition(8).cache()


def test_hot_case_counts_every_pair_once(spark, hot_docs):
    """Value groups and position blocks must account for exactly the pairs of the plain double loop."""
    got = {}
    for r in pairs.verdict_by_field(pairs.cross_doc_pairs(hot_docs)).collect():
        got[(r["case_id"], r["field"])] = got.get((r["case_id"], r["field"]), 0) + r["pairs"]
    want = {}
    docs = {}
    for r in hot_docs.collect():
        docs.setdefault(r["case_id"], []).append(r)
    for case, rows in docs.items():
        for a, b in itertools.combinations(rows, 2):
            for field in ("full_name", "dob", "id_number"):
                va, vb = a["fields"][field], b["fields"][field]
                if va in ("UNCERTAIN", "N/A") or vb in ("UNCERTAIN", "N/A") or (field == "id_number" and a["doc_type"] != b["doc_type"]):
                    continue
                want[(case, field)] = want.get((case, field), 0) + 1
    assert got == want


def test_hot_case_votes(spark, hot_docs):
    """Votes of a value are the documents that agree with it, whatever their type."""
    agree = {("14/06/1992", "14-06-1992"), ("14-06-1992", "14/06/1992")}
    seen = {}
    for r in hot_docs.collect():
        seen.setdefault(r["case_id"], []).append(r["fields"]["dob"])
    voted = pairs.majority_vote(
        pairs.judged_pairs(hot_docs), ["case_id", "field", "value_a", "value_b", "ord_a", "ord_b", "n_pairs", "doc_a", "doc_b"]
    ).where("field = 'dob'").collect()
    assert voted
    for r in voted:
        for side in "ab":
            value = r[f"value_{side}"]
            want = sum(v == value or (v, value) in agree for v in seen[r["case_id"]])
            assert r[f"votes_{side}"] == want


def test_hot_case_matrix_is_whole(spark, hot_docs):
    cells = views.matrix_cells(hot_docs).groupBy("case_id", "field").count().collect()
    sizes = {1: 3, 2: 700, 3: 5}
    assert {(r["case_id"], r["field"]): r["count"] for r in cells} == {
        (c, f): n for c, n in sizes.items() for f in ("full_name", "dob", "gender", "id_number")
    }


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_long_conversation_in_blocks(spark, monkeypatch, levels):
    """Running composed blocks equals walking the turns one by one, however deep the blocks are nested."""
    monkeypatch.setattr(dialogue, "BLOCK", 7)
    rng = random.Random(5)
    said = ["Sanika Chavan", "wrong", "14/06/1992", "Sa", "done", "Flat 12, CIDCO, Aurangabad", "", "please repeat"]
    rows = [(conv, "rto_dl_update", t, rng.choice(said)) for conv, n in ((1, 400), (2, 3)) for t in range(n)]
    turns = spark.createDataFrame(rows, "conv_id long, service_id string, turn long, transcript string")
    moved = dialogue.with_moves(turns)
    got = {(r["conv_id"], r["turn"]): r["before"] for r in dialogue.counts_before(moved, levels=levels).collect()}
    want, now = {}, {}
    for r in sorted(moved.collect(), key=lambda r: (r["conv_id"], r["turn"])):
        want[(r["conv_id"], r["turn"])] = now.get(r["conv_id"], 0)
        now[r["conv_id"]] = r["moves"][now.get(r["conv_id"], 0)]
    assert got == want


def test_entry_counts_continue_a_conversation(spark):
    turns = spark.createDataFrame([(1, "rto_dl_update", 10, "wrong"), (2, "rto_dl_update", 0, "wrong")], "conv_id long, service_id string, turn long, transcript string")
    entry = spark.createDataFrame([(1, 2)], "conv_id long, before int")
    run = dialogue.outcomes(dialogue.counts_before(dialogue.with_moves(turns), entry=entry))
    got = {r["conv_id"]: (r["update_key"], r["next_field"]) for r in run.collect()}
    assert got == {1: ("father_name", "father_name"), 2: (None, "full_name")}


def test_packs_have_one_shape_for_giant_cases(spark, hot_docs):
    from milaan.plans.verify import Verification

    forms = spark.createDataFrame([(c, "rto_dl_update", {"full_name": "Ravi Kumar"}) for c in (1, 2, 3)], "case_id long, service_id string, answers map<string,string>")
    packs = Verification(forms, hot_docs, F.lit("2026-01-01").cast("date")).packs.groupBy("case_id", "kind").count()
    assert {tuple(r) for r in packs.collect()} == {(1, "head", 1), (2, "head", 1), (3, "head", 1), (1, "document", 3), (2, "document", 700), (3, "document", 5)}


def test_no_join_without_keys(spark):
    """No registered plan may fall back to a nested-loop or Cartesian join."""
    from milaan.plans.registry import QUERIES

    for name in ("cross_doc_pairs", "majority_vote", "best_form_check", "case_score", "remediation_route", "scheme_match", "prefill_form"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan, name


def test_dialogue_stream_continues_over_batches(spark):
    """Turns that arrive in several files give the same outcomes as all turns at once."""
    import tempfile

    from milaan.streaming import jobs

    folder = tempfile.mkdtemp(prefix="run-")
    said = ["Sanika Chavan", "Santosh Chavan", "wrong", "Ravi Chavan", "15/08/2001", "Flat 12, CIDCO, Aurangabad", "done"]
    ddl = "conv_id long, service_id string, turn long, transcript string"
    rows = [(c, "rto_dl_update", t, said[t]) for c in (1, 2) for t in range(len(said)) if c == 1 or t < 4]
    for start in (0, 3, 5):
        part = [r for r in rows if start <= r[2] < {0: 3, 3: 5, 5: 99}[start]]
        spark.createDataFrame(part, ddl).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    got = {tuple(r) for r in jobs.form_fill_stream(stream, f"{folder}/job").collect()}
    want = {tuple(r) for r in dialogue.turn_outcomes(spark.createDataFrame(rows, ddl)).collect()}
    assert got == want and len(got) == len(rows)


def test_shuffles_follow_the_input_size(spark):
    from milaan import session

    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    session.size_shuffles(spark, 64 << 30)
    assert int(spark.conf.get(key)) == 1024
    session.size_shuffles(spark, 0)
    assert spark.conf.get(key) == spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.unset(key)


def test_streams_over_folder_tables_take_several_batches(spark, tmp_path):
    """Folder tables split into batches, with keys that return, give what the batch job gives; no input gives an empty frame."""
    from milaan.plans.registry import QUERIES, case_table
    from milaan.streaming import jobs

    folder, source = str(tmp_path), "/root/testdata/sf0.001"
    for name in ("events", "customer"):
        spark.read.parquet(f"{source}/{name}.parquet").repartition(3).write.parquet(f"{folder}/{name}.parquet")
    for part in ("turn < 2", "turn >= 2 AND turn < 5", "turn >= 5"):  # conversations return in later batches
        spark.read.parquet(f"{source}/conversations.parquet").where(part).coalesce(1).write.mode("append").parquet(f"{folder}/conversations.parquet")
    events = jobs.read_stream(spark, folder, "events")
    batches = jobs.run_to_end(events.select("user_id"), f"{folder}/job1").select("batch_id").distinct().count()
    assert batches == 3
    names = ["case_id", "user_id", "service_id", "citizen_label", "step", "notes", "form_reviewed", "status"]
    want = case_table(spark, folder).select(*names, F.unix_micros("updated_at").alias("updated_us"))
    assert sorted(map(str, QUERIES["case_patch_stream"](spark, folder).collect())) == sorted(map(str, want.collect()))
    for stream, batch in (("form_fill_stream", "turn_outcomes"), ("quarantine_stream", "extraction_failures")):
        assert sorted(map(str, QUERIES[stream](spark, folder).collect())) == sorted(map(str, QUERIES[batch](spark, folder).collect()))
    spark.read.parquet(f"{source}/events.parquet").limit(0).write.parquet(f"{folder}/none.parquet")
    nothing = jobs.run_to_end(jobs.read_stream(spark, folder, "none"), f"{folder}/job2")
    assert nothing.count() == 0 and "event_id" in nothing.columns


def test_late_uploads_are_not_lost(spark, tmp_path):
    from milaan.streaming import jobs

    ddl = "ts timestamp, case_id long, file_name string, size long"
    for n, day in enumerate(("2024-06-01", "2024-01-01", "2024-06-02")):
        rows = spark.sql(f"SELECT timestamp'{day}' AS ts, {n}L AS case_id, 'a' AS file_name, 1L AS size UNION ALL SELECT timestamp'{day}', 9L, 'a', 1L")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    kept = jobs.run_to_end(jobs.dedupe_upload_stream(stream), f"{tmp_path}/job")
    assert sorted(r["case_id"] for r in kept.collect()) == [0, 1, 2, 9]


def test_sparse_turn_numbers_need_no_long_list(spark, monkeypatch):
    """Time stamps as turn numbers: as many levels as they need, and no list longer than two blocks."""
    monkeypatch.setattr(dialogue, "BLOCK", 16)
    rng = random.Random(11)
    stamps = sorted(rng.sample(range(-50, 10**6), 600))
    said = ["Sanika Chavan", "wrong", "14/06/1992", "done", "Flat 12, CIDCO, Aurangabad"]
    rows = [(7, "rto_dl_update", t, rng.choice(said)) for t in stamps]
    turns = spark.createDataFrame(rows, "conv_id long, service_id string, turn long, transcript string")
    levels = dialogue.levels_for(turns)
    assert levels == 5
    at, longest = stamps, 0
    for level in range(levels):
        div = (lambda t: int(t / 16)) if level < levels - 1 else (lambda t: 0)
        longest = max(longest, *[sum(div(t) == b for t in at) for b in {div(t) for t in at}])
        at = sorted({div(t) for t in at})
    assert longest <= 2 * 16
    moved = dialogue.with_moves(turns)
    got = {r["turn"]: r["before"] for r in dialogue.counts_before(moved).collect()}
    now, want = 0, {}
    for r in sorted(moved.collect(), key=lambda r: r["turn"]):
        want[r["turn"]], now = now, r["moves"][now]
    assert got == want


def test_cases_of_one_row_group_are_dealt_over_tasks(spark, tmp_path):
    """A customer table is one small file; the forms and documents made of it must not be the work of one task, keys repeated or null."""
    n = 3 * bridge.CASES_PER_TASK
    rows = spark.range(n).selectExpr("IF(id % 2 = 0, 7, IF(id % 3 = 0, NULL, id)) AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey")
    rows.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    for made in (bridge.customers(spark, str(tmp_path)), bridge.forms(spark, str(tmp_path)).select("case_id")):
        sizes = [r["n"] for r in made.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
        assert sum(sizes) == n and len(sizes) == 3 and max(sizes) <= 1.1 * bridge.CASES_PER_TASK
    few = spark.range(5).selectExpr("id AS c_custkey", "1 AS c_nationkey")
    assert bridge.spread(few).rdd.getNumPartitions() == few.rdd.getNumPartitions()


def test_shuffles_get_partitions_for_the_cases_read(spark, tmp_path):
    """A small customer file can stand for far more rows than the session was started for; smaller tables take nothing away."""
    from milaan import session

    spark.range(200).selectExpr("id AS c_custkey", "1 AS c_nationkey").write.parquet(f"{tmp_path}/customer.parquet")
    before = spark.conf.get(session.INITIAL, None)
    try:
        bridge.customers(spark, str(tmp_path))
        assert spark.conf.get(session.INITIAL, None) == before
        rows, cases = spark.range(5).selectExpr("id AS c_custkey", "1 AS c_nationkey"), 900_000 * 6
        bridge.spread(rows, cases)
        assert int(spark.conf.get(session.INITIAL)) == -(-cases * bridge.CASE_BYTES // session.BYTES_PER_TASK) > 600
        bridge.customers(spark, str(tmp_path))
        assert int(spark.conf.get(session.INITIAL)) > 600
    finally:
        spark.conf.unset(session.INITIAL) if before is None else spark.conf.set(session.INITIAL, before)


def test_answers_are_written_key_by_key(spark, tmp_path):
    """No lambda that tries every arm for every key; the answers are those of the SQL text, keys repeated or null."""
    spark.sql("SELECT IF(id % 50 = 0, NULL, id % 400) AS c_custkey, IF(id % 7 = 0, NULL, CAST(id % 25 AS INT)) AS c_nationkey FROM range(500)").write.parquet(
        f"{tmp_path}/customer.parquet"
    )
    made = bridge.forms(spark, str(tmp_path))
    assert "transform(" not in made._jdf.queryExecution().optimizedPlan().toString()
    got = made.select("case_id", "service_id", F.explode("answers").alias("k", "v"))
    keys = F.explode(F.array(*[F.lit(k) for k in bridge.ANSWER_KEYS])).alias("k")
    want = spark.read.parquet(f"{tmp_path}/customer.parquet").select("*", keys).select(
        F.col("c_custkey").alias("case_id"), F.expr(bridge.SERVICE_OF_CASE).alias("service_id"), "k", F.expr(bridge.for_spark(bridge.ANSWER_VALUE)).alias("v")
    ).where("v IS NOT NULL")
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
