"""Streams: state per key only, expiry, late rows, restart and replay."""

import os
import random
import shutil

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from milaan.operators import cases, dialogue
from milaan.sources import bridge
from milaan.streaming import jobs, processors

SAID = ["Sanika Chavan", "Santosh Chavan", "wrong", "Ravi Chavan", "15/08/2001", "Flat 12, CIDCO, Aurangabad", "done", "", "again", "nonsense 1"]
TURNS = "conv_id long, service_id string, turn long, transcript string"


def arrive(frame, path):
    frame.coalesce(1).write.mode("append").parquet(path)


def stream_of(spark, path, ddl):
    return spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(path)


def state_rows(query_path, spark, batch=None):
    """Rows of the state variable of a finished query."""
    reader = spark.read.format("statestore").option("path", f"{query_path}/state")
    return reader.option("stateVarName", "newest").load().count()


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [(c, "rto_dl_update", t, SAID[(c + t) % len(SAID)]) for c in range(30) for t in range(c % 11 + 3)]
    return spark.createDataFrame(rows, TURNS)


def test_dialogue_state_survives_restarts_and_replays(spark, spoken, tmp_path):
    source, job = f"{tmp_path}/in", f"{tmp_path}/job"
    want = sorted(map(str, dialogue.turn_outcomes(spoken).collect()))
    for k in range(5):  # a query of its own for every batch: state comes back from the checkpoint
        arrive(spoken.where((F.col("turn") >= 3 * k) & (F.col("turn") < 3 * k + 3)), source)
        got = jobs.form_fill_stream(stream_of(spark, source, TURNS), job)
    assert sorted(map(str, got.collect())) == want
    # The last batch is taken as not committed: it runs again and overwrites its own output.
    last = max(int(n) for n in os.listdir(f"{job}/state/commits") if n.isdigit())
    os.rename(f"{job}/state/commits/{last}", f"{tmp_path}/commit")
    crc = f"{job}/state/commits/.{last}.crc"
    if os.path.exists(crc):
        os.rename(crc, f"{tmp_path}/crc")
    again = jobs.form_fill_stream(stream_of(spark, source, TURNS), job)
    assert sorted(map(str, again.collect())) == want


def test_a_batch_writes_its_own_conversations_only(spark, spoken, tmp_path):
    source, job = f"{tmp_path}/in", f"{tmp_path}/job"
    arrive(spoken, source)
    arrive(spoken.limit(0).unionByName(spark.createDataFrame([(7, "rto_dl_update", 99, "done")], TURNS)), source)
    rows = jobs.form_fill_stream(stream_of(spark, source, TURNS), job)
    assert rows.count() == spoken.count() + 1
    assert spark.read.parquet(f"{job}/out/batch_id=1").count() == 1


def test_idle_conversations_start_anew(spark, tmp_path):
    source, ddl = f"{tmp_path}/in", f"{TURNS}, ts timestamp"
    days = [("2024-01-01", 1, "Sanika Chavan"), ("2024-03-01", 2, "Ravi Kumar"), ("2024-03-02", 2, "Santosh Chavan"), ("2024-03-03", 1, "Sanika Chavan")]
    for n, (day, conv, said) in enumerate(days):
        arrive(spark.createDataFrame([(conv, "rto_dl_update", n, said)], TURNS).withColumn("ts", F.to_timestamp(F.lit(day))), source)
    got = {r["turn"]: r["update_key"] for r in jobs.form_fill_stream(stream_of(spark, source, ddl), f"{tmp_path}/job", idle="30 days").collect()}
    first = dialogue.required_fields(spark).where("service_id = 'rto_dl_update'").first()["required"]
    assert got == {0: first[0], 1: first[0], 2: first[1], 3: first[0]}


UPLOADS = "ts timestamp, case_id long, file_name string, size long"


def upload_days(spark, day, ids):
    return spark.createDataFrame([(i, "scan.jpg", 10) for i in ids], "case_id long, file_name string, size long").select(F.to_timestamp(F.lit(day)).alias("ts"), "*")


def test_upload_state_levels_off_and_late_rows_come_out(spark, tmp_path):
    source, job, sizes = f"{tmp_path}/in", f"{tmp_path}/job", []
    for week in range(6):  # 20 new uploads a week, each twice; remembered for ten days
        ids = range(20 * week, 20 * week + 20)
        arrive(upload_days(spark, f"2024-02-{1 + 4 * week:02d}", [*ids, *ids]), source)
        kept, late = jobs.split_uploads(stream_of(spark, source, UPLOADS), job, hold="10 days")
        sizes.append(state_rows(job, spark))
    assert kept.count() == 120 and late.count() == 0
    assert max(sizes) <= 80 and sizes[-1] <= 80 and sizes[-1] < 120
    arrive(upload_days(spark, "2024-02-01", [3, 500, 500]), source)  # forgotten, never seen
    arrive(upload_days(spark, "2024-02-20", [101, 600]), source)  # remembered, new
    kept, late = jobs.split_uploads(stream_of(spark, source, UPLOADS), job, hold="10 days")
    assert sorted(r["case_id"] for r in late.collect()) == [3, 500, 500]
    assert sorted(r["case_id"] for r in kept.collect()) == [*range(120), 600]


def told(batches, hold):
    """Upload by upload what should come out, times in microseconds and ``hold`` in milliseconds."""
    newest, top, out = {}, 0, []
    for rows in batches:
        mark, on_time = max(0, top - hold), {}
        for at, key in rows:
            if at is not None and at >= mark * 1000:
                on_time.setdefault(key, []).append(at)
        out += [(min(times), *key, "kept") for key, times in on_time.items() if key not in newest]
        out += [(at, *key, "late") for at, key in rows if key not in newest and key not in on_time]
        newest |= {key: max(*times, newest.get(key, times[0])) for key, times in on_time.items()}
        newest = {key: at for key, at in newest.items() if at // 1000 + 1 > mark}
        top = max([top, *[at // 1000 for at, _ in rows if at is not None]])
    return sorted(map(str, out))


def test_uploads_of_a_page_are_one_value_of_the_state_store(spark, tmp_path, monkeypatch):
    """However many keys come, the store is called per page; keys, first times, expiry and late rows are those of single keys."""
    monkeypatch.setattr(jobs, "UPLOAD_PAGES", 4, raising=False)
    rng, source, job, batches = random.Random(5), f"{tmp_path}/in", f"{tmp_path}/job", []
    names = ["a.jpg", "", None, 'b\nc"\\', "{\"x\":1}", "é漢\u2028\t", "a.jpg "]
    ids = [None, 2**60 + 1, 2**60 + 2, *range(-3, 20)]
    for n in range(6):  # twenty seconds are held, a batch is six seconds further and reaches back by thirty
        rows = []
        for _ in range(300):
            at = 1_700_000_000_000_000 + n * 6_000_000 + rng.randrange(-30_000, 10_000) * 1000 + rng.choice([0, 1, 999])
            rows.append((None if rng.random() < 0.02 else at, (rng.choice(ids), rng.choice(names), rng.choice([1, 2, None]))))
        batches.append([*rows, *rows[:20]])
        frame = spark.createDataFrame([(at, *key) for at, key in batches[-1]], "at long, case_id long, file_name string, size long")
        arrive(frame.select(F.timestamp_micros("at").alias("ts"), "case_id", "file_name", "size"), source)
    out = jobs.run_to_end(jobs.dedupe_upload_stream(stream_of(spark, source, UPLOADS), "20 seconds"), job)
    got = sorted(str(tuple(r)) for r in out.select(F.unix_micros("ts"), *jobs.UPLOAD_KEY, "outcome").collect())
    assert got == told(batches, 20_000) and any("'late'" in r for r in got) and any("'kept'" in r for r in got)
    assert state_rows(job, spark) <= 4


def test_uploads_are_packed_page_by_page(monkeypatch):
    monkeypatch.setattr(processors, "PACK_ROWS", 50)
    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 0, 1, 2, 3]), f'{{"n":{i}}}', i - 100) for i in range(230)]
    batches = [pa.RecordBatch.from_pylist([dict(zip(("page", "upload", "at"), r, strict=True)) for r in rows[i : i + 20]]) for i in range(0, 230, 20)]
    out = [r for b in processors.packed_uploads(iter([*batches, batches[0].slice(0, 0)])) for r in b.to_pylist()]
    each = [[(r["page"], *one) for one in processors.unpacked(r["uploads"], r["times"])] for r in out]
    assert sorted(x for some in each for x in some) == sorted(rows)
    assert max(map(len, each)) == processors.PACKED and len(out) < len(rows) / 5
    assert [*processors.packed_uploads(iter([]))] == []


PATCHES = "patch_id long, case_id long, user_id string, ts timestamp, step int, notes string"


@pytest.fixture
def known(spark):
    bare = spark.range(200).select(F.col("id").alias("case_id"), F.concat(F.lit("u"), F.expr("id % 10")).alias("user_id"))
    return cases.new_case_defaults(bare, F.to_timestamp(F.lit("2024-01-01")))


def patch(spark, rows):
    return spark.createDataFrame(rows, "patch_id long, case_id long, user_id string, ts string, step int, notes string").withColumn("ts", F.to_timestamp("ts"))


def table_files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def test_patches_rewrite_touched_buckets_only_and_replay_changes_nothing(spark, known, tmp_path):
    source, job = f"{tmp_path}/in", f"{tmp_path}/job"
    parts = [
        [(1, 5, "u5", "2024-01-05", 3, None), (2, 6, "u6", "2024-01-05", None, "six"), (3, 5, "u5", "2024-01-06", None, "five")],
        [(4, 5, "u5", "2024-01-04", 1, "early"), (5, 7, "u1", "2024-01-09", 9, "no owner"), (6, 999, "u9", "2024-01-09", 9, "unknown")],
        [(7, 5, "u5", "2024-01-06", 4, None)],
    ]
    want = cases.apply_case_patches(known, patch(spark, [r for p in parts for r in p]))
    for n, part in enumerate(parts):
        arrive(patch(spark, part), source)
        before = table_files(f"{job}/cases")
        got = jobs.case_patch_stream(stream_of(spark, source, PATCHES), job, known, buckets=16)
        after = table_files(f"{job}/cases")
        if n == 2:  # one case: the files of all other buckets are the ones that were there
            touched = {f.split("bucket=")[1].split("/")[0] for f in set(after) ^ set(before)}
            assert len(touched) == 1 and len(before) > 8
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    shutil.copytree(f"{job}/cases", f"{job}2/cases")  # a lost checkpoint: every patch once more, in one batch each
    again = jobs.case_patch_stream(stream_of(spark, source, PATCHES), f"{job}2", known, buckets=16)
    assert sorted(map(str, again.collect())) == sorted(map(str, want.collect()))


def test_streams_without_rows(spark, known, tmp_path):
    arrive(patch(spark, []), f"{tmp_path}/in")
    assert jobs.case_patch_stream(stream_of(spark, f"{tmp_path}/in", PATCHES), f"{tmp_path}/job", known).count() == 200
    arrive(spark.createDataFrame([], UPLOADS), f"{tmp_path}/up")
    assert [x.count() for x in jobs.split_uploads(stream_of(spark, f"{tmp_path}/up", UPLOADS), f"{tmp_path}/job2")] == [0, 0]


def test_arriving_cases_are_worked_out_once_a_batch_and_over_tasks(spark, tmp_path, monkeypatch):
    """Forms and documents of a batch are read from a written table of several files, however many tables are made of them."""
    n, files = 2 * bridge.CASES_PER_TASK, []
    arrive(spark.range(n).selectExpr("id AS c_custkey", "CAST(id % 25 AS INT) AS c_nationkey"), f"{tmp_path}/in")

    class Seen:
        def __init__(self, answers, docs, today, keep=False):
            if keep:
                files.append((set(answers.inputFiles()), set(docs.inputFiles()), answers.count()))
            self.verdicts = answers.select("case_id")

    monkeypatch.setattr(jobs, "Verification", Seen)
    stream = bridge.case_requests(bridge.spread(stream_of(spark, f"{tmp_path}/in", "c_custkey long, c_nationkey int"), n))
    assert jobs.verify_stream(stream, f"{tmp_path}/job", F.current_date()).count() == n
    (answers, docs, count), = files
    assert answers == docs and len(docs) == 2 and not any(f"{tmp_path}/in" in f for f in docs) and count == n
