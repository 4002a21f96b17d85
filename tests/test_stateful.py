"""Job states and bucket tables over several batches, with repeats and restarts, against their batch twins."""

import os
import random
import time

from medialoom.operators.ingest import job_counts, job_status, latest_rows
from medialoom.streaming.buckets import BucketTable
from medialoom.streaming import jobs
from medialoom.streaming.jobs import COUNTERS, JobStates, current_jobs, run_job_states
from medialoom.streaming.streams import dedupe_stream
from pyspark.sql import Row
from pyspark.sql import functions as F

EVENT = "event_id bigint, request_id string, outcome string"


def events(seed, n):
    rng = random.Random(seed)
    return [(i, f"r{rng.randint(0, 12)}", rng.choice(["queued", "success", "failed", "skipped", "skipped"])) for i in range(n)]


def put(spark, folder, name, rows, at=None):
    """Events a second apart, or all at ``at``; none at 0, where the watermark starts."""
    ts = F.timestamp_seconds(F.col("event_id") + 1 if at is None else F.lit(at))
    spark.createDataFrame(rows, EVENT).withColumn("ts", ts).coalesce(1).write.parquet(os.path.join(folder, name))


def stream(spark, folder):
    return spark.readStream.schema(EVENT + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(os.path.join(folder, "*"))


def test_job_states_over_batches_repeats_and_a_restart(spark, tmp_path):
    rows, folder = events(1, 120), str(tmp_path / "in")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    put(spark, folder, "a", rows[:40])
    put(spark, folder, "b", rows[30:70] + rows[:5])
    run_job_states(spark, stream(spark, folder), out, state, delay="1 day")
    half = {r.request_id: r for r in current_jobs(spark, out).collect()}
    assert sum(sum(r[c] for c in COUNTERS) for r in half.values()) == 70
    put(spark, folder, "c", rows[60:] + rows[60:])
    put(spark, folder, "d", rows[:120])  # nothing new: no version
    run_job_states(spark, stream(spark, folder), out, state, delay="1 day")
    got = {r.request_id: tuple(r) for r in current_jobs(spark, out).collect()}
    twin = job_counts(spark.createDataFrame(rows, EVENT)).withColumn("status", job_status())
    assert got == {r.request_id: tuple(r) for r in twin.collect()}
    changes = spark.read.parquet(out)
    assert changes.filter("reason = 'quiet'").count() == 0
    per = changes.groupBy("request_id").agg(F.max("version").alias("last"), F.count_distinct("version").alias("n"), F.count("*").alias("rows")).collect()
    assert all(r["last"] == r["n"] == r["rows"] for r in per)


def test_quiet_jobs_late_events_and_ids_that_leave(spark, tmp_path):
    folder, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    run = lambda: run_job_states(spark, stream(spark, folder), out, state, delay="10 seconds", quiet_ms=60_000, keep_ms=600_000)
    jobs = lambda: {r.request_id: tuple(r)[1:] for r in current_jobs(spark, out).collect()}
    put(spark, folder, "a", [(1, "open", "queued"), (2, "done", "success")])
    put(spark, folder, "b", [(3, "open", "success")], at=50)
    run()
    assert spark.read.parquet(out).filter("reason = 'quiet'").count() == 0
    put(spark, folder, "c", [(4, "other", "success")], at=200)  # the watermark passes 110
    run()
    quiet = spark.read.parquet(out).filter("reason = 'quiet'").collect()
    assert [(r.request_id, r.version, r.queued_count, r.success_count) for r in quiet] == [("open", 3, 1, 1)]
    put(spark, folder, "d", [(5, "open", "failed")], at=20)  # too late
    put(spark, folder, "e", [(3, "open", "success"), (6, "open", "failed")], at=195)  # a repeat and an event within the delay
    run()
    assert jobs()["open"] == (1, 1, 1, 0, "RUNNING")
    put(spark, folder, "f", [(7, "other", "success")], at=5_000)
    run()
    put(spark, folder, "g", [(1, "open", "queued")], at=5_001)  # its id has left the state, so it counts as new
    run()
    assert jobs() == {"open": (2, 1, 1, 0, "RUNNING"), "done": (0, 1, 0, 0, "COMPLETED"), "other": (0, 2, 0, 0, "COMPLETED")}


class Calls:
    """State and timers in memory that count how often they are called."""

    def __init__(self):
        self.calls, self.value, self.map, self.timers = 0, None, {}, set()

    def called(self, result=None):
        self.calls += 1
        return result

    def getValueState(self, name, schema):
        return self

    def getMapState(self, name, key, value):
        return self

    def exists(self):
        return self.called(self.value is not None)

    def get(self):
        return self.called(self.value)

    def update(self, value):
        self.value = self.called(value)

    def containsKey(self, key):
        return self.called(key in self.map)

    def updateValue(self, key, value):
        self.map[key] = self.called(value)

    def values(self):
        return self.called(iter(list(self.map.values())))

    def registerTimer(self, at):
        self.called(self.timers.add(at))

    def deleteTimer(self, at):
        self.called(self.timers.discard(at))

    def clear(self):
        self.called(self.map.clear())


def test_calls_of_the_state_do_not_grow_with_a_jobs_events(monkeypatch):
    monkeypatch.setattr(jobs, "BLOCK", 16, raising=False)
    state, job = Calls(), JobStates(10, 100)
    job.init(state)
    for n, lo in enumerate((0, 30, 10, 0)):
        ids = [*range(lo, lo + 60), lo]
        rows = [Row(event_id=i, outcome="queued", ms=1000 * i) for i in ids]
        state.calls = 0
        out = list(job.handleInputRows(("r",), iter(rows), None))
        assert state.calls <= 20
        assert [o["queued_count"] for o in out] == [[60], [90], [], []][n]
    assert state.timers == {89_010, 89_100} and len(state.map) == 5


VERSION = "user int, n int, value double, ts timestamp"


def versions(spark, rows):
    return spark.createDataFrame(rows, "user int, n int, value double, at bigint").select("user", "n", "value", F.timestamp_seconds("at").alias("ts"))


def table(spark, path, **more):
    schema = spark.createDataFrame([], VERSION).schema
    return BucketTable(spark, path, schema, ["user"], ["ts", "n"], "ts", buckets=8, **more)


def test_bucket_table_like_one_reduction(spark, tmp_path):
    rng = random.Random(2)
    rows = [(rng.randint(0, 60), i, rng.random(), rng.randint(0, 50)) for i in range(400)]
    kept = table(spark, str(tmp_path / "t"))
    assert kept.read().count() == 0 and kept.compact() == []
    for n in range(8):
        kept.write(versions(spark, rows[n * 50 : n * 50 + 50]), n)
        if n in (2, 5):
            kept.compact()
        if n == 5:
            kept.write(versions(spark, rows[200:250]), 4)  # a batch again, after it was taken in
            kept.clean()
    want = latest_rows(versions(spark, rows), ["user"], ["ts", "n"], "ts")
    same = lambda df: sorted(tuple(r) for r in df.select("user", "n", "value", "ts", "created_at").collect())
    assert same(kept.read()) == same(want)
    kept.compact()
    assert same(kept.read()) == same(want)
    assert kept.clean() > 0 and same(kept.read()) == same(want)
    assert table(spark, str(tmp_path / "t")).manifest() == kept.manifest()


def test_compaction_writes_only_changed_buckets(spark, tmp_path):
    kept = table(spark, str(tmp_path / "t"))
    kept.write(versions(spark, [(i, 0, 0.0, 1) for i in range(500)]), 0)
    assert len(kept.compact()) == 8
    before = set(kept.files("base/*/*/*.parquet"))
    kept.write(versions(spark, [(7, 1, 1.0, 2)]), 1)
    (bucket,) = kept.compact()
    new = set(kept.files("base/*/*/*.parquet")) - before
    assert new and all(f"bucket={bucket}/" in f for f in new)
    assert spark.read.parquet(*new).count() < 500 / 4
    assert kept.manifest()[bucket][0] == 2 and [g for b, (g, _) in kept.manifest().items() if b != bucket] == [1] * 7
    (row,) = kept.read().filter("user = 7").collect()
    assert (row.n, row.created_at.timestamp()) == (1, 1.0)


def test_few_rows_wait(spark, tmp_path):
    kept = table(spark, str(tmp_path / "t"), least_rows=40)
    kept.write(versions(spark, [(i, 0, 0.0, 1) for i in range(100)]), 0)
    assert kept.compact() == [] and kept.read().count() == 100
    kept.write(versions(spark, [(i, 1, 0.0, 2) for i in range(400)]), 1)
    assert len(kept.compact()) == 8 and kept.read().filter("n = 1").count() == 400


def test_log_rows_of_the_second_place_are_read(spark, tmp_path):
    from medialoom.streaming.streams import log_stream

    folder = str(tmp_path / "in")
    put(spark, folder, "a", [(i, "r", "success") for i in range(3)], at=86_400 * 20)
    put(spark, folder, "b", [(9, "r", "failed")], at=86_400)  # too old
    (tmp_path / "blocked").write_text("a file where the log's folder should be")
    for name, place in (("first", tmp_path / "log"), ("second", tmp_path / "blocked" / "log")):
        got = log_stream(spark, stream(spark, folder), "ts", str(place), str(tmp_path / name), 14)
        assert sorted(r.event_id for r in got.collect()) == [0, 1, 2]
        assert (tmp_path / name).exists() == (name == "second")


def test_dedupe_over_batches_forgets_what_is_past_the_horizon(spark, tmp_path):
    """Repeats within the horizon go, in whichever batch they come; an id whose time is past leaves it after a batch."""
    folder = str(tmp_path / "in")
    rows = [(i, f"r{i}", "queued") for i in range(100)]
    batches = [(rows[:60] + rows[:9], None), (rows[40:] + rows[20:50], None), (rows[95:] + [(500, "x", "queued")], 120), ([(600, "y", "queued")], 5_000), ([(700, "z", "queued")], 5_001), ([(1, "r1", "queued"), (600, "y", "queued")], 5_002)]
    for n, (batch, at) in enumerate(batches):
        put(spark, folder, f"b{n}", batch, at)
        time.sleep(1.1)  # files are taken in the order of their times
    out = dedupe_stream(spark, stream(spark, folder), "ts", ["event_id"], "150 seconds")
    assert sorted(r.event_id for r in out.collect()) == sorted([*range(100), 500, 600, 700, 1])
