"""Rules with timers on streams: an availableNow run gives the batch rows; state goes; late rows are dropped or written aside."""

from __future__ import annotations

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from osteon.streaming import jobs

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
T0 = 1_700_000_000
JOB = "event string, id string, s double, tool string, status string"
ACCESS = "method string, path string, s double, status int, duration_s double"


@pytest.fixture(scope="module", autouse=True)
def rocksdb(spark):
    names = {"spark.sql.streaming.stateStore.providerClass": ROCKS, "spark.sql.shuffle.partitions": "2"}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v) if v is not None else spark.conf.unset(n)


def timed(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("ts", F.timestamp_micros((F.lit(T0 * 1_000_000) + F.round(F.col("s") * 1e6)).cast("long"))).drop("s")


def run(spark, tmp_path, batches, rule, delay="10 seconds"):
    """Rows of a rule on a stream that gets the batches one by one, and the state rows of its batches."""
    folder, seen = tmp_path / "in", set()
    for i, b in enumerate(batches):
        b.coalesce(1).write.mode("append").parquet(str(folder))
        for f in set(folder.glob("part-*")) - seen:
            os.utime(f, (T0 + i, T0 + i))
            seen.add(f)
    stream = spark.readStream.schema(batches[0].schema).option("maxFilesPerTrigger", 1).parquet(str(folder)).withWatermark("ts", delay)
    q = rule(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    assert q.awaitTermination(200)
    return spark.read.parquet(str(tmp_path / "out")).collect(), [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]


def job_rows(seed):
    """30 jobs in four batches, out of order by up to 8 seconds, some without an end, some read-only, one start twice; then a far one."""
    r, rows = random.Random(seed), []
    for i in range(30):
        at, took = r.uniform(0, 100), r.choice([1.0, 4.999, 5.0, 22.0, 75.5, None])
        tool = r.choice(["crop", "smooth", "list"])
        rows.append(("start", f"j{i}", at, tool, None))
        if took is not None:
            rows.append(("end", f"j{i}", at + took, tool, "done"))
    rows += [rows[0], ("start", None, 3.0, "crop", None)]
    rows.sort(key=lambda x: x[2] + r.uniform(0, 8))
    return [rows[i * len(rows) // 4:(i + 1) * len(rows) // 4] for i in range(4)]


FAR = [("start", "far", 5000.0, "list", None)]


def test_promotion_on_a_stream(spark, tmp_path):
    parts = job_rows(1)
    batches = [timed(spark, p, JOB) for p in [*parts, FAR, [("end", "far", 1.0, "list", "done"), ("end", "late", 2.0, "crop", "done")]]]
    got, state = run(spark, tmp_path, batches, jobs.promote_jobs_stream)
    all_rows = timed(spark, [x for p in parts for x in p if x[1]], JOB)
    want = {r.id for r in jobs.promote_jobs(jobs.job_pairing(all_rows)).collect()}
    assert len(got) == len({r.id for r in got}) and {r.id for r in got} == want and want
    assert all((r["at"] - r.start).total_seconds() == 5.0 for r in got)
    # the late rows are dropped, and of the state only the far start and its timer are left
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 2
    assert state[-1]["numRowsTotal"] < max(s["numRowsTotal"] for s in state) / 4


def test_heartbeats_on_a_stream(spark, tmp_path):
    parts = job_rows(2)
    got, state = run(spark, tmp_path, [timed(spark, p, JOB) for p in [*parts, FAR]], jobs.heartbeat_stream)
    pairs = jobs.job_pairing(timed(spark, [x for p in parts for x in p if x[1]], JOB))
    want = {(r.id, r.after) for r in jobs.heartbeats(pairs).collect()}
    open_jobs = {r.id for r in pairs.where("end IS NULL").collect()}
    assert {(r.id, r.after) for r in got if r.id not in open_jobs} == want and want
    assert len(got) == len({(r.id, r.after) for r in got})
    starts = {r.id: r.start.timestamp() for r in pairs.collect()}
    for name in open_jobs:  # told of until the watermark, ten seconds behind the far row
        told = sorted(r.after for r in got if r.id == name)
        assert told == list(range(20, int(T0 + 4990 - starts[name]) + 1, 30))


def test_heartbeats_by_the_time_of_day(spark, tmp_path):
    timed(spark, [("start", "a", 0.0, "crop", None)], JOB).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = jobs.heartbeat_stream(stream, 1, 2, by_processing=True).writeStream.format("memory").queryName("beats").start()
    try:
        until = time.monotonic() + 60
        while time.monotonic() < until and spark.table("beats").count() < 2:
            time.sleep(1)
        assert [tuple(r) for r in spark.table("beats").orderBy("after").limit(2).collect()] == [("a", 1), ("a", 3)]
    finally:
        q.stop()


def access_rows(seed):
    r, rows, t = random.Random(seed), [], 0.0
    for _ in range(150):
        t += r.choice([0.0, 0.3, 0.9, 0.999999, 1.0, 0.7, 4.0])
        path = r.choice(["/a", "/a", "/a", "/x.png", "/y.css"])
        rows.append((r.choice(["GET", "GET", "GET", "POST"]), path, round(t, 6), r.choice([200, 200, 204, 404]), r.choice([0.25, 0.5, 2.0, None])))
    rows += [("GET", None, 1.0, 200, 1.0), (None, "/a", 1.0, 200, 1.0), ("GET", "/a", 1.0, None, 1.0)]
    rows += [("GET", "/busy", 3598.0 + i * 0.5, 200, 0.25) for i in range(40)]  # a burst over a full hour
    return rows


def brute(rows, quiet=1.0, every=5.0):
    lists = {}
    for m, p, t, s, d in rows:
        if m is not None and p is not None and s is not None and s < 400:
            lists.setdefault((m, "assets" if p.endswith((".png", ".css")) else p), []).append((round(t * 1e6), s, d or 0.0))
    out = set()
    for key, times in lists.items():
        times.sort()
        bursts = []
        for row in times:
            if bursts and row[0] - bursts[-1][-1][0] < quiet * 1e6:
                bursts[-1].append(row)
            else:
                bursts.append([row])
        for b in bursts:
            start, end, told, mark = b[0][0], b[-1][0] + round(quiet * 1e6), 0, 1
            marks = []
            while start + mark * every * 1e6 < end:
                marks.append((start + round(mark * every * 1e6), False))
                mark += 1
            for at, finished in [*marks, (end, True)]:
                some = [x for x in b if x[0] <= at]
                if finished or len(some) > told:
                    out.add((*key, start, at, finished, len(some), round(sum(x[2] for x in some), 6), max(x[2] for x in some), tuple(sorted({x[1] for x in some}))))
                    told = len(some)
    return out


def as_set(rows):
    us = lambda t: round((t.timestamp() - T0) * 1e6)
    out = [(r.method, r.endpoint, us(r.start), us(r["at"]), r.finished, r.n, round(r.total, 6), r.longest, tuple(r.statuses)) for r in rows]
    assert len(out) == len(set(out))
    return set(out)


@pytest.mark.parametrize(("quiet", "every"), [(1.0, 5.0), (4.5, 2.0), (1.0, 0.5)])
def test_burst_progress(spark, quiet, every):
    rows = access_rows(3)
    got = as_set(jobs.burst_progress(timed(spark, rows, ACCESS), quiet, every).collect())
    assert got == brute(rows, quiet, every) and any(not r[4] for r in got)
    assert jobs.burst_progress(timed(spark, [], ACCESS)).count() == 0


def test_burst_progress_on_a_stream(spark, tmp_path):
    rows = access_rows(4)
    mixed = sorted(rows, key=lambda x: x[2] + random.Random(x[2]).uniform(0, 8))
    parts = [mixed[i * len(mixed) // 4:(i + 1) * len(mixed) // 4] for i in range(4)]
    far = [("GET", "/far", 9000.0, 200, 0.0)]
    late = [("GET", "/a", 0.5, 200, 0.0)]
    got, state = run(spark, tmp_path, [timed(spark, p, ACCESS) for p in [*parts, far, late]], jobs.burst_progress_stream)
    assert as_set(got) == brute(rows)
    assert sum(s["numRowsDroppedByWatermark"] for s in state) == 1


def test_dead_letters(spark, tmp_path):
    batches = [[("GET", "/a", 100.0, 200, 1.0), ("GET", "/b", 0.0, 200, 1.0)], [("GET", "/c", 89.0, 200, 1.0), ("GET", "/d", 91.0, 200, 1.0), ("GET", "/e", None, 200, 1.0)], [("GET", "/f", 500.0, 200, 1.0)]]
    kept = []
    sink = jobs.with_dead_letters(str(tmp_path / "dead"), str(tmp_path / "marks"), 10, lambda df, n: kept.extend((n, r.path) for r in df.collect()))
    for n in (0, 1, 1, 2):  # the second batch is run again
        sink(timed(spark, batches[n], ACCESS), n)
    assert sorted(set(kept)) == [(0, "/a"), (0, "/b"), (1, "/d"), (2, "/f")]
    assert sorted((r.batch, r.path) for r in spark.read.parquet(str(tmp_path / "dead")).collect()) == [(1, "/c"), (1, "/e")]
