"""Jobs, progress and access events; each rule takes a batch or a streaming DataFrame where its docstring says so.

Streams are expected to carry a watermark on ts. Rows behind it are Spark's to drop; with_dead_letters writes them aside.
The rules with timers (promote_jobs_stream, burst_progress_stream, heartbeat_stream) need the RocksDB state store:
spark.sql.streaming.stateStore.providerClass.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Tools that never count as a job, and requests that poll.
READ_ONLY = ("list", "status", "preview")
POLLS = ("view", "progress")


def between(start: str, end: Column) -> Column:
    """Seconds from a column to another, of either kind of timestamp."""
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(F.col(start).cast("timestamp"))) / 1e6


def job_pairing(events: DataFrame) -> DataFrame:
    """id, tool, start, end, seconds, status of every start; without an end it is interrupted. Batch; duplicates: the first start and end."""
    start = events.where("event = 'start'").groupBy("id").agg(F.min_by("tool", "ts").alias("tool"), F.min("ts").alias("start"))
    end = events.where("event = 'end'").groupBy("id").agg(F.min("ts").alias("end"), F.min_by("status", "ts").alias("ended"))
    seconds = between("start", F.col("end"))
    return start.join(end, "id", "left").select("id", "tool", "start", "end", seconds.alias("seconds"), F.when(F.col("end").isNull(), "interrupted").otherwise(F.col("ended")).alias("status"))


def job_pairing_stream(starts: DataFrame, ends: DataFrame, delay: str = "10 minutes", most: str = "1 hour") -> DataFrame:
    """The same on streams: a left outer join with watermarks; a start whose end is over `most` late is interrupted."""
    s = starts.withWatermark("ts", delay).select(F.col("id").alias("s_id"), "tool", F.col("ts").alias("start"))
    e = ends.withWatermark("ts", delay).select(F.col("id").alias("e_id"), F.col("ts").alias("end"), F.col("status").alias("ended"))
    j = s.join(e, F.expr(f"s_id = e_id AND end >= start AND end <= start + interval {most}"), "left_outer")
    return j.select(F.col("s_id").alias("id"), "tool", "start", "end", F.when(F.col("end").isNull(), "interrupted").otherwise(F.col("ended")).alias("status"))


def promote_jobs(jobs: DataFrame, least: float = 5.0) -> DataFrame:
    """Requests of at least `least` seconds (or without an end) that aren't read-only. Batch or stream."""
    return jobs.where(((F.col("seconds") >= least) | F.col("seconds").isNull()) & ~F.col("tool").isin(*READ_ONLY))


def admitted(events: DataFrame, *keys: str) -> DataFrame:
    """Events with a time and all keys: others belong to no job or burst. The time also as ts_us, whatever the session's time zone."""
    out = events.where(F.col("ts").isNotNull())
    for k in keys:
        out = out.where(F.col(k).isNotNull())
    return out.withColumn("ts_us", F.unix_micros(F.col("ts").cast("timestamp")))


class _Job(StatefulProcessor):
    """Keeps the first start and end of a job; what is due is decided when the clock passes its time.

    The clock is the watermark, or with by_processing the time of day. The state goes when the job is decided, and what has an end
    only goes with the clock, since its start can't come any more.
    """

    by_processing = False

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "start long, tool string, end long, next long")

    def clock(self, timers) -> int:
        return (timers.getCurrentProcessingTimeInMs() if self.by_processing else timers.getCurrentWatermarkInMs()) * 1000

    def wake(self, at: int) -> None:
        """A timer at the first whole millisecond that is not before `at`."""
        due = -(-at // 1000)
        if due not in set(self.handle.listTimers()):
            self.handle.registerTimer(due)

    def forget(self) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.job.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        start, tool, end, due = self.job.get() if self.job.exists() else (None, None, None, None)
        now = self.clock(timerValues)
        for f in rows:
            for event, t, name in zip(f["event"], f["ts_us"], f["tool"], strict=True):
                t = now if self.by_processing else int(t)
                if event == "start" and (start is None or t < start):
                    start, tool = t, None if pd.isna(name) else name
                elif event == "end" and (end is None or t < end):
                    end = t
        if start is None and end is None:
            return
        if start is not None and due is None:
            due = self.first
        self.job.update((start, tool, end, due))
        self.wake(end if start is None else start + due)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.job.exists():
            return
        start, tool, end, due = self.job.get()
        now = self.clock(timerValues)
        if start is None:
            if now >= end:
                self.forget()
            return
        if start + due > now:  # an earlier start came after the timer was set, or the timer of an end
            self.wake(start + due)
            return
        yield from self.decide(key[0], start, tool, end, due, now)

    def close(self) -> None:
        pass


class _Promotion(_Job):
    def __init__(self, least: float) -> None:
        self.first = round(least * 1e6)

    def decide(self, name, start, tool, end, due, now) -> Iterator[pd.DataFrame]:
        self.forget()
        if tool not in READ_ONLY and tool is not None and (end is None or end - start >= due):
            yield pd.DataFrame({"id": [name], "tool": [tool], "start_us": [start], "at_us": [start + due]})


class _Notices(_Job):
    def __init__(self, first: int, every: int, by_processing: bool) -> None:
        self.first, self.every, self.by_processing = first * 1_000_000, every * 1_000_000, by_processing

    def decide(self, name, start, tool, end, due, now) -> Iterator[pd.DataFrame]:
        until = now if end is None else min(now, end)
        told = list(range(due, until - start + 1, self.every))
        if end is not None and end <= now:
            self.forget()
        else:
            due += self.every * len(told)
            self.job.update((start, tool, end, due))
            self.wake(start + due)
        if told:
            yield pd.DataFrame({"id": name, "after": [t // 1_000_000 for t in told]})


def promote_jobs_stream(events: DataFrame, least: float = 5.0) -> DataFrame:
    """promote_jobs on a stream of start and end events with a watermark: id, tool, start and at, the time at which a request became a job.

    A row comes out once the watermark has passed start + least, so an end in time is known by then, in whatever order rows arrive.
    Of repeated starts and ends the first counts; a start that comes after its id was decided is a new job. Rows without id, ts or
    tool make no job, and an end before its start is forgotten with the watermark.
    """
    rows = admitted(events, "id").select("id", "event", "tool", "ts", "ts_us")
    out = rows.groupBy("id").transformWithStateInPandas(_Promotion(least), "id string, tool string, start_us long, at_us long", "append", "EventTime")
    return out.select("id", "tool", F.timestamp_micros("start_us").alias("start"), F.timestamp_micros("at_us").alias("at"))


def stem(label: Column) -> Column:
    """The label without digits, its first 40 characters."""
    return F.substring(F.trim(F.regexp_replace(label, "[0-9]+", "")), 1, 40)


def background_sessions(progress: DataFrame, silence: str = "120 seconds") -> DataFrame:
    """Sessions of progress rows (user_id, ts, label, progress) of one stem, ended by silence. Batch or stream."""
    return progress.groupBy("user_id", stem(F.col("label")).alias("stem"), F.session_window("ts", silence).alias("w")).agg(F.count("*").alias("n"), F.max("progress").alias("progress")).select("user_id", "stem", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "progress")


def progress_normalise(c: Column) -> Column:
    """Over 1 counts as percent; clamped to 0 to 1."""
    return F.least(F.greatest(F.when(c > 1, c / 100).otherwise(c), F.lit(0.0)), F.lit(1.0))


def eta(fraction: Column, seconds: Column) -> Column:
    """Remaining seconds, linearly; only from 3 % on, before the end, and after 20 seconds."""
    return F.when((fraction >= 0.03) & (fraction < 1) & (seconds >= 20), seconds * (1 - fraction) / fraction)


def step_durations(steps: DataFrame) -> DataFrame:
    """Seconds from each step (job, ts, step) to the next, the last to the job's end (end_ts). Batch."""
    w = W.partitionBy("job").orderBy("ts", "step")
    until = F.coalesce(F.lead("ts").over(w), F.col("end_ts"))
    return steps.select("job", "step", "ts", between("ts", until).alias("seconds"))


def access_bursts(events: DataFrame, quiet: str = "1 second") -> DataFrame:
    """Successes by method and endpoint until a second is quiet: count, total, longest, statuses. Batch or stream.

    events: ts, method, path, status, duration_s. Assets are one endpoint; failures go to access_failures; a 409 on a poll is background.
    """
    endpoint = F.when(F.col("path").rlike(r"\.(js|css|png|svg|ico)$"), "assets").otherwise(F.col("path"))
    ok = events.where("status < 400").withColumn("endpoint", endpoint)
    s = ok.groupBy("method", "endpoint", F.session_window("ts", quiet).alias("w")).agg(F.count("*").alias("n"), F.sum("duration_s").alias("total"), F.max("duration_s").alias("longest"), F.array_sort(F.collect_set("status")).alias("statuses"))
    return s.select("method", "endpoint", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total", "longest", "statuses")


def successes(events: DataFrame) -> DataFrame:
    """method, endpoint, ts, ts_us, status and duration_s of successes, as in access_bursts; rows without a time or a method count as absent, a missing duration as 0."""
    endpoint = F.when(F.col("path").rlike(r"\.(js|css|png|svg|ico)$"), "assets").otherwise(F.col("path")).alias("endpoint")
    ok = admitted(events.where("status < 400"), "method", "path")
    return ok.select("method", endpoint, "ts", "ts_us", F.col("status").cast("int").alias("status"), F.coalesce(F.col("duration_s").cast("double"), F.lit(0.0)).alias("duration_s"))


REPORT = "method string, endpoint string, start_us long, at_us long, finished boolean, n long, total double, longest double, statuses array<int>"
_FIELDS = ["method", "endpoint", "timestamp_micros(start_us) AS start", "timestamp_micros(at_us) AS at", "finished", "n", "total", "longest", "statuses"]


def burst_progress(events: DataFrame, quiet: float = 1.0, every: float = 5.0) -> DataFrame:
    """Bursts with a row of the counts so far every `every` seconds while they go on, and a finished row when they have been quiet. Batch.

    method, endpoint, start, at, finished, n, total, longest, statuses. A row at start + k * every counts the rows until then; there is
    none where no row is new, or once the burst has been quiet. at of a finished row is the last row's time plus `quiet`.
    Starts are found within hours, then across them by one row an hour, so that a busy endpoint is spread over tasks.
    """
    q, e = round(quiet * 1e6), round(every * 1e6)
    key = ["method", "endpoint"]
    rows = successes(events).withColumn("hour", F.floor(F.col("ts_us") / 3_600_000_000))
    hours = rows.groupBy(*key, "hour").agg(F.max("ts_us").alias("newest")).select(*key, "hour", F.lag("newest").over(W.partitionBy(*key).orderBy("hour")).alias("before"))
    within = W.partitionBy(*key, "hour").orderBy("ts_us")
    rows = rows.join(hours, [*key, "hour"]).withColumn("was", F.coalesce(F.lag("ts_us").over(within), "before"))
    rows = rows.withColumn("own", F.when(F.col("was").isNull() | (F.col("ts_us") - F.col("was") >= q), F.col("ts_us")))
    rows = rows.withColumn("own", F.max("own").over(within.rangeBetween(W.unboundedPreceding, 0)))
    earlier = W.partitionBy(*key).orderBy("hour").rowsBetween(W.unboundedPreceding, -1)
    carried = rows.groupBy(*key, "hour").agg(F.max("own").alias("own")).select(*key, "hour", F.max("own").over(earlier).alias("carried"))
    rows = rows.join(carried, [*key, "hour"]).withColumn("start_us", F.coalesce("own", "carried"))
    mark = F.greatest(F.ceil((F.col("ts_us") - F.col("start_us")) / e), F.lit(1))
    parts = rows.groupBy(*key, "start_us", mark.alias("mark")).agg(F.max("ts_us").alias("newest"), F.count("*").alias("n"), F.sum("duration_s").alias("total"), F.max("duration_s").alias("longest"), F.collect_set("status").alias("statuses"))
    burst = W.partitionBy(*key, "start_us")
    far = burst.orderBy("mark").rowsBetween(W.unboundedPreceding, 0)
    sums = [F.sum("n").over(far).alias("n"), F.sum("total").over(far).alias("total"), F.max("longest").over(far).alias("longest"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("statuses").over(far)))).alias("statuses")]
    so_far = parts.select(*key, "start_us", (F.col("start_us") + F.col("mark") * e).alias("at_us"), (F.max("newest").over(burst) + q).alias("end_us"), (F.max("mark").over(burst) == F.col("mark")).alias("final"), *sums)
    kinds = F.filter(F.array(F.struct(F.col("at_us").alias("at"), F.lit(False).alias("f"), (F.col("at_us") < F.col("end_us")).alias("ok")), F.struct(F.col("end_us").alias("at"), F.lit(True).alias("f"), F.col("final").alias("ok"))), lambda r: r["ok"])
    return so_far.withColumn("r", F.explode(kinds)).withColumns({"at_us": F.col("r.at"), "finished": F.col("r.f")}).selectExpr(*_FIELDS)


class _Bursts(StatefulProcessor):
    """Rows wait until the watermark passes them, then join the open burst in order of time."""

    def __init__(self, quiet: int, every: int) -> None:
        self.quiet, self.every = quiet, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts long, status int, seconds double")
        self.open = handle.getValueState("open", "start long, newest long, n long, total double, longest double, statuses array<int>, told long, mark long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for f in rows:
            self.waiting.appendList([(int(t), int(s), float(d)) for t, s, d in zip(f["ts_us"], f["status"], f["duration_s"], strict=True)])
            low = int(f["ts_us"].min())
            first = low if first is None else min(first, low)
        if first is not None:
            self.wake(first)
        yield from ()

    def wake(self, at: int) -> None:
        """One timer only: the earliest that is wanted."""
        due, have = -(-at // 1000), list(self.handle.listTimers())
        if have and min(have) <= due:
            return
        for t in have:
            self.handle.deleteTimer(t)
        self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get()) if self.waiting.exists() else []
        ready, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        b = self.open.get() if self.open.exists() else None
        out: list[tuple] = []
        for t, status, seconds in ready:
            b = self.until(b, t, out)
            if b is None:
                b = (t, t, 1, seconds, seconds, [status], 0, 1)
            else:
                start, _, n, total, longest, statuses, told, mark = b
                b = (start, t, n + 1, total + seconds, max(longest, seconds), sorted({*statuses, status}), told, mark)
        b = self.until(b, now, out)
        self.waiting.put(later) if later else self.waiting.clear()
        self.open.update(b) if b is not None else self.open.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        wanted = [r[0] for r in later[:1]]
        if b is not None:  # at the latest when the burst has been quiet, or at its next mark
            wanted.append(max(now + 1000, min(b[1] + self.quiet, b[0] + b[7] * self.every)))
        if wanted:
            self.handle.registerTimer(-(-min(wanted) // 1000))
        if out:
            frame = pd.DataFrame(out, columns=["start_us", "at_us", "finished", "n", "total", "longest", "statuses"])
            frame.insert(0, "method", key[0])
            frame.insert(1, "endpoint", key[1])
            yield frame

    def until(self, b, t: int, out: list[tuple]):
        """The burst as it stands when nothing comes before t; its rows of progress and its end go to out."""
        if b is None:
            return None
        start, newest, n, total, longest, statuses, told, mark = b
        end = newest + self.quiet
        while start + mark * self.every < min(t, end):
            if n > told:
                out.append((start, start + mark * self.every, False, n, total, longest, list(statuses)))
                told = n
            mark += 1
        if end <= t:
            out.append((start, end, True, n, total, longest, list(statuses)))
            return None
        return (start, newest, n, total, longest, list(statuses), told, mark)

    def close(self) -> None:
        pass


def burst_progress_stream(events: DataFrame, quiet: float = 1.0, every: float = 5.0) -> DataFrame:
    """burst_progress on a stream with a watermark, each row when the watermark passes its time.

    An endpoint's state is its open burst and the rows that the watermark has not passed: it grows with the delay of the watermark, not with the stream.
    """
    rows = successes(events).groupBy("method", "endpoint")
    return rows.transformWithStateInPandas(_Bursts(round(quiet * 1e6), round(every * 1e6)), REPORT, "append", "EventTime").selectExpr(*_FIELDS)


def access_failures(events: DataFrame) -> DataFrame:
    return events.where((F.col("status") >= 400) & ~((F.col("status") == 409) & F.col("path").isin(*POLLS)))


def background_hourly(events: DataFrame) -> DataFrame:
    """Polls by kind and hour. Batch or stream."""
    polls = events.where(F.col("path").isin(*POLLS))
    return polls.groupBy(F.window("ts", "1 hour").alias("w"), F.col("path").alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "kind", "n")


def heartbeats(jobs: DataFrame, first: int = 20, every: int = 30) -> DataFrame:
    """The notices that a finished job gave: after `first` seconds, then every `every`, until its end. Batch."""
    span = F.floor(F.col("seconds")).cast("long")
    return jobs.where(F.col("seconds") >= first).select("id", F.explode(F.sequence(F.lit(first).cast("long"), span, F.lit(every).cast("long"))).alias("after"))


def heartbeat_stream(events: DataFrame, first: int = 20, every: int = 30, by_processing: bool = False) -> DataFrame:
    """The same on a stream of start and end events, while the jobs run: id and seconds since the start.

    By the watermark, so that finished jobs get the rows of the batch form and running ones those up to the watermark; with by_processing
    by the time of day since the start was seen, as a live log wants it. Rows without id or ts count as absent.
    """
    rows = admitted(events, "id").select("id", "event", "tool", "ts", "ts_us")
    return rows.groupBy("id").transformWithStateInPandas(_Notices(first, every, by_processing), "id string, after long", "append", "ProcessingTime" if by_processing else "EventTime")


def report_queue(jobs: DataFrame, least: float = 60.0, n: int = 50) -> DataFrame:
    """The newest n jobs that took `least` seconds or were interrupted, paths taken out of their errors. Batch."""
    error = F.regexp_replace("error", r"(/[^\s:/]+)+/?", "<path>")
    kept = jobs.where((F.col("seconds") >= least) | (F.col("status") == "interrupted"))
    return kept.withColumn("error", error).orderBy(F.desc("start"), "id").limit(n)


def split_late(events: DataFrame, newest: Column, delay_s: int = 600) -> tuple[DataFrame, DataFrame]:
    """Rows in time, and those more than the delay behind the newest: the dead letters."""
    behind = F.unix_seconds(newest.cast("timestamp")) - F.unix_seconds(F.col("ts").cast("timestamp")) > delay_s
    return events.where(~behind), events.where(behind)


def with_dead_letters(path: str, marks: str, delay_s: int, write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: rows more than the delay behind the newest time of all batches before go to `path`, the others to `write`.

    Each batch's newest time is one row under `marks`, and a batch's rows lie in a folder of its own, so a batch that is run again gives the same rows
    once. Rows without a time are dead letters too.
    """

    def sink(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        kept = spark.createDataFrame([], "batch long, newest timestamp")
        if number:
            kept = spark.read.schema("batch long, newest timestamp").parquet(marks)
        newest = kept.where(F.col("batch") < number).agg(F.max("newest")).first()[0]
        rows = batch.persist()
        try:
            behind = F.col("ts").isNull()
            if newest is not None:
                behind = behind | (F.col("ts").cast("timestamp") < F.lit(newest) - F.make_dt_interval(secs=F.lit(float(delay_s))))
            rows.where(behind).write.mode("overwrite").parquet(f"{path}/batch={number}")
            write(rows.where(~behind), number)
            rows.agg(F.lit(number).cast("long").alias("batch"), F.max(F.col("ts").cast("timestamp")).alias("newest")).write.mode("overwrite").parquet(f"{marks}/part={number}")
        finally:
            rows.unpersist()

    return sink
