"""Queries on job and access events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import manifests as m
from ..streaming import jobs as j
from .proxies import edits, job_events, scans, table, with_tables

T = with_tables


def accesses(k, d):
    e = table(k, d, "events")
    return e.select("ts", F.lit("GET").alias("method"), F.col("event_type").alias("path"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.coalesce("value", F.lit(0.0)).alias("duration_s"))


def progress(k, d):
    e = table(k, d, "events")
    return e.select("user_id", "ts", F.concat(F.col("event_type"), F.lit(" step "), F.col("event_id").cast("string")).alias("label"), (F.col("event_id") % 150).cast("double").alias("progress"))


def errors(k, d):
    return j.job_pairing(job_events(k, d)).withColumn("error", F.concat(F.lit("failed in /data/"), F.col("tool"), F.lit("/x.nii at 3")))


def landmark_json(k, d):
    e = table(k, d, "embeddings").select(F.col("vec_id").alias("scan_id"), F.transform("embedding", lambda v: F.round(v.cast("double"), 3)).alias("v"))
    triple = lambda a: F.concat(F.lit("["), F.array_join(F.slice("v", a, 3), ","), F.lit("]"))
    return e.select("scan_id", F.concat(F.lit("["), triple(1), F.lit(',{"position":'), triple(4), F.lit(',"landmark_type":"semi"}]')).alias("text"))


QUERIES = {
    "r1_job_pairing": lambda k, d: j.job_pairing(job_events(k, d)).select("id", "tool", "seconds", "status"),
    "r2_promote_jobs": lambda k, d: j.promote_jobs(j.job_pairing(job_events(k, d)), 20.0).select("id"),
    "r3_background_sessions": lambda k, d: j.background_sessions(progress(k, d), "3600 seconds").select("user_id", "stem", "start", "n", "progress"),
    "r4_progress_eta": lambda k, d: progress(k, d).select("user_id", "label", j.progress_normalise(F.col("progress")).alias("fraction"), j.eta(j.progress_normalise(F.col("progress")), F.lit(60.0)).alias("eta")),
    "r5_step_durations": lambda k, d: j.step_durations(table(k, d, "events").select(F.col("user_id").alias("job"), "ts", F.col("event_id").alias("step"), F.lit("2024-02-01 00:00:00").cast("timestamp").alias("end_ts"))).select("job", "step", "seconds"),
    "r6_access_bursts": lambda k, d: j.access_bursts(accesses(k, d), "60 seconds").select("method", "endpoint", "start", "n", F.round("total", 6).alias("total"), "longest"),
    "r6_access_failures": lambda k, d: j.access_failures(accesses(k, d)).select("ts", "path", "status"),
    "r6_burst_progress": lambda k, d: j.burst_progress(accesses(k, d), 900, 1800).select("method", "endpoint", "start", "at", "finished", "n", F.round("total", 6).alias("total"), "longest"),
    "r7_background_hourly": lambda k, d: j.background_hourly(accesses(k, d)),
    "r8_heartbeats": lambda k, d: j.heartbeats(j.job_pairing(job_events(k, d))),
    "r9_report_queue": lambda k, d: j.report_queue(errors(k, d)).select("id", "status", "error"),
    "s2_parse_edit_names": lambda k, d: m.parse_edit_names(edits(k, d).select(F.concat(F.lit("p/scan_"), F.col("scan_id").cast("string"), F.lit("_edit_"), F.col("edit_number").cast("string"), F.lit("_"), F.col("kind"), F.when(F.col("has_mask"), "_mask.nii.gz").otherwise(".nii.gz")).alias("file"))).select("scan", "edit_number", "kind", "lossy", "role"),
    "s3_slice_series": lambda k, d: m.slice_series_manifest(table(k, d, "orders").select(F.col("o_custkey").alias("folder"), F.concat(F.lit("slice_"), F.col("o_orderkey").cast("string"), F.lit(".tif")).alias("file")))[0],
    "s5_read_landmarks": lambda k, d: m.read_landmarks(landmark_json(k, d)),
    "s7_landmarks_wide": lambda k, d: m.landmarks_wide(m.read_landmarks(landmark_json(k, d)), scans(k, d), 2),
    "s9_upsert_label_names": lambda k, d: m.upsert_label_names(table(k, d, "nation").select(F.col("n_nationkey").cast("long").alias("label"), F.col("n_name").alias("name")), table(k, d, "customer").select(F.col("c_nationkey").cast("long").alias("label"), F.col("c_custkey").alias("seq"), F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_name")).alias("name"))),
    "s10_probe_slices": lambda k, d: m.probe_slices(table(k, d, "orders").select(F.col("o_custkey").alias("folder"), F.col("o_orderkey").alias("idx")), 4),
    "s11_rename_tokens": lambda k, d: m.rename_tokens(scans(k, d).select("scan_id", "elastic_to"), "skull"),
}

SQL = {
    "r1_job_pairing": T("job_events") + ", s AS (SELECT * FROM job_events WHERE event = 'start'), e AS (SELECT * FROM job_events WHERE event = 'end') SELECT s.id, s.tool, epoch_us(e.ts - s.ts) / 1e6 AS seconds, coalesce(e.status, 'interrupted') AS status FROM s LEFT JOIN e ON s.id = e.id",
    "r2_promote_jobs": "SELECT event_id::VARCHAR AS id FROM events WHERE coalesce(value, 0) <= 10 OR floor(value) >= 20",
    "r3_background_sessions": "WITH e AS (SELECT user_id, ts, event_id % 150 AS p, event_type || ' step' AS stem FROM events), g AS (SELECT *, sum(CASE WHEN was IS NULL OR ts - was >= INTERVAL 3600 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, stem ORDER BY ts) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, stem ORDER BY ts) AS was FROM e)) SELECT user_id, stem, min(ts) AS start, count(*) AS n, max(p)::DOUBLE AS progress FROM g GROUP BY user_id, stem, k",
    "r4_progress_eta": "WITH e AS (SELECT user_id, event_type || ' step ' || event_id AS label, CASE WHEN event_id % 150 > 1 THEN least((event_id % 150) / 100.0::DOUBLE, 1) ELSE (event_id % 150)::DOUBLE END AS fraction FROM events) SELECT *, CASE WHEN fraction >= 0.03 AND fraction < 1 THEN 60 * (1 - fraction) / fraction END AS eta FROM e",
    "r5_step_durations": "SELECT user_id AS job, event_id AS step, epoch_us(coalesce(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), TIMESTAMP '2024-02-01') - ts) / 1e6 AS seconds FROM events",
    "r6_access_bursts": "WITH e AS (SELECT ts, event_type AS endpoint, coalesce(value, 0) AS v FROM events WHERE event_type <> 'error'), g AS (SELECT *, sum(CASE WHEN was IS NULL OR ts - was >= INTERVAL 60 SECOND THEN 1 ELSE 0 END) OVER (PARTITION BY endpoint ORDER BY ts) AS k FROM (SELECT *, lag(ts) OVER (PARTITION BY endpoint ORDER BY ts) AS was FROM e)) SELECT 'GET' AS method, endpoint, min(ts) AS start, count(*) AS n, round(sum(v), 6) AS total, max(v) AS longest FROM g GROUP BY endpoint, k",
    "r6_access_failures": "SELECT ts, event_type AS path, 500 AS status FROM events WHERE event_type = 'error'",
    "r6_burst_progress": """WITH e AS (SELECT epoch_us(ts) AS t, event_type AS endpoint, coalesce(value, 0) AS v FROM events WHERE event_type <> 'error'),
        g AS (SELECT *, sum(CASE WHEN was IS NULL OR t - was >= 900000000 THEN 1 ELSE 0 END) OVER (PARTITION BY endpoint ORDER BY t) AS k FROM (SELECT *, lag(t) OVER (PARTITION BY endpoint ORDER BY t) AS was FROM e)),
        b AS (SELECT endpoint, k, min(t) AS start, max(t) + 900000000 AS stop FROM g GROUP BY ALL),
        m AS (SELECT DISTINCT endpoint, k, start, stop, start + greatest((t - start + 1799999999) // 1800000000, 1) * 1800000000 AS due FROM g JOIN b USING (endpoint, k)),
        w AS (SELECT *, false AS finished FROM m WHERE due < stop UNION ALL SELECT endpoint, k, start, stop, stop, true FROM b)
        SELECT 'GET' AS method, w.endpoint, make_timestamp(start) AS start, make_timestamp(due) AS "at", finished, count(*) AS n, round(sum(v), 6) AS total, max(v) AS longest
        FROM w JOIN g ON g.endpoint = w.endpoint AND g.k = w.k AND g.t <= w.due GROUP BY ALL""",
    "r7_background_hourly": "SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type AS kind, count(*) AS n FROM events WHERE event_type IN ('view', 'progress') GROUP BY ALL",
    "r8_heartbeats": "SELECT event_id::VARCHAR AS id, a AS after FROM events, range(20, 10000, 30) t(a) WHERE value > 10 AND a <= floor(value)",
    "r9_report_queue": T("job_events") + ", s AS (SELECT * FROM job_events WHERE event = 'start'), e AS (SELECT * FROM job_events WHERE event = 'end') SELECT s.id, coalesce(e.status, 'interrupted') AS status, 'failed in <path> at 3' AS error FROM s LEFT JOIN e ON s.id = e.id WHERE e.id IS NULL OR e.ts - s.ts >= INTERVAL 60 SECOND ORDER BY s.ts DESC, s.id LIMIT 50",
    "s2_parse_edit_names": T("edits") + " SELECT 'scan_' || scan_id AS scan, edit_number, CASE WHEN kind = 'mask' AND NOT has_mask THEN '' ELSE kind END AS kind, false AS lossy, CASE WHEN has_mask OR kind = 'mask' THEN 'mask' ELSE 'image' END AS role FROM edits",
    "s3_slice_series": "WITH g AS (SELECT o_custkey AS folder, o_orderkey AS idx, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - o_orderkey AS gap FROM orders) SELECT folder, 'slice_' AS prefix, 'tiff' AS ext, count(*) AS n, min(idx)::INT AS first, max(idx)::INT AS last, min(gap)::INT AS step FROM g GROUP BY 1",
    "s9_upsert_label_names": "WITH l AS (SELECT c_nationkey::BIGINT AS label, arg_max(CASE WHEN c_custkey % 3 = 0 THEN '' ELSE c_name END, c_custkey) AS new FROM customer GROUP BY 1), j AS (SELECT coalesce(n_nationkey::BIGINT, label) AS label, coalesce(new, n_name) AS name FROM nation FULL JOIN l ON label = n_nationkey) SELECT * FROM j WHERE name <> ''",
    "s11_rename_tokens": "SELECT c_custkey AS scan_id, CASE WHEN c_custkey % 3 = 0 THEN 'skull' END AS elastic_to FROM customer",
}
