"""Lockout, rate limits, sessions and audit counts (W), and stream sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import guards as G
from ..session import shared_folder
from ..sources import store
from ..sources.assets import documents_as_assets, stream_source
from ..streaming import jobs
from .corpus import AS_SHOWN, table
from .registry import query
from .signature_queries import DOC_FINDINGS_SQL, document_findings

EVENTS = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"

# The events span 30 days; brought closer together by a factor they become bursts.
BASE_US = 1_704_067_200_000_000  # 2024-01-01


def burst_sql(factor: int) -> str:
    return f"SELECT event_id, user_id, event_type, {BASE_US} + (epoch_us(ts) - {BASE_US}) // {factor} AS us FROM events"


def bursts(events: DataFrame, factor: int) -> DataFrame:
    us = F.lit(BASE_US) + F.floor((G.event_micros(events) - F.lit(BASE_US)) / F.lit(factor))
    return events.withColumn("ts", F.timestamp_micros(us.cast("bigint")))


ATTEMPT_FACTOR = 500
ATTEMPTS_SQL = f"""attempts AS (SELECT event_id, us, event_type <> 'error' AS success, unnest(['ip:10.0.0.' || (user_id % 40), 'user:' || user_id]) AS key FROM ({burst_sql(ATTEMPT_FACTOR)}))"""


def as_attempts(events: DataFrame) -> DataFrame:
    """Errors stand for failed logins, everything else for successful ones."""
    return bursts(events, ATTEMPT_FACTOR).select(
        "event_id", "ts", F.concat(F.lit("10.0.0."), F.col("user_id") % 40).alias("ip"),
        F.col("user_id").cast("string").alias("username"), (F.col("event_type") != "error").alias("success"),
    )


LOCKOUT_SQL = f"""WITH RECURSIVE {ATTEMPTS_SQL},
numbered AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY us, event_id) AS rn FROM attempts),
judged(key, event_id, us, success, rn, failures, locked_until, verdict) AS (
 SELECT key, event_id, us, success, rn, CASE WHEN success THEN [] ELSE [us] END, 0::BIGINT, CASE WHEN success THEN 'success' ELSE 'failure' END FROM numbered WHERE rn = 1
 UNION ALL
 SELECT key, event_id, us, success, rn, CASE WHEN verdict = 'blocked' THEN old WHEN success THEN [] ELSE seen END,
  CASE verdict WHEN 'blocked' THEN locked_until WHEN 'locked' THEN us + 900000000 ELSE 0 END, verdict
 FROM (SELECT *, CASE WHEN us < locked_until THEN 'blocked' WHEN success THEN 'success' WHEN len(seen) >= 5 THEN 'locked' ELSE 'failure' END AS verdict
  FROM (SELECT n.key, n.event_id, n.us, n.success, n.rn, j.failures AS old, j.locked_until,
   list_append(list_filter(j.failures, lambda t: t > n.us - 300000000), n.us) AS seen
   FROM judged j JOIN numbered n ON n.key = j.key AND n.rn = j.rn + 1)))
"""


@query("w1_lockouts", LOCKOUT_SQL + "SELECT key, event_id, us, success, verdict FROM judged")
def _(spark, sf_dir):
    return G.lockouts(as_attempts(table(spark, sf_dir, "events")))


@query(
    "w2_recent_failures",
    f"""WITH {ATTEMPTS_SQL} SELECT key, event_id, us, count(*) OVER (PARTITION BY key ORDER BY us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) AS recent
 FROM attempts WHERE NOT success""",
)
def _(spark, sf_dir):
    return G.recent_failures(as_attempts(table(spark, sf_dir, "events")))


REQUEST_FACTOR = 20000
RATE_SQL = f"""WITH RECURSIVE numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS rn FROM ({burst_sql(REQUEST_FACTOR)})),
judged(user_id, event_id, us, rn, start, n, allowed) AS (SELECT user_id, event_id, us, rn, us, 1, true FROM numbered WHERE rn = 1
 UNION ALL SELECT r.user_id, r.event_id, r.us, r.rn, CASE WHEN r.us - j.start > 60000000 THEN r.us ELSE j.start END,
  CASE WHEN r.us - j.start > 60000000 THEN 1 WHEN j.n >= 30 THEN j.n ELSE j.n + 1 END, r.us - j.start > 60000000 OR j.n < 30
 FROM judged j JOIN numbered r ON r.user_id = j.user_id AND r.rn = j.rn + 1)
"""


@query("w3_rate_limit", RATE_SQL + "SELECT user_id, event_id, us, allowed FROM judged")
def _(spark, sf_dir):
    return G.rate_limit(bursts(table(spark, sf_dir, "events"), REQUEST_FACTOR))


@query("w4_requests_per_minute", "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf_dir):
    return G.requests_per_minute(table(spark, sf_dir, "events"))


SESSION_SQL = """SELECT user_id, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM (
 SELECT *, sum(starts) OVER (PARTITION BY user_id ORDER BY us, event_id) AS session FROM (
 SELECT user_id, event_id, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 3600000000 THEN 1 ELSE 0 END AS starts FROM events))
 GROUP BY user_id, session"""


@query("w5_sessions", SESSION_SQL)
def _(spark, sf_dir):
    return G.sessions(table(spark, sf_dir, "events"))


@query(
    "w6_audit_counts",
    """SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type AS action, CASE event_type WHEN 'error' THEN 'warn' ELSE 'info' END AS severity, count(*) AS n FROM events GROUP BY ALL""",
)
def _(spark, sf_dir):
    counted = G.audit_counts(as_audit(table(spark, sf_dir, "events")))
    return counted.select(F.col("w.start").alias("start"), "action", "severity", "n")


def as_audit(events: DataFrame) -> DataFrame:
    severity = F.when(F.col("event_type") == "error", "warn").otherwise("info")
    return events.select(F.col("event_id").alias("id"), "ts", "user_id", F.col("event_type").alias("action"), severity.alias("severity"))


# -- the same jobs as streams over the files of a table ----------------------------------
# Each run writes to a new folder below the shared one and reads its output back.

def _run(spark: SparkSession, stream: DataFrame) -> DataFrame:
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    jobs.run_to_end(stream, f"{folder}/out", f"{folder}/state")
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _stream(spark: SparkSession, sf_dir: str, name: str, ddl: str) -> DataFrame:
    """The files of a table, which is one file or a folder of files of any name.

    The path is a pattern, since a stream takes a plain one for a folder.
    """
    return stream_source(spark, f"{sf_dir}/{name}[.]parquet", ddl, file_glob="*")


@query("w1_lockouts_stream", LOCKOUT_SQL + "SELECT key, event_id, us, success, verdict FROM judged")
def _(spark, sf_dir):
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    jobs.run_lockouts(as_attempts(_stream(spark, sf_dir, "events", EVENTS)), f"{folder}/out", f"{folder}/state")
    return jobs.read_lockouts(spark, f"{folder}/out")


@query("w3_rate_limit_stream", RATE_SQL + "SELECT user_id, event_id, us, allowed FROM judged")
def _(spark, sf_dir):
    requests = bursts(_stream(spark, sf_dir, "events", EVENTS), REQUEST_FACTOR)
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    jobs.run_rate_limit(requests.select("event_id", "user_id", "ts"), f"{folder}/out", f"{folder}/state")
    return jobs.read_rate_limit(spark, f"{folder}/out").drop("late")


LATE_SQL = f"""WITH RECURSIVE late_events AS (SELECT * FROM ({burst_sql(REQUEST_FACTOR)})),
halves AS (SELECT *, event_id % 2 = 1 AS second, max(us) FILTER (event_id % 2 = 0) OVER (PARTITION BY user_id) AS last_us FROM late_events),
marked AS (SELECT *, second AND coalesce(us < last_us, false) AS late FROM halves),
numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY second, us, event_id) AS rn FROM marked WHERE NOT late),
judged(user_id, event_id, us, rn, start, n, allowed) AS (SELECT user_id, event_id, us, rn, us, 1, true FROM numbered WHERE rn = 1
 UNION ALL SELECT r.user_id, r.event_id, r.us, r.rn, CASE WHEN r.us - j.start > 60000000 THEN r.us ELSE j.start END,
  CASE WHEN r.us - j.start > 60000000 THEN 1 WHEN j.n >= 30 THEN j.n ELSE j.n + 1 END, r.us - j.start > 60000000 OR j.n < 30
 FROM judged j JOIN numbered r ON r.user_id = j.user_id AND r.rn = j.rn + 1)
SELECT user_id, event_id, us, allowed, false AS late FROM judged UNION ALL SELECT user_id, event_id, us, NULL, true FROM marked WHERE late"""


@query("w3_rate_limit_late_rows", LATE_SQL)
def _(spark, sf_dir):
    """Even ids arrive first, odd ones in a second batch: most of those are late, and each has its row."""
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    requests = bursts(table(spark, sf_dir, "events"), REQUEST_FACTOR).select("event_id", "user_id", "ts")
    for part in (0, 1):
        requests.filter(F.col("event_id") % 2 == part).write.mode("append").parquet(f"{folder}/in/{part}")
        stream = spark.readStream.schema(requests.schema).parquet(f"{folder}/in/*")
        jobs.run_rate_limit(stream, f"{folder}/out", f"{folder}/state")
    return jobs.read_rate_limit(spark, f"{folder}/out")


# Windows are emitted once the watermark, ten minutes behind the last event, has passed their end.
CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query(
    "w4_requests_per_minute_stream",
    f"SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n FROM events WHERE date_trunc('minute', ts) + INTERVAL 1 MINUTE <= {CLOSED} GROUP BY ALL",
)
def _(spark, sf_dir):
    events = _stream(spark, sf_dir, "events", EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    return _run(spark, jobs.stream_requests_per_minute(events)).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query(
    "w6_audit_counts_stream",
    f"""SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type AS action, CASE event_type WHEN 'error' THEN 'warn' ELSE 'info' END AS severity, count(*) AS n
 FROM events WHERE time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE <= {CLOSED} GROUP BY ALL""",
)
def _(spark, sf_dir):
    events = _stream(spark, sf_dir, "events", EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    return _run(spark, jobs.stream_audit_counts(as_audit(events))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(
    "w5_sessions_stream",
    f"SELECT user_id, start_us, end_us, n FROM ({SESSION_SQL}) WHERE end_us + 3600000000 <= (SELECT epoch_us(max(ts)) - 600000000 FROM events)",
)
def _(spark, sf_dir):
    events = _stream(spark, sf_dir, "events", EVENTS).withColumn("ts", F.col("ts").cast("timestamp"))
    closed = _run(spark, jobs.stream_sessions(events))
    return closed.select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n")


DOCUMENTS = "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT"
STREAM_FINDINGS = "asset_id, rule_id, evidence, line_number"


def document_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_as_assets(_stream(spark, sf_dir, "documents", DOCUMENTS))


@query("w7_signatures_stream", DOC_FINDINGS_SQL + f"SELECT {STREAM_FINDINGS} FROM findings")
def _(spark, sf_dir):
    return _run(spark, jobs.stream_signatures(document_stream(spark, sf_dir), AS_SHOWN).select(*STREAM_FINDINGS.split(", ")))


@query(
    "w8_unique_findings_stream",
    DOC_FINDINGS_SQL + "SELECT source_url, substr(evidence, 1, 100) AS evidence, description FROM (SELECT DISTINCT d.source AS source_url, evidence, description "
    "FROM findings f JOIN documents d ON d.doc_id = f.asset_id)",
)
def _(spark, sf_dir):
    documents = _stream(spark, sf_dir, "documents", DOCUMENTS)
    assets = documents.select(
        F.col("doc_id").alias("asset_id"), F.col("source").alias("url"), F.lit("txt").alias("file_type"), F.col("text").alias("content")
    )
    found = jobs.stream_signatures(assets, AS_SHOWN).withColumn("ts", F.timestamp_micros(F.lit(BASE_US) + F.col("asset_id")))
    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    jobs.run_unique_findings(found.select("source_url", "evidence", "description", "ts"), f"{folder}/out", f"{folder}/state", key_chars=100)
    unique = spark.read.schema("source_url string, evidence string, description string, ts timestamp").parquet(f"{folder}/out/batch=*")
    return unique.select("source_url", F.substring("evidence", 1, 100).alias("evidence"), "description")


# -- sinks ----------------------------------------------------------------------------------

STORED_SQL = (
    "WITH " + DOC_FINDINGS_SQL.replace("WITH ", "", 1)
    + "SELECT doc_id % 7 AS scan_id, f.asset_id, f.line_number::BIGINT AS line_number, md5(f.evidence) AS evidence_md5 FROM findings f JOIN documents d ON d.doc_id = f.asset_id WHERE "
)


def _stored(spark: SparkSession, sf_dir: str) -> str:
    """Written twice, the second time scan 2 has lost all its findings; scan 3 is deleted."""
    folder = f"{shared_folder(spark)}/scan-{uuid.uuid4().hex}"
    # both writes take the findings of one scan of the documents
    document_findings(spark, sf_dir).withColumn("scan_id", F.col("asset_id") % 7).write.parquet(f"{folder}-found")
    found = spark.read.parquet(f"{folder}-found")
    scans = table(spark, sf_dir, "documents").groupBy((F.col("doc_id") % 7).alias("id")).agg(F.count("*").alias("files_scanned"))
    store.write_scan(scans, found, folder)
    store.write_scan(scans, found.where("scan_id <> 2"), folder)
    store.delete_scans(scans.where("id = 3"), folder)
    return folder


def _stored_columns(findings: DataFrame) -> DataFrame:
    return findings.select("scan_id", "asset_id", "line_number", F.md5("evidence").alias("evidence_md5"))


@query("s7_write_scan", STORED_SQL + "doc_id % 7 NOT IN (2, 3)")
def _(spark, sf_dir):
    return _stored_columns(store.read_findings(spark, _stored(spark, sf_dir)))


@query("s7_compacted_scans", STORED_SQL + "doc_id % 7 NOT IN (2, 3)")
def _(spark, sf_dir):
    """What is stored after compaction, replaced and deleted rows included if there were any."""
    folder = _stored(spark, sf_dir)
    store.compact_scans(spark, folder)
    return _stored_columns(spark.read.parquet(f"{folder}/generation=1/findings"))


@query("s7_one_scan", STORED_SQL + "doc_id % 7 = 5")
def _(spark, sf_dir):
    return _stored_columns(store.read_findings(spark, _stored(spark, sf_dir), 5))


@query("s9_append_audit", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf_dir):
    folder = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    store.append_audit(as_audit(table(spark, sf_dir, "events")), folder)
    return spark.read.parquet(folder).groupBy("day").agg(F.count("*").alias("n"))


