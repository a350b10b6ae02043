"""Structured Streaming forms of the event and scan jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import cut
from ..limits import NONE, Limits
from ..operators.automata import Lockout, Rate, judged, last_states
from ..operators.guards import HOUR, SECOND, attempt_keys, audit_counts, requests_per_minute, timed_requests
from ..operators.signatures import scan_signatures
from ..session import reliable_checkpoint

DELAY = "10 minutes"


def run_judged(stream: DataFrame, machine, path: str, checkpoint: str, keep: int = 24 * HOUR) -> StreamingQuery:
    """Judge a stream of events (key, us, event_id, flag) batch by batch into ``path``; every event gets a row.

    Each batch is judged as the batch job does it, in pieces, from the states the batch before has left. States are tables
    by batch, so a batch that is run again reads what it read before and replaces what it wrote. An event earlier than
    the last judged one of its key can change nothing any more: its row says so (``late``) and has no verdict. A key
    without events for ``keep`` µs of event time is forgotten. Verdicts and states are folders by batch.
    """

    def judge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        states = spark.createDataFrame([], STATES) if batch_id == 0 else spark.read.schema(STATES).parquet(f"{checkpoint}/states/batch={batch_id - 1}")
        events = batch.join(states.select("key", "last_us"), "key", "left").withColumn("late", F.coalesce(F.col("us") < F.col("last_us"), F.lit(False)))
        events = reliable_checkpoint(events)
        rows = reliable_checkpoint(judged(events.filter("not late"), machine, states))
        verdicts = rows.filter("kind = 1").select("key", "event_id", "us", "flag", F.lit(False).alias("late"), "verdict")
        late = events.filter("late").select("key", "event_id", "us", "flag", "late", F.lit(None).cast(machine.verdict).alias("verdict"))
        verdicts.unionByName(late).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        new = last_states(rows)
        now = rows.agg(F.max("us")).first()[0] or 0
        rest = states.join(new, "key", "left_anti").filter(F.col("last_us") > now - keep)
        new.unionByName(rest).write.mode("overwrite").parquet(f"{checkpoint}/states/batch={batch_id}")

    query = stream.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


VERDICTS = "key string, event_id bigint, us bigint, flag boolean, late boolean, verdict"
STATES = "key string, state array<bigint>, last_us bigint"


def run_lockouts(attempts: DataFrame, path: str, checkpoint: str, max_attempts: int = 5, window: int = 300, lockout: int = 900) -> StreamingQuery:
    """Verdict per attempt and key, with state kept across micro-batches."""
    machine = Lockout(max_attempts, window * SECOND, lockout * SECOND)
    return run_judged(attempt_keys(attempts).withColumnRenamed("success", "flag"), machine, path, checkpoint)


def read_lockouts(spark: SparkSession, path: str) -> DataFrame:
    """key, event_id, us, success and verdict of all batches; the verdict of a late attempt is ``late``."""
    rows = spark.read.schema(f"{VERDICTS} string").parquet(f"{path}/batch=*")
    return rows.select("key", "event_id", "us", F.col("flag").alias("success"), F.when(F.col("late"), "late").otherwise(F.col("verdict")).alias("verdict"))


def run_rate_limit(requests: DataFrame, path: str, checkpoint: str, limit: int = 30, seconds: int = 60) -> StreamingQuery:
    """Whether each request is allowed, with state kept across micro-batches."""
    return run_judged(timed_requests(requests), Rate(limit, seconds * SECOND), path, checkpoint)


def read_rate_limit(spark: SparkSession, path: str) -> DataFrame:
    """user_id, event_id, us, allowed and late of all batches; ``allowed`` is null where a request was late."""
    rows = spark.read.schema(f"{VERDICTS} boolean").parquet(f"{path}/batch=*")
    return rows.select(F.col("key").cast("bigint").alias("user_id"), "event_id", "us", F.col("verdict").alias("allowed"), "late")


def stream_requests_per_minute(requests: DataFrame, delay: str = DELAY) -> DataFrame:
    return requests_per_minute(requests.withWatermark("ts", delay))


def stream_sessions(events: DataFrame, gap_minutes: int = 60, delay: str = DELAY) -> DataFrame:
    """Sessions per user (W5); a pause equal to the gap closes a session here."""
    return (
        events.withWatermark("ts", delay)
        .groupBy("user_id", F.session_window("ts", f"{gap_minutes} minutes").alias("w"))
        .agg(F.count("*").alias("n"), F.max("ts").alias("last"))
        .select("user_id", F.col("w.start").alias("start"), F.col("last").alias("end"), "n")
    )


def stream_audit_counts(audit: DataFrame, delay: str = DELAY) -> DataFrame:
    counted = audit_counts(audit.withWatermark("ts", delay))
    return counted.select(F.col("w.start").alias("start"), "action", "severity", "n")


def stream_signatures(assets: DataFrame, limits: Limits = NONE) -> DataFrame:
    """Findings of newly arrived files (W7): the batch plan as it is, without state."""
    return scan_signatures(assets, limits=limits)


SEEN = "source_url string, shown string, description string, ts timestamp"


def run_unique_findings(findings: DataFrame, path: str, checkpoint: str, keep: str = "1 hour", key_chars: int | None = None) -> StreamingQuery:
    """Findings not seen before into ``path`` (W8). Needs an event time ``ts``.

    What has been seen is a table by batch, as in ``run_judged``: a finding that comes late is compared like any other and
    none is lost. What has not been seen for ``keep`` of event time may be reported again. ``key_chars`` compares
    only so many characters of the evidence.
    """
    key = ["source_url", "shown", "description"]
    keyed = findings.withColumn("shown", cut(F.col("evidence"), key_chars))

    def batch_job(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        seen = spark.createDataFrame([], SEEN) if batch_id == 0 else spark.read.schema(SEEN).parquet(f"{checkpoint}/seen/batch={batch_id - 1}")
        rows = reliable_checkpoint(batch)
        # of equal findings of a batch the earliest counts
        first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("ts"))).filter("place = 1").drop("place")
        known = F.lit(True)
        for c in key:
            known = known & first[c].eqNullSafe(seen[c])
        first.join(seen, known, "left_anti").drop("shown").write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        every = seen.unionByName(rows.select(*key, "ts")).groupBy(*key).agg(F.max("ts").alias("ts"))
        now = every.agg(F.max("ts")).first()[0]
        kept = every.filter(F.col("ts") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {keep}")) if now else every
        kept.select(*key, "ts").write.mode("overwrite").parquet(f"{checkpoint}/seen/batch={batch_id}")

    query = keyed.writeStream.foreachBatch(batch_job).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Process everything available into a parquet folder and stop."""
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
