"""Login lockout, rate limits and sessions over event tables (W1–W6, batch).

The state machines (``automata``), trailing counts and sessions run over pieces of
sorted events, whatever key they belong to.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import reliable_checkpoint
from .automata import Lockout, Rate, judged

SECOND = 1_000_000
HOUR = 3600 * SECOND


def event_micros(events: DataFrame, column: str = "ts") -> Column:
    """Event time in µs since 1970; a timestamp without time zone counts as UTC."""
    if dict(events.dtypes)[column] == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))
    return F.unix_micros(F.col(column))


# -- pieces of sorted rows ------------------------------------------------------

def sorted_pieces(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_piece``: rows are ordered by key and ``us`` over the cluster and cut by number, wherever that falls.

    Rows of one key and time share a piece. The table is written, so that a row keeps
    its piece whatever is computed again. A key with a third of all rows is many pieces.
    """
    return reliable_checkpoint(rows.repartitionByRange(*keys, "us").withColumn("_piece", F.spark_partition_id()))


def _with_summary(rows: DataFrame, summaries: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with the summary of its key and piece; a null key equals itself."""
    names = {k: f"_of_{k}" for k in [*keys, "_piece"]}
    other = summaries.withColumnsRenamed(names)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(o)) for k, o in names.items()])
    return rows.join(other, same).drop(*names.values())


def pause_segments(events: DataFrame, keys: Sequence[str], min_gap: int) -> DataFrame:
    """Add ``segment``: the time of the first event after a pause of ``min_gap`` µs or more.

    Expects ``us`` (event time in µs). Windows run within the pieces of a key; what
    crosses from piece to piece travels in one summary row a piece.
    """
    cell = [*keys, "_piece"]
    in_cell = Window.partitionBy(*cell).orderBy("us")
    so_far = in_cell.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    over_cells = Window.partitionBy(*keys).orderBy("_piece")

    # starts that show within a piece; its first event is decided by the pieces before
    gap = F.col("us") - F.lag("us").over(in_cell)
    marked = sorted_pieces(events, keys).withColumn("_start", F.when(gap >= min_gap, F.col("us")))
    marked = marked.withColumn("_running", F.max("_start").over(so_far))

    cells = marked.groupBy(*cell).agg(F.min("us").alias("_first"), F.max("us").alias("_last"), F.max("_start").alias("_own"))
    pause = F.col("_first") - F.lag("_last").over(over_cells)
    cells = cells.withColumn("_head", F.when(F.coalesce(pause >= min_gap, F.lit(True)), F.col("_first")))
    carried = F.max(F.coalesce("_own", "_head")).over(over_cells.rowsBetween(Window.unboundedPreceding, -1))
    cells = cells.withColumn("_carried", carried).select(*cell, F.coalesce("_head", "_carried").alias("_entry"))

    return (
        _with_summary(marked, cells, keys)
        .withColumn("segment", F.coalesce("_running", "_entry"))
        .drop("_piece", "_start", "_running", "_entry")
    )


# -- lockout (W1) --------------------------------------------------------------

def attempt_keys(attempts: DataFrame) -> DataFrame:
    """Each attempt once under its address and once under its user name."""
    keys = F.array(F.concat(F.lit("ip:"), "ip"), F.concat(F.lit("user:"), "username"))
    return attempts.select(
        F.explode(keys).alias("key"), event_micros(attempts).alias("us"), "success",
        *[c for c in ("event_id",) if c in attempts.columns],
    )


def lockouts(attempts: DataFrame, max_attempts: int = 5, window: int = 300, lockout: int = 900) -> DataFrame:
    """Verdict per attempt and key (W1). Input: ``event_id, ts, ip, username, success``.

    Address and user keys are judged independently. A key is judged in as many pieces as its events need.
    """
    machine = Lockout(max_attempts, window * SECOND, lockout * SECOND)
    keyed = attempt_keys(attempts).withColumnRenamed("success", "flag")
    return judged(keyed, machine).filter("kind = 1").select("key", "event_id", "us", F.col("flag").alias("success"), "verdict")


def recent_failures(attempts: DataFrame, window: int = 300) -> DataFrame:
    """Failures of a key in the trailing window, own failure included.

    The window is open at its old end. A failure counts from its time on and ceases to
    count one window later, so the number is a running sum of both changes: within the
    pieces of a key, plus what the pieces before add up to. No row is lent to another.
    """
    failures = attempt_keys(attempts).where(~F.col("success"))
    us = F.col("us")
    begins = F.struct(us.alias("us"), F.lit(1).alias("_change"))
    ends = F.struct((us + window * SECOND).alias("us"), F.lit(-1).alias("_change"))
    ids = [c for c in ("event_id",) if c in failures.columns]
    changes = failures.select("key", *ids, F.explode(F.array(begins, ends)).alias("_at")).select("key", *ids, "_at.*")
    placed = sorted_pieces(changes, ["key"])

    totals = placed.groupBy("key", "_piece").agg(F.sum("_change").alias("_total"))
    before = Window.partitionBy("key").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("key", "_piece", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_carried"))
    so_far = Window.partitionBy("key", "_piece").orderBy("us").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    counted = placed.withColumn("_here", F.sum("_change").over(so_far)).where("_change = 1")
    return _with_summary(counted, carried, ["key"]).select("key", *ids, "us", (F.col("_here") + F.col("_carried")).alias("recent"))


# -- rate limit (W3, W4) ---------------------------------------------------------

def timed_requests(requests: DataFrame) -> DataFrame:
    key = F.col("user_id").cast("string").alias("key")
    return requests.select(key, event_micros(requests).alias("us"), "event_id", F.lit(False).alias("flag"))


def rate_limit(requests: DataFrame, limit: int = 30, seconds: int = 60) -> DataFrame:
    """Whether each request is allowed (W3). Input: ``event_id, ts, user_id``."""
    rows = judged(timed_requests(requests), Rate(limit, seconds * SECOND)).filter("kind = 1")
    return rows.select(F.col("key").cast("bigint").alias("user_id"), "event_id", "us", F.col("verdict").alias("allowed"))


def requests_per_minute(requests: DataFrame) -> DataFrame:
    """Requests per user and tumbling minute (W4); also runs on a stream with a watermark."""
    return requests.groupBy("user_id", F.window("ts", "1 minute").alias("w")).agg(F.count("*").alias("n")).select(
        "user_id", F.col("w.start").alias("minute"), "n"
    )


# -- sessions (W5) and audit (W6) --------------------------------------------------

def sessions(events: DataFrame, gap_minutes: int = 60) -> DataFrame:
    """Sessions per user; a pause longer than the gap ends one (W5). Input: ``user_id, ts``."""
    timed = events.select("user_id", event_micros(events).alias("us"))
    cut = pause_segments(timed, ["user_id"], gap_minutes * 60 * SECOND + 1)
    return cut.groupBy("user_id", F.col("segment").alias("start_us")).agg(
        F.max("us").alias("end_us"), F.count("*").alias("n")
    )


def audit_counts(audit: DataFrame, by: Sequence[Column | str] = ("action", "severity"), width: str = "10 minutes") -> DataFrame:
    """Entries per time window, action and severity (W6); also runs on a stream."""
    return audit.groupBy(F.window("ts", width).alias("w"), *by).agg(F.count("*").alias("n"))
