"""Scan history, audit queries, retention and protection at rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

FINISHED = ["done", "error"]
PROTECTED_PREFIX = "aesgcm:"


def scan_history(
    scans: DataFrame, users: DataFrame, principal: int | None = None, is_admin: bool = False, limit: int | None = None
) -> DataFrame:
    """Newest scans with their owner's name; admins see all, others their own.

    With a limit, sorting becomes one top-k per task, merged at the end.
    """
    visible = scans if is_admin else scans.where(F.col("user_id") == F.lit(principal))
    newest = visible.join(users.select("user_id", "username"), "user_id").orderBy(F.col("id").desc())
    return newest if limit is None else newest.limit(limit)


def scan_with_user(scans: DataFrame, users: DataFrame, scan_id: int) -> DataFrame:
    return scans.where(F.col("id") == scan_id).join(users.select("user_id", "username"), "user_id")


def active_scans(scans: DataFrame) -> DataFrame:
    """Latest running scan of every user (T4)."""
    columns = [c for c in scans.columns if c != "user_id"]
    return (
        scans.where(F.col("status") == "running")
        .groupBy("user_id")
        .agg(F.max_by(F.struct(*columns), "id").alias("s"))
        .select("user_id", "s.*")
    )


def latest_progress(log: DataFrame) -> DataFrame:
    """Last update per scan of a log ``scan_id, ts, seq, progress, progress_msg`` (T5)."""
    return (
        log.groupBy("scan_id")
        .agg(F.max_by(F.struct("progress", "progress_msg"), F.struct("ts", "seq")).alias("p"))
        .select("scan_id", "p.progress", "p.progress_msg")
    )


def parse_counts(text: Column) -> Column:
    """Severity counts from JSON text; empty or missing text is an empty map."""
    parsed = F.from_json(F.when(text != "", text), "map<string, bigint>")
    return F.coalesce(parsed, F.create_map().cast("map<string, bigint>"))


def retain(df: DataFrame, ts_col: str, now: Column, days: int, statuses: Sequence[str] | None = None) -> DataFrame:
    """Drop rows older than ``days``, if given only those in one of ``statuses``.

    Rows without a timestamp stay. Compared as timestamps, not as text.
    """
    old = F.col(ts_col) < now - F.make_dt_interval(days=F.lit(days))
    if statuses is not None:
        old = old & F.col("status").isin(list(statuses))
    return df.where(~F.coalesce(old, F.lit(False)))


def retain_findings(findings: DataFrame, kept_scans: DataFrame) -> DataFrame:
    """Findings whose scan is still there (cascade of T7)."""
    return findings.join(kept_scans.select(F.col("id").alias("scan_id")), "scan_id", "left_semi")


def audit_query(
    audit: DataFrame, user_id: int | None = None, action: str | None = None, severity: str | None = None, limit: int | None = None
) -> DataFrame:
    """Newest entries with optional equality filters (T9); an unset filter is no filter."""
    chosen = audit
    for column, value in (("user_id", user_id), ("action", action), ("severity", severity)):
        if value:
            chosen = chosen.where(F.col(column) == value)
    newest = chosen.orderBy(F.col("id").desc())
    return newest if limit is None else newest.limit(limit)


def protect(text: Column, key: Column) -> Column:
    """AES-GCM ciphertext behind a prefix; empty and missing values stay as they are."""
    sealed = F.regexp_replace(F.base64(F.aes_encrypt(text, key, F.lit("GCM"))), r"\s", "")
    return F.when(text != "", F.concat(F.lit(PROTECTED_PREFIX), sealed)).otherwise(text)


def is_protected(text: Column) -> Column:
    return F.coalesce(text.startswith(PROTECTED_PREFIX), F.lit(False))


def reveal(text: Column, key: Column) -> Column:
    """Plain text of a protected value; anything that cannot be decrypted passes through."""
    body = F.try_to_binary(F.substring(text, len(PROTECTED_PREFIX) + 1, 1 << 30), F.lit("base64"))
    plain = F.decode(F.try_aes_decrypt(body, key, F.lit("GCM")), "UTF-8")
    return F.when(is_protected(text), F.coalesce(plain, text)).otherwise(text)
