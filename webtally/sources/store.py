"""Writers for scan results, reports and audit entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.history import protect
from ..schema import severity_rank

REPORT_PARTS = ["findings", "api_endpoints", "dependencies", "data_flows", "file_details"]


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _generation(spark: SparkSession, path: str) -> int:
    """The last generation that is complete; 0 is the first."""
    fs, folder = _folder(spark, path)
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    numbers = [int(n.partition("=")[2]) for n in names if n.startswith("generation=")]
    whole = lambda n: fs.exists(_folder(spark, f"{path}/generation={n}/scans/_SUCCESS")[1])
    return max(filter(whole, numbers), default=0)


def _at(spark: SparkSession, path: str) -> str:
    return f"{path}/generation={_generation(spark, path)}"


def _next_version(spark: SparkSession, at: str) -> int:
    """One more than any version of the table: versions do not depend on clocks."""
    fs, folder = _folder(spark, f"{at}/scans/_SUCCESS")
    if not fs.exists(folder):
        return 1
    return 1 + spark.read.parquet(f"{at}/scans").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]


def _write(findings: DataFrame, scans: DataFrame, at: str, mode: str) -> None:
    """Findings first: the scan rows, which name the version that counts, publish them.

    Findings lie by scan, so that the statistics of files and row groups tell where a scan is; a scan of any size is
    split over as many files as it needs.
    """
    findings.hint("rebalance", "scan_id").sortWithinPartitions("scan_id").write.mode(mode).parquet(f"{at}/findings")
    scans.hint("rebalance").write.mode(mode).parquet(f"{at}/scans")


def write_scan(scans: DataFrame, findings: DataFrame, path: str, key: Column | None = None) -> None:
    """Write scan rows and their findings (S7); a scan that is written again replaces what it was.

    Both tables are only appended to; every write has a version. A scan that has no findings any more is replaced too.
    One writer at a time gives versions to a scan; ``compact_scans`` wants no writer at all.
    """
    spark = scans.sparkSession
    at = _at(spark, path)
    version = F.lit(_next_version(spark, at)).cast("bigint").alias("version")
    sealed = findings if key is None else findings.withColumn("evidence", protect(F.col("evidence"), key))
    rows = scans.withColumnRenamed("id", "scan_id").withColumn("deleted", F.lit(False))
    _write(sealed.select("*", version), rows.select("*", version), at, "append")


def read_scans(spark: SparkSession, path: str) -> DataFrame:
    """The scans as last written, without deleted ones."""
    every = spark.read.parquet(f"{_at(spark, path)}/scans")
    last = every.groupBy("scan_id").agg(F.max("version").alias("version"))
    return every.join(last, ["scan_id", "version"]).where(~F.col("deleted")).drop("deleted")


def read_findings(spark: SparkSession, path: str, scan_id: int | None = None) -> DataFrame:
    """The findings of the scans as last written; of one scan only the parts of files are read that may hold it."""
    current = read_scans(spark, path).select("scan_id", "version")
    stored = spark.read.parquet(f"{_at(spark, path)}/findings")
    if scan_id is not None:
        current, stored = (df.where(F.col("scan_id") == scan_id) for df in (current, stored))
    return stored.join(current, ["scan_id", "version"], "left_semi").drop("version")


def delete_scans(scans: DataFrame, path: str) -> None:
    """Delete the scans with these ids (``id``) and with them their findings."""
    spark = scans.sparkSession
    at = _at(spark, path)
    stored = read_scans(spark, path)
    gone = stored.join(scans.select(F.col("id").alias("scan_id")).distinct(), "scan_id", "left_semi")
    version = F.lit(_next_version(spark, at)).cast("bigint")
    gone.withColumns({"version": version, "deleted": F.lit(True)}).hint("rebalance").write.mode("append").parquet(f"{at}/scans")


def compact_scans(spark: SparkSession, path: str) -> None:
    """Write what counts as a new generation and delete the old one: replaced and deleted rows go, many files become few.

    The scan rows, written last, make the generation the current one; a run that breaks off before leaves the old one.
    """
    before = _generation(spark, path)
    at = f"{path}/generation={before}"
    current = read_scans(spark, path)
    findings = spark.read.parquet(f"{at}/findings").join(current.select("scan_id", "version"), ["scan_id", "version"], "left_semi")
    _write(findings, current.withColumn("deleted", F.lit(False)), f"{path}/generation={before + 1}", "overwrite")
    fs, folder = _folder(spark, at)
    fs.delete(folder, True)


def report_json(scans: DataFrame, **parts: DataFrame) -> DataFrame:
    """Reports as JSON lines: one ``report`` line with the header of a scan, then one
    line per finding, endpoint, dependency, data flow and file (S8).

    A report of any size is many small rows; no scan is ever gathered in one task.
    ``parts`` are tables with ``scan_id`` named as in ``REPORT_PARTS``.
    """
    header = ["target", "scan_date", "model", "files_scanned", "total_findings", "severity_counts", "detector_counts"]
    lines = scans.select(
        "scan_id", F.lit("report").alias("part"), F.to_json(F.struct(*[c for c in header if c in scans.columns])).alias("json")
    )
    for name, table in parts.items():
        if name not in REPORT_PARTS:
            raise ValueError(f"unknown report part {name}")
        fields = F.struct(*[c for c in table.columns if c != "scan_id"])
        lines = lines.unionByName(table.select("scan_id", F.lit(name).alias("part"), F.to_json(fields).alias("json")))
    return lines


def report_counts(findings: DataFrame) -> DataFrame:
    """Counts per scan as maps. A scan has a handful of severities and detectors, so
    the maps stay small whatever the number of findings."""
    by_severity = findings.groupBy("scan_id", F.coalesce("severity", F.lit("UNKNOWN")).alias("k")).agg(F.count("*").alias("n"))
    by_detector = findings.groupBy("scan_id", F.coalesce("detector", F.lit("unknown")).alias("k")).agg(F.count("*").alias("n"))

    def as_map(counts: DataFrame, name: str) -> DataFrame:
        entries = F.array_sort(F.collect_list(F.struct(severity_rank(F.col("k")).alias("r"), "k", "n")))
        pairs = F.transform(entries, lambda e: F.struct(e.getField("k"), e.getField("n")))
        return counts.groupBy("scan_id").agg(F.map_from_entries(pairs).alias(name), F.sum("n").alias("total_findings"))

    return as_map(by_severity, "severity_counts").join(
        as_map(by_detector, "detector_counts").drop("total_findings"), "scan_id"
    )


def write_report(lines: DataFrame, path: str) -> None:
    (
        lines.select("scan_id", F.col("json").alias("value"))
        .hint("rebalance", "scan_id")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("scan_id")
        .text(path)
    )


def append_audit(entries: DataFrame, path: str) -> None:
    """Append audit rows, one folder per day so that retention and queries prune."""
    entries.withColumn("day", F.to_date("ts")).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)
