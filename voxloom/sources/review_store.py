"""Saved reviews and reports, and the published read-only copy of both."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxloom.schemas import REPORT, REVIEW, RUN_KEY

_ROWS_PER_FILE = 1_000_000


def scan_review_dump(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """A saved dump (JSON array or JSON lines) with the review schema."""
    return spark.read.schema(REVIEW).json(path, multiLine=multi_line)


def _write(df: DataFrame, path: str, kind: str, keys: tuple[str, ...]) -> None:
    """Replace only the partitions that `df` has rows for.

    Rebalancing gathers small runs in few files and splits a hot run over many tasks.
    """
    (df.hint("rebalance", *keys).write.partitionBy(*keys).mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", _ROWS_PER_FILE).format(kind).save(path))


def write_reviews(df: DataFrame, path: str) -> None:
    """Save cleaned reviews, one partition per run."""
    _write(df, path, "parquet", RUN_KEY)


def read_reviews(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_by_day(df: DataFrame, path: str) -> None:
    """Save reviews by day, sorted by time, so that later reads can skip what lies before a window."""
    by_day = df.withColumn("review_date", F.to_date("date"))
    (by_day.hint("rebalance", "review_date").sortWithinPartitions("review_date", "date")
     .write.partitionBy("review_date").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path))


def read_since(spark: SparkSession, path: str, start: datetime) -> DataFrame:
    """Reviews from `start` on; older days are never opened (partition pruning plus pushdown)."""
    since = F.lit(start).cast("timestamp")
    stored = spark.read.parquet(path)
    return stored.where((F.col("review_date") >= since.cast("date")) & (F.col("date") >= since)).drop("review_date")


def write_reports(df: DataFrame, path: str) -> None:
    """Save nested reports as JSON, one partition per run."""
    _write(df, path, "json", RUN_KEY)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPORT).json(path)


def write_snapshot(runs: DataFrame, reports: DataFrame, path: str) -> None:
    """Publish the run list and one partition per report."""
    runs.write.mode("overwrite").json(f"{path}/runs")
    _write(reports, f"{path}/reports", "json", RUN_KEY)


def write_markdown(texts: DataFrame, path: str) -> None:
    """Save the markdown `text` of each report under its run."""
    _write(texts.select(*RUN_KEY, "text"), path, "text", RUN_KEY)
