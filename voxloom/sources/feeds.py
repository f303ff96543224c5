"""Landed review feeds: pages of one store, batches of the other, and what to do when one is missing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from voxloom.schemas import FEED_ENTRY, FEED_PAGE, RAW_PAGE, SCRAPE_ROW

POLL = T.StructField("poll", T.IntegerType())
_SKIP_BROKEN = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}


def _poll(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == POLL.name]


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed pages as JSON lines `{product, app_id, page, payload, poll}`; `poll` counts the fetches and may be missing."""
    return spark.read.schema(T.StructType([*RAW_PAGE, POLL])).json(path)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """Landed scrape rows as JSON lines, 100 to a batch, newest first."""
    return spark.read.schema(T.StructType([*SCRAPE_ROW, POLL])).json(path)


def read_landed(spark: SparkSession, source: str, path: str, schema: T.StructType,
                expected: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows of the landed JSON lines with their `file`, one status row per file), whatever state the files are in.

    A file that cannot be read costs itself only, a line that is no JSON object costs that line; both are told by `(source, file, bytes,
    rows, broken, expected, ok, error)`: `ok` is a file without broken lines that gave rows, or as many as `expected` (`file, rows`) says. A
    compressed file that was cut off gives what comes before the cut, which only `expected` can tell. A listed file that has not landed, and
    a folder that is not there, have a status row too; files without a byte have none.
    """
    nothing = spark.createDataFrame([], T.StructType([*schema, T.StructField("file", T.StringType())]))
    try:
        there = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))
        lines = spark.read.options(ignoreCorruptFiles="true", ignoreMissingFiles="true").text(path)
    except AnalysisException as failure:
        gone = spark.range(1).select(F.lit(path).alias("file"), F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("long").alias("rows"),
                                     F.lit(None).cast("long").alias("broken"))
        return nothing, _file_status(gone, source, expected, failure.getCondition() or type(failure).__name__)
    parsed = lines.where(F.btrim("value") != "").select(
        F.col("_metadata.file_path").alias("file"),
        F.from_json("value", T.StructType([*schema, T.StructField("_corrupt_record", T.StringType())]), _SKIP_BROKEN).alias("_row"))
    broken = F.col("_row").isNull() | F.col("_row._corrupt_record").isNotNull()
    counted = parsed.groupBy("file").agg(F.count_if(~broken).alias("rows"), F.count_if(broken).alias("broken"))
    status = _file_status(there.join(counted, "file", "left"), source, expected, None)
    return parsed.where(~broken).select("_row.*", "file").drop("_corrupt_record"), status


def _file_status(files: DataFrame, source: str, expected: DataFrame | None, error: str | None) -> DataFrame:
    listed = files if expected is None else files.join(expected.select("file", F.col("rows").alias("expected")), "file", "full")
    rows, broken, bytes_ = (F.coalesce(c, F.lit(0)) for c in ("rows", "broken", "bytes"))
    want = F.lit(None).cast("long") if expected is None else F.col("expected")
    whole = F.col("bytes").isNotNull() & (broken == 0) & F.when(want.isNull(), (rows > 0) | (bytes_ == 0)).otherwise(rows == want)
    told = F.when(F.lit(error is not None), F.lit(error)).when(whole, F.lit(None)).when(F.col("bytes").isNull(), "not landed").when(
        broken > 0, "broken lines").when(rows == 0, "not readable").otherwise("rows missing")
    return listed.select(
        F.lit(source).alias("source"), "file", bytes_.alias("bytes"), rows.alias("rows"), broken.alias("broken"), want.alias("expected"),
        (whole if error is None else F.lit(False)).alias("ok"), told.cast("string").alias("error"))


def _with_entries(pages: DataFrame) -> DataFrame:
    parsed = pages.withColumn("_page", F.from_json("payload", FEED_PAGE, _SKIP_BROKEN))
    text = F.col("_page.feed.entry")
    entries = F.coalesce(
        F.from_json(text, T.ArrayType(FEED_ENTRY)), F.array(F.from_json(text, FEED_ENTRY)))
    return parsed.withColumns({
        "broken": F.col("payload").isNull() | F.col("_page._corrupt_record").isNotNull(),
        "entries": F.filter(F.coalesce(entries, F.array().cast(T.ArrayType(FEED_ENTRY))), lambda e: e.isNotNull()),
    }).drop("_page")


def scan_appstore_pages(pages: DataFrame, max_pages: int | None = None) -> DataFrame:
    """One row per feed entry. Broken pages give no rows; with `max_pages`, pages beyond it are not read."""
    read = _with_entries(pages if max_pages is None else pages.where(F.col("page") <= max_pages))
    return read.select("product", "app_id", "page", *_poll(pages), F.posexplode("entries").alias("pos", "entry"))


def scan_playstore_batches(batches: DataFrame) -> DataFrame:
    """Scrape rows with their place in the feed; a line that is no JSON object gives an empty row."""
    return batches.select(*SCRAPE_ROW.names, *_poll(batches))


def drop_after_failure(pages: DataFrame) -> DataFrame:
    """Keep the pages read before the first broken one of each product and poll."""
    poll = F.coalesce("poll", F.lit(0)) if _poll(pages) else F.lit(0)
    marked = _with_entries(pages).select(*pages.columns, "broken", poll.alias("_poll"))
    first = marked.where("broken").groupBy("product", "app_id", "_poll").agg(F.min("page").alias("_failed_page"))
    joined = marked.where(~F.col("broken")).join(first, ["product", "app_id", "_poll"], "left")
    return joined.where(F.col("_failed_page").isNull() | (F.col("page") < F.col("_failed_page"))).select(*pages.columns)


def page_status(pages: DataFrame) -> DataFrame:
    """Per product: pages landed, pages usable, first broken page."""
    marked = _with_entries(pages)
    return marked.groupBy("product", "app_id").agg(
        F.count("*").alias("pages"), F.count_if(~F.col("broken")).alias("usable"),
        F.min(F.when(F.col("broken"), F.col("page"))).alias("failed_page"))


def read_or_empty(spark: SparkSession, source: str, schema: T.StructType,
                  read: Callable[[], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """A source that cannot be read counts as empty; the other sources go on.

    Gives the rows and one status row `(source, ok, error)`.
    """
    error = None
    try:
        rows = read()
    except AnalysisException as failure:
        error = failure.getCondition() or type(failure).__name__
        rows = spark.createDataFrame([], schema)
    status = spark.range(1).select(
        F.lit(source).alias("source"), F.lit(error is None).alias("ok"), F.lit(error).cast("string").alias("error"))
    return rows, status
