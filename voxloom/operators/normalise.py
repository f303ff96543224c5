"""Raw feed rows to reviews, and the rules a review has to meet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.keys import STORES, clamp_rating, raw_length, review_id, to_utc

_SEQ_PER_PAGE = 1 << 20
_SEQ_PER_POLL = 1 << 40


def _whole_number(text: Column) -> Column:
    return F.when(text.rlike(r"^\s*[+-]?\d+\s*$"), F.btrim(text).try_cast("int"))


def _extra(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c == "poll"]


def _poll(df: DataFrame) -> Column:
    """The poll as the highest part of `seq`: of two polls with a review in the same place, the later one wins."""
    return F.coalesce("poll", F.lit(0)).cast("long") * _SEQ_PER_POLL if _extra(df) else F.lit(0).cast("long")


def normalize_appstore(entries: DataFrame) -> DataFrame:
    """Feed entries to reviews. Every label is required; a bad date or rating drops the row."""
    label = {
        "source_id": F.col("entry.id.label"), "author": F.col("entry.author.name.label"),
        "title": F.col("entry.title.label"), "body": F.col("entry.content.label"),
        "version": F.col("entry.`im:version`.label"), "rating": _whole_number(F.col("entry.`im:rating`.label")),
        "date": to_utc(F.col("entry.updated.label"))}
    rows = entries.select("product", "app_id", "page", "pos", *_extra(entries), *[c.alias(n) for n, c in label.items()])
    return rows.dropna(subset=list(label)).select(
        review_id(F.lit("appstore"), F.col("app_id"), F.col("source_id")).alias("id"),
        F.lit("appstore").alias("store"), "product", "author", clamp_rating(F.col("rating")).alias("rating"),
        "title", "body", "date", "version", F.lit("en").alias("language"),
        raw_length(F.col("body")).alias("raw_length"),
        (_poll(entries) + F.col("page").cast("long") * _SEQ_PER_PAGE + F.col("pos")).alias("seq"))


def normalize_playstore(rows: DataFrame) -> DataFrame:
    """Scrape rows to reviews. No id or no time drops the row; other gaps get defaults."""
    score = F.when(F.col("score").isNull(), F.lit(0)).otherwise(_whole_number(F.col("score")))
    read = rows.select(
        "product", "app_id", "batch", "pos", "reviewId", *_extra(rows),
        F.coalesce("userName", F.lit("Unknown")).alias("author"), F.coalesce("content", F.lit("")).alias("body"),
        score.alias("rating"), F.col("reviewCreatedVersion").alias("version"), to_utc(F.col("at")).alias("date"))
    kept = read.where((F.col("reviewId") != "") & F.col("date").isNotNull() & F.col("rating").isNotNull())
    return kept.select(
        review_id(F.lit("playstore"), F.col("app_id"), F.col("reviewId")).alias("id"),
        F.lit("playstore").alias("store"), "product", "author", clamp_rating(F.col("rating")).alias("rating"),
        F.lit(None).cast("string").alias("title"), "body", "date", "version", F.lit("en").alias("language"),
        raw_length(F.col("body")).alias("raw_length"),
        (_poll(rows) + F.col("batch").cast("long") * _SEQ_PER_PAGE + F.col("pos")).alias("seq"))


def review_reason(df: DataFrame) -> DataFrame:
    """Add `reason`: the first rule a review breaks, NULL for a good one."""
    checks = (
        ("no id", F.col("id").isNull()),
        ("unknown store", F.col("store").isNull() | ~F.col("store").isin(*STORES)),
        ("no product", F.col("product").isNull()),
        ("rating out of range", F.col("rating").isNull() | ~F.col("rating").between(1, 5)),
        ("no body", F.col("body").isNull()),
        ("no date", F.col("date").isNull()),
        ("negative length", F.coalesce(F.col("raw_length") < 0, F.lit(False))),
    )
    return df.withColumn("reason", F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in checks]))


def quarantine_invalid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into valid reviews and rejected ones with a reason."""
    checked = review_reason(df)
    return checked.where("reason IS NULL").drop("reason"), checked.where("reason IS NOT NULL")
