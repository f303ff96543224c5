"""From the landed feeds of both stores to the reviews of a weekly run."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, types as T

from voxloom.operators import ingest, normalise
from voxloom.plans.weekly import WeeklyRun, run_weekly
from voxloom.schemas import RAW_PAGE, SCRAPE_ROW
from voxloom.session import durable
from voxloom.settings import Settings
from voxloom.sources import feeds


@dataclass(frozen=True)
class Landed:
    """What the feeds gave, and what they did not."""

    reviews: DataFrame
    rejected: DataFrame
    files: DataFrame
    pages: DataFrame


def landed_reviews(spark: SparkSession, pages: str, batches: str, settings: Settings | None = None,
                   expected: DataFrame | None = None) -> Landed:
    """Every poll of both stores as valid reviews with `seq`; later polls have larger numbers.

    A store whose folder is missing counts as empty, a file or line that cannot be read is left out and told in `files`, pages from the
    first broken one of a product's poll on are left out (`pages` tells which), and reviews that break a rule are in `rejected`.
    """
    settings = settings or Settings()
    of = lambda schema: T.StructType([*schema, feeds.POLL])
    raw_pages, page_files = feeds.read_landed(spark, "appstore", pages, of(RAW_PAGE), expected)
    raw_rows, row_files = feeds.read_landed(spark, "playstore", batches, of(SCRAPE_ROW), expected)
    raw_pages = raw_pages.drop("file")
    entries = feeds.scan_appstore_pages(feeds.drop_after_failure(raw_pages), settings.max_feed_pages)
    app = normalise.normalize_appstore(entries)
    play = normalise.normalize_playstore(feeds.scan_playstore_batches(raw_rows.drop("file")))
    valid, rejected = normalise.quarantine_invalid(ingest.union_sources(app, play))
    return Landed(valid, rejected, page_files.unionByName(row_files), feeds.page_status(raw_pages))


def run_landed(spark: SparkSession, pages: str, batches: str, products: DataFrame, weeks: Sequence[ingest.Week], ledger: DataFrame,
               published: DataFrame, cache: DataFrame, now: Column, update_seq: int, settings: Settings | None = None,
               **pluggable: Any) -> tuple[WeeklyRun, Landed]:
    """The weekly run from the folders the feeds land in."""
    landed = landed_reviews(spark, pages, batches, settings)
    # Parsed pages are read several times: once for the choice of rows, once for the texts.
    reviews = durable(landed.reviews)
    run = run_weekly(reviews, products, weeks, ledger, published, cache, now, update_seq, settings, **pluggable)
    return run, landed
