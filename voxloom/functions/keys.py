"""Identifiers and small column expressions shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STORES = ("appstore", "playstore")


def review_id(store: Column, app_id: Column, source_id: Column) -> Column:
    """Stable id of a review: the first 16 hex digits of SHA-256 of `store:app:id`."""
    return F.substring(F.sha2(F.concat_ws(":", store, app_id, source_id), 256), 1, 16)


def clamp_rating(rating: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(5), rating))


def to_utc(text: Column) -> Column:
    """ISO-8601 text to a timestamp; text without offset is read as UTC, junk is NULL.

    The test keeps out what a cast would also take: a year alone, a time alone, `today`.
    """
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))


def raw_length(body: Column) -> Column:
    return F.length(body)


def run_key(product: Column, year: Column, week: Column) -> Column:
    return F.format_string("%s:%d:W%02d", product, year, week)


def section_anchor(product: Column, year: Column, week: Column) -> Column:
    return F.format_string("%s-%d-W%02d", product, year, week)


def report_key(product: Column, year: Column, week: Column) -> Column:
    return F.format_string("%s_%d_W%02d", product, year, week)


def deep_link(doc_id: Column, anchor: Column) -> Column:
    # Fixed value: the link format of the published document.
    return F.format_string("https://docs.google.com/document/d/%s/edit#heading=h.%s", doc_id, anchor)


def date_label(when: Column) -> Column:
    return F.coalesce(F.date_format(when, "yyyy-MM-dd"), F.lit("Unknown Date"))
