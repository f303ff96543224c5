"""Schemas of everything that is read from or written to files."""

from __future__ import annotations

from pyspark.sql import types as T

RUN_KEY = ("product", "iso_year", "iso_week")


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


_S, _I, _L, _D, _TS, _B = (
    T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType(), T.BooleanType())

REVIEW = _struct(
    ("id", _S), ("store", _S), ("product", _S), ("author", _S), ("rating", _I), ("title", _S),
    ("body", _S), ("date", _TS), ("version", _S), ("language", _S), ("raw_length", _I))

_LABEL = _struct(("label", _S))
FEED_ENTRY = _struct(
    ("id", _LABEL), ("author", _struct(("name", _LABEL))), ("title", _LABEL), ("content", _LABEL),
    ("im:rating", _LABEL), ("im:version", _LABEL), ("updated", _LABEL))

# A landed page: where it comes from, and the response as it was received.
RAW_PAGE = _struct(("product", _S), ("app_id", _S), ("page", _I), ("payload", _S))
# `entry` is kept as text: a page holds a list of entries, one entry, or none.
FEED_PAGE = _struct(("feed", _struct(("entry", _S))), ("_corrupt_record", _S))

# `score` and `at` are kept as text, so that one bad value drops one row.
SCRAPE_ROW = _struct(
    ("product", _S), ("app_id", _S), ("batch", _I), ("pos", _I), ("reviewId", _S), ("userName", _S),
    ("content", _S), ("score", _S), ("reviewCreatedVersion", _S), ("at", _S))

PRODUCT = _struct(
    ("slug", _S), ("display_name", _S), ("appstore_id", _S), ("playstore_id", _S), ("doc_id", _S),
    ("doc_title", _S), ("stakeholder_emails", T.ArrayType(_S)))
PRODUCT_FILE = _struct(("products", T.ArrayType(PRODUCT)))

EMBEDDING = _struct(("review_id", _S), ("embedding", T.ArrayType(T.FloatType())), ("model", _S))

QUOTE = _struct(
    ("text", _S), ("review_id", _S), ("rating", _I), ("store", _S), ("date", _TS), ("validated", _B))
ACTION = _struct(("title", _S), ("details", _S), ("related_theme", _S))
THEME = _struct(
    ("name", _S), ("description", _S), ("quotes", T.ArrayType(QUOTE)), ("actions", T.ArrayType(ACTION)),
    ("review_count", _I), ("cluster_label", _I))
TOKEN_USAGE = _struct(("input_tokens", _L), ("output_tokens", _L), ("estimated_cost_usd", _D))
STATS = _struct(
    ("total_reviews", _L), ("appstore_reviews", _L), ("playstore_reviews", _L), ("clusters_found", _L),
    ("noise_reviews", _L), ("themes_generated", _L), ("quotes_proposed", _L), ("quotes_validated", _L),
    ("llm_usage", TOKEN_USAGE))
REPORT = _struct(
    ("product", _S), ("display_name", _S), ("iso_year", _I), ("iso_week", _I), ("generated_at", _TS),
    ("review_window_start", _TS), ("review_window_end", _TS), ("themes", T.ArrayType(THEME)), ("stats", STATS))

RUN_RECORD = _struct(
    ("run_id", _S), ("product", _S), ("iso_year", _I), ("iso_week", _I), ("status", _S),
    ("started_at", _TS), ("completed_at", _TS),
    ("reviews_fetched", _struct(("appstore", _L), ("playstore", _L), ("total", _L))),
    ("review_window", _struct(("start", _TS), ("end", _TS))),
    ("clusters_found", _L), ("themes_generated", _L), ("quotes_proposed", _L), ("quotes_validated", _L),
    ("llm_tokens", _struct(("input", _L), ("output", _L), ("estimated_cost_usd", _D))),
    ("doc_delivery", _struct(("document_id", _S), ("heading_id", _S), ("section_anchor", _S), ("delivered_at", _TS))),
    ("email_delivery", _struct(
        ("draft_id", _S), ("message_id", _S), ("recipients", T.ArrayType(_S)), ("mode", _S), ("delivered_at", _TS))),
    ("update_seq", _L))

# The shape a summariser must answer with; `_corrupt_record` tells broken text from missing fields.
RAW_THEME = _struct(
    ("name", _S), ("description", _S), ("quotes", T.ArrayType(_S)), ("action_ideas", T.ArrayType(_S)),
    ("_corrupt_record", _S))
