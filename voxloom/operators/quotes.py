"""Are the quotes of a theme really in its reviews, and in which one?"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxloom.functions.text import strip
from voxloom.schemas import RUN_KEY

_SALTS = 16
_SOURCE = ("id", "pos", "rating", "store", "date")


def _hits(quotes: DataFrame, members: DataFrame, texts: DataFrame, keys: tuple[str, ...], salts: int) -> DataFrame:
    """Pairs of a quote and a member of its cluster whose body holds the trimmed quote.

    Quotes meet the members without their bodies first: a theme has a few quotes but a cluster
    may be huge, so members are dealt to `salts` shares and the quotes repeated for each share.
    The pairs then meet each body once, by review.
    """
    where = [*keys, "label"]
    asked = quotes.select(*where, "quote_no", strip(F.col("text")).alias("_needle"),
                          F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_salt"))
    told = members.select(
        *where, F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("_salt"), F.col("id"),
        *[F.col(c).alias(f"_m_{c}") for c in _SOURCE if c in members.columns])
    pairs = asked.join(told, [*where, "_salt"]).drop("_salt")
    by = [c for c in (*keys, "id") if c in texts.columns]
    return pairs.join(texts.select(*by, "body").where(F.col("body") != ""), by).where(F.contains("body", "_needle"))


def validate_quotes(quotes: DataFrame, members: DataFrame, texts: DataFrame, keys: tuple[str, ...] = RUN_KEY,
                    salts: int = _SALTS) -> DataFrame:
    """Add `validated`.

    `quotes` has the run key, `label`, `quote_no` and `text`; `members` the run key, `label` and
    `id`; `texts` the `body` per `id`, or per run and `id`.
    """
    found = _hits(quotes, members.select(*keys, "label", "id"), texts, keys, salts).select(
        *keys, "label", "quote_no").distinct().withColumn("validated", F.lit(True))
    return quotes.join(found, [*keys, "label", "quote_no"], "left").withColumn(
        "validated", F.coalesce("validated", F.lit(False)))


def attribute_quotes(quotes: DataFrame, members: DataFrame, texts: DataFrame, keys: tuple[str, ...] = RUN_KEY,
                     salts: int = _SALTS) -> DataFrame:
    """Add `validated` and, for a valid quote, id, rating, store and date of the first member that holds it.

    `members` also has `pos, rating, store, date`.
    """
    source = F.struct(*[F.col(f"_m_{c}").alias(c) for c in ("id", "rating", "store", "date")])
    first = _hits(quotes, members, texts, keys, salts).groupBy(*keys, "label", "quote_no").agg(
        F.min_by(source, "_m_pos").alias("_source"))
    joined = quotes.join(first, [*keys, "label", "quote_no"], "left")
    return joined.select(
        *quotes.columns, F.col("_source").isNotNull().alias("validated"), F.col("_source.id").alias("review_id"),
        F.col("_source.rating").alias("rating"), F.col("_source.store").alias("store"),
        F.col("_source.date").alias("date"))


def quote_validation_rate(checked: DataFrame, by: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """Proposed and validated quotes, their ratio (0 when none), and whether it is low."""
    rate = F.coalesce(F.try_divide(F.col("quotes_validated"), F.col("quotes_proposed")), F.lit(0.0))
    return checked.groupBy(*by).agg(
        F.count("*").alias("quotes_proposed"), F.count_if("validated").alias("quotes_validated")
    ).withColumn("rate", rate).withColumn("low", (F.col("quotes_proposed") > 0) & (F.col("rate") < 0.5))
