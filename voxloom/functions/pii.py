"""Removal of personal data, as built-in regular expressions only."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions.text import has_letter


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    placeholder: str
    counter: str
    guard: str


# Patterns, placeholders and their order decide the result. (?U) makes digits,
# blanks and word edges Unicode-aware; (?i) ignores case.
RULES = (
    Rule("email", r"(?iU)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[EMAIL]", "emails_scrubbed", "at"),
    Rule("upi", r"(?iU)\b[a-zA-Z0-9.\-_]+@[a-zA-Z0-9.\-_]+\b", "[UPI_ID]", "upi_scrubbed", "at"),
    Rule("phone_in", r"(?iU)(?<!\d)(?:\+91[\-\s]?|91[\-\s]?|0)?(?:[6-9]\d{9})(?!\d)", "[PHONE]", "phones_scrubbed",
         "digits"),
    Rule("national_id", r"(?iU)(?<!\+)\b\d{4}[\-\s]?\d{4}[\-\s]?\d{4}\b", "[ID]", "ids_scrubbed", "digits"),
    Rule("phone_intl",
         r"(?iU)(?<!\d)(?:\+\d{1,3}[\-\s]?)?\(?\d{2,4}\)?[\-\s]?\d{3,4}[\-\s]?\d{3,4}(?:[\-\s]?\d{3,4})?(?!\d)",
         "[PHONE]", "phones_scrubbed", "digits"),
    Rule("pan", r"(?iU)\b[A-Z]{5}[0-9]{4}[A-Z]{1}\b", "[PAN]", "pan_scrubbed", "digits"),
)
BY_NAME = {rule.name: rule for rule in RULES}
COUNTERS = ("emails_scrubbed", "upi_scrubbed", "phones_scrubbed", "ids_scrubbed", "pan_scrubbed")
AUTHOR_PLACEHOLDER = "[NAME]"


def _may_match(guard: str, text: Column) -> Column:
    """A cheap test that is true for every text a rule of this guard can change."""
    return F.instr(text, "@") > 0 if guard == "at" else text.rlike(r"(?U)\d{3}")


def scrub_one(text: Column, rule: str) -> Column:
    """Apply a single rule."""
    found = BY_NAME[rule]
    return F.when(
        _may_match(found.guard, text), F.regexp_replace(text, found.pattern, found.placeholder)).otherwise(text)


def anonymize_author(author: Column) -> Column:
    return F.when(author != "", F.lit(AUTHOR_PLACEHOLDER)).otherwise(author)


def _chain(text: Column, *guards: str) -> Column:
    for rule in RULES:
        if rule.guard in guards:
            text = F.regexp_replace(text, rule.pattern, rule.placeholder)
    return text


def scrub_text(text: Column) -> Column:
    """All rules in order. Placeholders hold no digits or '@', so both guards are taken on the input."""
    numbers = F.when(_may_match("digits", text), _chain(text, "digits")).otherwise(text)
    every = F.when(_may_match("digits", text), _chain(text, "at", "digits")).otherwise(_chain(text, "at"))
    return F.when(_may_match("at", text), every).otherwise(numbers)


def lettered_after_scrub(text: Column) -> Column:
    """`has_letter(scrub_text(text))`, which scrubs only texts without letters: placeholders have some."""
    return has_letter(text) | has_letter(scrub_text(text))


def scrub_columns(df: DataFrame, columns: tuple[str, ...] = ("body", "title"), author: str | None = "author") -> DataFrame:
    """The whole chain on the given columns in one projection."""
    clean = {c: scrub_text(F.col(c)) for c in columns}
    if author:
        clean[author] = anonymize_author(F.col(author))
    return df.select(*[clean.get(c, F.col(c)).alias(c) for c in df.columns])


def scrub_lettered(df: DataFrame) -> DataFrame:
    """Scrubbed reviews, without those whose body then holds no letter."""
    return scrub_columns(df.where(lettered_after_scrub(F.col("body"))))


def count_hits(df: DataFrame, columns: tuple[str, ...] = ("body", "title"), author: str = "author") -> DataFrame:
    """Add how often each kind hits. Counts are taken on the text each rule sees, so an e-mail is not
    also a payment handle."""
    kept = df.columns
    totals: dict[str, Column] = {}
    for column in columns:
        df = df.withColumns({f"_{column}_{g}": F.coalesce(_may_match(g, F.col(column)), F.lit(False))
                             for g in ("at", "digits")})
        before = column
        for rule in RULES:
            guard, after = F.col(f"_{column}_{rule.guard}"), f"_{column}_{rule.name}"
            df = df.withColumn(after, F.when(
                guard, F.regexp_replace(F.col(before), rule.pattern, rule.placeholder)).otherwise(F.col(before)))
            hits = F.when(guard, F.regexp_count(F.col(before), F.lit(rule.pattern))).otherwise(0).cast("long")
            totals[rule.counter] = totals[rule.counter] + hits if rule.counter in totals else hits
            before = after
    totals["authors_anonymized"] = F.coalesce(
        (F.col(author) != "") & (F.col(author) != AUTHOR_PLACEHOLDER), F.lit(False)).cast("long")
    return df.select(*kept, *[total.alias(name) for name, total in totals.items()])


def pii_stats(df: DataFrame, keys: tuple[str, ...], columns: tuple[str, ...] = ("body", "title")) -> DataFrame:
    """Hits per kind and key."""
    counted = count_hits(df, columns)
    return counted.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in (*COUNTERS, "authors_anonymized")])


NameDetector = Callable[[pd.Series], tuple[pd.Series, pd.Series]]


def scrub_names(df: DataFrame, column: str, detector: NameDetector | None = None) -> DataFrame:
    """Optional name detection: `detector` maps a batch of texts to (texts with [NAME], hits).

    Without a detector the text stays as it is and no Python worker is started.
    """
    if detector is None:
        return df.withColumn("names_scrubbed", F.lit(0).cast("long"))

    @F.pandas_udf("text string, n long")
    def detect(texts: pd.Series) -> pd.DataFrame:
        replaced, hits = detector(texts)
        return pd.DataFrame({"text": replaced, "n": hits.astype("int64")})

    found = df.withColumn("_names", detect(F.col(column)))
    return found.withColumns({column: F.col("_names.text"), "names_scrubbed": F.col("_names.n")}).drop("_names")
