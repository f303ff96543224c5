"""Text expressions: joining, trimming, letters, sanitising."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Longest text shown to a summariser, and what an over-long one keeps.
MAX_PROMPT_TEXT = 2000
KEPT_PROMPT_TEXT = 1997
CONTROL_CHARS = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"


def join_title(title: Column, body: Column, sep: str) -> Column:
    """`title<sep>body`, or the body alone when the title is missing or empty."""
    return F.concat_ws(sep, F.nullif(title, F.lit("")), body)


def embedding_text(title: Column, body: Column) -> Column:
    return join_title(title, body, "\n")


def has_letter(body: Column) -> Column:
    """At least one Unicode letter."""
    return body.rlike(r"\p{L}")


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def sanitize(text: Column) -> Column:
    """Drop control characters, shorten, and only then escape angle brackets."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL_CHARS, "")
    short = F.when(
        F.length(clean) > MAX_PROMPT_TEXT,
        F.concat(F.substring(clean, 1, KEPT_PROMPT_TEXT), F.lit("..."))).otherwise(clean)
    return F.replace(F.replace(short, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
