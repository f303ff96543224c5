"""Token prices and costs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# USD per 1000 tokens as (part of the model name, input, output); the first part
# that occurs in a model's name decides, and an unknown model costs as DEFAULT_PRICE.
PRICES = (
    ("text-embedding-3-small", 0.00002, 0.0),
    ("gpt-4o-mini", 0.00015, 0.00060),
    ("gpt-4o", 0.0025, 0.0100),
    ("llama", 0.0, 0.0),
    ("all-MiniLM", 0.0, 0.0),
)
DEFAULT_PRICE = "gpt-4o-mini"


def price_of(model: Column, prices: tuple[tuple[str, float, float], ...] = PRICES,
             default: str = DEFAULT_PRICE) -> Column:
    """STRUCT<pattern, input, output> for a model. The list is short, so it is a CASE, not a join."""
    def row(pattern: str, cost_in: float, cost_out: float) -> Column:
        return F.struct(
            F.lit(pattern).alias("pattern"), F.lit(cost_in).alias("input"), F.lit(cost_out).alias("output"))

    fallback = next(row(*p) for p in prices if p[0] == default)
    chain = F.when(model.isNull(), fallback)
    for entry in prices:
        chain = chain.when(F.contains(model, F.lit(entry[0])), row(*entry))
    return chain.otherwise(fallback)


def token_cost(model: Column, tokens_in: Column, tokens_out: Column,
               prices: tuple[tuple[str, float, float], ...] = PRICES) -> Column:
    price = price_of(model, prices)
    return (tokens_in / F.lit(1000.0)) * price["input"] + (tokens_out / F.lit(1000.0)) * price["output"]
