"""Tokens, money and budgets of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voxloom.functions import ranking
from voxloom.functions.pricing import token_cost
from voxloom.schemas import RUN_KEY


def usage_cost(calls: DataFrame) -> DataFrame:
    """Add the USD cost of every call `(model, input_tokens, output_tokens)`."""
    return calls.withColumn("cost_usd", token_cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens")))


def run_cost(calls: DataFrame, keys: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """Tokens and cost per run."""
    return usage_cost(calls).groupBy(*keys).agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum("cost_usd").alias("estimated_cost_usd"))


def cost_alerts(totals: DataFrame, max_tokens: int = 60_000, max_usd: float = 2.0) -> DataFrame:
    """Runs over the token budget or over the money threshold."""
    tokens = F.col("input_tokens") + F.col("output_tokens")
    flagged = totals.withColumns({
        "over_tokens": tokens > max_tokens, "over_cost": F.col("estimated_cost_usd") > max_usd})
    return flagged.where(F.col("over_tokens") | F.col("over_cost"))


def token_budget(ranked: DataFrame, tokens: str, budget: int, keys: tuple[str, ...] = RUN_KEY, rank: str = "rank",
                 start: Column | int = 0) -> DataFrame:
    """Calls made before the budget ran out; the one that crosses it is still kept.

    A key may hold any number of calls: the running totals come from slices.
    """
    spent = ranking.total_before(ranked, keys, [F.col(rank)], F.col(tokens), "tokens_before")
    return spent.withColumn("tokens_before", (F.col("tokens_before") + start).cast("long")).where(F.col("tokens_before") <= budget)
