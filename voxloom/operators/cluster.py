"""Clusters of the reviews of a run, their members and their figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxloom.functions import ranking
from voxloom.operators.density import NOISE, density_cluster
from voxloom.operators.reduce import reduce_dims
from voxloom.schemas import RUN_KEY


def cluster_reviews(embedded: DataFrame, min_cluster_size: int = 5, keys: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """Add `label` and `reduced`. A run with fewer than two minimal clusters is one cluster, label 0.

    `embedded` has the run key, `pos` and `embedding`.
    """
    sizes = embedded.groupBy(*keys).agg(F.count("*").alias("_n"))
    sized = embedded.join(sizes, list(keys))
    reduced = reduce_dims(sized.drop("_n"), keys)
    small = F.col("_n") < 2 * min_cluster_size
    flagged = reduced.join(sizes, list(keys))
    few = flagged.where(small).drop("_n").withColumn("label", F.lit(0))
    many = density_cluster(flagged.where(~small).drop("_n"), keys, min_cluster_size=min_cluster_size)
    return few.unionByName(many)


def noise_exclude(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("label") != NOISE)


def noise_count(labelled: DataFrame, keys: tuple[str, ...] = RUN_KEY) -> DataFrame:
    noise = F.col("label") == NOISE
    return labelled.groupBy(*keys).agg(
        F.count_if(noise).alias("noise_reviews"), F.count_if(~noise).alias("clustered_reviews"))


def cluster_stats(labelled: DataFrame, keys: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """Size, mean rating, first and last member of each cluster; `cluster_members` lists the members, a row each."""
    return noise_exclude(labelled).groupBy(*keys, "label").agg(
        F.count("*").alias("size"), F.avg("rating").alias("avg_rating"), F.min("pos").alias("first_pos"),
        F.min_by("id", "pos").alias("first_id"), F.max_by("id", "pos").alias("last_id"))


def top_clusters(clusters: DataFrame, max_themes: int = 5, keys: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """The largest clusters of a run with their `rank`; ties by first member."""
    return ranking.top_n(clusters, keys, [F.col("size").desc(), F.col("first_pos")], max_themes, "rank")


def cluster_members(labelled: DataFrame, reviews: DataFrame, keys: tuple[str, ...] = RUN_KEY) -> DataFrame:
    """One row per member of a cluster with its number in member order (from 0) and its review, however large the cluster."""
    members = noise_exclude(labelled).select(*keys, "label", "pos", "id")
    listed = number_items(members, (*keys, "label"), [F.col("pos")], "_n").withColumn("member_no", F.col("_n") - 1).drop("_n", "pos")
    return listed.join(reviews, [*[k for k in keys if k in reviews.columns], "id"])


def number_items(df: DataFrame, keys: tuple[str, ...], order: list, name: str = "n") -> DataFrame:
    """1-based numbers inside a cluster or report; a hot one spans many tasks."""
    return ranking.position(df, keys, order, name)
