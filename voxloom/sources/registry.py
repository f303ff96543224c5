"""The product registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxloom.schemas import PRODUCT, PRODUCT_FILE


def scan_products(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Registry files `{"products": [..]}` as a table; of a repeated slug the last one counts."""
    files = spark.read.schema(PRODUCT_FILE).json(path, multiLine=multi_line)
    rows = files.select(F.input_file_name().alias("_file"), F.posexplode("products").alias("_pos", "p"))
    place = F.struct("_file", "_pos")
    last = rows.where(F.col("p.slug").isNotNull()).groupBy(F.col("p.slug").alias("slug")).agg(
        F.max_by("p", place).alias("p"))
    defaults = {
        name: F.coalesce(F.col(f"p.{name}"), F.lit("")) for name in PRODUCT.names
        if name not in ("slug", "stakeholder_emails")}
    return last.select(
        "slug", *[value.alias(name) for name, value in defaults.items()],
        F.coalesce(F.col("p.stakeholder_emails"), F.array().cast("array<string>")).alias("stakeholder_emails"))


def unknown_products(requested: DataFrame, products: DataFrame) -> DataFrame:
    """Requested slugs the registry does not have."""
    return requested.select("slug").distinct().join(products, "slug", "left_anti")


def require_products(requested: DataFrame, products: DataFrame) -> DataFrame:
    """The requested products; an unknown slug is an error that lists the known ones."""
    missing = unknown_products(requested, products).orderBy("slug").limit(1).collect()
    if missing:
        known = products.agg(F.array_join(F.sort_array(F.collect_set("slug")), ", ").alias("slugs")).first()["slugs"]
        raise KeyError(f"Product '{missing[0]['slug']}' is not registered. Available: {known}")
    return products.join(requested.select("slug").distinct(), "slug", "left_semi")
