"""What readers ask for: runs with a preview, and a report with its document."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voxloom.schemas import RUN_KEY


def _doc_ids(products: DataFrame) -> DataFrame:
    return products.select(F.col("slug").alias("product"), "doc_id")


def runs_with_preview(ledger: DataFrame, products: DataFrame, reports: DataFrame) -> DataFrame:
    """Ledger rows with the product's document and the first theme, quote and action of the report."""
    first = F.get("themes", F.lit(0))
    preview = reports.select(
        *RUN_KEY, F.struct(
            first["name"].alias("theme_name"), F.get(first["quotes"], F.lit(0))["text"].alias("quote"),
            F.get(first["actions"], F.lit(0))["title"].alias("action")).alias("_p"), (F.size("themes") > 0).alias("_some"))
    joined = ledger.join(_doc_ids(products), "product", "left").join(preview, list(RUN_KEY), "left")
    return joined.withColumn("preview", F.when(F.col("_some"), F.col("_p"))).drop("_p", "_some")


def reports_with_product(reports: DataFrame, products: DataFrame) -> DataFrame:
    return reports.join(_doc_ids(products), "product", "left")


def report_with_product(reports: DataFrame, products: DataFrame, product: str, iso_year: int,
                        iso_week: int) -> DataFrame:
    """One report and its document; a missing report is an error."""
    wanted = reports.where(
        (F.col("product") == product) & (F.col("iso_year") == iso_year) & (F.col("iso_week") == iso_week))
    if wanted.isEmpty():
        raise KeyError(f"Report not found: {product}_{iso_year}_W{iso_week:02d}")
    return reports_with_product(wanted, products)
