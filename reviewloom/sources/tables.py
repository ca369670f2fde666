"""The test tables by name, and the fabricated review attributes of a plain document table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents_as_reviews(documents: DataFrame) -> DataFrame:
    """Review rows from documents: ids shifted to start at 1, all other attributes by arithmetic on doc_id."""
    d = F.col("doc_id")
    denom = ((d * 3) % 11).cast("int")
    return documents.select(
        (d + 1).alias("review_id"),
        F.concat(F.lit("B"), F.lpad(F.expr("cast(doc_id div 10 as string)"), 9, "0")).alias("product_id"),
        (1 + (d * 7) % 5).cast("int").alias("score"),
        ((d * 5) % (denom + 1)).cast("int").alias("helpfulness_num"),
        denom.alias("helpfulness_denom"),
        "text",
    )
