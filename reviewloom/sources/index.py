"""The persisted index: four Parquet tables, laid out for point lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewloom import schemas
from reviewloom.operators import build
from reviewloom.operators.lookup import ReviewLookup

TABLES = {"reviews": schemas.REVIEWS, "products": schemas.PRODUCTS, "tokens": schemas.TOKENS, "postings": schemas.POSTINGS}


def _sorted(df: DataFrame, *by: str) -> DataFrame:
    """Range-partitioned and sorted, so that each file's and row group's min/max are narrow. Spark's sort spills."""
    return df.repartitionByRange(*by).sortWithinPartitions(*by)


def write_index(reviews: DataFrame, path: str) -> None:
    """Builds and writes all four tables from typed rows (review_id, product_id, score, helpfulness_num, helpfulness_denom, text).

    An existing index is overwritten. Empty input gives empty tables.
    """
    spark = reviews.sparkSession
    from reviewloom.functions.tokens import token_count

    prods = build.products(reviews)
    _sorted(prods, "product_id").write.mode("overwrite").parquet(f"{path}/products")
    nums = spark.read.schema(schemas.PRODUCTS).parquet(f"{path}/products").select("product_id", "product_num")
    typed = reviews.withColumn("length", token_count("text"))
    full = typed.join(nums, "product_id", "left").select(*[F.col(f.name).cast(f.dataType) for f in schemas.REVIEWS])
    _sorted(full, "review_id").write.mode("overwrite").parquet(f"{path}/reviews")
    post = build.postings(reviews)
    _sorted(post, "token", "review_id").write.mode("overwrite").parquet(f"{path}/postings")
    stored = spark.read.schema(schemas.POSTINGS).parquet(f"{path}/postings")
    _sorted(build.token_dictionary(build.token_stats(stored)), "token").write.mode("overwrite").parquet(f"{path}/tokens")


def open_index(spark: SparkSession, path: str) -> ReviewLookup:
    """Raises if a table is missing."""
    return ReviewLookup(*[spark.read.schema(s).parquet(f"{path}/{t}") for t, s in TABLES.items()])


def drop_index(spark: SparkSession, path: str) -> bool:
    """Deletes the index through the file system that holds it; false if there was none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.delete(p, True)
