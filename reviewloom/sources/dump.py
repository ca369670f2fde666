"""The review dump: `key: value` lines, a record starting at a product/productId line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Record start in the dump format, anchored at a line start (fixed value of the format).
START = "product/productId: "
FIELDS = {"product_id": "product/productId", "helpfulness": "review/helpfulness", "score": "review/score", "text": "review/text"}


def field(record: Column | str, name: str, join_lines: str | None = None) -> Column:
    """Value of a field: from its line to the next line that opens a product/ or review/ field; null if absent.

    The first occurrence counts. A name inside a line opens nothing. join_lines replaces the line breaks inside.
    """
    r = F.col(record) if isinstance(record, str) else record
    m = F.regexp_extract(r, rf"(?:^|\n){name}: ?((?:(?!\n(?:product|review)/\w+: )[\s\S])*+)", 1)
    v = F.when(r.rlike(rf"(?:^|\n){name}:"), m)
    return v if join_lines is None else F.regexp_replace(v, "\n", join_lines)


ORDER = ("file", "block", "pos")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, pos, record): raw records, which ascend in file order by those three. Text of a file before its first
    record is dropped.

    The multi-character line separator lets Spark split the files at record starts, in parallel. The partitions of a scan
    come in no particular order, so the order is that of file name, offset of the split and place in it.
    """
    raw = spark.read.option("lineSep", "\n" + START).text(path)
    at = F.monotonically_increasing_id()
    named = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), at.alias("pos"), F.col("value").alias("v"))
    # a file's first row keeps its START, or is what stands before the first record
    heads = named.filter("block = 0").groupBy("file").agg(F.min("pos").alias("head"))
    j = named.join(heads, "file", "left")
    first = F.col("v").startswith(START)
    rec = F.when(first, F.col("v")).when(F.col("pos").eqNullSafe(F.col("head")), F.lit(None)).otherwise(F.concat(F.lit(START), F.col("v")))
    return j.select(*ORDER, F.regexp_replace(rec, r"\n+$", "").alias("record")).filter("record is not null")


def parse_records(records: DataFrame, join_lines: str | None = None) -> DataFrame:
    """Adds product_id, helpfulness, score and text as strings; works on batch and streaming frames alike."""
    out = records
    for column, name in FIELDS.items():
        v = field("record", name, join_lines if column == "text" else None)
        out = out.withColumn(column, v if column == "text" else F.trim(F.regexp_extract(v, r"^([^\n]*)", 1)))
    return out


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine with reason): a record needs all four fields, an int/int helpfulness and a numeric score."""
    reason = (
        F.when(F.col("product_id").isNull() | (F.col("product_id") == ""), "missing product_id")
        .when(F.col("text").isNull(), "missing text")
        .when(F.col("helpfulness").isNull(), "missing helpfulness")
        .when(F.col("score").isNull(), "missing score")
        .when(~F.col("helpfulness").rlike(r"^\s*\d+\s*/\s*\d+\s*$"), "bad helpfulness")
        .when(F.expr("try_cast(score as float)").isNull(), "bad score")
    )
    marked = parsed.withColumn("reason", reason)
    return marked.filter("reason is null").drop("reason"), marked.filter("reason is not null")


def number_reviews(df: DataFrame, *order: str) -> DataFrame:
    """review_id dense from 1 in the order of the columns."""
    from reviewloom.operators.numbering import dense_index

    return dense_index(df, [F.col(c) for c in order], "_n").withColumn("review_id", F.col("_n") + 1).drop("_n")


def read_dump(spark: SparkSession, path: str, join_lines: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(reviews with text fields and a dense review_id, quarantine). An empty file gives two empty frames."""
    valid, bad = split_valid(parse_records(read_records(spark, path), join_lines))
    return number_reviews(valid, *ORDER).select("review_id", *FIELDS), bad.select("record", "reason")


def dump_record(reviews: DataFrame) -> DataFrame:
    """(review_id, record) of typed review rows. A null field has no line. A line of the text that would open a field is moved by
    a blank; line breaks at the end of a record are lost."""
    inner = F.regexp_replace("text", r"\n((?:product|review)/\w+: )", "\n $1")
    helpful = F.concat(F.col("helpfulness_num").cast("string"), F.lit("/"), F.col("helpfulness_denom").cast("string"))
    value = {"product_id": F.col("product_id"), "helpfulness": helpful, "score": F.col("score").cast("string"), "text": inner}
    lines = [F.concat(F.lit(f"{name}: "), value[c]) for c, name in FIELDS.items()]
    # every record opens with its product line, be it empty
    lines[0] = F.concat(F.lit(START), F.coalesce("product_id", F.lit("")))
    return reviews.select("review_id", F.concat_ws("\n", *lines).alias("record"))


def write_dump(reviews: DataFrame, path: str) -> None:
    """Text files in the order of review_id, by file name and place."""
    r = dump_record(reviews).repartitionByRange("review_id").sortWithinPartitions("review_id")
    r.select("record").write.mode("overwrite").text(path)
