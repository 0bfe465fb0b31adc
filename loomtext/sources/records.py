"""Record sources and sinks: JSON lines, CSV and Parquet, inventories and fingerprints."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

NAME = re.compile(r"^[a-z][a-z0-9_]{0,62}$")


def read_records(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Read by the path's ending. A JSON line that is no object fails the read."""
    end = path.rsplit(".", 1)[-1].lower()
    if end in ("parquet", "pq"):
        return spark.read.parquet(path)
    if end == "csv":
        reader = spark.read.option("header", True)
        return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    if end in ("jsonl", "json", "ndjson"):
        reader = spark.read.option("mode", "FAILFAST")
        return (reader.schema(schema) if schema else reader).json(path)
    raise ValueError(f"no reader for .{end}")


def bad_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """(line, text) of JSON lines that do not fit the schema; blank lines are no records."""
    text = spark.read.text(path).withColumn("line", F.monotonically_increasing_id())
    full = StructType([*schema.fields, StructField("_corrupt", StringType())])
    parsed = text.where(F.trim("value") != "").withColumn("r", F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    return parsed.where(F.col("r").isNull() | F.col("r._corrupt").isNotNull()).select("line", F.col("value").alias("text"))


def write_once(df: DataFrame, path: str) -> None:
    """Write zstd Parquet; an existing folder is an error."""
    df.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def save_table(df: DataFrame, name: str) -> None:
    """Save under a checked identifier."""
    if not NAME.match(name):
        raise ValueError(f"not a table name: {name!r}")
    df.write.mode("overwrite").saveAsTable(name)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, rows, sha256) of every part of a Parquet folder, hashed where it lies."""
    name = lambda c: F.regexp_extract(c, r"([^/]+)$", 1)
    rows = spark.read.parquet(path).groupBy(name(F.input_file_name()).alias("file")).agg(F.count(F.lit(1)).alias("rows"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select(name(F.col("path")).alias("file"), F.sha2("content", 256).alias("sha256"))
    return files.join(rows, "file", "left").select("file", F.coalesce("rows", F.lit(0)).alias("rows"), "sha256")


def verify_inventory(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Parts that are missing, unexpected or changed; empty when all is well."""
    now = inventory(spark, path).alias("n")
    both = expected.alias("e").join(now, F.col("e.file") == F.col("n.file"), "full_outer")
    issue = (
        F.when(F.col("n.file").isNull(), "missing").when(F.col("e.file").isNull(), "unexpected")
        .when(F.col("e.sha256") != F.col("n.sha256"), "changed").when(F.col("e.rows") != F.col("n.rows"), "row_count")
    )
    return both.select(F.coalesce("e.file", "n.file").alias("file"), issue.alias("issue")).where("issue is not null")


def row_hash(df: DataFrame) -> Column:
    """A hash of a whole row, whatever the order of its columns."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


def fingerprint(df: DataFrame) -> str:
    """A hash of a table's rows as a multiset; it does not collect them."""
    sums = [F.sum(F.conv(F.substring(F.col("h"), 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).alias(f"s{k}") for k in range(5)]
    row = df.select(row_hash(df).alias("h")).agg(F.count(F.lit(1)).alias("n"), *sums).first()
    return json.dumps([str(v) for v in row])


def data_dictionary(df: DataFrame) -> list[tuple[str, str, bool]]:
    """(column, type, nullable) of a table."""
    return [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
