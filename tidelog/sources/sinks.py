"""Results as files, by Spark's writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def plain(df: DataFrame) -> DataFrame:
    """Times as ISO text, maps, arrays and structs as JSON, nulls as empty strings."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        elif isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType)):
            c = F.to_json(c)
        out.append(F.coalesce(c.cast("string"), F.lit("")).alias(f.name))
    return df.select(*out)


def write_csv(df: DataFrame, path: str) -> None:
    plain(df).write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def verify_files(spark, path: str, manifest: DataFrame) -> DataFrame:
    """name, expected, found, ok: the SHA-256 of files against a manifest (name, sha256); a file that one side lacks is not ok. Files are hashed where they are read."""
    files = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("found"))
    both = manifest.select("name", F.lower("sha256").alias("expected")).join(files, "name", "full")
    return both.select("name", "expected", "found", F.coalesce(F.col("expected") == F.col("found"), F.lit(False)).alias("ok"))
