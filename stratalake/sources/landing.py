"""JSON landing zones: explicit schema, no inference."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import RAW_ACCOUNT, RAW_PRICE, RAW_TRANSACTION, parse

RAW = {"transactions": RAW_TRANSACTION, "accounts": RAW_ACCOUNT, "prices": RAW_PRICE}


def read_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Raw records with the file they came from in ``_source_file``; broken lines fail the read."""
    df = spark.read.schema(parse(RAW[kind])).option("mode", "FAILFAST").json(path)
    return df.select("*", df["_metadata.file_path"].alias("_source_file"))


def stream_json(spark: SparkSession, path: str, kind: str, files_per_batch: int = 100) -> DataFrame:
    df = spark.readStream.schema(parse(RAW[kind])).option("maxFilesPerTrigger", files_per_batch).json(path)
    return df.select("*", df["_metadata.file_path"].alias("_source_file"))
