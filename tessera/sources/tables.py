"""Readers: parquet tables and delimited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def delimited(spark: SparkSession, path: str, schema: T.StructType, sep: str = "|", corrupt: str | None = None) -> DataFrame:
    """Delimited text. A row that does not fit the schema fails the read, or stands whole in the column ``corrupt`` of the schema."""
    reader = spark.read.schema(schema).option("sep", sep).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True)
    reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", corrupt) if corrupt else reader.option("mode", "FAILFAST")
    return reader.csv(path)
