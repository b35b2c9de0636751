"""Parquet tables, with columns that later versions added filled by their defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POSTINGS = T.StructType([
    T.StructField("id", T.IntegerType()), T.StructField("source", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()), T.StructField("canonical_url", T.StringType()), T.StructField("company", T.StringType()),
    T.StructField("experience", T.StringType()), T.StructField("technologies", T.StringType()), T.StructField("first_seen", T.TimestampType()),
    T.StructField("active", T.BooleanType()), T.StructField("hidden", T.BooleanType()), T.StructField("sweep_dead", T.BooleanType()),
])
DEFAULTS = {"active": True, "hidden": False, "sweep_dead": False}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def evolved(df: DataFrame, schema: T.StructType = POSTINGS, defaults: dict = DEFAULTS) -> DataFrame:
    """df in the schema: columns it lacks are added, and nulls take the default."""
    out = []
    for field in schema:
        column = F.col(field.name) if field.name in df.columns else F.lit(None)
        out.append(F.coalesce(column, F.lit(defaults.get(field.name))).cast(field.dataType).alias(field.name))
    return df.select(out)
