"""Reading the tables that the queries run on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Default place of a vocabulary file; every operator takes another path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def output_schema(df: DataFrame, *columns: str, more: str) -> str:
    """DDL of some columns of a table and further ones."""
    own = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns]
    return ", ".join([*own, more])


def with_field(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The table's schema with a further column at its end."""
    return T.StructType([*df.schema.fields, T.StructField(name, kind)])
