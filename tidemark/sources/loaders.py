"""Readers and writers of tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _schema(schema: list[tuple[str, str]] | str) -> str:
    return schema if isinstance(schema, str) else ", ".join(f"`{n}` {t}" for n, t in schema)


def read_csv(spark: SparkSession, path: str, schema: list[tuple[str, str]] | str, header: bool = False, **options) -> DataFrame:
    """Quoted CSV with a given schema; without ``header`` a first line of names is a row like any other."""
    return spark.read.options(quote='"', escape='"', **options).schema(_schema(schema)).csv(path, header=header)


def read_text(spark: SparkSession, path: str, delimiter: str, names: list[str]) -> DataFrame:
    """Lines split by a pattern into string columns; a missing piece is an empty string."""
    parts = F.split("value", delimiter, -1)
    return spark.read.text(path).select(*[F.coalesce(F.get(parts, F.lit(i)), F.lit("")).alias(n) for i, n in enumerate(names)])


def read_table(spark: SparkSession, table: str, columns: list[str] | None = None, where: str | None = None) -> DataFrame:
    """Columns and rows of a catalog table; both reach the scan."""
    df = spark.table(table)
    df = df.where(where) if where else df
    return df.select(*columns) if columns else df


def coerce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns, by position, under the schema's names and types; what does not parse is null."""
    if len(df.columns) != len(schema.fields):
        raise ValueError(f"{len(df.columns)} columns do not fit {len(schema.fields)} fields")
    return df.toDF(*schema.names).select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])


#: Schemas of keyed updates: hashes to keep, duplicate counts, string and double values.
FILTER = T.StructType([T.StructField("hash", T.StringType())])
DUP = T.StructType([T.StructField("hash", T.StringType()), T.StructField("dup", T.IntegerType())])
TEXT_UPDATE = T.StructType([T.StructField("hash", T.StringType()), T.StructField("value", T.StringType())])
NUMBER_UPDATE = T.StructType([T.StructField("hash", T.StringType()), T.StructField("value", T.DoubleType())])


def as_json(df: DataFrame) -> DataFrame:
    """One JSON object per row, in a column ``value``."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_json(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def load(reader: Callable[[], DataFrame], name: str, session, ratio: float = 1.0):
    """Reads a table and samples it into a session under ``name``."""
    return session.sample(reader(), name, ratio)
