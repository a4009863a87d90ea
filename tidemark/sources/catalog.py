"""Catalog tables: what a working set that outlives its application needs of DDL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..plans.scratch import discard, materialize, new_path


def quoted(name: str) -> str:
    """A table's name, each part in backquotes."""
    return ".".join(f"`{part.strip('`')}`" for part in name.split("."))


def create(df: DataFrame, name: str, properties: dict[str, str] | None = None, path: str | None = None) -> DataFrame:
    """A table made of a query's rows, in place of one of that name; an external one if ``path`` is given."""
    drop(df.sparkSession, name)
    writer = df.write.format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    if properties:
        set_properties(df.sparkSession, name, properties)
    return df.sparkSession.table(name)


def create_shared(df: DataFrame, name: str, properties: dict[str, str] | None = None) -> DataFrame:
    """As ``create``, with the files below the shared folder."""
    return create(df, name, properties, new_path(df.sparkSession, f"table-{name.split('.')[-1]}"))


def overwrite(df: DataFrame, name: str) -> DataFrame:
    """Replaces a table's rows; ``df`` may read the table itself, for it is written aside first. Properties stay."""
    spark = df.sparkSession
    columns = spark.table(name).columns
    if [c.lower() for c in columns] != [c.lower() for c in df.columns]:
        raise ValueError(f"{name} has the columns {', '.join(columns)}, not {', '.join(df.columns)}")
    aside = materialize(df, "overwrite")
    aside.write.insertInto(name, overwrite=True)
    discard(aside)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def append(df: DataFrame, name: str) -> DataFrame:
    """Adds rows, columns by name."""
    df.select(*df.sparkSession.table(name).columns).write.insertInto(name)
    return df.sparkSession.table(name)


def set_properties(spark: SparkSession, name: str, properties: dict[str, str]) -> None:
    text = ", ".join("'" + k.replace("'", "") + "' = '" + str(v).replace("\\", "\\\\").replace("'", "\\'") + "'" for k, v in properties.items())
    spark.sql(f"ALTER TABLE {quoted(name)} SET TBLPROPERTIES ({text})")


def properties(spark: SparkSession, name: str) -> dict[str, str]:
    return {r.key: r.value for r in spark.sql(f"SHOW TBLPROPERTIES {quoted(name)}").collect()}


def add_columns(spark: SparkSession, name: str, columns: dict[str, str]) -> None:
    """Adds columns of the given types, null in the rows that are there."""
    spark.sql(f"ALTER TABLE {quoted(name)} ADD COLUMNS ({', '.join(f'`{c}` {t}' for c, t in columns.items())})")


def rename(spark: SparkSession, name: str, to: str) -> None:
    spark.sql(f"ALTER TABLE {quoted(name)} RENAME TO {quoted(to)}")


def drop(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")


def column_indexes(spark: SparkSession, name: str, columns: list[str]) -> list[int]:
    """Places of columns in a table, whatever the case; fails if one is missing."""
    low = [c.lower() for c in spark.table(name).columns]
    missing = [c for c in columns if c.lower() not in low]
    if missing:
        raise KeyError(f"{name} has no column {', '.join(missing)}")
    return [low.index(c.lower()) for c in columns]
