"""Tables of the session's catalog: what may be analysed, and what the analysis saves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..types import analysed

#: Names of what the analysis itself made.
OWN = ("logical_", "view_")


def quoted(*names: str) -> str:
    return ".".join("`" + n.replace("`", "``") + "`" for n in names)


def source_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """The tables of a database, without views, temporary ones and those that the analysis made."""
    return sorted(t.name for t in spark.catalog.listTables(database)
                  if not t.isTemporary and t.tableType != "VIEW" and not t.name.lower().startswith(OWN))


def columns(spark: SparkSession, database: str = "default") -> list[tuple[str, str, str]]:
    """(table, column, type) of what is analysed: nested types are not."""
    return [(t, f.name, f.dataType.simpleString()) for t in source_tables(spark, database) for f in analysed(spark.table(quoted(database, t)))]


def read_tables(spark: SparkSession, database: str = "default") -> dict[str, DataFrame]:
    """The source tables, with the columns that are analysed."""
    found = {t: spark.table(quoted(database, t)) for t in source_tables(spark, database)}
    return {t: df.select(*[F.col(quoted(f.name)) for f in analysed(df)]) for t, df in found.items()}


def save_table(df: DataFrame, database: str, name: str) -> DataFrame:
    """``df`` as a table of the database, in place of one of that name; returns the table."""
    df.write.mode("overwrite").saveAsTable(quoted(database, name))
    return df.sparkSession.table(quoted(database, name))
