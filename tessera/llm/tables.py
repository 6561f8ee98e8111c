"""Small helpers that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str | Column, modulus: int) -> Column:
    """crc32 of an id's decimal digits, modulo ``modulus``; the folds that split training rows from held-out ones. Null ids are in fold 0."""
    return F.coalesce(F.crc32(F.encode((F.col(column) if isinstance(column, str) else column).cast("string"), "UTF-8")) % modulus, F.lit(0))


def others(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` that none of ``names`` replaces; Spark's names ignore case."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def quoted(name: str) -> Column:
    """A column by its exact name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")
