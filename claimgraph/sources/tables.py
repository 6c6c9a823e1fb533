"""Parquet tables of a collection, and the records that delivered rows stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table `name` of the collection in `sf_dir`, lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(rows: DataFrame, *columns: str, key: str = "id", clock: str = "updated_at") -> DataFrame:
    """One row for each `key`: the delivered row with the greatest `clock`.

    Only `key`, `clock` and `columns` (all, if none are named) travel through the
    shuffle. Rows that tie on the clock are identical by contract; a null clock
    loses to any other. Rows without a key identify no record and are left out.
    The rank filter becomes a WindowGroupLimit, so older versions are dropped
    before the exchange where they meet.
    """
    if columns:
        rows = rows.select(*dict.fromkeys((key, *columns, clock)))
    latest = Window.partitionBy(key).orderBy(F.col(clock).desc_nulls_last())
    ranked = rows.where(F.col(key).isNotNull()).withColumn("__version", F.row_number().over(latest))
    return ranked.where("__version = 1").drop("__version")
