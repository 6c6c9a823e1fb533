"""Moving a collection: export to and import from an archive folder, and writes that may be repeated."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERSION = 1


def export(tables: dict[str, DataFrame], path: str) -> dict:
    """Write each table as parquet and a manifest of their schemas; returns the manifest."""
    spark = next(iter(tables.values())).sparkSession
    for name, rows in tables.items():
        rows.write.mode("error").parquet(f"{path}/{name}")
    manifest = {"version": VERSION, "tables": {n: json.loads(t.schema.json()) for n, t in tables.items()}}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.mode("error").text(f"{path}/manifest")
    return manifest


def manifest(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r.value for r in spark.read.text(f"{path}/manifest").collect()))


def load(spark: SparkSession, path: str, expect: dict[str, Sequence[str]] | None = None) -> dict[str, DataFrame]:
    """The archive's tables. A newer archive, or one without an expected table or column, is refused."""
    held = manifest(spark, path)
    if held["version"] > VERSION:
        raise ValueError(f"archive version {held['version']} is newer than {VERSION}")
    for name, columns in (expect or {}).items():
        there = {f["name"] for f in held["tables"].get(name, {"fields": []})["fields"]}
        if missing := [c for c in columns if c not in there]:
            raise ValueError(f"{name} lacks {', '.join(missing)}")
    return {n: spark.read.parquet(f"{path}/{n}") for n in held["tables"]}


def insert_missing(current: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key is not there yet, one for each key; null keys are equal."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"n.{k}").eqNullSafe(F.col(f"c.{k}"))
    return rows.dropDuplicates(list(keys)).alias("n").join(current.select(*keys).alias("c"), same, "left_anti")


def upsert(current: DataFrame, rows: DataFrame, keys: Sequence[str], clock: str) -> DataFrame:
    """The table after the rows have come in: for each key the row with the latest clock, the incoming one among equals."""
    both = current.withColumn("__in", F.lit(0)).unionByName(rows.withColumn("__in", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.col(clock).desc_nulls_last(), F.col("__in").desc())
    return both.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n", "__in")


def update_only(current: DataFrame, rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The table with `columns` taken from the rows where a key comes in, all others kept; new keys are added with nulls elsewhere."""
    same = F.lit(True)
    for k in keys:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}"))
    marked = rows.withColumn("__there", F.lit(True))
    joined = current.alias("c").join(marked.alias("n"), same, "full_outer")
    pick = lambda c: F.coalesce(f"c.{c}", f"n.{c}") if c in keys else F.when(F.col("n.__there"), F.col(f"n.{c}")).otherwise(F.col(f"c.{c}")) if c in columns else F.col(f"c.{c}")
    return joined.select(*(pick(c).alias(c) for c in current.columns))
