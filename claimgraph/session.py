"""A session with the settings the operators are written for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(cores: int | str = "*", partitions: int = 8, name: str = "claimgraph", **conf: str) -> SparkSession:
    """A local session; on a cluster use the cluster's own and set the session time zone to UTC."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.sql.adaptive.enabled": "true",
    } | conf
    return builder.config(map=settings).getOrCreate()
