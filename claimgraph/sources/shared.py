"""Tables written to the shared folder, to cut lineage in iterative operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
_swept: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one of our own on a local master only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if existing := context.getCheckpointDir():
        return existing
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="claimgraph-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return f"file://{_own[0]}"


def _folder(spark: SparkSession) -> str:
    """This application's own part of the shared folder; what is left in it goes when the application ends."""
    folder = f"{shared_dir(spark)}/claimgraph/{spark.sparkContext.applicationId}"
    if folder not in _swept:
        _swept.add(folder)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
    return folder


class Stage:
    """A DataFrame written once to the shared folder; `df` reads it, `drop` deletes it.

    `rows` is the number of rows and `held` the number of those for which `where` is
    true, both observed while writing.
    """

    def __init__(self, frame: DataFrame, where: str = "true"):
        self.spark = frame.sparkSession
        self.path = f"{_folder(self.spark)}/{uuid.uuid4().hex}"
        seen = Observation()
        counted = frame.observe(seen, F.count("*").alias("rows"), F.count_if(F.expr(where)).alias("held"))
        counted.write.option("compression", "zstd").parquet(self.path)
        self.df = self.spark.read.schema(frame.schema).parquet(self.path)
        counts = seen.get
        self.rows = counts["rows"] if "rows" in counts else self.df.count()
        self.held = counts["held"] if "held" in counts else self.df.where(where).count()

    def drop(self) -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(frame: DataFrame, where: str = "true") -> Stage:
    """Write `frame` to the shared folder and hand back a reader: later plans start there, and a lost executor recomputes nothing before it."""
    return Stage(frame, where)
