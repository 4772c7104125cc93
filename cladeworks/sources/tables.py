"""Reading the driver's tables, and making this package visible to Python workers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> SparkSession:
    """Let workers on this machine find the package wherever the session was started.

    A cluster gets it by ``--py-files`` as usual; the extra path is harmless there.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(":")
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*filter(None, paths), ROOT])
    return spark


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table; time stamps without a zone stay so."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def ntz(df: DataFrame, *columns: str) -> DataFrame:
    """Cast time stamps to TIMESTAMP_NTZ, so that results do not shift with the session's zone."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (``spark.checkpoint.dir``). Where it is unset, a temporary folder serves a
    local session; a cluster would scatter tables over its machines, so it is an error there."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="cladeworks-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


#: Folders of the tables that this process has written.
_written: list[str] = []


def drop_tables(spark: SparkSession) -> None:
    """Delete all intermediate tables that this process has written, once nothing is computed from them any more."""
    hadoop = spark._jvm.org.apache.hadoop
    while _written:
        path = hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _new_folder(spark: SparkSession) -> str:
    _written.append(f"{shared_dir(spark)}/table-{uuid.uuid4().hex}")
    return _written[-1]


class Levels:
    """A table that grows level by level: each is written below one folder, and all are read together."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.path, self.schema, self.n = spark, _new_folder(spark), None, 0

    def add(self, df: DataFrame) -> DataFrame:
        """Write a level and read it back; its rows are the walk's frontier."""
        self.schema = df.schema
        df.write.parquet(f"{self.path}/{self.n}")
        self.n += 1
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n - 1}")

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)


def materialize(df: DataFrame) -> DataFrame:
    """Write a result that is read more than once as a table in the shared folder, and read it from there.

    This cuts the lineage, survives lost executors and, unlike a checkpoint, computes the rows only once.
    """
    path = _new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
