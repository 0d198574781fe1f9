"""Tables that a job writes once and reads several times, and shuffles whose tasks grow in number with the input."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of input files for each task of a shuffle.
TASK_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, from ``spark.checkpoint.dir``; a local master may go without and gets a new one."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="panelspark-"))
        known = spark.sparkContext.getCheckpointDir()
    return known


def new_place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later passes read it, and a lost executor repeats a read only."""
    path = new_place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def usual(spark: SparkSession) -> int:
    """Tasks that a shuffle without a number has at least: adaptive execution merges the session's partitions, down to one a core, until each holds 64 MB of compressed rows."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def parts(df: DataFrame) -> int:
    """Tasks for a shuffle of rows made from the files that ``df`` reads; :func:`usual` where that is enough.

    A fixed number of shuffle partitions makes a task's memory grow with the input, and
    so does a high one that is merged again; a number that a shuffle is given stays.
    """
    least, files = usual(df.sparkSession), df.inputFiles()
    if not files:
        return least
    size = df.sparkSession.read.format("binaryFile").load(files).agg(F.sum("length")).first()[0]
    return max(least, math.ceil((size or 0) / TASK_BYTES))


def spread(df: DataFrame, *columns: str, n: int | None = None) -> DataFrame:
    """Rows of equal ``columns`` in one of ``n`` tasks (:func:`parts`); the rows as they are where :func:`usual` tasks are enough."""
    n = n or parts(df)
    return df.repartition(n, *columns) if n > usual(df.sparkSession) else df


def discard(spark: SparkSession, *places: str) -> None:
    """Deletes places of :func:`new_place` that nothing will read again."""
    for place in places:
        path = spark._jvm.org.apache.hadoop.fs.Path(place)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
