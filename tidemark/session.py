"""Where staged tables live, and how a plan is cut into stages.

A staged table is written as Parquet under the cluster's shared checkpoint
folder and read back.  Unlike a cached block it survives losing executors, and
unlike an RDD checkpoint it stays columnar: later steps still prune columns and
push filters into the scan.
"""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder; on a
    cluster a machine-local folder would be lost with its node, so it is refused.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    already = spark.sparkContext.getCheckpointDir()
    if already:
        return already.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def stage(df: DataFrame, name: str, partition_by: tuple = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/staged-{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def side_by_side(spark: SparkSession, *steps: Callable) -> list:
    """Results of independent steps, in their order; the Spark jobs of one use the cores that the last tasks of another leave idle."""
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(max(1, len(steps))) as pool:
        return [made.result() for made in [pool.submit(inherit(step)) for step in steps]]


def source_stamp(spark: SparkSession, *paths: str) -> tuple:
    """Size, file count and change time of input paths, read from the file system."""
    jvm = spark._jvm
    conf = spark._jsc.hadoopConfiguration()
    out = []
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        if not fs.exists(path):
            out.append((p, None))
            continue
        total = fs.getContentSummary(path)
        out.append(
            (p, total.getLength(), total.getFileCount(),
             fs.getFileStatus(path).getModificationTime())
        )
    return tuple(out)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application.

    Functions that run inside tasks import it there, wherever the driver was started.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    archive = shutil.make_archive(
        str(Path(tempfile.mkdtemp(prefix="spark-")) / package.name), "zip", package.parent, package.name
    )
    spark.sparkContext.addPyFile(archive)
    _shipped.add(app)
