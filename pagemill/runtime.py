"""Session helpers: where shared intermediate results go, and shipping this package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


#: Text that goes to a Python worker at once, where the session has Spark's default of 64 MB.
BATCH_KEY, BATCH_BYTES, SPARK_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m", ("67108864b", "64m", "67108864")


def ship_package(spark: SparkSession) -> None:
    """Let executors import this package, also where they don't share the driver's PYTHONPATH.

    Arrow batches become small too: with long texts, a batch and its copies in
    both processes are most of what a task holds.
    """
    if spark.conf.get(BATCH_KEY).lower() in SPARK_BATCH_BYTES:
        spark.conf.set(BATCH_KEY, BATCH_BYTES)
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="pagemill-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent).as_posix())
    context.addPyFile(name)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh path below spark.checkpoint.dir; where that is unset, below a local folder on a local master, else below the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not base and spark.sparkContext.master.startswith("local"):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="pagemill-checkpoint-"))
        base = spark.sparkContext.getCheckpointDir()
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/pagemill/{tag}-{uuid.uuid4().hex[:12]}"


_scratch: list[list[str]] = []


def written(df: DataFrame, tag: str, result: bool = False) -> DataFrame:
    """Write to the shared folder as Parquet and read back: cuts lineage and survives lost executors.

    Inside of `scratch`, the folder goes with it; a result goes with the one around it, if any.
    """
    spark = df.sparkSession
    path = shared_folder(spark, tag)
    df.write.parquet(path)
    if len(_scratch) > result:
        _scratch[-1 - result].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at the end what `written` made inside and isn't a result; nothing lazy may depend on it then.

    Shuffle files of finished jobs go too: Spark removes them once the driver's collector has
    seen that nothing refers to them, which an idle driver does twice an hour only.
    """
    _scratch.append([])
    try:
        yield
    finally:
        for path in _scratch.pop():
            drop_folder(spark, path)
        spark.sparkContext._jvm.System.gc()


def spread(df: DataFrame) -> DataFrame:
    """An input of fewer splits than cores over all cores; larger inputs, so all that matter at scale, stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_side(df: DataFrame, rows: int = 200_000, otherwise: str | None = None) -> DataFrame:
    """A written table as a join's broadcast side if its counted rows are few, else as it is, or with the hint `otherwise`."""
    if df.count() <= rows:
        return F.broadcast(df)
    return df.hint(otherwise) if otherwise else df


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder made by shared_folder, whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
