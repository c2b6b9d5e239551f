"""Session helpers."""

from __future__ import annotations

import gc
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "ledgerloom", cores: str | int = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once for each context, so that tasks can import it."""
    sc = spark.sparkContext
    if not getattr(sc, "_ledgerloom_shipped", False):
        here = Path(__file__).resolve().parent
        target = os.path.join(os.path.realpath(tempfile.mkdtemp()), "ledgerloom.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        sc.addPyFile(target)
        sc._ledgerloom_shipped = True
    return spark


def spread(df: DataFrame, waves: int = 4) -> DataFrame:
    """df dealt over all cores, for work that takes far longer than reading: few bytes of columns are few splits, whatever their rows cost."""
    return df.repartition(waves * df.sparkSession.sparkContext.defaultParallelism)


@contextmanager
def whole_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches for Python are cut by rows only while this lasts: Spark measures a batch after each row else, which takes far longer than narrow rows do."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(2**31 - 1))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the session, which the driver and all executors share.

    A folder is only set here if neither the session nor the context has one, and only for a local
    master, whose executors share the driver's disk; on a cluster that is an error.
    """
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, computed once and read back from the shared checkpoint folder of the session; its plan starts there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark drop shuffle files and checkpoints that no frame refers to any more: its cleaner follows the driver's garbage collection."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """df as compressed Parquet in the shared folder, and its path for discard(): for large tables that are let go of at a known point."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a stored table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
