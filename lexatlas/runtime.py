"""Session plumbing shared by every operator: code shipping, shared scratch storage, lineage cuts."""

from __future__ import annotations

import contextlib
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch; a longer row is a batch of its own.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_SHIPPED: set[str] = set()
_SCRATCH: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per application), and Arrow batches at most BATCH_BYTES (but for one row).

    The zip travels through Spark's own file server, so it also works on
    clusters whose executors do not see the driver's disk.
    """
    size = re.fullmatch(r"(\d+)b?", spark.conf.get(_BATCH))  # other forms were chosen by someone
    if size and int(size[1]) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="lexatlas-")) / "lexatlas_src.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share: spark.checkpoint.dir, or, where that is
    unset and everything runs in this process, a temporary one. A cluster without it is refused."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", sc.getConf().get("spark.checkpoint.dir", None))
    if not configured:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isEmpty():
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="lexatlas-shared-"))
            current = sc._jsc.sc().getCheckpointDir()
        configured = current.get()
    path = sc._jvm.org.apache.hadoop.fs.Path(configured)
    full = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub(r"^file:/+", "file:///", full).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the application ends."""
    top = f"{shared_dir(spark)}/lexatlas-{spark.sparkContext.applicationId}"
    if top not in _SCRATCH:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _SCRATCH.add(top)
    return f"{top}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage is cut,
    and a lost executor costs a reread instead of a recomputation."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(df: DataFrame) -> None:
    """Delete what ``materialize`` wrote for ``df``, once nothing reads it any more."""
    if path := getattr(df, "_scratch", None):
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function for ``mapInArrow`` that gives memory its task does not use any more back to the system, as
    workers live on between tasks."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries know it
        ctypes.CDLL(None).malloc_trim(0)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def open_uri(uri: str, mode: str):
    """A byte stream of a shared file (mode r or w) for Python workers; folders are made as needed."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))
    if mode == "w":
        system.create_dir(os.path.dirname(path), recursive=True)
        return system.open_output_stream(path, compression=None)
    return system.open_input_file(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt to as many tasks as there are cores where its files are few: a file can be one unit of reading."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(4 * cores) if 2 * len(df.inputFiles()) < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
