"""Session settings and the shared folder that staged tables live in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

#: Settings the library is tuned for. All of them may be overridden by the caller.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Text grows about tenfold when it is exploded into grams: keep small shuffles
    # of text spread over all cores. Without effect once partitions are large.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole documents travel in Arrow batches; bound a batch by bytes, not only by rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 * 1024 * 1024),
}


#: Folder of the run that owns the tables being staged, if there is one.
_RUN: ContextVar[str | None] = ContextVar("captrellis_run", default=None)


def build_session(app_name: str = "captrellis", master: str | None = None, **conf: str) -> SparkSession:
    """A session with :data:`DEFAULTS`; keyword names use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """Folder every executor can reach, taken from ``spark.checkpoint.dir``.

    A local master may fall back to a temporary folder because driver and
    executors share the machine; a cluster without the setting is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    root = tempfile.mkdtemp(prefix="captrellis-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def stage_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one staged table, inside the run's folder where a run owns it."""
    root = _RUN.get() or shared_root(spark).rstrip("/")
    return f"{root}/{name}-{uuid.uuid4().hex}"


@contextmanager
def owned_run(spark: SparkSession, name: str) -> Iterator[str]:
    """A run that owns every table staged inside the block, and drops them at its end, also after an error.

    Results must be written or collected inside the block. The folder's name is made from ``name``: what a run
    that was killed has left is dropped by the next one of that name, so two runs of one name must not overlap.
    Inside another run the block's tables belong to that one.
    """
    if _RUN.get():
        yield _RUN.get()
        return
    if not name or set(name) - set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_"):
        raise ValueError("a run's name has letters, digits, - and _ only")
    folder = f"{shared_root(spark).rstrip('/')}/run-{name}"
    drop_folder(folder)
    mark = _RUN.set(folder)
    try:
        yield folder
    finally:
        _RUN.reset(mark)
        drop_folder(folder)


def file_system(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and plain path of a folder; ``file:/path`` and ``/path`` are local."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = folder.removeprefix("file:")
    fs, base = pafs.FileSystem.from_uri(folder)
    return fs, base.rstrip("/")


def finished(folder: str) -> list[str]:
    """Names of the tables in ``folder`` whose write was committed, in order; none if there is no such folder."""
    fs, base = file_system(folder)
    found = fs.get_file_info(pafs.FileSelector(base, allow_not_found=True))
    names = sorted(f.base_name for f in found if f.type == pafs.FileType.Directory)
    done = fs.get_file_info([f"{base}/{name}/_SUCCESS" for name in names])
    return [name for name, mark in zip(names, done) if mark.type == pafs.FileType.File]


def drop_folder(folder: str) -> None:
    """Delete a folder of staged tables; a missing one is no error."""
    fs, base = file_system(folder)
    if fs.get_file_info(base).type == pafs.FileType.Directory:
        fs.delete_dir(base)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back.

    Used where a stage has side effects or is read by several later actions.
    A written table survives the loss of any executor.
    """
    path = stage_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Jobs inside the block drop their shuffle files when they end, not when the driver next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
