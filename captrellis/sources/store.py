"""Image files written and read by tasks: a data source with commits, a manifest, and partitions planned by bytes.

A store is a folder. Every write job has a folder in it, and every task attempt of the job one for its files and one index
file, a Parquet table of the rows it was given with ``image_path``, ``n_bytes`` and ``status``, without the bytes. When all tasks are
done, the job's manifest names the attempts that count; what other attempts left, for example killed ones, is deleted
before. So a file that an index names exists as a whole, and ``success`` is only said of such files. A marker stands while
the job runs: tasks that outlive a job given up find it gone and take back what they wrote.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

from captrellis.session import file_system

FORMAT = "image_store"
#: Bytes of files that one partition of a scan reads, and bytes that a task hands on at a time.
PARTITION_BYTES = 128 * 1024 * 1024
FLUSH_BYTES = 16 * 1024 * 1024
#: Looks at the folder of a failed job, and seconds between them.
CLEAN_ROUNDS, CLEAN_SECONDS = 4, 0.5
MANIFEST, MARKER = "manifest.parquet", "running"
ADDED = ("image_path", "n_bytes", "status")


@dataclass
class Attempt(WriterCommitMessage):
    """What a finished task says of itself."""

    name: str
    rows: int
    bytes: int


class StoreWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType) -> None:
        self.folder, self.job = options["folder"], options["job"]
        self.name, self.content = options["name"], options["content"]
        self.columns = [f.name for f in schema.fields if f.name not in (self.name, self.content)]

    def begin(self) -> StoreWriter:
        fs, base = file_system(self.folder)
        fs.create_dir(f"{base}/{self.job}", recursive=True)
        with fs.open_output_stream(f"{base}/{self.job}/{MARKER}"):
            return self

    def _check(self, fs: pafs.FileSystem, base: str) -> None:
        if fs.get_file_info(f"{base}/{self.job}/{MARKER}").type == pafs.FileType.NotFound:
            raise RuntimeError(f"{self.job} was given up")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Attempt:
        fs, base = file_system(self.folder)
        context = TaskContext.get()
        own = f"{context.partitionId()}-{context.attemptNumber()}-{uuid.uuid4().hex}"
        files, index = f"{base}/{self.job}/files/{own}", f"{base}/{self.job}/index/{own}.parquet"
        self._check(fs, base)
        fs.create_dir(files, recursive=True)
        fs.create_dir(f"{base}/{self.job}/index", recursive=True)
        taken: set[str] = set()
        rows = total = 0
        out = None
        try:
            for batch in iterator:
                found = [self._one(fs, files, n.as_py(), c, taken) for n, c in zip(batch.column(self.name), batch.column(self.content))]
                added = [pa.array(c, k) for c, k in zip(zip(*found), (pa.string(), pa.int64(), pa.string()))] if found else [pa.array([], k) for k in (pa.string(), pa.int64(), pa.string())]
                table = pa.table([*(batch.column(c) for c in self.columns), *added], [*self.columns, *ADDED])
                out = out or pq.ParquetWriter(index, table.schema, filesystem=fs)
                out.write_table(table)
                rows, total = rows + len(found), total + sum(f[1] or 0 for f in found)
            if out:
                out.close()
            self._check(fs, base)
        except BaseException:
            _delete(fs, files, index)
            raise
        return Attempt(own, rows, total)

    def _one(self, fs: pafs.FileSystem, files: str, name: str | None, content: pa.Scalar, taken: set[str]) -> tuple:
        if name is None or not content.is_valid:
            return None, None, "failed"
        while name in taken:  # a name is used once in a folder
            name = f"{uuid.uuid4().hex}-{name}"
        taken.add(name)
        body = content.as_buffer()
        try:
            with fs.open_output_stream(f"{files}/{name}") as out:
                out.write(body)
        except OSError as e:
            _delete(fs, f"{files}/{name}")
            return None, None, f"file_io_error: {e}"
        return f"{files}/{name}", body.size, "success"

    def commit(self, messages: list[Attempt | None]) -> None:
        fs, base = file_system(self.folder)
        kept = [m for m in messages if m is not None]
        names = {m.name for m in kept}
        for part, end in (("files", ""), ("index", ".parquet")):
            fs.create_dir(f"{base}/{self.job}/{part}", recursive=True)
            for info in fs.get_file_info(pafs.FileSelector(f"{base}/{self.job}/{part}")):
                if info.base_name.removesuffix(end) not in names:
                    _delete(fs, info.path)
        table = pa.table({"attempt": [m.name for m in kept], "rows": [m.rows for m in kept], "bytes": [m.bytes for m in kept]})
        pq.write_table(table, f"{base}/{self.job}/{MANIFEST}", filesystem=fs)
        _delete(fs, f"{base}/{self.job}/{MARKER}")

    def abort(self, messages: list[Attempt | None]) -> None:
        fs, base = file_system(self.folder)
        _delete(fs, f"{base}/{self.job}")


def _delete(fs: pafs.FileSystem, *paths: str) -> None:
    for info in fs.get_file_info(list(paths)):
        try:
            if info.type == pafs.FileType.Directory:
                fs.delete_dir(info.path)
            elif info.type == pafs.FileType.File:
                fs.delete_file(info.path)
        except FileNotFoundError:  # somebody else deleted it meanwhile
            pass


@dataclass
class Range(InputPartition):
    """Rows ``start`` to ``stop`` of some index files; ``stop`` is None for the end."""

    parts: list[tuple[str, int, int | None]]


class StoreReader(DataSourceReader):
    """Files of one job. Partitions hold about equal bytes by the manifest; equal paths asked for are read alone."""

    def __init__(self, options: dict) -> None:
        self.folder, self.job = options["folder"], options["job"]
        self.size = int(options.get("partition_bytes", PARTITION_BYTES))
        self.paths: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, (EqualTo, In)) and f.attribute == ("path",):
                asked = set(f.value) if isinstance(f, In) else {f.value}
                self.paths = asked if self.paths is None else self.paths & asked
            else:
                yield f

    def partitions(self) -> Sequence[Range]:
        fs, base = file_system(self.folder)
        manifest = pq.read_table(f"{base}/{self.job}/{MANIFEST}", filesystem=fs).to_pylist()
        if self.paths is not None:
            # A file's folder is its attempt.
            asked = {p.split("/")[-2] for p in self.paths if p.count("/") > 1}
            manifest = [m for m in manifest if m["attempt"] in asked]
        out, held, total = [], [], 0
        for m in manifest:
            pieces = max(1, -(-m["bytes"] // self.size))
            borders = [m["rows"] * i // pieces for i in range(pieces + 1)]
            for start, stop in zip(borders[:-1], borders[1:]):
                if start < stop:
                    held.append((f"{base}/{self.job}/index/{m['attempt']}.parquet", start, stop))
                    total += m["bytes"] // pieces
                    if total >= self.size:
                        out.append(Range(held))
                        held, total = [], 0
        return [*out, Range(held)] if held or not out else out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(self.folder)
        for index, start, stop in partition.parts:
            table = pq.read_table(index, columns=["image_path"], filesystem=fs).slice(start, stop - start)
            paths = [p for p in table.column(0).to_pylist() if p is not None and (self.paths is None or p in self.paths)]
            for names, bodies in _opened(fs, paths):
                lengths = pa.array([len(b) for b in bodies], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), lengths, pa.array(bodies, pa.binary())], ["path", "length", "content"])


def _opened(fs: pafs.FileSystem, paths: list[str]) -> Iterator[tuple[list[str], list[bytes]]]:
    """Files and their bytes, a bounded number of bytes at a time."""
    names, bodies, held = [], [], 0
    for path in paths:
        with fs.open_input_stream(path) as f:
            bodies.append(f.read())
        names.append(path)
        held += len(bodies[-1])
        if held >= FLUSH_BYTES:
            yield names, bodies
            names, bodies, held = [], [], 0
    if names:
        yield names, bodies


class ImageStore(DataSource):
    """``path, length, content`` of a store's files; options ``folder`` and ``job``, for writing also ``name`` and ``content``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, length bigint, content binary"

    def reader(self, schema: StructType) -> StoreReader:
        return StoreReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> StoreWriter:
        return StoreWriter(dict(self.options), schema).begin()


def store(df: DataFrame, folder: str, name: str = "name", content: str = "content") -> tuple[DataFrame, str]:
    """Write every non-NULL ``content`` to a file called ``name`` and return the committed rows and the job's name.

    The rows are those of ``df`` without both columns, plus ``image_path`` (NULL on failure), ``n_bytes`` and ``status``:
    ``success``, ``failed`` (no name or no bytes) or ``file_io_error: <message>``. Bytes go from the task that has them
    to the file. A failed job leaves nothing behind.
    """
    clash = set(ADDED) & set(df.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    spark, job = df.sparkSession, f"job-{uuid.uuid4().hex}"
    spark.dataSource.register(ImageStore)
    try:
        df.write.format(FORMAT).mode("append").options(folder=folder, job=job, name=name, content=content).save()
    except BaseException:
        # Tasks that Spark is still stopping may have written since the job was given up.
        fs, base = file_system(folder)
        for _ in range(CLEAN_ROUNDS):
            _delete(fs, f"{base}/{job}")
            time.sleep(CLEAN_SECONDS)
        raise
    schema = StructType([f for f in df.schema.fields if f.name not in (name, content)])
    schema = schema.add("image_path", StringType()).add("n_bytes", LongType()).add("status", StringType())
    return spark.read.schema(schema).parquet(f"{folder.rstrip('/')}/{job}/index"), job


def committed_jobs(folder: str) -> list[str]:
    """Names of the jobs below ``folder`` that have ended, in order of their names."""
    fs, base = file_system(folder)
    if fs.get_file_info(base).type != pafs.FileType.Directory:
        return []
    found = [i.base_name for i in fs.get_file_info(pafs.FileSelector(base)) if i.type == pafs.FileType.Directory]
    ended = fs.get_file_info([f"{base}/{job}/{MANIFEST}" for job in found])
    return sorted(job for job, i in zip(found, ended) if i.type == pafs.FileType.File)


def scan_store(spark: SparkSession, folder: str, job: str, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """``path, length, content`` of all files of a job. Filters on ``path`` reach the files; only those asked for are opened."""
    spark.dataSource.register(ImageStore)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format(FORMAT).options(folder=folder, job=job, partition_bytes=str(partition_bytes)).load()


def with_bodies(df: DataFrame, path: str = "image_path", content: str = "content") -> DataFrame:
    """``df`` plus the bytes of the files that ``path`` names; NULL where it is NULL or names no file.

    Each task opens the files of its own rows, so bytes cross no exchange.
    """
    if content in df.columns:
        raise ValueError(f"column {content} exists already")
    schema = StructType([*df.schema.fields]).add(content, BinaryType())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        systems: dict[str, pafs.FileSystem] = {}
        for batch in batches:
            bodies, held, start = [], 0, 0
            for i, p in enumerate(batch.column(path).to_pylist()):
                bodies.append(_body(p, systems))
                held += len(bodies[-1] or b"")
                if held >= FLUSH_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(start, len(bodies))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bodies, pa.binary())], [*part.schema.names, content])
                    bodies, held, start = [], 0, i + 1

    return df.mapInArrow(read, schema)


def _body(path: str | None, systems: dict[str, pafs.FileSystem]) -> bytes | None:
    if path is None:
        return None
    scheme = path.split("://")[0] if "://" in path else "file"
    if scheme not in systems:
        systems[scheme] = file_system(path)[0]
    try:
        with systems[scheme].open_input_stream(path.split("://", 1)[-1] if "://" in path else path.removeprefix("file:")) as f:
            return f.read()
    except FileNotFoundError:
        return None
