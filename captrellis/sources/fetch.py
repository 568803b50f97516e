"""Fetch stage: URL table in, asset table with one auditable status per row out.

How a URL is opened is injected, so the stage runs against any transport:

``fetcher(url, attempt) -> Response``

raising :class:`FetchTimeout` for a timeout, :class:`FetchError` for any other
request failure (HTTP errors included) and :class:`OSError` while the body is
read or stored.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from captrellis.functions.images import extension_for, probe
from captrellis.sources.blobs import blob_name
from captrellis.session import file_system
from captrellis.sources.store import committed_jobs, store
from captrellis.sources.tables import extended, require_columns

#: Attempts, seconds until a timeout, seconds between attempts.
ATTEMPTS = 2
TIMEOUT_SECONDS = 10
DELAY_SECONDS = 2.0
HEADER = "struct<format:string,width:int,height:int,mode:string,ok:boolean>"
#: Bytes of bodies that a task collects before it hands them on.
FLUSH_BYTES = 8 * 1024 * 1024


class FetchTimeout(Exception):
    """No answer in time."""


class FetchError(Exception):
    """The request failed for another reason."""


class Response(NamedTuple):
    content_type: str | None
    body: bytes | Callable[[], bytes]  # a callable is read after the headers arrived


def http_fetcher(timeout: float = TIMEOUT_SECONDS) -> Callable[[str, int], Response]:
    """A fetcher over HTTP(S) built on the standard library; other schemes are refused, also after redirects."""

    def fetch(url: str, attempt: int) -> Response:
        import http.client
        import urllib.error
        import urllib.request

        # The URLs are not trusted: an opener without file, FTP and data handlers cannot read executors' files.
        opener = urllib.request.OpenerDirector()
        for handler in (
            urllib.request.ProxyHandler(),
            urllib.request.HTTPHandler(),
            urllib.request.HTTPSHandler(),
            urllib.request.HTTPRedirectHandler(),
            urllib.request.HTTPErrorProcessor(),
            urllib.request.HTTPDefaultErrorHandler(),
            urllib.request.UnknownHandler(),
        ):
            opener.add_handler(handler)
        try:
            if not url.lower().startswith(("http://", "https://")):
                raise FetchError(f"not an HTTP address: {url}")
            reply = opener.open(url, timeout=timeout)
        except TimeoutError as e:
            raise FetchTimeout(str(e)) from e
        except urllib.error.URLError as e:
            if isinstance(e.reason, TimeoutError):
                raise FetchTimeout(str(e)) from e
            raise FetchError(str(e)) from e
        except (OSError, http.client.HTTPException, ValueError) as e:  # a broken reply, or not a usable URL
            raise FetchError(str(e)) from e

        def body() -> bytes:
            try:
                with reply:
                    return reply.read()
            except http.client.HTTPException as e:
                raise OSError(str(e)) from e

        return Response(reply.headers.get("content-type"), body)

    return fetch


def mirror_fetcher(root: str) -> Callable[[str, int], Response]:
    """A fetcher of mirrored files: URLs are paths or URIs below ``root``, on any file system that Arrow knows.

    The content type follows from the name. The URLs are not trusted: a path outside ``root`` is refused.
    """

    def fetch(url: str, attempt: int) -> Response:
        import mimetypes
        import posixpath

        fs, base = file_system(root)
        # A plain path belongs to the root's file system; a URI must begin like the root.
        scheme = root.partition("://")[0] + "://" if "://" in root else "file://"
        path = posixpath.normpath(url.removeprefix(scheme))
        if "://" in url.removeprefix(scheme) or not path.startswith(base + "/"):
            raise FetchError("outside the mirror")
        try:
            source = fs.open_input_stream(path)
        except OSError as e:
            raise FetchError("not found") from e

        def body() -> bytes:
            with source:
                return source.read()

        return Response(mimetypes.guess_type(path)[0], body)

    return fetch


def fetch_one(
    url: str | None, fetcher: Callable[[str, int], Response], attempts: int, delay: float, first: int = 0
) -> tuple[str, str | None, bytes | None]:
    """``(status, content_type, body)`` for one URL; attempts are numbered from ``first``.

    Timeouts and request errors are tried again; a failure of the body or
    anything unexpected ends at once.
    """
    if not url:
        return "missing_url", None, None
    status = "failed_after_retries"
    for attempt in range(first, first + attempts):
        if attempt > first:
            time.sleep(delay)
        try:
            content_type, body = fetcher(url, attempt)
        except FetchTimeout:
            status = "timeout"
            continue
        except FetchError as e:
            status = f"request_error: {e}"
            continue
        except OSError as e:
            return f"file_io_error: {e}", None, None
        except Exception as e:  # noqa: BLE001 - every row must end with a status
            return f"unexpected_error: {e}", None, None
        try:
            return "success", content_type, body() if callable(body) else body
        except OSError as e:
            return f"file_io_error: {e}", None, None
        except Exception as e:  # noqa: BLE001
            return f"unexpected_error: {e}", None, None
    return status, None, None


def fetch_in_rounds(
    df: DataFrame,
    fetcher: Callable[[str, int], Response],
    key: str,
    folder: str,
    url: str = "image_url",
    tasks: int | None = None,
    attempts: int = ATTEMPTS,
    delay: float = DELAY_SECONDS,
    slices: int = 1,
    unknown_extension: str = ".bin",
) -> DataFrame:
    """Every row of ``df`` plus ``download_status, image_path, n_bytes, header``; bodies are files below ``folder``.

    An attempt at all pending URLs is a round of jobs, and nothing waits inside a task: the driver sleeps between
    rounds, and the URLs that are left are dealt to the tasks anew by their keys. Each round deals its URLs to
    ``slices`` jobs. The jobs' indexes, committed with their files, are the ledger of attempts: called again with the same
    ``folder`` it goes on, asks no URL again that has a final answer, and repeats at most the slice that was cut off.
    Only timeouts and request errors are tried again. ``key`` must be unique; rows with a NULL key are an error.
    """
    require_columns(df, [key, url])
    if attempts < 0 or slices < 1:
        raise ValueError("attempts must not be negative, and there is at least one slice")
    ours = {"download_status", "image_path", "n_bytes", "header", "status", "content", "_attempt", "_asked"} & set(df.columns)
    if ours:
        raise ValueError(f"columns {sorted(ours)} exist already")
    if not df.where(F.col(key).isNull()).isEmpty():
        raise ValueError(f"{key} is NULL in some rows")
    kind = df.schema[key].dataType.simpleString()
    fields = f"`{key}` {kind}, _attempt int, download_status string, header {HEADER}, image_path string, n_bytes long, status string"
    for n in range(attempts):
        for part in range(slices):
            known = _answers(ledger(df.sparkSession, folder, fields), key)
            pending = df.select(key, url).where(F.pmod(F.xxhash64(key), F.lit(slices)) == part).join(known, key, "left")
            pending = pending.where(f"_asked IS NULL OR (NOT final AND _asked <= {n})").select(key, url, F.expr("coalesce(_asked, 0)").cast("int").alias("_attempt"))
            if pending.isEmpty():
                continue
            asked = fetch(pending, fetcher, key, url, "", tasks, 1, 0.0, unknown_extension, "_attempt")
            asked = asked.withColumn("header", probe("content")).withColumnRenamed("image_path", "_name")
            store(asked.select(key, "_attempt", "download_status", "header", "_name", "content"), folder, "_name", "content")
        left = _answers(ledger(df.sparkSession, folder, fields), key).where(f"NOT final AND _asked <= {n + 1}")
        if n + 1 < attempts and not left.isEmpty():
            time.sleep(delay)
    out = df.join(_answers(ledger(df.sparkSession, folder, fields), key).drop("_asked", "final"), key, "left")
    return out.withColumn("download_status", F.coalesce("download_status", F.lit("failed_after_retries")))


def ledger(spark: SparkSession, folder: str, fields: str) -> DataFrame:
    """The index rows of all committed jobs below ``folder``."""
    jobs = committed_jobs(folder)
    if not jobs:
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).parquet(*[f"{folder.rstrip('/')}/{j}/index" for j in jobs])


def _answers(attempts: DataFrame, key: str) -> DataFrame:
    """Per key the number of attempts and the last one's answer; a body that was not stored is not a success."""
    told = attempts.withColumn("download_status", F.expr("IF(download_status = 'success' AND status <> 'success', status, download_status)"))
    last = F.max_by(F.struct("download_status", "header", "image_path", "n_bytes"), "_attempt").alias("last")
    final = F.expr("last.download_status NOT LIKE 'timeout%' AND last.download_status NOT LIKE 'request_error%'")
    return told.groupBy(key).agg(F.count("*").alias("_asked"), last).select(key, "_asked", final.alias("final"), "last.*")


def fetch(
    df: DataFrame,
    fetcher: Callable[[str, int], Response],
    key: str,
    url: str = "image_url",
    folder: str = "",
    tasks: int | None = None,
    attempts: int = ATTEMPTS,
    delay: float = DELAY_SECONDS,
    unknown_extension: str = ".bin",
    attempt: str | None = None,
) -> DataFrame:
    """Add ``image_path, download_status, content`` to every row.

    ``tasks`` spreads the URLs by the row key, which bounds the number of open
    connections. Paths derive from the row key, so a repeated task yields the
    same rows. The stage has side effects on the remote side: write its result
    once (``captrellis.session.stage``) and read that. ``attempt`` names a column with the number of the first attempt.
    """
    require_columns(df, [key, url])
    if attempts < 0:
        raise ValueError("attempts must not be negative")
    schema = extended(df.schema, "download_status", "_content_type").add("content", BinaryType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            done, held, start = [], 0, 0
            firsts = batch[attempt].tolist() if attempt else [0] * len(batch)
            for i, (u, first) in enumerate(zip(batch[url], firsts)):
                done.append(fetch_one(u, fetcher, attempts, delay, first))
                held += len(done[-1][2] or b"")
                # Bodies leave the task as soon as they add up, however many rows the batch has.
                if held >= FLUSH_BYTES or i == len(batch) - 1:
                    status, kind, content = zip(*done)
                    yield batch.iloc[start : i + 1].assign(
                        download_status=list(status), _content_type=list(kind), content=list(content)
                    )
                    done, held, start = [], 0, i + 1

    spread = df.repartition(tasks, key) if tasks else df
    name = blob_name(key, extension_for("_content_type", unknown=unknown_extension))
    prefix = F.lit(folder.rstrip("/") + "/" if folder else "")
    return (
        spread.mapInPandas(run, schema)
        .withColumn("image_path", F.when(F.col("download_status") == "success", F.concat(prefix, name)).cast(StringType()))
        .drop("_content_type")
    )
