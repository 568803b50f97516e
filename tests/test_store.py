"""The image store: commits, failures, scans planned by bytes, and bytes attached to rows."""

import sys
from pathlib import Path

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from captrellis.sources import fetch
from captrellis.sources.fetch import FetchTimeout, Response
from captrellis.sources.store import MANIFEST, Attempt, Range, StoreReader, StoreWriter, scan_store, store, with_bodies

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _rows(spark, n=40, parts=4):
    df = spark.range(n).select("id", F.concat(F.col("id") % 7, F.lit(".bin")).alias("name"), F.expr("CAST(repeat(CAST(id AS STRING), 50) AS BINARY)").alias("content"))
    return df.repartition(parts, "id")


def test_written_rows_read_back(spark, tmp_path):
    df = _rows(spark).withColumn("content", F.when(F.col("id") != 5, F.col("content"))).withColumn("name", F.when(F.col("id") != 6, F.col("name")))
    done, job = store(df, str(tmp_path))
    rows = {r.id: r for r in done.collect()}
    assert done.columns == ["id", "image_path", "n_bytes", "status"] and len(rows) == 40
    assert {i for i, r in rows.items() if r.status != "success"} == {5, 6} and rows[5].image_path is None
    assert len({r.image_path for r in rows.values()}) == 39  # equal names do not meet, and NULL for two rows
    for i, r in rows.items():
        if r.status == "success":
            assert Path(r.image_path).read_bytes() == (str(i) * 50).encode() and r.n_bytes == 50 * len(str(i))
    back = with_bodies(done)
    assert {r.id: r.content for r in back.collect()} == {i: None if i in (5, 6) else (str(i) * 50).encode() for i in range(40)}
    assert "Exchange" not in back._jdf.queryExecution().executedPlan().toString()
    scanned = scan_store(spark, str(tmp_path), job, partition_bytes=300)
    assert {r.path: bytes(r.content) for r in scanned.collect()} == {r.image_path: (str(i) * 50).encode() for i, r in rows.items() if r.image_path}
    assert scanned.rdd.getNumPartitions() > 4
    paths = [rows[1].image_path, rows[39].image_path, "/nowhere/x/y"]
    assert {r.path for r in scanned.where(F.col("path").isin(paths)).collect()} == set(paths[:2])
    assert scanned.where(F.col("path") == paths[0]).where("length > 3").count() == 1


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    def broken(batches):
        for batch in batches:
            yield batch
            if 13 in batch["id"].tolist():
                raise RuntimeError("lost")

    df = _rows(spark)
    with pytest.raises(Exception, match="lost"):
        store(df.mapInPandas(broken, df.schema), str(tmp_path))
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []


def test_commit_deletes_what_other_attempts_left(tmp_path):
    writer = StoreWriter({"folder": str(tmp_path), "job": "j", "name": "name", "content": "content"}, schema=type("S", (), {"fields": []}))
    for attempt in ("0-0-killed", "0-1-done"):
        (tmp_path / "j/files" / attempt).mkdir(parents=True)
        (tmp_path / "j/files" / attempt / "a.png").write_bytes(b"x")
        (tmp_path / "j/index").mkdir(exist_ok=True)
        (tmp_path / "j/index" / f"{attempt}.parquet").write_bytes(b"x")
    writer.commit([Attempt("0-1-done", 1, 1), None])
    assert sorted(str(p.relative_to(tmp_path / "j")) for p in tmp_path.rglob("*") if p.is_file()) == ["files/0-1-done/a.png", "index/0-1-done.parquet", MANIFEST]
    reader = StoreReader({"folder": str(tmp_path), "job": "j"})
    assert reader.partitions() == [Range([(f"{tmp_path}/j/index/0-1-done.parquet", 0, 1)])]
    reader.paths = {"/elsewhere/attempt/a.png"}
    assert reader.partitions() == [Range([])]


def test_partitions_follow_bytes(tmp_path):
    writer = StoreWriter({"folder": str(tmp_path), "job": "j", "name": "n", "content": "c"}, schema=type("S", (), {"fields": []}))
    writer.commit([Attempt("a", 10, 1000), Attempt("b", 3, 30), Attempt("c", 3, 30), Attempt("d", 0, 0)])
    parts = StoreReader({"folder": str(tmp_path), "job": "j", "partition_bytes": "250"}).partitions()
    assert [[(p[0][-9], p[1], p[2]) for p in r.parts] for r in parts] == [[("a", 0, 2)], [("a", 2, 5)], [("a", 5, 7)], [("a", 7, 10)], [("b", 0, 3), ("c", 0, 3)]]


def test_empty_tables_and_clashing_columns(spark, tmp_path):
    done, job = store(_rows(spark).where("id < 0"), str(tmp_path))
    assert done.count() == 0 and scan_store(spark, str(tmp_path), job).count() == 0
    with pytest.raises(ValueError):
        store(_rows(spark).withColumn("status", F.lit(1)), str(tmp_path))
    assert with_bodies(spark.createDataFrame([("/no/such/file",), (None,)], "image_path string")).where("content IS NOT NULL").count() == 0


class Diary:
    """A transport that writes down every request and fails by plan: key 1 once, key 2 always, key 3 for good, key 4 in the body."""

    def __init__(self, folder):
        self.folder = folder

    def __call__(self, url, attempt):
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(f"{url} {attempt}")
        n = int(url.split("/")[-1])
        if n == 2 or n == 1 and attempt == 0:
            raise FetchTimeout()
        if n == 3:
            raise RuntimeError("boom")

        def body():
            if n == 4:
                raise OSError("broken")
            return b"body" + str(n).encode()

        return Response("image/png", body)

    def asked(self):
        found = sorted(p.read_text() for p in Path(self.folder).iterdir())
        for p in Path(self.folder).iterdir():
            p.unlink()
        return found


def test_rounds_go_on_where_they_stopped(spark, tmp_path, monkeypatch):
    (tmp_path / "diary").mkdir()
    diary, images = Diary(str(tmp_path / "diary")), str(tmp_path / "images")
    urls = spark.range(6).select("id", F.expr("IF(id = 0, NULL, concat('http://h/', id))").alias("image_url"), F.lit("x").alias("caption"))
    ask = lambda df, **more: {r.id: r for r in fetch.fetch_in_rounds(df, diary, "id", images, tasks=2, delay=0.0, **more).collect()}
    assert {r.download_status for r in ask(urls, attempts=0).values()} == {"failed_after_retries"} and diary.asked() == []
    ask(urls.where("id IN (1, 2, 5)"), attempts=1)
    assert diary.asked() == ["http://h/1 0", "http://h/2 0", "http://h/5 0"]
    # A job that is cut off in its second slice keeps the first one's answers.
    real, calls = fetch.store, []

    def cut_off(*args):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return real(*args)

    monkeypatch.setattr(fetch, "store", cut_off)
    with pytest.raises(KeyboardInterrupt):
        ask(urls, slices=3)
    monkeypatch.setattr(fetch, "store", real)
    first = diary.asked()
    rows = ask(urls, slices=3)
    second = diary.asked()
    assert sorted(first + second) == ["http://h/1 1", "http://h/2 1", "http://h/3 0", "http://h/4 0"] and first and second
    assert {i: r.download_status.split(":")[0] for i, r in rows.items()} == {0: "missing_url", 1: "success", 2: "timeout", 3: "unexpected_error", 4: "file_io_error", 5: "success"}
    assert Path(rows[1].image_path).read_bytes() == b"body1" and rows[5].n_bytes == 5 and rows[2].image_path is None
    assert rows[1].header.ok is False and rows[1].caption == "x"
    assert ask(urls)[5] == rows[5] and diary.asked() == []
    with pytest.raises(ValueError, match="NULL"):
        ask(urls.withColumn("id", F.expr("nullif(id, 3)")))


def test_mirror_fetcher_stays_in_its_folder(tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m/a.png").write_bytes(b"x")
    (tmp_path / "secret").write_bytes(b"y")
    ask = fetch.mirror_fetcher(str(tmp_path / "m"))
    kind, body = ask(str(tmp_path / "m/a.png"), 0)
    assert kind == "image/png" and body() == b"x"
    for url in (f"{tmp_path}/m/../secret", f"{tmp_path}/secret", "../secret", "/etc/hostname", f"{tmp_path}/mm/a.png", "http://h/m/a.png"):
        with pytest.raises(fetch.FetchError, match="outside"):
            ask(url, 0)
    for url in (f"{tmp_path}/m/b.png", f"{tmp_path}/m/a.png/c"):
        with pytest.raises(fetch.FetchError, match="not found"):
            ask(url, 0)
