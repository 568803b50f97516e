"""Header probe, gate, blobs and the fetch stage."""

import struct

import pytest
from pyspark.sql import functions as F

from captrellis.functions.images import extension_for, extension_from_header, probe, reject_reason
from captrellis.operators import gate
from captrellis.sources import blobs, tables
from captrellis.sources.fetch import FetchError, FetchTimeout, Response, fetch, fetch_one


def png(w, h, depth=8, colour=2):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBB", 13, b"IHDR", w, h, depth, colour) + b"\0\0\0"


def jpeg(w, h, parts):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * parts, 8, h, w, parts) + b"\0" * 9


def box(kind, body):
    return struct.pack(">I4s", 8 + len(body), kind) + body


def heif(brand, w, h, alpha=False, long=False):
    def ispe(a, b):
        return box(b"ispe", struct.pack(">III", 0, a, b))

    props = ispe(16, 16) + ispe(w, h) + box(b"pixi", b"\0" * 8)
    if alpha:
        props += box(b"auxC", b"\0\0\0\0urn:mpeg:mpegB:cicp:systems:auxiliary:alpha\0")
    meta = box(b"meta", b"\0\0\0\0" + box(b"hdlr", b"\0" * 24) + box(b"iprp", box(b"ipco", props) + box(b"ipma", b"\0" * 9)))
    free = struct.pack(">I4sQ", 1, b"free", 40) + b"x" * 24 if long else box(b"free", b"y" * 5)
    return box(b"ftyp", brand + b"\0\0\0\0mif1miaf") + free + meta + struct.pack(">I4s", 0, b"mdat") + b"z" * 30


def tiff(order, w, h, light, bits, samples, extra=None, start=8):
    e = "<" if order == b"II" else ">"
    tags = [(256, 4, 1, w), (257, 3, 1, h), (258, 3, samples, bits), (259, 3, 1, 1), (262, 3, 1, light), (277, 3, 1, samples)]
    tags += [(338, 3, 1, extra)] if extra is not None else []
    out = order + struct.pack(e + "HI", 42, start) + b"\0" * (start - 8) + struct.pack(e + "H", len(tags))
    for tag, kind, count, value in tags:
        out += struct.pack(e + "HHI", tag, kind, count)
        if kind == 3 and count > 2:
            out += struct.pack(e + "I", start + 2 + 12 * len(tags) + 4)
        else:
            out += struct.pack(e + "HH", value, value if count == 2 else 0) if kind == 3 else struct.pack(e + "I", value)
    return out + b"\0" * 4 + struct.pack(e + f"{samples}H", *[bits] * samples)


def jp2(w, h, parts):
    head = box(b"ihdr", struct.pack(">IIHBBBB", h, w, parts, 7, 7, 0, 0))
    return b"\0\0\0\x0cjP  \r\n\x87\n" + box(b"ftyp", b"jp2 \0\0\0\0jp2 ") + box(b"jp2h", head + box(b"colr", b"\1\0\0\0\0\0\x10"))


def ico(entries):
    out, place, bodies = struct.pack("<HHH", 0, 1, len(entries)), 6 + 16 * len(entries), b""
    for w, h, body in entries:
        out += struct.pack("<BBBBHHII", w % 256, h % 256, 0, 0, 1, 32, len(body), place + len(bodies))
        bodies += body
    return out + bodies


BAD = (None, None, None, None, False)
HEADERS = [
    (png(60, 50), ("PNG", 60, 50, "RGB", True)),
    (png(60, 50, 1, 0), ("PNG", 60, 50, "1", True)),
    (png(60, 50, 16, 0), ("PNG", 60, 50, "I;16", True)),
    (jpeg(70, 80, 3), ("JPEG", 70, 80, "RGB", True)),
    (jpeg(70, 80, 1), ("JPEG", 70, 80, "L", True)),
    (jpeg(70, 80, 4), ("JPEG", 70, 80, "CMYK", True)),
    (b"GIF89a" + struct.pack("<HH", 9, 8), ("GIF", 9, 8, "P", True)),
    (b"BM" + b"\0" * 16 + struct.pack("<iiHH", 64, -65, 1, 24) + b"\0" * 4, ("BMP", 64, 65, "RGB", True)),
    (b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", 100, 90), ("WEBP", 100, 90, "RGB", True)),
    (b"RIFF\0\0\0\0WEBPVP8L\0\0\0\0\x2f" + struct.pack("<I", 99 | 89 << 14 | 1 << 28), ("WEBP", 100, 90, "RGBA", True)),
    (b"RIFF\0\0\0\0WEBPVP8X\0\0\0\0\x10\0\0\0" + b"\x63\0\0\x59\0\0", ("WEBP", 100, 90, "RGBA", True)),
    (b"BM" + b"\0" * 12 + struct.pack("<IHHHH", 12, 64, 65, 1, 8), ("BMP", 64, 65, "P", True)),
    (b"\xff\xd8" + b"\xff" * 3000 + jpeg(70, 80, 3)[2:], ("JPEG", 70, 80, "RGB", True)),
    (heif(b"avif", 640, 480), ("AVIF", 640, 480, "RGB", True)),
    (heif(b"heic", 64, 4800, alpha=True, long=True), ("HEIF", 64, 4800, "RGBA", True)),
    (tiff(b"II", 70, 60, 2, 8, 3), ("TIFF", 70, 60, "RGB", True)),
    (tiff(b"MM", 70_000, 60, 2, 8, 4, 2, start=60), ("TIFF", 70_000, 60, "RGBA", True)),
    (tiff(b"II", 70, 60, 2, 8, 4, 0), ("TIFF", 70, 60, "RGB", True)),
    (tiff(b"MM", 70, 60, 0, 1, 1), ("TIFF", 70, 60, "1", True)),
    (tiff(b"II", 70, 60, 1, 16, 1), ("TIFF", 70, 60, "I;16", True)),
    (tiff(b"II", 70, 60, 5, 8, 4), ("TIFF", 70, 60, "CMYK", True)),
    (tiff(b"II", 70, 60, 1, 8, 2, 2), ("TIFF", 70, 60, "LA", True)),
    (tiff(b"MM", 70, 60, 3, 8, 1), ("TIFF", 70, 60, "P", True)),
    (tiff(b"MM", 70, 60, 6, 8, 3), ("TIFF", 70, 60, "YCbCr", True)),
    (jp2(300, 200, 3), ("JPEG2000", 300, 200, "RGB", True)),
    (b"\xff\x4f\xff\x51" + struct.pack(">HHIIIIIIIIH", 47, 0, 303, 205, 3, 5, 9, 9, 0, 0, 1), ("JPEG2000", 300, 200, "L", True)),
    (ico([(16, 16, b"d" * 40), (256, 256, png(256, 256, 8, 2)), (32, 32, b"e" * 40)]), ("ICO", 256, 256, "RGB", True)),
    (ico([(48, 49, b"d" * 40)]), ("ICO", 48, 49, "RGBA", True)),
    (b"II*\0" + b"\xff" * 8, BAD),
    (tiff(b"II", 70, 60, 2, 8, 3)[:30], BAD),
    (heif(b"avif", 640, 480)[:60], BAD),
    (b"\0\0\1\0\0\0", BAD),
    (png(0, 60), BAD),
    (png(1 << 31, 60), BAD),
    (b"\xff\xd8\xff", BAD),
    (b"<html>", (None, None, None, None, False)),
    (b"", (None, None, None, None, False)),
    (None, (None, None, None, None, False)),
]


def test_probe_column(spark):
    df = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, (b, _) in enumerate(HEADERS)], "i int, content binary")
    got = {r["i"]: tuple(r["h"]) for r in df.select("i", probe("content").alias("h")).collect()}
    assert got == {i: w for i, (_, w) in enumerate(HEADERS)}


def test_cut_headers_never_fail(spark):
    """Every beginning of every header is read or refused, and read only as what it is."""
    rows = [(i, n, bytearray(b[:n])) for i, (b, _) in enumerate(HEADERS) if b and len(b) < 700 for n in range(0, len(b), 3)]
    df = spark.createDataFrame(rows, "i int, n int, content binary")
    for r in df.select("i", probe("content").alias("h")).collect():
        want = HEADERS[r["i"]][1]
        assert tuple(r["h"]) == BAD or r["h"]["format"] == want[0]


def test_probe_stays_in_the_engine(spark):
    df = spark.createDataFrame([(bytearray(b"x"),)], "content binary").select(probe("content").alias("h"))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()


def test_header_behind_long_metadata(spark):
    """Frame after 200 kB of application segments."""
    late = b"\xff\xd8" + (b"\xff\xe1" + struct.pack(">H", 50_002) + b"m" * 50_000) * 4 + jpeg(90, 91, 3)[8:]
    df = spark.createDataFrame([(1, bytearray(late)), (2, bytearray(png(60, 60) + b"z" * 100_000)), (3, bytearray(b"x" * 70_000))], "k int, content binary")
    got = {r["k"]: tuple(r["h"]) for r in df.select("k", probe("content").alias("h")).collect()}
    assert got == {1: ("JPEG", 90, 91, "RGB", True), 2: ("PNG", 60, 60, "RGB", True), 3: (None, None, None, None, False)}


@pytest.mark.parametrize(
    "body, limit, want",
    [
        (png(50, 50), None, None),
        (png(49, 50), None, "small_or_mode"),
        (png(50, 49), None, "small_or_mode"),
        (png(500, 500, 16, 0), None, "small_or_mode"),
        (png(3000, 3000), None, None),
        (png(3000, 3000), 2048 * 2048, "high_res"),
        (png(2048, 2048), 2048 * 2048, None),
        (b"junk", 10, "corrupted"),
    ],
)
def test_gate(spark, body, limit, want):
    df = spark.createDataFrame([(bytearray(body),)], "content binary")
    assert df.select(reject_reason(probe("content"), limit).alias("r")).first()["r"] == want


def test_drop_counts_with_and_without_a_second_pass(spark):
    rows = [(1, "p", "success", png(60, 60)), (2, None, "timeout", None), (3, "p", "success", b"x"), (4, "p", "success", png(9, 9)), (5, None, None, png(60, 60))]
    df = gate.gated(spark.createDataFrame([(a, b, c, bytearray(d) if d else None) for a, b, c, d in rows], "k int, image_path string, status string, content binary"))
    want = {"corrupted": 1, "small_or_mode": 1, "high_res": 0, "total_removed": 4, "final_size": 1}
    assert gate.drop_report(df).first().asDict() == want
    seen_df, seen = gate.observe_drops(df)
    seen_df.write.format("noop").mode("overwrite").save()
    assert seen.get == want


def test_rejects_from_many_tables(spark):
    df = spark.range(6).withColumnRenamed("id", "k")
    a = spark.createDataFrame([(1,), (1,), (None,)], "k long")
    b = spark.createDataFrame([(1,), (4,)], "k long")
    assert sorted(r["k"] for r in gate.without_rejects(df, [a, b], "k").collect()) == [0, 2, 3, 5]


@pytest.mark.parametrize(
    "kind, want",
    [("image/jpeg", ".jpg"), ("IMAGE/PNG ; q=1", ".png"), (None, ".jpg"), ("", ".jpg"), ("what/ever", ".bin")],
)
def test_extensions(spark, kind, want):
    df = spark.createDataFrame([(kind,)], "t string")
    assert df.select(extension_for("t").alias("e")).first()["e"] == want


class Script:
    """Plays one outcome per attempt and counts the attempts."""

    def __init__(self, *outcomes):
        self.outcomes, self.calls = outcomes, 0

    def __call__(self, url, attempt):
        out = self.outcomes[attempt]
        self.calls += 1
        if isinstance(out, Exception):
            raise out
        return out


def broken_body():
    raise OSError("cut")


@pytest.mark.parametrize(
    "url, outcomes, status, calls",
    [
        (None, [], "missing_url", 0),
        ("", [], "missing_url", 0),
        ("u", [Response("image/png", b"1")], "success", 1),
        ("u", [FetchTimeout(), Response(None, b"1")], "success", 2),
        ("u", [FetchTimeout(), FetchTimeout()], "timeout", 2),
        ("u", [FetchTimeout(), FetchError("500")], "request_error: 500", 2),
        ("u", [FetchError("404"), FetchTimeout()], "timeout", 2),
        ("u", [FetchError("404"), FetchError("404")], "request_error: 404", 2),
        ("u", [Response("x", broken_body)], "file_io_error: cut", 1),
        ("u", [OSError("disk")], "file_io_error: disk", 1),
        ("u", [RuntimeError("boom")], "unexpected_error: boom", 1),
    ],
)
def test_status_precedence(url, outcomes, status, calls):
    script = Script(*outcomes)
    got, _, body = fetch_one(url, script, 2, 0.0)
    assert (got, script.calls) == (status, calls) and (body is not None) == (status == "success")


def test_no_attempts():
    assert fetch_one("u", Script(), 0, 0.0)[0] == "failed_after_retries"


def test_fetch_stage_is_repeatable(spark):
    df = spark.createDataFrame([(1, "u"), (2, None)], "k long, image_url string")
    out = fetch(df, lambda url, attempt: Response("image/png", b"abc"), "k", folder="f/", tasks=2)
    first, second = (sorted(map(str, out.collect())) for _ in range(2))
    assert first == second
    got = {r["k"]: r for r in out.collect()}
    assert got[1]["image_path"].startswith("f/") and got[1]["image_path"].endswith(".png")
    assert got[2]["image_path"] is None and got[2]["content"] is None
    with pytest.raises(ValueError, match="Available columns"):
        fetch(df.drop("image_url"), None, "k")


def test_table_checks(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "val")], "k long, split string")
    with pytest.raises(ValueError, match="Available columns"):
        tables.require_columns(df, ["image_url"])
    with pytest.raises(ValueError, match="empty"):
        tables.require_rows(df.where(F.lit(False)))
    tables.write_table(df, str(tmp_path / "t"), partition_by="split")
    assert [r["k"] for r in tables.read_table(spark, str(tmp_path / "t"), "val", ["k"]).collect()] == [2]
    assert tables.extended(df.schema, "image_path").names == ["k", "split", "image_path"]
    assert df.schema.names == ["k", "split"]


def test_fetcher_speaks_http_only():
    from captrellis.sources.fetch import FetchError, http_fetcher

    for url in ("file:///etc/hostname", "ftp://x/y", "data:text/plain,a", "x", "HTTP:/"):
        with pytest.raises(FetchError):
            http_fetcher(1)(url, 0)


def test_fetch_hands_bodies_on_as_they_add_up(spark, monkeypatch):
    from captrellis.sources import fetch as stage

    monkeypatch.setattr(stage, "FLUSH_BYTES", 10)
    df = spark.createDataFrame([(i, f"http://h/{i}") for i in range(20)], "k long, image_url string").coalesce(1)
    out = stage.fetch(df, lambda url, attempt: stage.Response("image/png", b"1234"), "k").collect()
    assert sorted(r.k for r in out) == list(range(20)) and all(bytes(r.content) == b"1234" for r in out)


def test_image_gate_compares_two_probes(spark, data_dir):
    from captrellis.queries.corpus import image_gate

    rows = image_gate(spark, data_dir).collect()
    assert rows and all(r["same_in_jvm"] for r in rows)


def test_probe_png_reads_what_probe_reads(spark):
    from captrellis.functions.images import probe_png

    head = "89504E470D0A1A0A0000000D49484452"
    bodies = [head + "00000040" + "00000041" + "0806000000", head + "00000040" + "00000000" + "0802000000", "00" + head[2:] + "0" * 26, head + "0000", ""]
    df = spark.createDataFrame([(i, bytearray.fromhex(b)) for i, b in enumerate(bodies)], "i int, content binary")
    got = df.select("i", probe_png("content").alias("png"), (probe_png("content") == probe("content")).alias("same")).orderBy("i").collect()
    assert [r["png"]["ok"] for r in got] == [True, False, False, False, False] and all(r["same"] for r in got)
    assert got[0]["png"][:4] == ("PNG", 64, 65, "RGBA")


def test_fetch_hands_on_few_megabytes(spark):
    """Ten bodies of 3 MB leave a task in several batches."""
    urls = spark.createDataFrame([(i, f"u{i}") for i in range(10)], "k long, image_url string").coalesce(1)
    got = fetch(urls, lambda url, attempt: Response("image/png", b"x" * 3_000_000), "k", tasks=1).select(F.octet_length("content").alias("n"))
    assert got.agg(F.sum("n")).first()[0] == 30_000_000
    from captrellis.sources import fetch as stage

    assert stage.FLUSH_BYTES <= 8 * 1024 * 1024
