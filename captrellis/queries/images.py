"""Header probe over images of every known format, built around the sides that a table gives."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from captrellis.functions.images import needs_rgb, probe, reject_reason
from captrellis.sources.tables import read_table

# Sides in the templates; every template has both once.
_W, _H = 0x1A1B, 0x2A2B


def _box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", 8 + len(body), kind) + body


def _heif(brand: bytes, alpha: bool) -> bytes:
    """A thumbnail's size before the image's, a box with a long size in between, and an open end."""
    sizes = _box(b"ispe", struct.pack(">III", 0, 1, 1)) + _box(b"ispe", struct.pack(">III", 0, _W, _H))
    plane = _box(b"auxC", b"\0\0\0\0urn:mpeg:mpegB:cicp:systems:auxiliary:alpha\0") if alpha else b""
    meta = _box(b"meta", b"\0\0\0\0" + _box(b"hdlr", b"\0" * 24) + _box(b"iprp", _box(b"ipco", sizes + plane)))
    return _box(b"ftyp", brand + b"\0\0\0\0mif1") + struct.pack(">I4sQ", 1, b"free", 24) + b"x" * 8 + meta + struct.pack(">I4s", 0, b"mdat")


def _tiff(order: bytes, light: int, samples: int) -> bytes:
    e = "<" if order == b"II" else ">"
    tags = [(256, 4, 1, _W), (257, 4, 1, _H), (258, 3, samples, 8), (262, 3, 1, light), (277, 3, 1, samples)]
    out = order + struct.pack(e + "HIH", 42, 8, len(tags))
    for tag, kind, count, value in tags:
        out += struct.pack(e + "HHI", tag, kind, count)
        if kind == 3 and count > 2:  # too long for the entry
            out += struct.pack(e + "I", 10 + 12 * len(tags))
        else:
            out += struct.pack(e + "HH", value, 0) if kind == 3 else struct.pack(e + "I", value)
    return out + struct.pack(e + f"{samples}H", *[8] * samples)


_TEMPLATES = [
    ("PNG", "RGBA", b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sIIBB", 13, b"IHDR", _W, _H, 8, 6) + b"\0\0\0"),
    ("JPEG", "RGB", b"\xff\xd8MANY\xff\xff\xff\xc0" + struct.pack(">HBHHB", 17, 8, _H, _W, 3) + b"\0" * 9),
    ("GIF", "P", b"GIF89a" + struct.pack("<HH", _W, _H)),
    ("BMP", "RGB", b"BM" + b"\0" * 12 + struct.pack("<IIIHH", 40, _W, _H, 1, 24)),
    ("BMP", "P", b"BM" + b"\0" * 12 + struct.pack("<IHHHH", 12, _W, _H, 1, 8)),
    ("WEBP", "RGB", b"RIFF\0\0\0\0WEBPVP8 " + b"\0" * 10 + struct.pack("<HH", _W, _H)),
    ("TIFF", "RGB", _tiff(b"II", 2, 3)),
    ("TIFF", "L", _tiff(b"MM", 1, 1)),
    ("TIFF", "CMYK", _tiff(b"MM", 5, 4)),
    ("AVIF", "RGB", _heif(b"avif", False)),
    ("HEIF", "RGBA", _heif(b"heic", True)),
    ("JPEG2000", "RGB", b"\0\0\0\x0cjP  \r\n\x87\n" + _box(b"ftyp", b"jp2 ") + _box(b"jp2h", _box(b"ihdr", struct.pack(">IIHI", _H, _W, 3, 0)))),
    ("JPEG2000", "L", b"\xff\x4f\xff\x51" + struct.pack(">HHIIIIIIIIH", 47, 0, _W, _H, 0, 0, 9, 9, 0, 0, 1)),
    ("ICO", "RGBA", struct.pack("<HHHIIII", 0, 1, 2, 0x0101, 0x200001, 0, 38) + bytes([0xA1, 0xA2]) + struct.pack("<HIII", 0, 0x200001, 0, 38)),
    (None, None, _tiff(b"II", 2, 3)[:40]),
    (None, None, b"<html><body>not an image</body></html>"),
]


def _hex(template: bytes) -> str:
    """SQL for the template's hexadecimal digits with the sides ``w`` and ``h`` of a row put in, in the order of its bytes."""
    text = "'" + template.hex().upper() + "'"
    for value, side in ((_W, "w"), (_H, "h")):
        digits = f"lpad(hex({side}), 4, '0')"
        text = text.replace(f"{value & 255:02X}{value >> 8:02X}", f"' || substr({digits}, 3, 2) || substr({digits}, 1, 2) || '")
        text = text.replace(f"{value:04X}", f"' || {digits} || '")
    text = text.replace("A1A2", "' || lpad(hex(w), 2, '0') || lpad(hex(h), 2, '0') || '")
    return text.replace(b"MANY".hex().upper(), "' || repeat('FFE1000400AA', n) || '")


def _images(spark: SparkSession, d: str) -> DataFrame:
    """``p_partkey, content``: an image per part, of all formats in turn; a JPEG has as many segments in front as its part's size."""
    parts = read_table(spark, f"{d}/part.parquet", columns=["p_partkey", "p_size"])
    sized = parts.selectExpr("p_partkey", "CAST(p_partkey % 16 AS INT) AS kind", "CAST(p_size * 2 AS BIGINT) AS w", "p_partkey % 97 + 3 AS h", "CAST(p_size AS INT) AS n")
    chosen = " ".join(f"WHEN {i} THEN {_hex(t)}" for i, (_, _, t) in enumerate(_TEMPLATES))
    return sized.selectExpr("p_partkey", f"unhex(CASE kind {chosen} END) AS content")


def image_headers(spark: SparkSession, d: str) -> DataFrame:
    headers = _images(spark, d).select("p_partkey", probe("content").alias("header"))
    return headers.select(
        "p_partkey",
        F.col("header.format").alias("format"),
        F.col("header.width").cast("bigint").alias("width"),
        F.col("header.height").cast("bigint").alias("height"),
        F.col("header.mode").alias("mode"),
        needs_rgb(F.col("header")).alias("needs_rgb"),
        reject_reason(F.col("header")).alias("reject_reason"),
    )


QUERIES = {"image_headers": image_headers}

_FORMATS = ", ".join("NULL" if f is None else f"'{f}'" for f, _, _ in _TEMPLATES)
_MODES = ", ".join("NULL" if m is None else f"'{m}'" for _, m, _ in _TEMPLATES)

ORACLES = {
    "image_headers": f"""WITH kinds AS (
          SELECT p_partkey, [{_FORMATS}][p_partkey % 16 + 1] AS format, [{_MODES}][p_partkey % 16 + 1] AS mode,
                 (p_size * 2)::BIGINT AS w, p_partkey % 97 + 3 AS h
          FROM part
        )
        SELECT p_partkey, format, CASE WHEN format IS NOT NULL THEN w END AS width, CASE WHEN format IS NOT NULL THEN h END AS height,
               mode, mode <> 'RGB' AS needs_rgb,
               CASE WHEN format IS NULL THEN 'corrupted' WHEN w < 50 OR h < 50 THEN 'small_or_mode' END AS reject_reason
        FROM kinds""",
}
