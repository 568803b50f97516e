"""Image header probe, quality gate and file extensions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from captrellis.functions.headers import PNG_MODES, header_sql

# Colour modes the gate accepts and its smallest side in pixels.
ACCEPTED_MODES = ["RGB", "RGBA", "YCbCr", "P", "L", "CMYK", "LA", "1"]
MIN_SIDE = 50

# File extensions of registered MIME types that image servers send.
EXTENSIONS = {
    "image/avif": ".avif",
    "image/bmp": ".bmp",
    "image/gif": ".gif",
    "image/heic": ".heic",
    "image/heif": ".heif",
    "image/jp2": ".jp2",
    "image/jpeg": ".jpg",
    "image/png": ".png",
    "image/svg+xml": ".svg",
    "image/tiff": ".tiff",
    "image/vnd.microsoft.icon": ".ico",
    "image/webp": ".webp",
    "application/json": ".json",
    "application/octet-stream": ".bin",
    "application/pdf": ".pdf",
    "text/html": ".html",
    "text/plain": ".txt",
    "text/xml": ".xml",
}


def probe(content: str) -> Column:
    """Header of a binary column as ``struct<format,width,height,mode,ok>``, read by SQL expressions.

    PNG, JPEG, GIF, BMP, WebP, TIFF, AVIF, HEIF, JPEG 2000 and ICO are known. Only the header counts: a truncated body
    still passes, as with a lazy open. NULL, empty and other content is not ``ok``.
    """
    return F.expr(header_sql(content))


def probe_png(content: Column | str) -> Column:
    """The same struct for PNG only, from the fixed places of its first 26 bytes: checks :func:`probe`."""
    c = F.col(content) if isinstance(content, str) else content

    def number(start: int, length: int) -> Column:
        return F.conv(F.hex(F.substring(c, start, length)), 16, 10).cast("bigint")

    known = F.create_map(*[F.lit(x) for (k, d), m in PNG_MODES.items() for x in (f"{k}/{d}", m)])
    mode = F.try_element_at(known, F.concat_ws("/", number(26, 1).cast("string"), number(25, 1).cast("string")))
    signed = F.hex(F.substring(c, 1, 8)) == "89504E470D0A1A0A"
    headed = F.hex(F.substring(c, 13, 4)) == "49484452"
    ok = F.coalesce(
        signed & headed & (F.octet_length(c) >= 26) & mode.isNotNull() & (number(17, 4) > 0) & (number(21, 4) > 0),
        F.lit(False),
    )
    return F.struct(
        F.when(ok, F.lit("PNG")).alias("format"),
        F.when(ok, number(17, 4).cast("int")).alias("width"),
        F.when(ok, number(21, 4).cast("int")).alias("height"),
        F.when(ok, mode).alias("mode"),
        ok.alias("ok"),
    )


def reject_reason(header: Column, max_pixels: int | None = None) -> Column:
    """NULL for a good image, else ``corrupted``, ``small_or_mode`` or ``high_res``.

    Exactly ``MIN_SIDE`` pixels pass. ``max_pixels`` is off by default.
    """
    reason = F.when(~F.coalesce(header["ok"], F.lit(False)), F.lit("corrupted")).when(
        (header["width"] < MIN_SIDE) | (header["height"] < MIN_SIDE) | ~header["mode"].isin(*ACCEPTED_MODES),
        F.lit("small_or_mode"),
    )
    if max_pixels is not None:
        if max_pixels < 1:
            raise ValueError("max_pixels must be positive")
        reason = reason.when(
            header["width"].cast("bigint") * header["height"] > max_pixels, F.lit("high_res")
        )
    return reason


def needs_rgb(header: Column) -> Column:
    """Whether the image would have to be converted to RGB."""
    return header["mode"] != "RGB"


def extension_for(content_type: Column | str, unknown: str = ".bin", missing: str = ".jpg") -> Column:
    """File extension of a content type; parameters after ``;`` are ignored."""
    c = F.col(content_type) if isinstance(content_type, str) else content_type
    known = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    bare = F.lower(F.trim(F.split_part(c, F.lit(";"), F.lit(1))))
    return F.when(c.isNull() | (c == ""), F.lit(missing)).otherwise(
        F.coalesce(F.try_element_at(known, bare), F.lit(unknown))
    )


def extension_from_header(header: Column, fallback: str = "jpg") -> Column:
    """Decoded format of an image as its extension."""
    return F.coalesce(header["format"], F.lit(fallback))
