"""Image headers read by SQL expressions: numbers at byte positions, directories, and walks along chained parts.

A walk (JPEG markers, boxes of the ISO and JPEG 2000 families) is a fold whose state is a position in the bytes. It takes a
few steps for nearly every image; only a walk that has not ended goes on, at most as often as the image has bytes.

Expressions are written as text, in which ``b`` names the bytes and ``n`` their number; a large tree is parsed far faster
than it is put together. Positions count from zero. Whoever reads a number has made sure that the bytes are there.
"""

from __future__ import annotations

# Mode of a PNG by (colour type, bit depth), of a JPEG and JPEG 2000 by component count, of a BMP by bits.
PNG_MODES = {
    (0, 1): "1", (0, 2): "L", (0, 4): "L", (0, 8): "L", (0, 16): "I;16",
    (2, 8): "RGB", (2, 16): "RGB",
    (3, 1): "P", (3, 2): "P", (3, 4): "P", (3, 8): "P",
    (4, 8): "LA", (4, 16): "RGBA",
    (6, 8): "RGBA", (6, 16): "RGBA",
}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
JPEG2000_MODES = {1: "L", 2: "LA", 3: "RGB", 4: "RGBA"}
BMP_MODES = {1: "1", 4: "P", 8: "P", 16: "RGB", 24: "RGB", 32: "RGB"}
# Brands of still images, and the marker of an alpha plane, in the ISO box family.
AVIF_BRANDS = ["avif", "avis"]
HEIF_BRANDS = ["heic", "heix", "heim", "heis", "hevc", "hevx", "mif1", "msf1"]

#: Steps of a walk's first two parts; the third has as many as the image has bytes.
STEPS = (32, 1024)
PNG_START = b"\x89PNG\r\n\x1a\n".hex().upper()
LARGEST_SIDE = (1 << 31) - 1


def let(name: str, value: str, use: str) -> str:
    """``use`` with ``name`` for ``value``, which is computed once."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def cut(at: str | int, size: int) -> str:
    """``size`` bytes in hexadecimal digits."""
    return f"hex(substring(b, try_cast({at} + 1 AS INT), {size}))"


def big(at: str | int, size: int) -> str:
    return f"CAST(conv({cut(at, size)}, 16, 10) AS BIGINT)"


def little(at: str | int, size: int) -> str:
    turned = "".join(f"${size - i}" for i in range(size))
    return f"CAST(conv(regexp_replace({cut(at, size)}, '{'(..)' * size}', '{turned}'), 16, 10) AS BIGINT)"


def tag(at: str | int, *texts: str | bytes) -> str:
    """Whether one of the equally long ``texts`` stands there."""
    known = [(t.encode() if isinstance(t, str) else t).hex().upper() for t in texts]
    return f"coalesce({cut(at, len(known[0]) // 2)} IN ({', '.join(repr(k) for k in known)}), false)"


def cases(*pairs: tuple[str, str], otherwise: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in pairs) + f" ELSE {otherwise} END"


def named(known: dict, key: str) -> str:
    """The mode of ``key``, NULL if it is not known."""
    return f"CASE {key} " + " ".join(f"WHEN {k!r} THEN '{mode}'" for k, mode in known.items()) + " END"


def shown(name: str, width: str, height: str, mode: str) -> str:
    """Format, sides and mode as found."""
    return f"named_struct('format', '{name}', 'width', CAST({width} AS BIGINT), 'height', CAST({height} AS BIGINT), 'mode', {mode})"


def walk(start: str, step: str) -> str:
    """Steps of a state ``s`` with the fields ``at`` and ``stop`` until it stops."""

    def go(state: str, steps: str) -> str:
        return f"aggregate({steps}, {state}, (s, i) -> IF(s.stop, s, {step}))"

    state = go(start, f"sequence(1, {STEPS[0]})")
    for more in (str(STEPS[1]), "greatest(n, 1)"):
        state = let("w", state, go("w", f"IF(w.stop, CAST(array() AS ARRAY<INT>), sequence(1, {more}))"))
    return state


def png_mode(at: str | int) -> str:
    known = {f"{colour:02X}{depth:02X}": mode for (colour, depth), mode in PNG_MODES.items()}
    return named(known, f"concat({cut(f'{at} + 25', 1)}, {cut(f'{at} + 24', 1)})")


PNG = cases((f"n >= 26 AND {tag(12, 'IHDR')}", shown("PNG", big(16, 4), big(20, 4), png_mode(0))))

GIF = cases(("n >= 10", shown("GIF", little(6, 2), little(8, 2), "'P'")))

# The old header of 12 bytes has short sides; the others may have a negative height, for rows from the top.
BMP = cases(
    (f"n >= 26 AND {little(14, 4)} = 12", shown("BMP", little(18, 2), little(20, 2), named(BMP_MODES, little(24, 2)))),
    ("n >= 30", shown("BMP", little(18, 4), let("y", little(22, 4), f"IF(y > {LARGEST_SIDE}, {1 << 32} - y, y)"), named(BMP_MODES, little(28, 2)))),
)

_VP8L = shown("WEBP", "(p & 16383) + 1", "(shiftright(p, 14) & 16383) + 1", f"IF((p & {1 << 28}) > 0, 'RGBA', 'RGB')")
WEBP = cases(
    (f"n >= 30 AND {tag(12, 'VP8 ')}", shown("WEBP", f"{little(26, 2)} & 16383", f"{little(28, 2)} & 16383", "'RGB'")),
    (f"n >= 25 AND {tag(12, 'VP8L')}", let("p", little(21, 4), _VP8L)),
    (f"n >= 30 AND {tag(12, 'VP8X')}", shown("WEBP", f"{little(24, 3)} + 1", f"{little(27, 3)} + 1", f"IF(({big(20, 1)} & 16) > 0, 'RGBA', 'RGB')")),
)


def _marker(at: str, stop: str = "false", found: tuple[str, str, str] = ("NULL",) * 3) -> str:
    sides = ", ".join(f"'{name}', CAST({c} AS BIGINT)" for name, c in zip(("width", "height", "parts"), found))
    return f"named_struct('at', CAST({at} AS BIGINT), 'stop', {stop}, {sides})"


# Markers from the second byte on, up to the first frame header: fill bytes, markers without a body, frames, the image.
_JPEG_STEP = f"IF(s.at + 4 > n OR NOT {tag('s.at', bytes([255]))}, {_marker('s.at', 'true')}, " + let(
    "m",
    f"named_struct('kind', {big('s.at + 1', 1)}, 'size', {big('s.at + 2', 2)})",
    cases(
        ("m.kind = 255", _marker("s.at + 1")),
        ("m.kind = 1 OR m.kind BETWEEN 208 AND 216", _marker("s.at + 2")),
        (
            "m.kind BETWEEN 192 AND 207 AND m.kind NOT IN (196, 200, 204)",
            f"IF(s.at + 10 > n, {_marker('s.at', 'true')}, {_marker('s.at', 'true', (big('s.at + 7', 2), big('s.at + 5', 2), big('s.at + 9', 1)))})",
        ),
        ("m.kind = 218 OR m.size < 2", _marker("s.at", "true")),
        otherwise=_marker("s.at + 2 + m.size"),
    ),
) + ")"
JPEG = let("j", walk(_marker("2"), _JPEG_STEP), shown("JPEG", "j.width", "j.height", named(JPEG_MODES, "j.parts")))


def _tiff(number) -> str:
    """The first directory; a field's first value stands in its entry, or where the entry points to."""
    size = "CASE k WHEN 1 THEN 1 WHEN 3 THEN 2 ELSE 4 END"
    place = let("k", number("e + 2", 2), f"IF({number('e + 4', 4)} * {size} > 4, {number('e + 8', 4)}, e + 8)")
    value = let("q", place, f"IF(q + 4 <= n, CASE {number('e + 2', 2)} WHEN 1 THEN {big('q', 1)} WHEN 3 THEN {number('q', 2)} ELSE {number('q', 4)} END, NULL)")
    entries = f"transform(sequence(0L, c - 1), x -> {let('e', 'd + 2 + 12 * x', f"named_struct('tag', {number('e', 2)}, 'value', {value})")})"
    field = lambda t, default="NULL": f"coalesce(get(filter(f, x -> x.tag = {t}), 0).value, {default})"
    fields = {"width": field(256), "height": field(257), "bits": field(258, "1L"), "compression": field(259, "1L"), "light": field(262, "0L"),
              "samples": field(277, "1L"), "extra": field(338, "2L"), "kind": field(339, "1L")}
    mode = cases(
        ("t.light IN (0, 1) AND t.samples = 2 AND t.bits = 8", "'LA'"),
        ("t.light IN (0, 1) AND t.bits = 1", "'1'"),
        ("t.light IN (0, 1) AND t.bits <= 8", "'L'"),
        ("t.light IN (0, 1) AND t.bits <= 16", "'I;16'"),
        ("t.light IN (0, 1) AND t.bits = 32", "IF(t.kind = 3, 'F', 'I')"),
        ("t.light = 2 AND t.samples = 3", "'RGB'"),
        ("t.light = 2 AND t.samples >= 4", "IF(t.extra = 0, 'RGB', 'RGBA')"),
        ("t.light = 3 AND t.bits <= 8", "'P'"),
        ("t.light = 5 AND t.samples >= 4", "'CMYK'"),
        ("t.light = 6", "IF(t.compression = 7, 'RGB', 'YCbCr')"),
        ("t.light = 8", "'LAB'"),
    )
    held = "named_struct(" + ", ".join(f"'{name}', {c}" for name, c in fields.items()) + ")"
    read = let("f", entries, let("t", held, shown("TIFF", "t.width", "t.height", mode)))
    whole = let("c", number("d", 2), f"IF(c > 0 AND d + 2 + 12 * c <= n, {read}, NULL)")
    return let("d", number(4, 4), f"IF(d + 2 <= n, {whole}, NULL)")


def _box(at: str, stop: str, width: str = "s.width", height: str = "s.height", parts: str = "s.parts", alpha: str = "s.alpha") -> str:
    numbers = {"at": at, "width": width, "height": height, "parts": parts}
    held = ", ".join(f"'{name}', CAST({c} AS BIGINT)" for name, c in numbers.items())
    return f"named_struct({held}, 'stop', {stop}, 'alpha', {alpha})"


# Nested boxes as one chain: those that hold the wanted ones are entered, others are passed over, and what follows a box
# stands behind its last child. Of several images the largest counts, since thumbnails and tiles are smaller.
_LONG = f"IF({big('s.at + 8', 4)} > 0, n + 1, {big('s.at + 12', 4)})"
_BOX_STEP = f"IF(s.at + 8 > n, {_box('s.at', 'true')}, " + let(
    "x",
    let("z", big("s.at", 4), f"named_struct('kind', {cut('s.at + 4', 4)}, 'body', s.at + IF(z = 1, 16, 8), 'end', s.at + CASE z WHEN 0 THEN n - s.at WHEN 1 THEN {_LONG} ELSE z END)"),
    cases(
        ("x.end IS NULL OR x.end < x.body", _box("s.at", "true")),
        (f"x.kind = '{b'meta'.hex().upper()}'", _box("x.body + 4", "false")),
        (f"x.kind IN ({', '.join(repr(k.hex().upper()) for k in (b'iprp', b'ipco', b'jp2h'))})", _box("x.body", "false")),
        (
            f"x.kind = '{b'ispe'.hex().upper()}' AND x.body + 12 <= n",
            let(
                "y",
                f"named_struct('w', {big('x.body + 4', 4)}, 'h', {big('x.body + 8', 4)})",
                f"IF(s.width IS NULL OR CAST(y.w AS DOUBLE) * y.h > CAST(s.width AS DOUBLE) * s.height, {_box('x.end', 'false', 'y.w', 'y.h')}, {_box('x.end', 'false')})",
            ),
        ),
        (f"x.kind = '{b'ihdr'.hex().upper()}' AND x.body + 10 <= n", _box("x.end", "false", big("x.body + 4", 4), big("x.body", 4), big("x.body + 8", 2))),
        (f"x.kind = '{b'auxC'.hex().upper()}'", _box("x.end", "false", alpha=f"s.alpha OR instr({cut('x.body + 4', 64)}, '{b'alpha'.hex().upper()}') > 0")),
        otherwise=_box("x.end", "false"),
    ),
) + ")"
_BOXES = walk(_box("0", "false", "NULL", "NULL", "NULL", "false"), _BOX_STEP)


def heif(name: str) -> str:
    return let("h", _BOXES, shown(name, "h.width", "h.height", "IF(h.alpha, 'RGBA', 'RGB')"))


JPEG2000 = let("h", _BOXES, shown("JPEG2000", "h.width", "h.height", named(JPEG2000_MODES, "h.parts")))
# A bare JPEG 2000 stream: the reference grid less its offset.
STREAM = cases(("n >= 42", shown("JPEG2000", f"{big(8, 4)} - {big(16, 4)}", f"{big(12, 4)} - {big(20, 4)}", named(JPEG2000_MODES, big(40, 2)))))

# The largest picture of the directory, the deeper of equally large ones: a PNG, or a bitmap with a mask. A side of 0 is 256.
_SIDES = f"named_struct('w', coalesce(nullif({big('e', 1)}, 0), 256), 'h', coalesce(nullif({big('e + 1', 1)}, 0), 256), 'bits', {little('e + 6', 2)}, 'place', {little('e + 12', 4)})"
_ENTRY = let("e", "6 + 16 * x", let("v", _SIDES, "named_struct('area', v.w * v.h, 'bits', v.bits, 'place', v.place, 'w', v.w, 'h', v.h)"))
_INNER = cases(
    (f"v.place + 26 <= n AND {cut('v.place', 8)} = '{PNG_START}'", shown("ICO", big("v.place + 16", 4), big("v.place + 20", 4), png_mode("v.place"))),
    otherwise=shown("ICO", "v.w", "v.h", "'RGBA'"),
)
ICO = let("c", little(4, 2), f"IF(c > 0 AND 6 + 16 * c <= n, {let('v', f'array_max(transform(sequence(0L, c - 1), x -> {_ENTRY}))', _INNER)}, NULL)")


def header_sql(content: str) -> str:
    """``struct<format,width,height,mode,ok>`` of the binary column (or SQL expression) ``content``."""
    found = cases(
        (f"{cut(0, 8)} = '{PNG_START}'", PNG),
        (tag(0, b"\xff\xd8"), JPEG),
        (tag(0, "GIF87a", "GIF89a"), GIF),
        (tag(0, "BM"), BMP),
        (f"{tag(0, 'RIFF')} AND {tag(8, 'WEBP')}", WEBP),
        (tag(0, b"II*\0"), _tiff(little)),
        (tag(0, b"MM\0*"), _tiff(big)),
        (f"{tag(4, 'ftyp')} AND {tag(8, *AVIF_BRANDS)}", heif("AVIF")),
        (f"{tag(4, 'ftyp')} AND {tag(8, *HEIF_BRANDS)}", heif("HEIF")),
        (tag(0, b"\0\0\0\x0cjP  \r\n\x87\n"), JPEG2000),
        (tag(0, b"\xff\x4f\xff\x51"), STREAM),
        (tag(0, b"\0\0\1\0"), ICO),
    )
    ok = f"coalesce(h.mode IS NOT NULL AND h.width BETWEEN 1 AND {LARGEST_SIDE} AND h.height BETWEEN 1 AND {LARGEST_SIDE}, false)"
    parts = [f"'{c}', IF(ok, {v}, NULL)" for c, v in (("format", "h.format"), ("width", "CAST(h.width AS INT)"), ("height", "CAST(h.height AS INT)"), ("mode", "h.mode"))]
    judged = let("h", found, let("ok", ok, f"named_struct({', '.join(parts)}, 'ok', ok)"))
    return let("b", content, let("n", "octet_length(b)", judged))
