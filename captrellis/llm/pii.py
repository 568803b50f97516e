"""Personal data by patterns and a character tagger.

Patterns find the regular forms. A bidirectional LSTM with CRF transitions, trained on labelled spans of the
corpus itself and on rewritten forms of them, finds irregular ones: numbers without the leading plus, cards
grouped by dots, addresses with blanks around the at sign; and, as a kind of its own, secrets such as access keys
and digests, of which made-up ones are set between the words of the corpus. It reads every text in overlapping
windows; each character takes the tag of the window in which it is most central, and spans are read off the joined
tags, so no window border splits one; a secret is widened to the whole run of its characters. A tagged span counts
if it has the make-up of its kind (digits, check digit, or mixed letters and digits) and does not overlap a pattern's span.

Every span of these kinds holds a digit or an at sign; a window with neither is decoded as empty without a pass.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from captrellis.llm.common import bounded_batches, share_of, slices
from captrellis.llm.tagger import Tagger, encode_chars

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "secret"]
#: Patterns of the base kinds.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A run of digits is entered at its start only: entering it later cannot succeed where that failed.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
#: Characters of a secret, and the fewest of them.
SECRET = re.compile(r"[A-Za-z0-9_+/=-]+")
SECRET_LEAST = 20
#: What may stand on both sides of a long run of characters.
AROUND = [("", ""), ("", "."), ("", ","), ('"', '"'), ("'", "'"), ("(", ")"), (": ", ""), ("= ", ";"), ('= "', '"'), (': "', '",'), ("`", "`")]

WINDOW, STRIDE = 96, 48
#: Documents that labelled spans are taken from, parts of each, secrets set into a part, windows kept, and training steps.
SAMPLE_DOCS = 4_000
SAMPLE_PARTS = 8
SECRETS_PER_PART = 4
SAMPLE_WINDOWS = 3_000
STEPS = 200

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """Spans of the patterns, ``(start, end, kind)``, leftmost and non-overlapping within a kind."""
    out: list[Span] = []
    limit, at = 0, text.find("@")
    while at >= 0:  # the longest local part before each at sign that no earlier address has used
        start = at
        while start > limit and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            limit = m.end()
        else:
            limit = at + 1
        at = text.find("@", limit)
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in CARD.finditer(text):
        if 14 <= len(_digits(m.group())) <= 19 and luhn(_digits(m.group())):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=_order)


def _order(span: Span) -> tuple[int, int, int]:
    return span[0], KINDS.index(span[2]), span[1]


def plausible(text: str, kind: str) -> bool:
    """Whether a tagged span has the make-up of its kind."""
    digits = _digits(text)
    if kind == "email":
        name, _, host = text.partition("@")
        return bool(name.strip()) and "." in host.strip(" .") and "@" not in host and len(text) <= 100
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts) and len(text) <= 24
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits) and len(text) <= 40
    if kind == "secret":  # letters and digits that take turns, unlike words, dates, numbers and titles in addresses
        letters = len(re.findall("[A-Za-z]", text))
        turns = len(re.findall("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])", text))
        return len(text) >= SECRET_LEAST and min(len(digits), letters) >= 3 and turns >= 4
    return 10 <= len(digits) <= 15 and len(digits) < len(text) <= 30 and not re.search("[A-Za-z]", text)


def _text_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def tagged_spans(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """Spans that the tagger finds in each text."""
    out: list[list[Span]] = [[] for _ in texts]
    rows, starts, points = [], [], {}
    for i, text in enumerate(texts):
        hits = np.fromiter((m.start() for m in TRIGGER.finditer(text)), np.int64)
        if len(hits):
            last = hits // STRIDE  # the windows k with k * STRIDE <= hit < k * STRIDE + WINDOW
            k = np.unique(np.concatenate([last, last - 1]))
            k = k[k >= 0]
            points[i] = encode_chars(_text_points(text))
            rows += [i] * len(k)
            starts += (k * STRIDE).tolist()
    for a in range(0, len(rows), 2048):  # windows of several texts share a pass
        part = range(a, min(a + 2048, len(rows)))
        x = np.zeros((len(part), WINDOW), np.int64)
        for j, p in enumerate(part):
            piece = points[rows[p]][starts[p] : starts[p] + WINDOW]
            x[j, : len(piece)] = piece
        for p, tags in zip(part, tagger.decode(x)):
            if tags.any():
                points.setdefault(("tags", rows[p]), []).append((starts[p], tags))
    for i, text in enumerate(texts):
        if ("tags", i) in points:
            found = _whole_secrets(text, _reconcile(points[("tags", i)], len(text)))
            out[i] = [s for s in found if plausible(text[s[0] : s[1]], s[2])]
    return out


def _whole_secrets(text: str, spans: list[Span]) -> list[Span]:
    """``spans`` with each secret widened to the run of its characters, once."""
    out, end = [], -1
    for span in spans:
        if span[2] != "secret":
            out.append(span)
        elif span[0] >= end:
            start = span[0]
            while start > max(end, 0) and SECRET.fullmatch(text, start - 1, start):
                start -= 1
            run = SECRET.match(text, span[0])
            end = max(span[1], run.end() if run else 0)
            out.append((start, end, "secret"))
    return out


def _reconcile(found: list[tuple[int, np.ndarray]], length: int) -> list[Span]:
    """Spans of the tags that each character has in the window where it is most central."""
    best: dict[int, tuple[float, int]] = {}
    for start, tags in found:
        for j in np.flatnonzero(tags).tolist():
            place = start + j
            # The text's first and last stride have one window only; elsewhere the middle half of a window rules.
            central = abs(j + 0.5 - WINDOW / 2)
            if place < length and (central <= STRIDE / 2 or place < STRIDE / 2 or central < best.get(place, (1e9, 0))[0]):
                best[place] = (central, int(tags[j]))
    spans, previous = [], (-2, 0)
    for place in sorted(best):
        tag = best[place][1]
        kind = (tag - 1) // 2
        if spans and place == previous[0] + 1 and tag % 2 == 0 and kind == previous[1]:
            spans[-1][1] = place + 1
        else:
            spans.append([place, place + 1, KINDS[kind]])
        previous = (place, kind)
    return [tuple(s) for s in spans]


def all_spans(texts: list[str], tagger: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """For each text its base spans, and all spans, sorted by start and kind."""
    base = [base_spans(t) if TRIGGER.search(t) else [] for t in texts]
    added = tagged_spans(texts, tagger) if tagger else [[] for _ in texts]
    out = []
    for own, more in zip(base, added):
        more = [s for s in more if not any(s[0] < b[1] and b[0] < s[1] for b in own)] if own else more
        out.append((own, sorted(own + more, key=_order)))
    return out


def rewrite(text: str, kind: str, turn: int) -> str:
    """An irregular form of a labelled span."""
    digits = _digits(text)
    if kind == "email":
        return text.replace("@", [" @ ", "@ ", " @"][turn % 3])
    if kind == "ip":
        return text.replace(".", [" . ", ". ", "-", ","][turn % 4])
    if kind == "card":
        return [".", " - ", "/"][turn % 3].join(digits[i : i + 4] for i in range(0, len(digits), 4))
    tail = digits[-10:]
    return [f"({tail[:3]}) {tail[3:6]}-{tail[6:]}", f"{tail[:3]}-{tail[3:6]}-{tail[6:]}", f"{tail[:3]}.{tail[3:6]}.{tail[6:]}", f"00{digits[:1]} {tail[:3]} {tail[3:6]} {tail[6:]}"][turn % 4]


def made_up_secret(rng: np.random.Generator) -> str:
    """A key or digest: hexadecimal, or letters and digits, some behind a prefix, some in groups."""
    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    signs = [hexa, hexa, mixed, mixed, mixed[:26] + mixed[52:]][int(rng.integers(5))]
    size = int(rng.choice([24, 32, 40, 40, 48, 64]))
    body = "".join(signs[i] for i in rng.integers(0, len(signs), size).tolist())
    return ["", "", "", "sk_live_", "key-", "token_"][int(rng.integers(6))] + body


def made_up_plain(rng: np.random.Generator) -> str:
    """A long run of characters that is no secret: joined words, a dated title, a number, a path."""
    word = lambda: "".join(chr(97 + i) for i in rng.integers(0, 26, int(rng.integers(3, 9))).tolist())
    year = str(rng.integers(1900, 2100))
    parts = [word() for _ in range(int(rng.integers(3, 6)))]
    number = "".join(map(str, rng.integers(0, 10, 13).tolist()))
    return ["-".join([*parts, year]), "_".join([year, *parts]), number, "/".join([year, f"{rng.integers(1, 13):02d}", *parts]), "".join(parts)][int(rng.integers(5))]


def labelled_windows(texts: list[str], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Training windows and tags: around labelled spans, rewritten ones, made-up secrets, other long runs and other digits."""
    x, y = [], []
    rng = np.random.default_rng(7)

    def add(text: str, span: Span | None, middle: int) -> None:
        start = max(0, middle - int(rng.integers(20, WINDOW - 20)))
        piece = text[start : start + WINDOW]
        for m in SECRET.finditer(text):  # a run that nobody has labelled may be a secret: it must not teach the opposite
            own = span is not None and m.start() < span[1] and span[0] < m.end()
            if not own and m.end() > start and m.start() < start + WINDOW and plausible(m.group(), "secret"):
                return
        tags = np.zeros(WINDOW, np.int64)
        if span:
            a, b, k = max(0, span[0] - start), min(len(piece), span[1] - start), 1 + 2 * KINDS.index(span[2])
            if span[2] != "secret" and (span[0] < start or span[1] > start + len(piece)):
                return  # only secrets, which are widened later, may show a part
            if a >= b:
                return
            tags[a] = k
            tags[a + 1 : b] = k + 1
        own = np.zeros(WINDOW, np.int64)
        own[: len(piece)] = encode_chars(_text_points(piece))
        x.append(own)
        y.append(tags)

    for text in texts:
        if len(x) >= limit:
            break
        found = base_spans(text)
        taken = np.zeros(len(text) + 1, bool)
        for a, b, _ in found:
            taken[a:b] = True
        for a, b, kind in found:
            if taken[max(0, a - WINDOW) : a].any() or taken[b : b + WINDOW].any():
                continue  # windows show one span each
            add(text, (a, b, kind), a)
            for turn in rng.integers(0, 12, 2).tolist():
                other = rewrite(text[a:b], kind, turn)
                add(text[:a] + other + text[b:], (a, a + len(other), kind), a)
            date = f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}"
            plain = str(rng.integers(0, 10 ** int(rng.integers(1, 9))))
            other = [date, plain, f"{rng.integers(0, 99)}.{rng.integers(0, 99)}", "v1.2.3", f"${plain}", "%x" % int(rng.integers(1 << 62))][int(rng.integers(6))]
            add(text[:a] + other + text[b:], None, a)
        gaps = [m.end() for m in re.finditer(r"\s", text) if not taken[max(0, m.end() - WINDOW) : m.end() + WINDOW].any()]
        for at in rng.choice(gaps, SECRETS_PER_PART).tolist() if gaps else []:
            for run, kind in ((made_up_secret(rng), "secret"), (made_up_plain(rng), None)):
                left, right = AROUND[int(rng.integers(len(AROUND)))]  # the same surroundings for both
                first = at + len(left)
                add(f"{text[:at]}{left}{run}{right} {text[at:]}", kind and (first, first + len(run), kind), first)
        others = [m.start() for m in TRIGGER.finditer(text) if not taken[max(0, m.start() - WINDOW) : m.start() + WINDOW].any()]
        for at in others[:: max(1, len(others) // 2)][:2]:
            add(text, None, at)
    if not x:
        return np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int64)
    return np.stack(x), np.stack(y)


def fit_pii(docs: DataFrame, key: str = "doc_id", text: str = "text", docs_bound: int = SAMPLE_DOCS, windows: int = SAMPLE_WINDOWS) -> Tagger | None:
    """A tagger trained on about ``windows`` windows of at most about ``docs_bound`` documents; None without spans.

    The documents are chosen by a hash of their keys, and so are :data:`SAMPLE_PARTS` parts of each and the windows.
    Tasks cut the parts around digits and at signs; the driver gets those. Repeated rows teach like other rows.
    """
    bounded_batches(docs.sparkSession)
    chosen = docs.where(share_of(docs.select(key), key, docs_bound)).select(key, text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                out_key, out = [], []
                for k, t in zip(part.column(key), part.column(text).to_pylist()):
                    if t and TRIGGER.search(t):
                        hits = [m.start() for m in TRIGGER.finditer(t)]
                        cuts, at = [], None
                        for h in hits:  # parts with triggers, each with its surroundings
                            if at is None or h > at:
                                cuts.append(t[max(0, h - 2 * WINDOW) : h + 3 * WINDOW])
                                at = h + 2 * WINDOW
                        cuts = sorted(cuts, key=lambda c: xxhash.xxh3_64_intdigest(c))[:SAMPLE_PARTS]
                        out_key += [k.as_py()] * len(cuts)
                        out += cuts
                yield pa.RecordBatch.from_arrays([pa.array(out_key, pa.int64()), pa.array(out, pa.string())], ["id", "part"])

    parts = chosen.mapInArrow(apply, "id long, part string").collect()
    parts = sorted((xxhash.xxh3_64_intdigest(f"{r.id}:{r.part}"), r.part) for r in parts)
    x, y = labelled_windows([p for _, p in parts], windows)
    if not y.any():
        return None
    tagger = Tagger(len(KINDS))
    tagger.train(x, y, STEPS)
    return tagger


def _spans_column(docs: DataFrame, tagger: Tagger | None, text: str, fields: str, make) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                texts = part.column(text).to_pylist()
                yield make(part, texts, all_spans([t or "" for t in texts], tagger))

    return docs.mapInArrow(apply, fields)


def find_pii(docs: DataFrame, tagger: Tagger | None, text: str = "text") -> DataFrame:
    """``docs`` plus ``base`` and ``spans``: arrays of ``start, end, kind`` in code points, end exclusive.

    ``base`` has the patterns' spans, ``spans`` those and the tagger's, by start and kind. Null and empty texts
    have none. All rows and columns stay.
    """
    if {"base", "spans"} & set(docs.columns):
        raise ValueError("columns base or spans exist already")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def make(part: pa.RecordBatch, texts: list, found: list) -> pa.RecordBatch:
        both = [pa.array([[dict(zip(("start", "end", "kind"), s)) for s in f[i]] for f in found], kind) for i in (0, 1)]
        return pa.RecordBatch.from_arrays([*part.columns, *both], [*part.schema.names, "base", "spans"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    spans = "array<struct<start: bigint, end: bigint, kind: string>>"
    return _spans_column(docs, tagger, text, f"{fields}, base {spans}, spans {spans}", make)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span, or group of overlapping spans, replaced by the name of its first kind."""
    if not spans:
        return text
    out, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"<{kind}>"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_pii(docs: DataFrame, tagger: Tagger | None, text: str = "text") -> DataFrame:
    """``docs`` with personal data replaced in ``text``; null texts stay null, all rows and columns stay."""

    def make(part: pa.RecordBatch, texts: list, found: list) -> pa.RecordBatch:
        columns = {c: part.column(c) for c in part.schema.names}
        columns[text] = pa.array([redact(t, f[1]) for t, f in zip(texts, found)], pa.string())
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return _spans_column(docs, tagger, text, fields, make)
