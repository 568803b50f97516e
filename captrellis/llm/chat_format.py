r"""Chat formatting with a grammar round trip.

A turn is rendered as ``### role: text </turn>`` and a line feed. The rendered turn is parsed again by the grammar
below; where the parser does not give back role and text exactly, the turn is rendered with escapes, and parsed
again, until it does.

Grammar: ``turn = "### " part ": " part " </turn>" LF``; a part is any text in which a backslash stands for the
character after it, and which holds neither ``###`` nor ``</turn>`` (nor ``": "`` in a role) unescaped.

Turns are formatted one by one, so a conversation of any length is never held together.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captrellis.llm.common import bounded_batches

OPEN, MIDDLE, CLOSE = "### ", ": ", " </turn>\n"
#: What each level of escaping puts a backslash before; a colon is escaped in roles only.
LEVELS = [None, re.compile(r"[\\#<]")]
ROLE_LEVELS = [None, re.compile(r"[\\#<:]")]
_ROLE_STEP = re.compile(r"\\(.)|(: )|(###|</turn>)|(.)", re.S)
_TEXT_STEP = re.compile(r"\\(.)|( </turn>\n)|(###|</turn>)|([^\\ #<]+|.)", re.S)


def escape(text: str, pattern: re.Pattern | None) -> str:
    return text if pattern is None else pattern.sub(lambda m: "\\" + m.group(), text)


def parse(rendered: str, start: int = 0) -> tuple[str, str, int, int, int] | None:
    """One turn from ``start``: role, text, borders of the text, and the turn's end; None if it does not parse."""
    if not rendered.startswith(OPEN, start):
        return None
    role = _part(rendered, start + len(OPEN), _ROLE_STEP)
    text = role and _part(rendered, role[2], _TEXT_STEP)
    return (role[0], text[0], role[2], text[1], text[2]) if text else None


def _part(rendered: str, at: int, step: re.Pattern) -> tuple[str, int, int] | None:
    """The unescaped part from ``at`` up to its closing string, and where that starts and ends."""
    out = []
    for m in step.finditer(rendered, at):
        if m.lastindex == 2:
            return "".join(out), m.start(), m.end()
        if m.lastindex == 3:
            return None
        out.append(m.group(m.lastindex))
    return None


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn and the borders of its text, at the lowest level of escaping that reads back identically."""
    for role_level, level in ((0, 0), (0, 1), (1, 1)):
        head = OPEN + escape(role, ROLE_LEVELS[role_level]) + MIDDLE
        body = escape(text, LEVELS[level])
        rendered = head + body + CLOSE
        if _plain(role, text) if level == role_level == 0 else parse(rendered) == (role, text, len(head), len(head) + len(body), len(rendered)):
            return rendered, len(head), len(head) + len(body)
    raise ValueError("a turn does not read back")  # escapes of the last level cover the whole grammar


def _plain(role: str, text: str) -> bool:
    """Short cut for the parser on unescaped turns: nothing in them can be taken for the grammar's own strings."""
    both = role + "\0" + text
    return not ("\\" in both or "###" in both or "</turn>" in both or ": " in role or role.endswith(":"))


def format_turns(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per turn: ``conv_id, turn, role, text`` as they were, ``formatted``, ``loss_start``, ``loss_end``.

    The loss span, in code points of ``formatted``, covers the escaped text of ``loss_role`` turns and is null for
    others. Null roles and texts count as empty. Other columns go on unchanged; repeated rows stay.
    """
    clash = {"formatted", "loss_start", "loss_end"} & set(conversations.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} exist already")
    bounded_batches(conversations.sparkSession)
    added = ["formatted", "loss_start", "loss_end"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            out = [render(r or "", t or "") for r, t in zip(roles, texts)]
            spans = [(a, b) if r == loss_role else (None, None) for r, (_, a, b) in zip(roles, out)]
            new = [pa.array([x[0] for x in out], pa.string()), *(pa.array(c, pa.int64()) for c in ([s[0] for s in spans], [s[1] for s in spans]))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *added])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in conversations.schema.fields)
    return conversations.mapInArrow(apply, f"{fields}, formatted string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, parsed from its formatted turns in order.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``. Turns are sorted by key and
    streamed: a task keeps two running digests, however long a conversation is. Equal turns are ordered by their
    formatted text. Rows with a null ``conv_id`` are one conversation.
    """
    bounded_batches(formatted.sparkSession)
    rows = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, done = None, None, []

        def table() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

        def close() -> None:
            if held is not None:
                n, turns, chars, loss, total = held
                done.append((current, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        for batch in batches:
            for conv, piece, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end"))):
                if held is None or conv != current:
                    close()
                    current, held = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text, start, end, stop = parse(piece)
                if stop != len(piece):
                    raise ValueError(f"conversation {conv}: more than one turn in a row")
                held[0] += 1
                held[1].update(f"{role}\n{text}\n".encode())
                held[4] += len(piece)
                if a is not None:
                    masked = re.sub(r"\\(.)", r"\1", piece[a:b], flags=re.S)
                    held[2] += len(masked)
                    held[3].update(masked.encode())
            if len(done) >= 1000:
                yield table()
                done = []
        close()
        if done:
            yield table()

    return rows.mapInArrow(apply, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
