"""Chat formatting with a grammar round trip.

A turn becomes ``### Role:``, its text and ``</turn>``, each on lines of their own. Inside a text,
``###`` and ``</turn>`` are control strings; one that stands there is a conflict, as is one behind
backslashes, which the parser would take for an escaped one. Every rendered turn is parsed again by
a deterministic parser, and while the parse differs from the source, conflicting content gets one
more backslash. A rendered turn ends itself, so a conversation is the concatenation of its turns.

Turns are rendered where they lie, before any shuffle. Reading back streams over rows sorted by
conversation and turn, and keeps one running state, so that a conversation of any length is neither
collected nor held.

Defined cases: null texts and roles are empty; rows with equal turn are ordered by role and text;
rows without conversation id form one conversation; an empty table gives no conversations.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = re.compile(r"(\\*)(###|</turn>)")
# Roles with a header of their own; others are written behind an equals sign.
HEADERS = {"user": "User", "assistant": "Assistant", "system": "System"}
ROLES = {header: role for role, header in HEADERS.items()}
LEARNED = "assistant"
END = "\n</turn>\n"


class Conflict(ValueError):
    """Rendered text that the grammar does not allow."""


def escape(text: str) -> str:
    return CONTROL.sub(r"\\\1\2", text)


def _plain(match: re.Match) -> str:
    if not match[1]:
        raise Conflict(match[2])
    return match[1][1:] + match[2]


def _header(role: str) -> str:
    name = HEADERS.get(role) or "=" + role.replace("\\", "\\\\").replace("\n", "\\n")
    return f"### {name}:\n"


def _role(name: str) -> str:
    if name in ROLES:
        return ROLES[name]
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], name[1:], flags=re.S)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """Turns of rendered text: role, text, and where the rendered content starts and ends."""
    turns, at = [], 0
    while at < len(text):
        line = text.find("\n", at)
        if not text.startswith("### ", at) or line < 0 or text[line - 1] != ":":
            raise Conflict("a turn must start with its header")
        start, end = line + 1, text.find(END, line + 1)
        if end < 0:
            raise Conflict("a turn must end")
        turns.append((_role(text[at + 4:line - 1]), CONTROL.sub(_plain, text[start:end]), start, end))
        at = end + len(END)
    return turns


def render(role: str, text: str) -> tuple[str, int, int]:
    """A rendered turn that parses to the source, and where its content starts and ends."""
    content = text
    while True:
        out = _header(role) + content + END
        try:
            turns = parse(out)
            if len(turns) == 1 and turns[0][:2] == (role, text):
                return out, turns[0][2], turns[0][3]
        except Conflict:
            pass
        content = escape(content)


RENDERED = "struct<segment: string, start: int, end: int, learned: boolean>"
_RENDERED_ARROW = pa.struct([("segment", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("learned", pa.bool_())])


def format_turns(rows: DataFrame, *, role: str = "role", text: str = "text", into: str = "rendered") -> DataFrame:
    """``rows`` with a struct column: the rendered turn, its content span, and whether loss falls on it."""
    @F.arrow_udf(RENDERED)
    def rendered(roles: pa.Array, texts: pa.Array) -> pa.Array:
        out = []
        for who, said in zip(roles.to_pylist(), texts.to_pylist()):
            segment, start, end = render(who, said)
            out.append({"segment": segment, "start": start, "end": end, "learned": who == LEARNED})
        return pa.array(out, type=_RENDERED_ARROW)

    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return rows.withColumn(into, rendered(text_of(role), text_of(text)))


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(batches):
    """Numbers and digests of each conversation, read back from its rendered turns in order."""
    now, state = None, None
    done: list[tuple] = []

    def closed():
        return (now[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    def table():
        return pa.RecordBatch.from_arrays(
            [pa.array([d[i] for d in done], t) for i, t in enumerate(
                (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))],
            names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        for conv, segment in zip(batch.column("conv_id").to_pylist(), batch.column("segment").to_pylist()):
            if now is None or now[0] != conv:
                if now is not None:
                    done.append(closed())
                now, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text, start, end in parse(segment):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                if role == LEARNED:
                    state[2] += len(text)
                    state[3].update(text.encode())
            state[4] += len(segment)
        if done:
            yield table()
            done = []
    if now is not None:
        done.append(closed())
        yield table()


def format_digests(rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                   text: str = "text") -> DataFrame:
    """One row for each conversation: turns, digests and sizes, read back from the formatted text."""
    turns = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    out = format_turns(turns).select("conv_id", "turn", "role", "text", "rendered.segment")
    return out.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text") \
        .select("conv_id", "segment").mapInArrow(_digests, DIGEST)
