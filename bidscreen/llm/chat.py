"""Chat formatting by incremental rendering of a template that is a black box.

A template is called with successive prefixes of a conversation; where an output continues the one
before, what was added is the new turn's span, and where it doesn't, the template has rewritten
history and the row says so. Conversations stream through their task in sorted order, so a task
holds one segment of one conversation at a time, however many turns a conversation has.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The control strings of the template below.
CONTROL = re.compile(r"<(/?s>)|\[(/?INST\])")
_turn = re.compile(r"<s>(?:\[INST\] )?([^\n]*)\n(.*?)( \[/INST\]|)</s>\n", re.S)

Turns = list[tuple[str, str]]


def escape(text: str) -> str:
    """Doubles backslashes and parts control strings by one, so that none is left in the text."""
    return CONTROL.sub(lambda m: m.group()[0] + "\\" + m.group()[1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)?", lambda m: {"\\": "\\", "n": "\n", None: ""}[m.group(1)], role)


def instruct_template(turns: Turns) -> str:
    """Turns between control strings; what isn't the assistant's is an instruction."""
    return "".join(f"<s>{escape_role(r)}\n{escape(t)}</s>\n" if r == "assistant" else f"<s>[INST] {escape_role(r)}\n{escape(t)} [/INST]</s>\n" for r, t in turns)


def read_turn(formatted: str) -> tuple[str, str, int, int]:
    """Role, text, and the span of the escaped text of one formatted turn."""
    m = _turn.fullmatch(formatted)
    if m is None:
        raise ValueError("not a turn of this template")
    return unescape_role(m[1]), unescape(m[2]), m.start(2), m.end(2)


def spans(template: Callable[[Turns], str], turns: Turns) -> Iterator[tuple[int, str, int]]:
    """For each turn: where its span begins, what it adds, and the length of the earlier output that it rewrote."""
    before = ""
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        if now.startswith(before):
            yield len(before), now[len(before) :], 0
        else:
            same = next((i for i, (a, b) in enumerate(zip(before, now, strict=False)) if a != b), min(len(before), len(now)))
            yield same, now[same:], len(before) - same
        before = now


def format_conversations(conversations: DataFrame, template: Callable[[Turns], str] = instruct_template, segment_turns: int = 512) -> DataFrame:
    """A row for each turn of each conversation, in order within its partition.

    conversations: conv_id, turn, role, text; others aren't read. Turns go by turn, then role and
    text, repeated rows included; null turns come first, null roles and texts count as empty, rows
    with a null conv_id are one conversation. Returns conv_id, position (from 0), begin (of the
    span), formatted (what the turn adds), rewritten (characters of earlier turns' output that it
    changed; over 0 shows a template that rewrites history, and formatted then holds the output
    from the first change on).

    Prefixes are rendered from the segment's first turn on: a conversation of more than
    segment_turns turns is formatted in segments of so many, one after another. Each two neighbouring
    segments are also rendered together; where that isn't what they give one by one (a header of the
    conversation, numbered turns, history rewritten across the border), segments can't be formatted
    apart and a ValueError asks for more segment_turns, so a template never has another result by size.
    """
    c = conversations.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    kind = c.schema["conv_id"].dataType.simpleString()
    ordered = c.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        turns: Turns = []
        earlier: Turns = []  # the segment before, of the same conversation
        conv, position, base = None, 0, 0

        def flush() -> None:
            nonlocal position, base, turns, earlier
            if earlier and template(earlier + turns) != template(earlier) + template(turns):
                raise ValueError(f"conversation {conv!r} has more than {segment_turns} turns and its template doesn't treat turns {position - len(earlier)} to {position + len(turns) - 1} alike when parted at {position}; raise segment_turns")
            last = 0
            for begin, added, rewritten in spans(template, turns):
                rows.append((conv, position, base + begin, added, rewritten))
                position, last = position + 1, begin + len(added)
            base, turns, earlier = base + last, [], turns

        def batch() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["conv_id", "position", "begin", "formatted", "rewritten"])
            rows.clear()
            return out

        types: list = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
        for part in batches:
            types[0] = part.column(0).type
            for key, role, text in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                if turns and key != conv or len(turns) >= segment_turns:
                    flush()
                if key != conv:
                    position, base, earlier = 0, 0, []
                conv = key
                turns.append((role, text))
                if len(rows) >= 2000:
                    yield batch()
        if turns:
            flush()
        if rows:
            yield batch()

    return ordered.mapInArrow(run, f"conv_id {kind}, position bigint, begin bigint, formatted string, rewritten bigint")


def digests(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, read back from format_conversations' output in its own order and partitions.

    Returns conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 (of the assistant's texts,
    unescaped), formatted_chars, rewritten.
    """
    kind = formatted.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewritten"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for part in batches:
            done = []
            for conv, position, begin, text, rewritten in zip(*(part.column(i).to_pylist() for i in range(5)), strict=True):
                if position == 0:
                    if state:
                        done.append(state)
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                role, said, _, _ = read_turn(text)
                state[1] += 1
                state[2].update(f"{role}\n{said}\n".encode())
                if role == "assistant":
                    state[3] += len(said)
                    state[4].update(said.encode())
                state[5] = begin + len(text)
                state[6] += rewritten
            if done:
                yield table(done, part.column(0).type)
            last_type = part.column(0).type
        if state:
            yield table([state], last_type)

    def table(done: list[list], key_type: pa.DataType) -> pa.RecordBatch:
        types = [key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i].hexdigest() if i in (2, 4) else r[i] for r in done], t) for i, t in enumerate(types)], names=names)

    return formatted.mapInArrow(run, f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint, rewritten bigint")
