"""Chat formatting by columnar byte assembly.

A turn is written as

    ### role:
    text</turn>

Inside roles and texts a backslash is doubled, and one is put before each `###` and
`</turn>` (in roles also before `:` and line ends), so a control string in the output that
no backslash precedes is always the template's own, and reading back is exact.

Per Arrow batch the headers, escaped texts and ends of all turns are laid out by their
lengths and cumulative offsets in one preallocated buffer, which becomes the result's
Arrow array; a scatter of index ranges copies every segment at once. The loss mask is a
list of spans in code points over the assistant's texts.

Rows are dealt by ranges of conversation and turn, sorted and streamed. A conversation
becomes one row; one with more than `PART_TURNS` turns or `PART_BYTES` bytes, or one that a
range's end cuts, becomes several parts, which `task` and `part` put in order. So memory is
bounded, and a conversation with a third of all rows is formatted by many tasks. Its digest
is sequential by nature: the parts of a conversation meet in one task, which streams them.

Results for odd rows: a null text or role is empty; a null turn sorts first and ties in
turn go by role, then text; repeated rows are turns of their own; a null conversation id
is a conversation; an empty table gives no row. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, END = b"### ", b":\n", b"</turn>\n"
TURN_END = "</turn>"
LEARNED = "assistant"
PART_TURNS = 2048
PART_BYTES = 16 << 20
FORMATTED = "conv_id long, task int, part int, n_turns long, formatted string, loss array<struct<start: long, stop: long>>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _starts(data: np.ndarray, what: bytes) -> np.ndarray:
    """Where the bytes `what` begin."""
    hit = np.zeros(len(data), bool)
    if len(data) >= len(what):
        n = len(data) - len(what) + 1
        hit[:n] = True
        for i, c in enumerate(what):
            hit[:n] &= data[i : i + n] == c
    return hit


def escape(data: np.ndarray, offsets: np.ndarray, role: bool) -> tuple[np.ndarray, np.ndarray]:
    """All values of a column escaped at once: bytes and offsets."""
    marked = (data == 0x5C) | _starts(data, b"###") | _starts(data, TURN_END.encode())
    if role:
        marked |= (data == 0x3A) | (data == 0x0A)
    # a control string split over two values is none
    for what in (b"###", TURN_END.encode()):
        for back in range(1, len(what)):
            at = offsets[1:-1] - back
            at = at[at >= 0]
            at = at[data[at] == what[0]]
            own_end = offsets[np.searchsorted(offsets, at, side="right")]
            marked[at[own_end - at < len(what)]] = False
    shift = np.concatenate(([0], np.cumsum(marked)))
    out = np.full(len(data) + int(shift[-1]), 0x5C, np.uint8)
    out[np.arange(len(data)) + shift[1:]] = data
    return out, offsets + shift[offsets]


def scatter(out: np.ndarray, at: np.ndarray, source: np.ndarray, start: np.ndarray, length: np.ndarray) -> None:
    """Copy source[start:start+length] to out[at:at+length] for all segments at once."""
    if total := int(length.sum()):
        within = np.arange(total) - np.repeat(np.cumsum(length) - length, length)
        out[np.repeat(at, length) + within] = source[np.repeat(start, length) + within]


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column, nulls empty."""
    column = pa.array(column.fill_null(""), pa.large_string()) if column.type != pa.large_string() else column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def assemble(turns: pa.Table, task: int = 0) -> pa.RecordBatch:
    """Formatted rows of whole parts: turns carry conv_id, role, text and a part number."""
    rows = turns.num_rows
    role, text = (turns.column(c).combine_chunks() for c in ("role", "text"))
    role_data, role_at = escape(*column_bytes(role), role=True)
    text_data, text_at = escape(*column_bytes(text), role=False)
    role_len, text_len = np.diff(role_at), np.diff(text_at)
    length = len(HEAD) + role_len + len(MIDDLE) + text_len + len(END)
    at = np.concatenate(([0], np.cumsum(length)))
    out = np.empty(int(at[-1]), np.uint8)
    head = np.frombuffer(HEAD + MIDDLE + END, np.uint8)
    cut = np.cumsum([0, len(HEAD), len(MIDDLE), len(END)])
    text_from = at[:-1] + len(HEAD) + role_len + len(MIDDLE)
    for i, where in enumerate((at[:-1], text_from - len(MIDDLE), at[1:] - len(END))):
        scatter(out, where, head, np.full(rows, cut[i]), np.full(rows, cut[i + 1] - cut[i]))
    scatter(out, at[:-1] + len(HEAD), role_data, role_at[:-1], role_len)
    scatter(out, text_from, text_data, text_at[:-1], text_len)

    conv, number = turns.column("conv_id").combine_chunks(), turns.column("part").to_numpy()
    begins = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1])))
    bounds = np.append(begins, rows)
    chars = np.concatenate(([0], np.cumsum((out & 0xC0) != 0x80)))
    learned = pc.equal(role.fill_null(""), LEARNED).to_numpy(zero_copy_only=False)
    base = np.repeat(chars[at[begins]], np.diff(bounds))
    start, stop = (chars[text_from] - base)[learned], (chars[text_from + text_len] - base)[learned]
    spans = pa.StructArray.from_arrays([pa.array(start, pa.int64()), pa.array(stop, pa.int64())], names=["start", "stop"])
    ends = np.concatenate(([0], np.cumsum(learned)))[bounds].astype(np.int32)
    formatted = pa.Array.from_buffers(pa.large_string(), len(begins), [None, pa.py_buffer(at[bounds].astype(np.int64)), pa.py_buffer(out)])
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(begins)), pa.array(np.full(len(begins), task), pa.int32()), pa.array(turns.column("part_in").to_numpy()[begins], pa.int32()), pa.array(np.diff(bounds), pa.int64()), formatted.cast(pa.string()), pa.ListArray.from_arrays(pa.array(ends), spans)],
        names=["conv_id", "task", "part", "n_turns", "formatted", "loss"],
    )


def format_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to formatted parts; only the last, unended part is held back."""
    context = TaskContext.get()
    task = context.partitionId() if context else 0
    held: pa.Table | None = None
    state = {"conv": object(), "part": 0, "turns": 0, "bytes": 0, "number": 0}
    for batch in batches:
        if not batch.num_rows:
            continue
        new = pa.Table.from_batches([batch])
        number, part_in = [], []
        size = sum(pc.fill_null(pc.binary_length(new.column(c)), 0).to_numpy() for c in ("role", "text"))
        for conv, n in zip(new.column("conv_id").to_pylist(), size.tolist()):
            if conv != state["conv"]:
                state.update(conv=conv, part=0, turns=0, bytes=0, number=state["number"] + 1)
            elif state["turns"] >= PART_TURNS or state["bytes"] + n > PART_BYTES:
                state.update(part=state["part"] + 1, turns=0, bytes=0, number=state["number"] + 1)
            state["turns"] += 1
            state["bytes"] += n
            number.append(state["number"])
            part_in.append(state["part"])
        new = new.append_column("part_in", pa.array(part_in, pa.int32())).append_column("part", pa.array(number, pa.int64()))
        new = new if held is None else pa.concat_tables([held, new])
        numbers = new.column("part").to_numpy()
        whole = int(np.searchsorted(numbers, numbers[-1]))
        if whole:
            yield assemble(new.slice(0, whole), task)
        held = new.slice(whole)
    if held is not None and held.num_rows:
        yield assemble(held, task)


def format_conversations(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, task, part, n_turns, formatted and loss; task and part order the parts of a conversation."""
    rows = conversations.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    rows = rows.repartitionByRange("conv_id", "turn").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    return rows.mapInArrow(format_stream, FORMATTED)


_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _plain(text: str, what: str, at: int) -> int:
    """The next place of `what` that no odd run of backslashes precedes."""
    while True:
        at = text.index(what, at)
        back = at
        while back and text[back - 1] == "\\":
            back -= 1
        if (at - back) % 2 == 0:
            return at
        at += 1


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    at, head, middle, end = 0, HEAD.decode(), MIDDLE.decode(), END.decode()
    while at < len(formatted):
        if not formatted.startswith(head, at):
            raise ValueError(f"no turn begins at {at}")
        colon = _plain(formatted, middle, at + len(head))
        stop = _plain(formatted, end, colon + len(middle))
        yield unescape(formatted[at + len(head) : colon]), unescape(formatted[colon + len(middle) : stop])
        at = stop + len(end)


def digest_stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per conversation, read back from its parts as they come."""
    conv, state = object(), None
    names = [c.split()[0] for c in DIGEST.split(", ")]

    def row() -> list:
        return [conv, state["n"], state["turns"].hexdigest(), state["loss_chars"], state["loss"].hexdigest(), state["chars"]]

    def batch_of(rows: list[list]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    for batch in batches:
        rows = []
        for c, formatted, loss in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss"))):
            if state is None or c != conv:
                if state is not None:
                    rows.append(row())
                conv, state = c, {"n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
            for role, text in read_turns(formatted):
                state["n"] += 1
                state["turns"].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for span in loss:
                text = unescape(formatted[span["start"] : span["stop"]])
                state["loss_chars"] += len(text)
                state["loss"].update(text.encode("utf-8", "surrogatepass"))
            state["chars"] += len(formatted)
        if rows:
            yield batch_of(rows)
    if state is not None:
        yield batch_of([row()])


def digest(formatted: DataFrame) -> DataFrame:
    """Digests read back from the rows of `format_conversations`, each conversation's parts in order."""
    parts = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "task", "part")
    return parts.mapInArrow(digest_stream, DIGEST)
