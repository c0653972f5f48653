"""Chat formatting by columnar byte assembly, and reading the formatted text back.

A turn is <s>role\\ntext</s>. Inside roles and texts a backslash is doubled, and each control string gets
a backslash after its first character, so that none remains; a newline in a role becomes \\n. Unescaping
turns a backslash and what follows back, so that any text, control strings included, returns unchanged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
SLICE = 8 << 20  # bytes of roles and texts that are assembled at once: their scatter indices take sixteen times as much
_FIXED = (b"<s>", None, b"\n", None, b"</s>")


def _escape(column: pa.Array) -> pa.Array:
    column = pc.replace_substring(pc.fill_null(column, ""), "\\", "\\\\")
    for c in CONTROL:
        column = pc.replace_substring(column, c, f"{c[0]}\\{c[1:]}")
    return column


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S) if "\\" in text else text


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The data of a string array without nulls, and the offsets into it."""
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of about SLICE bytes of roles and texts (columns 1 and 2), a row at least."""
    for batch in batches:
        size = sum(pc.fill_null(pc.binary_length(batch.column(k)), 0).to_numpy().astype(np.int64) for k in (1, 2))
        upto, at = np.cumsum(size), 0
        while at < batch.num_rows:
            n = max(1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, "right")) - at)
            yield batch.slice(at, n)
            at += n


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of escaped roles and texts: all turns in one buffer, where each turn starts in it, and the code points before and in each text."""
    n = len(role)
    length = np.zeros((n, len(_FIXED)), np.int64)
    columns = {1: _bytes(role), 3: _bytes(text)}
    for i, fixed in enumerate(_FIXED):
        length[:, i] = len(fixed) if fixed is not None else np.diff(columns[i][1])
    ends = np.cumsum(length.ravel())
    begin = (ends - length.ravel()).reshape(n, -1)
    buf = np.empty(int(ends[-1]) if n else 0, np.uint8)
    for i, fixed in enumerate(_FIXED):
        if fixed is not None:
            buf[begin[:, i, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
        else:
            data, offsets = columns[i]
            to = np.repeat(begin[:, i] - offsets[:-1], length[:, i])
            source = np.arange(offsets[0], offsets[-1])
            buf[to + source] = data[offsets[0] : offsets[-1]]
    return buf, np.r_[begin[:, 0], len(buf)], pc.utf8_length(role).to_numpy() + 4, pc.utf8_length(text).to_numpy().astype(np.int64)


_PIECE = "conv_id long, piece long, n_turns long, formatted string, loss array<struct<start:long,length:long>>"


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, piece, n_turns, formatted, loss: each conversation as text, with the spans (code points) under the loss mask.

    Turns go by turn, ties by role and text, null turns first; null roles and texts count as empty, and rows
    with a null conv_id make one conversation. One that spans Arrow batches, or SLICE bytes, comes in several pieces, in
    order within a partition, so that memory stays bounded for a conversation of any length. Repeated rows are turns
    of their own; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, piece = None, 0
        for batch in _slices(batches):
            ids = batch.column(0)
            known, values = pc.is_valid(ids).to_numpy(zero_copy_only=False), pc.fill_null(ids, 0).to_numpy()
            cuts = np.r_[0, np.flatnonzero((np.diff(values) != 0) | (known[1:] != known[:-1])) + 1, len(values)]
            role, text = batch.column(1), _escape(batch.column(2))
            masked = pc.equal(pc.fill_null(role, ""), loss_role).to_numpy(zero_copy_only=False)
            role = pc.replace_substring(_escape(role), "\n", "\\n")
            buf, starts, head, chars = assemble(role, text)
            if len(buf) > 2**31 - 1:
                raise ValueError("a turn whose escaped text exceeds the largest string")
            point = np.cumsum(head + chars + 4) - chars - 4  # code points before each text
            first = (point - head)[cuts[:-1]]
            span = np.flatnonzero(masked)
            owner = np.searchsorted(cuts, span, "right") - 1
            loss = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(span, cuts), pa.int32()),
                pa.StructArray.from_arrays([pa.array(point[span] - first[owner]), pa.array(chars[span])], ["start", "length"]),
            )
            formatted = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(starts[cuts].astype(np.int32)), pa.py_buffer(buf))
            here = [(int(values[c]) if known[c] else None) for c in cuts[:-1]]
            piece = piece + 1 if before == (here[0],) else 0
            numbers = np.zeros(len(here), np.int64)
            numbers[0] = piece
            if len(here) > 1:
                piece = 0
            before = (here[-1],)
            yield pa.RecordBatch.from_arrays([pa.array(here, pa.int64()), pa.array(numbers), pa.array(np.diff(cuts)), formatted, loss], [x.split()[0] for x in ("conv_id", "piece", "n_turns", "formatted", "loss")])

    rows = conversations.select(F.col("conv_id").cast("long"), "role", "text", "turn").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(run, _PIECE)


def read_turns(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a formatted piece."""
    for turn in formatted.split("</s>")[:-1]:
        role, _, text = turn[3:].partition("\n")
        yield unescape(role), unescape(text)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(pieces: DataFrame) -> DataFrame:
    """Digests per conversation of what the formatted pieces say, in the order that format_conversations() leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list = []

        def pack(done: list) -> pa.RecordBatch:
            rows = [(i, n, a.hexdigest(), c, b.hexdigest(), f) for i, n, a, c, b, f in done]
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in _READ.split(", ")])

        for batch in batches:
            done = []
            for r in batch.to_pylist():
                if state and r["piece"] == 0:
                    done.append(state)
                    state = []
                state = state or [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_turns(r["formatted"]):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for x in r["loss"]:
                    text = unescape(r["formatted"][x["start"] : x["start"] + x["length"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(r["formatted"])
            if done:
                yield pack(done)
        if state:
            yield pack([state])

    return pieces.mapInArrow(run, _READ)
