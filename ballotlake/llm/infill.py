"""Fill-in-middle: a text is cut at two places between tokens and its parts change places behind markers.

A token is a run of other bytes with the white space before it, or the white space that ends a text. White space is one
byte each in UTF-8, so tokens end at bytes, and a text is read as 64-bit words: a few additions on all words mark
the bytes that end a token (see `ends`), a population count a word and its running sum lead to the word of the
k-th token's end, and the place within that word is what is left to find.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_batches

MARKERS = ("<P>", "<S>", "<M>")
BLOCK = 1 << 17  # words that are looked at together: a megabyte of text

_LOW, _HIGH = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)
_BLANK, _FROM_9, _FROM_14 = (np.uint64(0x0101010101010101 * b) for b in (0x20, 0x80 - 9, 0x80 - 14))


def spaces(words: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is \\x20 or \\x09 to \\x0D. No sum leaves its byte, as both parts lack the high bit."""
    low = words & _LOW
    blank = ~((low ^ _BLANK) + _LOW)
    return (blank | ((low + _FROM_9) & ~(low + _FROM_14))) & _HIGH & ~words


def ends(space: np.ndarray, after: np.ndarray) -> np.ndarray:
    """The high bit of each byte that is no white space before one that is; after holds each word's successor's spaces."""
    return ~space & _HIGH & ((space >> np.uint64(8)) | (after << np.uint64(56)))


class Units:
    """The tokens of a text as places of bytes: their number n, and the place after the first k of them."""

    def __init__(self, text: bytes):
        self.text = text
        self.closed = bool(text) and text[-1:] in b" \t\n\v\f\r"  # white space at the end is one token more
        self.sums = [np.cumsum(np.bitwise_count(self._marks(at)), dtype=np.int64) for at in range(0, len(text), 8 * BLOCK)]
        self.before = np.cumsum([0, *(int(s[-1]) for s in self.sums)])
        self.n = int(self.before[-1]) + self.closed

    def _marks(self, at: int) -> np.ndarray:
        """Marks of one block, which is filled up with spaces; its last word looks at the byte that follows it."""
        part = self.text[at : at + 8 * BLOCK + 8]
        words = np.frombuffer(part + b" " * (-len(part) % 8 + 8), "<u8")
        space = spaces(words)
        size = min(BLOCK, -(-(len(self.text) - at) // 8))
        return ends(space[:size], space[1 : size + 1])

    def place(self, k: int) -> int:
        if k <= 0:
            return 0
        if k >= self.n:
            return len(self.text)
        block = int(np.searchsorted(self.before, k)) - 1
        left = k - int(self.before[block])
        word = int(np.searchsorted(self.sums[block], left))
        left -= int(self.sums[block][word - 1]) if word else 0
        mark = int(self._marks(8 * BLOCK * block)[word])
        for _ in range(left - 1):
            mark &= mark - 1  # takes the lowest mark away
        return 8 * (BLOCK * block + word) + ((mark & -mark).bit_length() + 7) // 8


def points(text: bytes) -> int:
    """Code points: all bytes but those that go on with one, 10xxxxxx."""
    whole = np.frombuffer(text, np.int8)
    return sum(int(np.count_nonzero(whole[at : at + (1 << 20)] >= -64)) for at in range(0, len(whole), 1 << 20))


def arrange(text: bytes, doc_id: int | None, rate: float = 0.5, spm: float = 0.8, seed: int = 42, markers: tuple[str, ...] = MARKERS) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, code points of prefix and middle (None for plain), and the rearranged text. See transform."""
    units = Units(text)
    p, s, m = (x.encode() for x in markers)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or any(x in text for x in (p, s, m)) or h3 % 100 >= 100 * rate:
        return units.n, "plain", None, None, text
    first, last = sorted((h1 % (units.n + 1), h2 % (units.n + 1)))
    a, b = units.place(first), units.place(last)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    form = "spm" if h4 % 100 < 100 * spm else "psm"
    out = (s, suffix, p, prefix, m, middle) if form == "spm" else (p, prefix, s, suffix, m, middle)
    return units.n, form, points(prefix), points(middle), b"".join(out)


def rebuilt(output: bytes, form: str, markers: tuple[str, ...] = MARKERS) -> bytes:
    """The text that was rearranged. It holds no marker, so each marker is found where it was put."""
    if form == "plain":
        return output
    p, s, m = (x.encode() for x in markers)
    if form == "spm":
        suffix, rest = output[len(s) :].split(p, 1)
        prefix, middle = rest.split(m, 1)
    else:
        prefix, rest = output[len(p) :].split(s, 1)
        suffix, middle = rest.split(m, 1)
    return prefix + middle + suffix


def transform(docs: DataFrame, rate: float = 0.5, spm: float = 0.8, seed: int = 42, markers: tuple[str, ...] = MARKERS) -> DataFrame:
    """doc_id, n (tokens), form, prefix_chars, middle_chars, output of every row of docs (doc_id, text, any others).

    Both cuts, whether a text is rearranged (at this rate) and into which form (spm at its rate, else psm) hang on the
    seed and doc_id alone, so reruns agree. Null texts count as empty and stay plain, as do texts that hold a marker; rows with
    one doc_id get the same draws and a row each; a null doc_id draws as an empty one. Texts are whole, of any length; an
    empty table gives none. Narrow: no shuffle.
    """
    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [arrange(t or b"", i, rate, spm, seed, markers) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        n, form, prefix, middle, output = zip(*rows)
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64())
        columns = [pa.array(c, k) for c, k in zip((n, form, prefix, middle), kinds)]
        return pa.RecordBatch.from_arrays([batch.column(0), *columns, pa.array(output, pa.binary()).view(pa.string())], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")), run, schema)


def restore(made: DataFrame, markers: tuple[str, ...] = MARKERS, name: str = "restored") -> DataFrame:
    """made (output, form, any others) with the text that each output came from, under this or a fresh name."""
    name = fresh(made, name)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.names
        outputs = batch.column(at.index("output")).cast(pa.binary()).to_pylist()
        texts = [rebuilt(o, f, markers) for o, f in zip(outputs, batch.column(at.index("form")).to_pylist())]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary()).view(pa.string())], [*at, name])

    return map_batches(made, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields) + f", `{name}` string")
