"""Best-fit packing of token sequences, by partitions first and then up a tree.

Every partition packs its own pieces best-fit, largest first. Bins that are nearly full, or that have less
room than the smallest underfull bin anywhere, are final; the others are items of the next round, in which
groups of partitions meet, until one group is left. Where one group would hold too many bins, the bins are dealt
to as many groups as it takes, to other ones each round, until a round saves less than a bin a group.
"""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

CAPACITY = 1024
SLACK = 4  # a bin with this much room or less counts as full
FAN_IN = 8
GROUP = 1_000_000  # bins that meet in one task at most


@cache
def tokenizer(path: str):
    """The byte-level BPE of the .json file, faster: ranks lie beside it under the same name, added tokens are its own."""
    import public_tokenizers
    import tiktoken

    with open(path.removesuffix(".json") + ".tiktoken", "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path, encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f).get("added_tokens", [])}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_PIECE = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str | None = None, end: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """row, doc_id, piece, start, length, ids_crc32: each text's ids and the end id, cut where longer than capacity.

    The first piece of a long document is the short one. Null texts count as empty; each row of docs has
    pieces of its own, told apart by row. Texts are read whole.
    """
    path = path or default_tokenizer()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = tokenizer(path), TaskContext.get().partitionId() << 36
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.append(coder.encode_to_numpy(text or "", allowed_special="all"), end).astype("<u4")
                first = len(ids) % capacity or capacity
                for k, at in enumerate(range(first - capacity, len(ids), capacity)):
                    start = max(0, at)
                    part = ids[start : at + capacity]
                    out.append((row, doc_id, k, start, len(part), zlib.crc32(part.tobytes())))
                    row += 1
            if out:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [x.split()[0] for x in _PIECE.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PIECE)


_BIN = "bin long, used int, rows array<long>, lengths array<int>"


def best_fit(used: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Items by index in bins: each item, largest first, goes where it leaves the least room."""
    open_bins: dict[int, list[list[int]]] = {}
    rooms, bins = 0, []  # rooms: bit r is set if some bin has r left
    for i in sorted(range(len(used)), key=lambda i: -used[i]):
        fits = rooms >> used[i]
        if fits:
            room = used[i] + (fits & -fits).bit_length() - 1
            chosen = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, chosen = capacity, []
            bins.append(chosen)
        chosen.append(i)
        room -= used[i]
        open_bins.setdefault(room, []).append(chosen)
        rooms |= 1 << room
    return bins


def _round(items: DataFrame, number: int, capacity: int) -> DataFrame:
    """Pack the bins (used, rows, lengths) of each partition into fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
        if whole is None:
            return
        base = (number << 56) + (TaskContext.get().partitionId() << 32)
        used, rows, lengths = (whole.column(c).combine_chunks() for c in ("used", "rows", "lengths"))
        bins = best_fit(used.to_pylist(), capacity)
        for at in range(0, len(bins), 8192):
            part = bins[at : at + 8192]
            flat = pa.array([i for b in part for i in b])
            r, m = rows.take(flat), lengths.take(flat)
            ends = np.cumsum([len(b) for b in part])
            sizes = np.r_[0, np.cumsum(r.value_lengths().to_numpy())]
            cuts = pa.array(sizes[np.r_[0, ends]], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [pa.array(base + at + np.arange(len(part))), pa.array([sum(b) for b in np.split(used.take(flat).to_numpy(), ends[:-1])], pa.int32()), pa.ListArray.from_arrays(cuts, r.flatten()), pa.ListArray.from_arrays(cuts, m.flatten())],
                ["bin", "used", "rows", "lengths"],
            )

    return items.select("used", "rows", "lengths").mapInArrow(run, _BIN)


def pack(docs: DataFrame, path: str | None = None, end: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text, any others).

    Pieces of a sequence stand side by side from 0. An empty table gives none.
    """
    cut = materialize(pieces(docs, path, end, capacity), "pieces")
    short = cut.filter(F.col("length") < capacity).select(F.col("length").cast("int").alias("used"), F.array("row").alias("rows"), F.array(F.col("length").cast("int")).alias("lengths"))
    groups = max(1, short.rdd.getNumPartitions())
    final, number, before = [], 0, None
    bins = materialize(_round(short, number, capacity), "bins")
    while True:
        open_bins = bins.filter(F.col("used") < capacity - SLACK)
        n, least = open_bins.agg(F.count("*"), F.min("used")).first()
        fewer = max(-(-groups // FAN_IN), -(-n // GROUP)) if n else 0
        if not n or groups == 1 >= fewer or (fewer >= groups and before is not None and n > before - groups):
            final.append(bins)
            break
        stuck = (F.col("used") >= capacity - SLACK) | (F.col("used") > capacity - least)
        final.append(bins.filter(stuck))
        number, groups, before = number + 1, fewer, n
        bins = materialize(_round(bins.filter(~stuck).repartition(groups, F.col("bin")), number, capacity), "bins")
    placed = final[0]
    for more in final[1:]:
        placed = placed.unionByName(more)
    ahead = F.expr("transform(rows, (r, i) -> struct(r AS row, aggregate(slice(lengths, 1, i), 0L, (a, x) -> a + x) AS offset))")
    placed = placed.select(F.col("bin").alias("sequence_id"), F.inline(ahead))
    full = cut.filter(F.col("length") == capacity).withColumn("sequence_id", -1 - F.col("row")).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.filter(F.col("length") < capacity).join(placed, "row")
    return full.unionByName(rest).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
