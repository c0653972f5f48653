"""Quartile bucket digests: locality-sensitive fingerprints of byte texts.

Six byte triplets of every five-byte window are hashed into 128 buckets. Each bucket is encoded as the
quartile that its count falls in (two bits), beside the logarithm of the length, the ratios of the
quartiles and a checksum. Two digests differ by a bounded score; likeness is one less its share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

BUCKETS = 128
#: The offsets back from the newest byte of a window, one salt each.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))
_K = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_BODY = BUCKETS // 4
_LEN_CAP, _RATIO_CAP, _FAR = 12, 8, 6
WORST = _FAR * BUCKETS + 12 * _LEN_CAP + 2 * 12 * _RATIO_CAP + 1


def digest(data: bytes) -> str:
    """The digest as 72 hex digits: checksum, length, quartile ratios, then two bits a bucket. Any length will do."""
    b = np.frombuffer(data, np.uint8)
    counts = np.zeros(BUCKETS, np.int64)
    for at in range(0, len(b), 1 << 18):  # bounded memory for very long texts
        part = b[max(0, at - 4) : at + (1 << 18)].astype(np.uint32)
        part = part if at else np.r_[np.zeros(4, np.uint32), part]  # short texts have windows too
        n = len(part) - 4
        terms = [[part[4 - o : 4 - o + n] * k for o in range(5)] for k in _K]
        for salt, (i, j, k) in enumerate(TRIPLETS):
            h = terms[0][i] ^ terms[1][j] ^ (terms[2][k] + np.uint32(salt * 0x27D4EB2F & 0xFFFFFFFF))
            counts += np.bincount((h * np.uint32(0x165667B1)) >> np.uint32(25), minlength=BUCKETS)
    q = np.sort(counts)[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    code = (counts[:, None] > q).sum(1).astype(np.uint8)
    body = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8).tobytes()
    length = min(255, int(round(np.log(len(b) + 1) / np.log(1.15))))
    ratios = (int(q[0] * 100 // max(1, q[2])) % 16) << 4 | int(q[1] * 100 // max(1, q[2])) % 16
    check = hashlib.blake2b(data, digest_size=1).digest()[0]
    return bytes([check, length, ratios]).hex() + "00" + body.hex()


def difference(a: str, b: str) -> int:
    """A bounded score: 0 for equal digests, at most WORST."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    score = 12 * min(_LEN_CAP, abs(int(x[1]) - int(y[1]))) + int(x[0] != y[0])
    for shift in (0, 4):
        d = abs(int(x[2] >> shift & 15) - int(y[2] >> shift & 15))
        score += 12 * min(_RATIO_CAP, d, 16 - d)
    shifts = np.array([0, 2, 4, 6], np.uint8)
    d = np.abs((x[4:, None] >> shifts & 3).astype(np.int64) - (y[4:, None] >> shifts & 3))
    return score + int(np.where(d == 3, _FAR, d).sum())


def likeness(a: str, b: str) -> float:
    return 1.0 - difference(a, b) / WORST


_ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def _edit(doc_id, text: str, own: str, follower: str, follower_digest: str) -> list:
    k = len(text) // 3
    edited = (text[: len(text) - k] + follower[:k]).encode()
    after = digest(edited)
    return [doc_id, len(text), hashlib.sha256(edited).hexdigest(), own, after, likeness(own, after), likeness(own, follower_digest)]


def edits(docs: DataFrame) -> DataFrame:
    """Each document's digest, that of its edited text, and both likenesses.

    The edited text has its last third replaced by the start of the next document's, in descending doc_id
    (equal ids: by text hash; null ids last; after the last comes the first; a lone document follows itself).
    Null texts count as empty and have the digest of the empty text. Documents are range-partitioned once;
    the first and last of each partition, two rows each, are then joined across the borders.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("tie")]
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, last, first = TaskContext.get().partitionId(), None, None
        schema = pa.schema([("pid", pa.int32()), ("border", pa.string()), ("text", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in _NAMES[2:5]), ("near_edited", pa.float64()), ("near_next", pa.float64())])
        pack = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                here = (doc_id, text, last[2] if last and last[1] == text else digest(text.encode()))
                if last:
                    out.append([pid, None, None, *_edit(*last, here[1], here[2])])
                else:
                    first = here
                last = here
            if out:
                yield pack(out)
        if last:
            yield pack([[pid, side, t, i, None, None, d, None, None, None] for side, (i, t, d) in (("first", first), ("last", last))])

    done = materialize(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, f"pid int, border string, text string, {_ROW}"), "digest")
    border = done.filter(F.col("border").isNotNull())
    # two rows a partition: their number is that of the partitions, not of the documents
    at = border.filter("border = 'first'").select("pid").withColumn("following", F.lead("pid").over(Window.orderBy("pid")))
    at = at.withColumn("following", F.coalesce("following", F.min("pid").over(Window.partitionBy())))
    heads = border.filter("border = 'first'").select(F.col("pid").alias("following"), F.col("text").alias("head"), F.col("fingerprint").alias("head_fp"))
    ends = border.filter("border = 'last'").select("pid", "doc_id", "text", "fingerprint").join(at, "pid").join(heads, "following")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = [_edit(r["doc_id"], r["text"], r["fingerprint"], r["head"], r["head_fp"]) for r in batch.to_pylist()]
                types = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], _NAMES)

    return done.filter(F.col("border").isNull()).select(*_NAMES).unionByName(ends.select("doc_id", "text", "fingerprint", "head", "head_fp").mapInArrow(finish, _ROW))
