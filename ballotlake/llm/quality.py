"""Quality from weak labels: heuristic labellers, their accuracies by EM, and a hashed linear scorer.

Each labeller votes good, bad or abstains on statistics of the whole text. Documents are counted by their
pattern of votes, so that expectation-maximisation over all documents works on a table of bounded size.
The posterior of a pattern labels a bounded sample, from which a logistic scorer on hashed runs of
character classes learns; it scores every document.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows

SAMPLE = 6_000  # distinct texts that the scorer learns from, at most: those of the least hashes
FEATURES = 2048
THRESHOLD = 0.5

#: Name, lower and upper bound between which it abstains, which side is good, least words. Plain words and
#: letters overlap with all the others, which each know one kind of fault.
LABELLERS = (
    ("plain", 0.60, 0.80, "high", 5),
    ("letters", 0.90, 0.94, "high", 5),
    ("symbols", 0.04, 0.08, "low", 5),
    ("capitals", 0.20, 0.50, "low", 5),
    ("doubled", 0.05, 0.20, "low", 10),
    ("varied", 0.50, 0.80, "high", 30),
    ("separators", 0.05, 0.20, "low", 5),
    ("runs", 0.05, 0.20, "low", 5),
    ("sentences", 0.005, 0.02, "high", 60),
)
STATS = tuple(x[0] for x in LABELLERS)
_PLAIN = re.compile(rb"(?<!\S)[A-Za-z\x80-\xff][a-z\x80-\xff'-]*[.,;:!?]?(?!\S)")

_CLASS = np.full(256, 15, np.uint8)  # bytes above ASCII are letters of other alphabets
_CLASS[:128] = 9
_CLASS[list(range(97, 123))] = 1
_CLASS[list(range(65, 91))] = 2
_CLASS[list(range(48, 58))] = 3
_CLASS[32] = 4
_CLASS[[9, 10, 11, 12, 13]] = 5
_CLASS[[ord(c) for c in ".,;:"]] = 6
_CLASS[[ord(c) for c in "'\"-()"]] = 7
_CLASS[[ord(c) for c in "!?"]] = 8
_CLASS[[ord(c) for c in "|/\\"]] = 10


def statistics(text: bytes) -> tuple[int, dict[str, float], np.ndarray]:
    """The number of words, the labellers' statistics, and the classes of the bytes."""
    w = text.split()
    n = len(w)
    cls = _CLASS[np.frombuffer(text, np.uint8)]
    by = np.bincount(cls, minlength=16).tolist()
    shown = max(1, sum(by) - by[4] - by[5])
    letters = max(1, by[1] + by[2] + by[15])
    marks = cls >= 6
    marks[cls == 15] = False
    pairs = int((marks[1:] & marks[:-1] & ~np.r_[False, marks[:-2]]).sum()) if len(cls) > 1 else 0
    lone = 0
    if by[10] or by[9] or by[7]:
        lone = sum(len(x) == 1 and not x.isalnum() and x[0] < 128 for x in w)
    ends = text.count(b". ") + text.count(b".\n") + text.endswith(b".") + text.count(b"! ") + text.count(b"? ")
    doubled = sum(map(operator.eq, w, w[1:])) / max(1, n - 1)
    return n, {
        "plain": len(_PLAIN.findall(text)) / max(1, n) - doubled,
        "letters": letters / shown,
        "symbols": (by[9] + by[10] + by[8]) / shown,
        "capitals": by[2] / letters,
        "doubled": doubled,
        "varied": len(set(zip(w, w[1:], w[2:]))) / max(1, n - 2),
        "separators": lone / max(1, n),
        "runs": pairs / max(1, n),
        "sentences": ends / max(1, n),
    }, cls


def votes(n: int, stats: dict[str, float]) -> str:
    """One letter a labeller: g, b, or - where it abstains."""
    out = []
    for name, low, high, good, least in LABELLERS:
        x = stats[name]
        out.append("-" if n < least or low <= x <= high else "g" if (x < low) == (good == "low") else "b")
    return "".join(out)


def vector(n: int, stats: dict[str, float], cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features: runs of four character classes by their share, and each statistic by its tenth."""
    code = np.zeros(max(0, len(cls) - 3), np.uint32)
    for i in range(4):
        code = (code << np.uint32(4)) | cls[i : len(cls) - 3 + i]
    counts = np.bincount((code * np.uint32(2654435761)) >> np.uint32(21), minlength=FEATURES).astype(np.float32)
    norm = float(np.sqrt((counts * counts).sum()))
    if norm:
        counts /= norm
    for k, name in enumerate(STATS):
        tenth = min(10, int(stats[name] * 10)) + 11 * (n < LABELLERS[k][4])
        counts[((k * 22 + tenth) * 2654435761 & 0xFFFFFFFF) >> 21] += 1
    at = np.flatnonzero(counts)
    return at, counts[at]


def patterns(docs: DataFrame) -> list[tuple[str, int]]:
    """How many documents have each pattern of votes: at most 3 to the number of labellers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}
        for batch in batches:
            for t in batch.column(0).to_pylist():
                p = votes(*statistics(t or b"")[:2])
                found[p] = found.get(p, 0) + 1
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found)), pa.array(list(found.values()), pa.int64())], ["votes", "n"])

    rows = docs.select(F.col("text").cast("binary")).mapInArrow(run, "votes string, n long").groupBy("votes").agg(F.sum("n").alias("n"))
    return sorted((r.votes, r.n) for r in rows.collect())


def label_model(counted: list[tuple[str, int]], rounds: int = 100) -> tuple[dict[str, float], np.ndarray]:
    """The posterior of good of each pattern, and each labeller's share of right votes on good and on bad documents."""
    vote = np.array([["b-g".index(c) - 1 for c in p] for p, _ in counted]).reshape(len(counted), len(LABELLERS))
    n = np.array([k for _, k in counted], float)
    q = np.where((vote == -1).any(1), 0.1, 0.9)  # each kind of fault has its own labeller, so one bad vote counts at the start
    right = np.full((2, len(LABELLERS)), 0.8)
    for _ in range(rounds):
        for k, (own, w) in enumerate(((1, n * q), (-1, n * (1 - q)))):
            hit = (w[:, None] * (vote == own)).sum(0)
            cast = (w[:, None] * (vote != 0)).sum(0)
            right[k] = np.clip((hit + 0.5) / (cast + 1), 0.01, 0.999)
        prior = float(np.clip(((n * q).sum() + 1) / (n.sum() + 2), 0.05, 0.95))
        good = np.where(vote == 1, np.log(right[0]), np.where(vote == -1, np.log(1 - right[0]), 0)).sum(1)
        bad = np.where(vote == -1, np.log(right[1]), np.where(vote == 1, np.log(1 - right[1]), 0)).sum(1)
        q = 1 / (1 + np.exp(-np.clip(good - bad + np.log(prior / (1 - prior)), -50, 50)))
    return {p: float(x) for (p, _), x in zip(counted, q)}, right


def fit(docs: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """The posteriors by pattern and the scorer's weights, intercept last. An empty table gives weights of zero: every text scores a half and stays."""
    counted = patterns(docs)
    posterior, _ = label_model(counted)
    if not counted:
        return posterior, np.zeros(FEATURES + 1)
    hashed = docs.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("draw"), F.col("text").cast("binary").alias("text"))
    drawn = [d for d, in hashed.select("draw").distinct().orderBy("draw").limit(SAMPLE).collect()]
    some = hashed.filter(F.col("draw") <= drawn[-1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, at, x = [], [], []
            for t in batch.column(1).to_pylist():
                n, stats, cls = statistics(t or b"")
                q.append(posterior.get(votes(n, stats), 0.5))
                a, v = vector(n, stats, cls)
                at.append(a.astype(np.int16))
                x.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(q, pa.float64()), pa.array(at, pa.list_(pa.int16())), pa.array(x, pa.list_(pa.float32()))], ["draw", "q", "at", "x"])

    some = some.dropDuplicates(["draw"])  # copies of a text are one example; as texts differ by their hash, at most SAMPLE rows
    rows = some.mapInArrow(run, "draw long, q double, at array<short>, x array<float>").orderBy("draw", "q").limit(SAMPLE).toArrow()
    q = rows.column("q").to_numpy()
    at, x = (np.concatenate([c.flatten().to_numpy() for c in rows.column(k).chunks]).astype(kind) for k, kind in (("at", np.int64), ("x", np.float64)))
    size = np.concatenate([c.value_lengths().to_numpy() for c in rows.column("at").chunks])
    row = np.repeat(np.arange(len(size)), size)
    w, b = np.zeros(FEATURES), 0.0
    g2, gb2 = np.full(FEATURES, 1e-8), 1e-8
    for _ in range(200):  # full-batch steps with a rate for each weight
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, x * w[at], len(q)) + b, -30, 30)))
        d = (p - q) / len(q)
        g, gb = np.bincount(at, x * d[row], FEATURES) + 1e-5 * w, float(d.sum())
        g2, gb2 = g2 + g * g, gb2 + gb * gb
        w, b = w - 0.5 * g / np.sqrt(g2), b - 0.5 * gb / np.sqrt(gb2)
    return posterior, np.r_[w, b]


def verdict(text: bytes | None, model: tuple[dict[str, float], np.ndarray]) -> tuple[float, float, int]:
    """Posterior of the text's pattern, score, and 1 if it is good."""
    posterior, weights = model
    n, stats, cls = statistics(text or b"")
    at, x = vector(n, stats, cls)
    s = float(1 / (1 + np.exp(-np.clip(float(weights[at] @ x) + weights[-1], -500, 500))))
    return posterior.get(votes(n, stats), 0.5), s, int(s >= THRESHOLD)


_ROW = "doc_id long, posterior double, score double, predicted int"


def score(docs: DataFrame, model: tuple[dict[str, float], np.ndarray]) -> DataFrame:
    """doc_id, posterior (weak label), score and predicted (1: good) of each whole text.

    Null counts as empty; equal texts score alike, repeated rows keep a row each, an empty table has none.
    """
    send = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [verdict(t, send.value) for t in batch.column(1).to_pylist()]
            if out:
                types = [pa.float64(), pa.float64(), pa.int32()]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*out), types))], [x.split()[0] for x in _ROW.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, _ROW)


def keep(docs: DataFrame, model: tuple[dict[str, float], np.ndarray]) -> DataFrame:
    """The rows of docs that are good, with all their columns."""
    send = docs.sparkSession.sparkContext.broadcast(model)
    return keep_rows(docs, lambda t: verdict(t, send.value)[2] == 1)
