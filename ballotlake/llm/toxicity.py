"""Toxic passages: significant maximum-scoring segments of token log-odds.

Log-odds of tokens by class come from documents that hold them, with a Dirichlet prior in proportion to
their counts in all documents (its weight a share of each class, so that rare tokens stay near zero). Words and the starts of
words are tokens, so that a stem counts in forms that were not learned; a word scores by its best token.
A token scores its log-odds where they speak for toxicity and are significant; those of all others, most of which tell
languages apart and not toxicity, are taken as zero and cost a little. A linear scan finds all maximal segments of a text;
their scores follow an extreme-value law on clean text. Its rate is the root of the score's mean, its constant is
fitted to the best segments of the clean rows. They give each segment an expected number, and the segments
together the evidence that a logistic curve turns into a probability.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep_rows, materialize

LABELLED = 60_000  # distinct labelled texts that are learned from, at most: a bounded sample by hash of doc_id
BROADCAST = 500_000  # tokens that tasks are told to look for, at most: beyond it they count all
HELD = 300_000  # distinct tokens that a counting task holds before it sends them
PRIOR = 0.1  # the prior's weight against the class
Z = 3.0  # standard errors from zero at which a token counts
DRIFT = 0.5  # what any other token costs
STARTS = range(4, 9)  # bytes of a word's starts that are tokens
THRESHOLD = 0.7
_STRIP = b".,;:!?*%$&#|\"'()[]{}<>-_=+/\\`~@^"


def words(text: bytes) -> list[bytes]:
    """The words of a text as bytes, A-Z lower-cased; marks around them are not part of a token."""
    return text.lower().split()


def starts(word: bytes) -> list[bytes]:
    """The starts of a word that are tokens, told from whole words by the blank that ends them."""
    return [word[:k] + b" " for k in STARTS if k < len(word)]


def segments(at: np.ndarray, gain: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of tokens that gain at places at, and lose drift elsewhere.

    The linear-time scan keeps candidates with their left and right cumulative sums, and merges back.
    """
    stack: list[list] = []  # first, last, sum before, sum after, index of the nearest one with a lower sum before
    total = 0.0
    before = -1
    for i, g in zip(at.tolist(), gain.tolist()):
        total -= drift * (i - before - 1)
        item = [i, i, total, total + g, -1]
        total, before = total + g, i
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= item[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= item[3]:
                item[4] = j
                stack.append(item)
                break
            item[0], item[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - l) for a, b, l, r, _ in stack]


class Model:
    """Log-odds of significant tokens, and the extreme-value and logistic parameters."""

    def __init__(self, gains: dict[bytes, float], rate: float, scale: float, intercept: float = 0.0, slope: float = 0.0):
        self.gains, self.rate, self.scale, self.intercept, self.slope = gains, rate, scale, intercept, slope
        self.memo: dict[bytes, float] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}}

    def scored(self, tokens: list[bytes]) -> list[tuple[int, int, float]]:
        """All maximal segments: first, last, score, in words."""
        memo, gains = self.memo, self.gains
        if len(memo) > 400_000:
            memo.clear()
        hits, gain = [], []
        for i, w in enumerate(tokens):
            g = memo.get(w)
            if g is None:
                word = w.strip(_STRIP)
                g = memo[w] = max(gains.get(x, 0.0) for x in (word, *starts(word)))
            if g:
                hits.append(i)
                gain.append(g)
        return segments(np.array(hits), np.array(gain), DRIFT) if hits else []

    def passages(self, tokens: list[bytes]) -> list[tuple[int, int, float]]:
        """first, last, expected number on clean text of each significant passage, in words."""
        found = self.scored(tokens)
        room = np.log(self.scale * max(1, len(tokens)))
        return [(a, b, float(np.exp(np.clip(room - self.rate * s, -700, 700)))) for a, b, s in found if room - self.rate * s < 0]

    def evidence(self, passages: list[tuple[int, int, float]]) -> float:
        """Minus the log of the passages' joint expected number, at its best number of passages."""
        logs = np.sort([-np.log(max(e, 1e-300)) for *_, e in passages])[::-1]
        sums = np.cumsum(logs) + np.cumsum(np.log(np.arange(1, len(logs) + 1)))
        return float(min(60.0, sums.max())) if len(logs) else 0.0

    def score(self, evidence: float) -> float:
        return float(1 / (1 + np.exp(-(self.intercept + self.slope * evidence))))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


SHINGLE = 5  # words of a run in near_keys


def near_keys(tokens: list[bytes], word: dict[bytes, int]) -> list[int]:
    """Three keys, each of two minima over the runs of SHINGLE words; word gives each word's hash.

    Texts that share 0.8 of their runs agree in one of the keys with probability 0.95; unrelated texts have no runs in common."""
    h = np.array([word[w] for w in tokens] or [0], np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    runs = np.zeros(n, np.uint64)
    for k in range(min(SHINGLE, len(h))):
        runs = (runs ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        runs ^= runs >> np.uint64(29)
    least = []
    for seed in range(1, 7):
        x = (runs + np.uint64(seed * 0x632BE59BD9B4E019 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        least.append((x ^ (x >> np.uint64(30))).min())
    least = np.array(least, np.uint64)
    return (least[::2] * np.uint64(3) + least[1::2]).view(np.int64).tolist()


def one_of_each(rows: DataFrame) -> DataFrame:
    """label, text of one row for each set of near copies: near copies would make each of their words look significant."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = _Memo(lambda w: xxhash.xxh64_intdigest(w))
        for batch in batches:
            found = [near_keys(words(t), word) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in np.array(found, np.int64).reshape(-1, 3).T)], ["key", "label", "a", "b", "c"])

    left = rows.select("key", "label", "text").mapInArrow(run, "key binary, label int, a long, b long, c long")  # LABELLED rows at most
    for by in ("a", "b", "c"):
        left = left.groupBy("label", by).agg(F.min(F.struct("key", *(k for k in "abc" if k != by))).alias("row")).select("label", by, "row.*")
    return rows.join(left.select("key", "label"), ["key", "label"], "left_semi").select("label", "text")


def training_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """label, text, key: learned rows, one for each distinct text and label, at most LABELLED; case of A-Z and blanks make no other text.

    A doc_id with several labels has the largest of them."""
    chosen = labels.filter(F.col(label).isNotNull() & ~held_out()).select(F.col("doc_id").cast("long"), F.col(label).cast("int").alias("label")).groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).filter("doc_id is not null and text is not null")

    def keys(texts: pa.Array) -> pa.Array:
        return pa.array([xxhash.xxh3_128_digest(b" ".join(words(t))) for t in texts.to_pylist()], pa.binary())

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), keys(batch.column(1))], ["doc_id", "key"])

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # a doc_id can have several texts
        for batch in batches:
            yield batch.filter(pa.array([a == b for a, b in zip(keys(batch.column(2)).to_pylist(), batch.column(3).to_pylist())], pa.bool_()))

    own = rows.filter(~held_out()).mapInArrow(key, "doc_id long, key binary").join(chosen, "doc_id")
    first = own.groupBy("key", "label").agg(F.min("doc_id").alias("doc_id")).orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(LABELLED)
    first = materialize(first, "learned")  # the broadcast is bounded by LABELLED
    texts = rows.join(F.broadcast(first), "doc_id").select("doc_id", "label", "text", "key").mapInArrow(same, "doc_id long, label int, text binary, key binary")
    return texts.dropDuplicates(["key", "label"]).select("label", "text", "key")


class _Memo(dict):
    """What make gives of each word, kept for the next document."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, w: bytes):
        if len(self) > 200_000:
            self.clear()
        self[w] = out = self.make(w)
        return out


WORDS = b" "  # counts a row's distinct words; no token is a blank alone


def token_counts(texts: DataFrame, name: str, wanted: set[bytes] | None = None) -> DataFrame:
    """token, and in how many rows of texts (one binary column) each wanted token is (all of them if None), with WORDS."""
    send = texts.sparkSession.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        these, found, n = send.value, Counter(), 0
        bare = _Memo(lambda w: w.strip(_STRIP))
        of = _Memo(lambda w: tuple(x for x in (w, *starts(w)) if these is None or x in these) if w else ())
        for batch in batches:
            for text in batch.column(0).to_pylist():
                own = set(map(bare.__getitem__, set(words(text))))
                n += len(own) - (b"" in own)
                found.update(set().union(*map(of.__getitem__, own)))
                if len(found) > HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["token", name])
                    found.clear()
        found[WORDS] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["token", name])

    return materialize(texts.mapInArrow(count, f"token binary, {name} long").groupBy("token").agg(F.sum(name).alias(name)), f"{name}-tokens")


def _few(tokens: DataFrame) -> set[bytes] | None:
    """The tokens of a table, or None if they are more than BROADCAST."""
    found = tokens.select("token").limit(BROADCAST + 1).collect()
    return {bytes(t) for t, in found} if len(found) <= BROADCAST else None


def least_rows(toxic: int, clean: int) -> int:
    """In how many toxic rows a token of no clean row must be to count, whatever its prior."""
    p = np.logspace(-9, 6, 3000)
    t = 1
    while t < 1000:
        left = np.maximum(1 - (t + p) / (toxic * (1 + PRIOR)), 1e-9)
        z = (np.log((t + p) / p) - np.log(left)) / np.sqrt(1 / (t + p) + toxic / (clean * p))
        if z.max() >= 0.99 * Z:
            break
        t += 1
    return t


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not below zero) of the likeliest curve, with a small ridge; w rows each have x and y.

    Newton's steps are halved until they lower the loss: whole ones circle for good where x tells the labels apart.
    """

    def loss(c: np.ndarray) -> float:
        z = c[0] + c[1] * x
        return float((w * (np.logaddexp(0, z) - y * z)).sum() + 0.005 * (c @ c))

    c = np.array([0.0, 0.0])
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(c[0] + c[1] * x, -30, 30)))
        g = np.array([(w * (y - p)).sum(), (w * (y - p) * x).sum()]) - 0.01 * c
        v = w * p * (1 - p)
        step = np.linalg.solve([[v.sum() + 0.01, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.01]], g)
        while loss(c + step) > loss(c) and np.abs(step).max() > 1e-9:
            step /= 2
        c = c + step
        if np.abs(step).max() < 1e-9:
            break
    return float(c[0]), max(0.0, float(c[1]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    """A model from labelled documents of the learned folds; without any of either class, one that scores low."""
    rows = materialize(training_rows(docs, labels, label), "toxic-rows")
    rows = materialize(one_of_each(rows), "toxic-apart")
    clean = token_counts(rows.filter("label = 0").select("text"), "clean")
    toxic = token_counts(rows.filter("label = 1").select("text"), "toxic")
    n0, n1 = (t.filter(F.col("token") == F.lit(WORDS)).agg(F.sum(name)).first()[0] for t, name in ((clean, "clean"), (toxic, "toxic")))
    if not n0 or not n1:
        return Model({}, 1.0, 1.0, -5.0, 0.0)
    # no other token can reach Z
    possible = toxic.filter((F.col("toxic") >= least_rows(n1, n0)) & (F.col("token") != F.lit(WORDS)))
    both = possible.join(clean, "token", "left").fillna(0, ["clean"])

    def z_at(own: float) -> F.Column:  # of a token whose prior count among toxic rows is own
        t, c = F.col("toxic") + own, F.col("clean") + own * n0 / n1
        return (F.log(t / (n1 + PRIOR * n1 - t)) - F.log(c / (n0 + PRIOR * n0 - c))) / F.sqrt(1 / t + 1 / c)

    # the labelled rows leave few tokens that some number in the corpus could make significant: only these are counted in all documents
    likely = both.filter(F.greatest(*map(z_at, np.geomspace(1e-9, PRIOR * n1 / 2, 60).tolist())) >= 0.95 * Z)
    likely = materialize(likely, "likely-tokens")
    corpus = token_counts(docs.filter("text is not null").select(F.col("text").cast("binary")), "n", _few(likely))
    everything = corpus.filter(F.col("token") == F.lit(WORDS)).agg(F.sum("n")).first()[0]
    n = (n0, n1)
    counts = likely.join(corpus, "token")

    def prior(size: int) -> F.Column:  # each class is drawn alike to the corpus, however the copies of a text swell it
        return PRIOR * size * F.col("n") / everything

    def log_odds(own: str, size: int) -> F.Column:
        seen = F.col(own) + prior(size)
        return F.log(seen / (size + PRIOR * size - seen))

    delta = log_odds("toxic", n[1]) - log_odds("clean", n[0])
    z = delta / F.sqrt(1 / (F.col("toxic") + prior(n[1])) + 1 / (F.col("clean") + prior(n[0])))
    significant = (F.col("z") >= Z) & (F.col("delta") > 1.0)
    # as many as the labelled rows, of which there are LABELLED at most, can make significant
    picked = counts.withColumn("delta", delta).withColumn("z", z).filter(significant).orderBy("token").select("token", "delta", "clean").collect()
    gains = {bytes(t): float(d) for t, d, _ in picked}
    # the law of clean text: tokens that gain are as rare as they are there, one more for what was not seen
    hits = np.array([c for *_, c in picked] + [1.0])
    gain = np.array([d for _, d, _ in picked] + [max([d for _, d, _ in picked], default=1.0)])
    share = hits / max(2 * hits.sum(), n0)
    low, high = 1e-6, 50.0
    for _ in range(100):  # the positive root of the mean of exp(rate * score) = 1
        rate = (low + high) / 2
        low, high = (rate, high) if (share * np.exp(np.minimum(rate * gain, 700))).sum() + (1 - share.sum()) * np.exp(-rate * DRIFT) < 1 else (low, rate)
    model, least = Model(gains, rate, 1.0), float(gain.min())

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, left = 0, 0.0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                own = words(t)
                scores = [x for *_, x in model.scored(own)]
                found += bool(scores)
                left += max(1, len(own)) * float(np.exp(-rate * max(scores, default=least)))
        yield pa.RecordBatch.from_arrays([pa.array([found]), pa.array([left])], ["found", "left"])

    # the likeliest constant: a clean text of n words has no segment over s with probability exp(-constant n exp(-rate s));
    # a text without any is only known to have none over the least gain
    found, left = rows.filter("label = 0").select("text").mapInArrow(best, "found long, left double").agg(F.sum("found"), F.sum("left")).first()
    model.scale = float((found + 1) / (left + 1))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [round(2 * model.evidence(model.passages(words(t)))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.int32())], ["label", "x"])

    seen = rows.filter("label in (0, 1)").mapInArrow(gather, "label int, x int").groupBy("label", "x").count().collect()  # at most 2 * 121 rows
    y, x, w = (np.array(c, float) for c in zip(*seen))
    x = x / 2
    model.intercept, model.slope = logistic(x, y, w)
    return model


_ROW = "doc_id long, score double, predicted int, n_passages int, passages array<struct<first:int,last:int,expected:double>>"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted, n_passages and the significant passages (in words) of each whole text.

    Null counts as empty, which has no passage and scores lowest; repeated rows keep a row each, an empty table
    none. Texts of any length are scanned whole.
    """
    send = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = send.value
        for batch in batches:
            found = [m.passages(words(t or b"")) for t in batch.column(1).to_pylist()]
            scores = [m.score(m.evidence(p)) for p in found]
            spans = [[{"first": a, "last": b, "expected": e} for a, b, e in p] for p in found]
            kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("expected", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32()), pa.array(map(len, found), pa.int32()), pa.array(spans, kind)], [x.split()[0] for x in ("doc_id", "score", "predicted", "n_passages", "passages")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, _ROW)


def keep(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that are not predicted toxic, with all their columns."""
    send = docs.sparkSession.sparkContext.broadcast(model)

    def clean(text: bytes | None) -> bool:
        m = send.value
        return m.score(m.evidence(m.passages(words(text or b"")))) < THRESHOLD

    return keep_rows(docs, clean)
