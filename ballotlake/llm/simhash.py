"""SimHash near-duplicates, with candidates pruned by the pigeonring principle.

A fingerprint has eight one-byte segments on a ring. If two fingerprints differ in at most three bits,
then from some segment on every chain of l segments differs in at most floor(3 l / 8) bits: chains of
one and two segments agree, those of three to five differ in at most one bit, six and seven in two.
The first five segments of such a chain give equality keys: the two leading bytes, and one of the two
12-bit halves of the next three (one bit cannot spoil both). Candidates share a key, then must keep the
chain's budgets, and only then is the whole Hamming distance counted. The scheme loses no pair.

That is `near_duplicates`. `similar_components` and `keep_first` link by a Jaccard of shingle sets of 0.8 or more, which
64 bits cannot tell: wide fingerprints are checked along the ring, and what passes is compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, map_batches, materialize
from .wide import BANDS, LANES, homes, jaccard, majority, near_pairs, own_pairs, shingles, signature

BITS = 3
BLOCK = 2048
WIDE_BLOCK = 1024  # two blocks have at most two million pairs in memory
PART = 256  # sets of a part, about; two parts are compared in one task
HELD = 32 << 20  # bytes of shingle hashes in a part, about


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """The majority bit of the XXH64 of each shingle, as a signed long; 0 for a text without words."""
    return majority(shingles(text, words, seed))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, tie (a hash of the text), fp (signed long) of every whole text; null counts as empty."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fp = [fingerprint(t or b"", words) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(fp, pa.int64())], ["doc_id", "tie", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), _tie(), F.col("text").cast("binary")), run, "doc_id long, tie long, fp long")


def _tie() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie")


def _keys(fps: DataFrame) -> DataFrame:
    """key, fp: the sixteen keys of each fingerprint; bits 28 and up of a key tell its kind."""
    parts = []
    for i in range(8):
        rot = F.shiftleft("fp", 8 * i).bitwiseOR(F.shiftrightunsigned("fp", 64 - 8 * i)) if i else F.col("fp")
        near = F.shiftrightunsigned(rot, 36)
        far = F.shiftleft(F.shiftrightunsigned(rot, 48), 12).bitwiseOR(F.shiftrightunsigned(rot, 24).bitwiseAND(F.lit(0xFFF)))
        parts += [near + F.lit((2 * i) << 28), far + F.lit((2 * i + 1) << 28)]
    return fps.select(F.explode(F.array(*parts)).alias("key"), "fp")


def _rings(key: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The differing bits x, turned so that the chain of the key starts at the top."""
    turn = ((key >> 29) * 8).astype(np.uint64)
    return (x << turn) | np.where(turn > 0, x >> ((np.uint64(64) - turn) & np.uint64(63)), np.uint64(0))


def link_sorted(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of each run of equal keys, as stars: one link a member at most."""
    n = len(key)
    root = np.arange(n)
    at, d = np.arange(n), 0
    while True:
        d += 1
        at = at[at + d < n]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        pair = at[root[at] != root[at + d]]
        for budget, bits in ((24, 1), (8, 2), (0, BITS)):  # chains of five, seven and eight segments
            ring = _rings(key[pair], fp[pair] ^ fp[pair + d]) >> np.uint64(budget)
            pair = pair[np.bitwise_count(ring) <= bits]
        for a, b in zip(root[pair].tolist(), root[pair + d].tolist()):
            while root[a] != a:
                a = int(root[a])
            while root[b] != b:
                b = int(root[b])
            root[max(a, b)] = min(a, b)
        if len(pair):
            while (root[root] != root).any():
                root = root[root]
    off = np.flatnonzero(root != np.arange(n))
    return fp[root[off]], fp[off]


def _link_partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, block, fp) in the order of key and block. A run of both is at most about two blocks long."""
    key = block = np.empty(0, np.int64)
    fp = np.empty(0, np.uint64)

    def out(hi: int) -> pa.RecordBatch:
        run = np.cumsum(np.r_[0, (np.diff(key[:hi]) != 0) | (np.diff(block[:hi]) != 0)])
        # a run's own number keeps blocks of one key apart; the kind of key stays in the upper bits
        a, b = link_sorted((key[:hi] >> 28 << 28) + run, fp[:hi])
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        key = np.r_[key, batch.column(0).to_numpy()]
        block = np.r_[block, batch.column(1).to_numpy()]
        fp = np.r_[fp, batch.column(2).to_numpy().view(np.uint64)]
        last = np.flatnonzero((key != key[-1]) | (block != block[-1])) if len(key) else []
        if len(last):
            hi = int(last[-1]) + 1
            yield out(hi)
            key, block, fp = key[hi:], block[hi:], fp[hi:]
    if len(key):
        yield out(len(key))


def links(fps: DataFrame) -> DataFrame:
    """a, b: links that connect all distinct fingerprints (column fp) within three bits of each other.

    A key of more than BLOCK fingerprints is dealt as pairs of blocks, so that no task holds more than two.
    """
    return _dealt(_keys(fps), "fp", BLOCK).mapInArrow(_link_partitions, "a long, b long").distinct()


def _dealt(keys: DataFrame, name: str, size: int) -> DataFrame:
    """key, block and the other columns of keys, in the order of key and block; name tells the rows of a key apart."""
    return _placed(keys, name, F.ceil(F.count("*") / size)).drop("own", "other").repartition("key", "block").sortWithinPartitions("key", "block")


def _placed(keys: DataFrame, name: str, blocks: Column) -> DataFrame:
    """key, block, own, other and the other columns of keys: a row's own block of its key and each other one, as many as blocks says of a key's rows."""
    hot = materialize(keys.groupBy("key").agg(blocks.alias("blocks")).filter("blocks > 1"), "simhash-hot")
    own = F.pmod(F.xxhash64(name), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    rest = [c for c in keys.columns if c != "key"]
    return (
        keys.join(hot, "key", "left")
        .select("key", *rest, F.coalesce("blocks", F.lit(1).cast("long")).alias("blocks"))
        .select("key", *rest, "blocks", own.alias("own"), other.alias("other"))
        .select("key", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("block"), "own", "other", *rest)
    )


def components(edges: DataFrame) -> DataFrame:
    """node, label: the least node that each node of edges (a, b) reaches, by large-star and small-star rounds.

    Every round is a join and a minimum by node, and is written. A hub's edges meet in one task, unless the join is split as it runs.
    """
    e = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "star")
    seen = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter("v > u and v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()
        e = materialize(small, "star")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        seen = now


def _labelled(fps: DataFrame, first) -> DataFrame:
    """fp, first, label: each distinct fingerprint, what `first` makes of its rows, and the fingerprint that names its component."""
    distinct = materialize(fps.groupBy("fp").agg(first.alias("first")), "simhash-distinct")
    label = components(links(distinct.select("fp"))).withColumnRenamed("node", "fp")
    return distinct.join(label, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))


def near_duplicates(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs (doc_id, text, any others).

    Null and empty texts have fingerprint zero and link like any other; rows with one doc_id or one text
    keep a row each. A null doc_id gives a row with its component's smallest id, null if it has none.
    """
    fps = materialize(fingerprints(docs, words), "simhash")
    labelled = _labelled(fps, F.min("doc_id"))
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    member = labelled.join(least, "label").select("fp", "component_id")
    return fps.join(member, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def signatures(docs: DataFrame, words: int = 5) -> DataFrame:
    """doc_id, tie, node (the text's hash; 0 for all texts without words), sig (see wide; empty without words)."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sig = [signature(t or b"", words) for t in batch.column(2).to_pylist()]
        node = pa.array([x if s else 0 for x, s in zip(batch.column(1).to_pylist(), sig)], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), node, pa.array(sig, pa.list_(pa.int64()))], ["doc_id", "tie", "node", "sig"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), _tie(), F.col("text").cast("binary")), run, "doc_id long, tie long, node long, sig array<long>")


def _pair_partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (key, block, node, fingerprint words) in the order of key and block: see near_pairs.

    The rows that have more pairs come as pairs with themselves. A pair's home is a number of its key and block.
    """
    held = None

    def out(rows: np.ndarray) -> pa.RecordBatch:
        run = np.cumsum(np.r_[0, (np.diff(rows[:, :2], axis=0) != 0).any(axis=1)])
        words = np.ascontiguousarray(rows[:, 3 : 3 + LANES]).view(np.uint32)
        a, b, more = near_pairs(run, words)
        left, right = np.r_[a, more], np.r_[b, more]
        return pa.RecordBatch.from_arrays([pa.array(rows[left, 2]), pa.array(rows[right, 2]), pa.array(homes(rows[left, 0], rows[left, 1]))], ["a", "b", "home"])

    for batch in batches:
        new = np.stack([c.to_numpy() for c in batch.columns], axis=1)
        held = new if held is None else np.concatenate([held, new])
        last = np.flatnonzero((held[:, :2] != held[-1, :2]).any(axis=1)) if len(held) else []
        if len(last):
            hi = int(last[-1]) + 1
            yield out(held[:hi])
            held = held[hi:]
    if held is not None and len(held):
        yield out(held)


def shingle_sets(texts: DataFrame, words: int = 5) -> DataFrame:
    """node, n, hashes of texts (node, text): the distinct shingle hashes in order, as the bytes of unsigned longs."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingles(t, words)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], ["node", "n", "hashes"])

    return map_batches(texts.select("node", "text"), run, "node long, n long, hashes binary")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float = 0.8) -> DataFrame:
    """The pairs (a, b, home) of nodes whose sets (node, n, hashes) have this Jaccard or more.

    Pairs of one home meet in one task, so a set travels once a home and not once a pair. A home with more sets than
    PART, or with more bytes than HELD, is dealt as pairs of parts.
    """
    used = pairs.select("home", F.explode(F.array("a", "b")).alias("node")).distinct().join(sets.select("node", "n"), "node")
    parts = F.ceil(F.greatest(F.count("*") / PART, F.sum("n") * 8 / HELD)).alias("parts")
    large = materialize(used.groupBy("home").agg(parts).filter("parts > 1"), "simhash-parts")
    left, right = F.pmod(F.xxhash64("a"), "parts"), F.pmod(F.xxhash64("b"), "parts")
    dealt = (
        pairs.join(large, "home", "left")
        .select("home", "a", "b", F.coalesce("parts", F.lit(1).cast("long")).alias("parts"))
        .select("home", (F.least(left, right) * F.col("parts") + F.greatest(left, right)).alias("block"), "a", "b")
    )
    member = dealt.select("home", "block", F.explode(F.array("a", "b")).alias("node")).distinct().join(sets, "node")
    rows = member.select("home", "block", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "hashes")
    rows = rows.unionByName(dealt.withColumn("hashes", F.lit(None).cast("binary")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}  # the sets of a block come before its pairs
        for batch in batches:
            keep = []
            for home, block, a, b, hashes in zip(*(c.to_pylist() for c in batch.columns)):
                if (home, block) != at:
                    at, held = (home, block), {}
                if b is None:
                    held[a] = np.frombuffer(hashes, np.uint64)
                keep.append(b is not None and jaccard(held[a], held[b], similarity) >= similarity)
            yield batch.select([2, 3]).filter(pa.array(keep, pa.bool_()))

    order = ["home", "block", F.col("b").asc_nulls_first()]
    return rows.repartition("home", "block").sortWithinPartitions(*order).mapInArrow(run, "a long, b long")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows anew, so that no two batches share a run of equal first and second columns."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in filter(len, batches):
        at = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
        starts = np.flatnonzero(np.r_[last is None or (at[0] != last).any(), (np.diff(at, axis=0) != 0).any(axis=1)])
        last = at[-1]
        if len(starts):
            if held or starts[-1]:
                yield pa.concat_batches([*held, batch.slice(0, int(starts[-1]))])
            held, batch = [], batch.slice(int(starts[-1]))
        held.append(batch)
    if held:
        yield pa.concat_batches(held)


def similar_apart(nodes: DataFrame, sets: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Links (a, b) that join the labels of nodes (node, sig, label) as all pairs of this similarity under a shared key do.

    Pairs are compared in the task that finds them, by sets (node, n, hashes) that travel to the members of a key, so only links
    leave it: fewer than it has labels. A pair is compared under one of its keys, and not at all once its labels are joined. Only keys of two labels are
    dealt; one with more than WIDE_BLOCK nodes, or more bytes of sets than HELD, as pairs of blocks.
    """
    keys = nodes.join(sets.select("node", "n"), "node").select(F.posexplode(F.slice("sig", LANES + 1, BANDS)).alias("band", "key"), "node", "label", "n")
    mixed = materialize(keys.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo < hi").select("key"), "simhash-mixed")
    blocks = F.ceil(F.greatest(F.count("*") / WIDE_BLOCK, F.sum("n") * 8 / HELD))
    placed = _placed(keys.join(mixed, "key", "left_semi"), "node", blocks).drop("n", "label")
    rows = placed.join(nodes.join(sets.select("node", "hashes"), "node"), "node").select("key", "block", "own", "other", F.col("band").cast("long"), "node", "label", "sig", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}  # of labels that this task's links join

        def top(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        for batch in _runs(batches):
            key, block, own, other, band, node, label = (c.to_numpy() for c in batch.columns[:7])
            sig = batch.column(7).flatten().to_numpy().reshape(-1, LANES + BANDS)
            at = np.cumsum(np.r_[0, (np.diff(key) != 0) | (np.diff(block) != 0)])
            wanted = own_pairs(band, sig[:, LANES:], node, own, other)
            left, right, _ = near_pairs(at, np.ascontiguousarray(sig[:, :LANES]).view(np.uint32), label, wanted)
            found, hashes = [], batch.column(8)
            for i, j, x, y in zip(left.tolist(), right.tolist(), label[left].tolist(), label[right].tolist()):
                x, y = top(x), top(y)
                if x != y and jaccard(*(np.frombuffer(hashes[k].as_buffer(), np.uint64) for k in (i, j)), similarity) >= similarity:
                    root[max(x, y)] = min(x, y)
                    found.append((i, j))
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], ["a", "b"])

    return rows.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(run, "a long, b long")


def similar_components(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, tie, node, label of every row of docs: texts that are linked, step by step, by this similarity share a label.

    Texts are told apart by a hash. A bucket first gives a spanning forest of its nearest pairs, which is compared
    exactly by its sorted shingle hashes; then only pairs of texts that these links leave apart, in the task that finds them (similar_apart). So
    no pair that is no link becomes a row, but those of the forest. Texts without words are alike, and like no others.
    """
    sigs = materialize(signatures(docs, words), "simhash-wide")
    nodes = sigs.filter("node <> 0").groupBy("node").agg(F.any_value("sig").alias("sig"))
    lanes = [F.element_at("sig", i + 1).alias(f"f{i}") for i in range(LANES)]
    key = F.explode(F.slice("sig", LANES + 1, BANDS)).alias("key")

    pairs = _dealt(nodes.select(key, "node", *lanes), "node", WIDE_BLOCK).mapInArrow(_pair_partitions, "a long, b long, home long")
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "home")
    forest = materialize(pairs.groupBy("a", "b").agg(F.min("home").alias("home")), "simhash-forest")
    used = forest.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    texts = docs.select(_tie().alias("node"), F.col("text").cast("binary").alias("text")).join(used, "node", "left_semi").dropDuplicates(["node"])
    sets = materialize(shingle_sets(texts, words), "simhash-sets")
    first = materialize(similar(forest.filter("a <> b"), sets, similarity), "simhash-links")
    more = forest.filter("a = b").select(F.col("a").alias("node"))
    named = components(first).select(F.col("node").alias("of"), "label")
    labelled = nodes.join(more, "node").join(named, F.col("node") == F.col("of"), "left").select("node", "sig", F.coalesce("label", "node").alias("label"))
    links = first.unionByName(similar_apart(materialize(labelled, "simhash-apart"), sets, similarity))
    label = components(links).withColumnRenamed("node", "of")
    return sigs.join(label, F.col("node") == F.col("of"), "left").select("doc_id", "tie", "node", F.coalesce("label", "node").alias("label"))


def keep_first(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of each component, with all columns of docs: that of the smallest doc_id (null last), then of the least text hash.

    Rows are told apart by id and text: different texts under one id, or without an id, stand for themselves. Of
    rows alike in both one stays, whichever its other columns are. Null and empty texts, and those without words,
    are one component; an empty table gives none.
    """
    own, tie = fresh(docs, "own"), fresh(docs, "tie")
    labelled = materialize(similar_components(docs, words, similarity), "simhash-labels")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie"))
    winner = materialize(labelled.groupBy("label").agg(first.alias("first")).select("first.doc_id", "first.tie"), "simhash-first")
    alike = labelled.groupBy("doc_id", "tie").count().filter("count > 1").select("doc_id", "tie")
    named = winner.select(F.col("doc_id").alias(own), F.col("tie").alias(f"{tie}_"))
    kept = docs.withColumn(tie, _tie()).join(named, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.col(tie) == F.col(f"{tie}_")), "left_semi")
    return (kept if alike.isEmpty() else kept.dropDuplicates(["doc_id", tie])).select(*docs.columns)
