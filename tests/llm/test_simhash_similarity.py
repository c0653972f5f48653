"""Links at a five-word Jaccard of 0.8 or more against all pairs, in hot buckets and over odd rows."""

import random
from itertools import combinations

import numpy as np

from ballotlake.llm import simhash, wide
from ballotlake.llm.common import table


def plain_labels(texts: dict, words: int = 5, least: float = 0.8) -> dict:
    """The smallest id that each text reaches by links between sets of word runs; texts without words are alike."""
    sets = {}
    for i, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + words]) for k in range(max(len(w) - words, 0) + 1)} if w else set()
    label = {i: i for i in texts}
    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if sets[a] == sets[b] or both >= least * (len(sets[a]) + len(sets[b]) - both) > 0:
            x, y = sorted((label[a], label[b]))
            if x != y:
                label = {i: x if v == y else v for i, v in label.items()}
    return label


def _kept(df):
    return sorted(r.doc_id for r in df.collect())


def test_kept_equal_all_pairs(spark, data):
    docs = table(spark, data, "documents")
    label = plain_labels({r.doc_id: r.text for r in docs.collect()})
    assert _kept(simhash.keep_first(docs)) == sorted(set(label.values()))


def _variants(n: int, share: float) -> dict:
    """Texts that each differ from one text in this share of its words."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(3000)}" for _ in range(300)]
    return {i: " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in base) for i in range(n)}


def test_hot_bucket_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "WIDE_BLOCK", 8)
    texts = _variants(60, 0.012) | {100 + i: t for i, t in _variants(60, 0.03).items()}
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string").repartition(3)
    assert _kept(simhash.keep_first(docs)) == sorted(set(plain_labels(texts).values()))


def test_odd_rows(spark):
    long_text = " ".join(f"word{i % 997}of{i}" for i in range(60_000))
    rows = [(1, None), (2, ""), (3, " \t "), (4, "one"), (5, "ONE"), (6, "one two"), (None, "one two"), (7, long_text), (8, long_text + " end"), (9, "one"), (9, "one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert _kept(simhash.keep_first(docs)) == [1, 4, 6, 7]
    assert simhash.keep_first(docs.limit(0)).count() == 0
    assert simhash.keep_first(spark.createDataFrame(rows[:3], docs.schema)).count() == 1


def test_keys_and_bits_reach_the_threshold():
    rng = np.random.default_rng(3)
    missed = 0
    for _ in range(400):  # 80 runs of words in common, ten more on each side: a Jaccard of 0.8
        both, a, b = (b" ".join(b"t%d" % x for x in rng.integers(0, 1 << 40, n)) for n in (80, 10, 10))
        left, right = wide.signature(both + b" " + a, 1), wide.signature(both + b" " + b, 1)
        f = np.array([left[: wide.LANES], right[: wide.LANES]]).view(np.uint32)
        found = len(wide.near_pairs(np.zeros(2, np.int64), f)[0]) == 1
        missed += not (found and set(left[wide.LANES :]) & set(right[wide.LANES :]))
    assert missed <= 1


def test_sets_of_a_home_in_parts(spark, monkeypatch):
    texts = _variants(40, 0.012) | {100 + i: t for i, t in _variants(40, 0.03).items()}
    docs = spark.createDataFrame(sorted(texts.items()), "node long, text string")
    nodes = docs.withColumn("text", docs.text.cast("binary"))
    pairs = spark.createDataFrame([(a, b, 7) for a, b in combinations(sorted(texts), 2)], "a long, b long, home long").repartition(3)
    sets = simhash.shingle_sets(nodes)
    run = {i: set(zip(*(t.split()[k:] for k in range(5)))) for i, t in texts.items()}
    alike = sorted((a, b) for a, b in combinations(sorted(texts), 2) if len(run[a] & run[b]) >= 0.8 * len(run[a] | run[b]))
    assert 0 < len(alike) < 80 * 79 // 2
    for part, held in ((256, 32 << 20), (8, 32 << 20), (256, 4096)):
        monkeypatch.setattr(simhash, "PART", part)
        monkeypatch.setattr(simhash, "HELD", held)
        assert sorted(map(tuple, simhash.similar(pairs, sets).collect())) == alike


def test_pairs_apart_leave_no_rows_but_links(spark, monkeypatch):
    texts = _variants(50, 0.012) | {100 + i: t for i, t in _variants(50, 0.03).items()}
    label = plain_labels(texts)
    docs = spark.createDataFrame([(i, t.encode()) for i, t in sorted(texts.items())], "node long, text binary").repartition(3)
    nodes = spark.createDataFrame([(i, wide.signature(t.encode(), 5), i) for i, t in texts.items()], "node long, sig array<long>, label long")
    sets = simhash.shingle_sets(docs)
    for block, held in ((1024, 32 << 20), (8, 32 << 20), (1024, 4096)):
        monkeypatch.setattr(simhash, "WIDE_BLOCK", block)
        monkeypatch.setattr(simhash, "HELD", held)
        links = [(r.a, r.b) for r in simhash.similar_apart(nodes, sets).collect()]
        assert all(label[a] == label[b] for a, b in links)
        assert len(links) < 16 * len(texts)  # some 2,000 pairs of these are within the bits
        root = {i: i for i in texts}
        for a, b in links:
            x, y = sorted((root[a], root[b]))
            root = {i: x if v == y else v for i, v in root.items()}
        assert root == label


def test_a_pair_is_compared_once(monkeypatch):
    rng = np.random.default_rng(6)
    n, blocks = 40, 3
    keys = rng.integers(0, 3, (n, wide.BANDS)) + 10 * np.arange(wide.BANDS)
    node, home = rng.integers(-(1 << 62), 1 << 62, n), rng.integers(0, blocks, n)
    rows = sorted((keys[i, k], min(home[i], o) * blocks + max(home[i], o), k, home[i], o, i) for i in range(n) for k in range(wide.BANDS) for o in range(blocks))
    key, block, band, own, other, i = np.array(rows).T
    run = np.cumsum(np.r_[0, (np.diff(key) != 0) | (np.diff(block) != 0)])
    a, b, _ = wide.near_pairs(run, np.zeros((len(rows), 8), np.uint32), i, wide.own_pairs(band, keys[i], node[i], own, other))
    found = sorted(tuple(sorted(p)) for p in zip(i[a].tolist(), i[b].tolist()))
    assert found == [(x, y) for x, y in combinations(range(n), 2) if (keys[x] == keys[y]).any()]
