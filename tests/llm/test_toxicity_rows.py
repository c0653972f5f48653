"""What the toxicity model learns from: every distinct labelled text, and prior counts of all documents."""

import zlib

import numpy as np
import xxhash

from ballotlake.llm import toxicity


def test_texts_that_share_a_word_pair_are_all_learned(spark):
    low = min((f"w{i} x{i}" for i in range(20_000)), key=lambda p: zlib.crc32(p.encode()))  # the least word pair of each text
    texts = [f"{low} text {chr(97 + i % 26)}{i} goes on" for i in range(60)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t.upper().replace(" ", "  ")) for i, t in enumerate(texts)] + [(5, texts[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = docs.selectExpr("doc_id", "0 as toxic").distinct()
    held = {i for i, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    learned = {t.lower().replace("  ", " ") for i, t in rows if i not in held}
    got = [bytes(r.text).decode().lower().replace("  ", " ") for r in toxicity.training_rows(docs, labels, "toxic").collect()]
    assert len(got) == len(set(got)) and set(got) == learned


def test_prior_counts_come_from_all_documents(spark):
    kept = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 != 1]
    rows = [(i, f"vile usual text n{i}" if k % 5 == 0 else f"some other text n{i}", int(k % 5 == 0)) for k, i in enumerate(kept)]
    labels = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    unlabelled = spark.createDataFrame([(1000 + i, f"usual words m{i}") for i in range(600)], "doc_id long, text string")
    gains = toxicity.fit(labels.select("doc_id", "text").unionByName(unlabelled), labels.select("doc_id", "toxic")).gains
    assert gains[b"vile"] > gains.get(b"usual", 0.0) + 0.5  # the same labelled rows hold both, the corpus does not


def test_near_copies_meet_and_others_do_not():
    word = toxicity._Memo(lambda w: xxhash.xxh64_intdigest(w))
    base = [b"w%d" % i for i in range(300)]
    near = base[:150] + [b"other"] + base[151:]
    common = base[:12] + [b"x%d" % i for i in range(288)]
    keys = [toxicity.near_keys(t, word) for t in (base, near, common, [], [b"w1"])]
    assert sum(a == b for a, b in zip(keys[0], keys[1])) >= 1
    assert not set(keys[0]) & set(keys[2]) and not set(keys[3]) & set(keys[4])


def test_curve_settles_where_evidence_tells_the_labels_apart():
    x, y, w = np.array([0, 3, 8, 60.0]), np.array([0, 0, 0, 1.0]), np.array([9000, 2000, 300, 1400.0])
    a, b = toxicity.logistic(x, y, w)
    p = 1 / (1 + np.exp(-(a + b * x)))
    assert p[2] < 0.01 and p[3] > 0.99
    assert abs((w * (y - p)).sum() - 0.01 * a) < 1e-3 and abs((w * (y - p) * x).sum() - 0.01 * b) < 1e-2
