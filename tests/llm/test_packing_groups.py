"""Bins that are too many for one task are dealt anew, not left as they are."""

import random

from pyspark.sql import functions as F

from ballotlake.llm import packing


def test_more_bins_than_a_group_holds(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(["word"] * rng.randrange(300, 700)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    whole = packing.pack(docs).agg(F.countDistinct("sequence_id")).first()[0]
    monkeypatch.setattr(packing, "GROUP", 20)
    rows = packing.pack(docs).collect()
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert used.get(r.sequence_id, 0) == r.offset
        used[r.sequence_id] = r.offset + r.length
    assert len(rows) == len(texts) and max(used.values()) <= packing.CAPACITY
    assert whole <= len(used) <= whole * 1.04
