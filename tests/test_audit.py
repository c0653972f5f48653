"""Chains, canonical JSON and Merkle roots against plain versions."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ballotlake.operators import audit


def plain_root(hashes):
    if not hashes:
        return audit.ZEROS
    twice = lambda b: hashlib.sha256(hashlib.sha256(b).digest()).digest()
    layer = [bytes.fromhex(h) for h in hashes]
    while len(layer) > 1:
        layer += layer[-1:] if len(layer) % 2 else []
        layer = [twice(a + b) for a, b in zip(layer[::2], layer[1::2])]
    return layer[0].hex()


def leaves_of(spark, sizes):
    rows = [(n, k, hashlib.sha256(f"{n}.{k}".encode()).hexdigest()) for n in sizes for k in range(n)]
    return rows, spark.createDataFrame(rows, "batch long, seq long, hash string")


@pytest.mark.parametrize("block, sizes", [(4, range(1, 70)), (audit.BLOCK, (1, 2, 3, 1023, 1024, 1025, 2049, 3100))])
def test_roots_of_aligned_blocks_are_those_of_the_whole_tree(spark, monkeypatch, block, sizes):
    monkeypatch.setattr(audit, "BLOCK", block)
    rows, leaves = leaves_of(spark, sizes)
    found = {r.batch: (r.merkle_root, r.leaf_count) for r in audit.merkle_roots(audit.numbered(leaves, span=10, by=["batch"])).collect()}
    assert found == {n: (plain_root([h for b, _, h in rows if b == n]), n) for n in sizes}


def test_anchor_of_nothing_is_none(spark):
    assert audit.anchor(spark.createDataFrame([], "seq long, log_hash string")).count() == 0


@pytest.mark.parametrize("text", ['{"b": 1, "a": {"d": [1, 2.50, {"z": null, "y": true}], "c": "Ọ̀yọ́ \\u00e9 \\" \\\\ / \\n"}}', "[]", "{}", ' "x" ', "3.0", '{"é": 1, "z": 2, "😀": 3, "a": 1e30}', '{"a": 1, "a": 2}', "not json", "", None])
def test_canonical_json(spark, text):
    try:
        expected = None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        expected = None
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(audit.canonical_json(F.col("t")).alias("c")).first().c == expected


EVENT = "seq long, event_type string, entity_type string, entity_id string, actor_id string, event_at string, event_data string"


def events(spark, n):
    return spark.createDataFrame([(k * 3, "e", "t", f"i{k}", None if k % 2 else "me", "now", f'{{"z": {k}, "a": "é"}}') for k in range(n)], EVENT)


def test_chain_is_whole_goes_on_and_is_checked(spark):
    first = audit.append(events(spark, 2500)).orderBy("seq").collect()
    prev = audit.ZEROS
    for r in first:
        said = r.event_type + r.entity_type + r.entity_id + (r.actor_id or "") + r.event_at + json.dumps(json.loads(r.event_data), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert (r.prev_hash, r.log_hash) == (prev, hashlib.sha256((prev + said).encode()).hexdigest())
        prev = r.log_hash
    assert len(first) == 2500
    log = spark.createDataFrame(first, f"{EVENT}, prev_hash string, log_hash string")
    assert audit.broken(log, span=100).count() == 0
    more = audit.append(events(spark, 2501).filter("seq = 7500"), prev=prev)
    assert audit.broken(log.unionByName(more), span=100).count() == 0
    bad = log.withColumn("event_data", F.when(F.col("seq") == 30, "{").otherwise(F.col("event_data"))).filter("seq <> 300")
    assert sorted(r.seq for r in audit.broken(bad, span=100).collect()) == [30, 303]


def test_chains_side_by_side_are_the_same_as_alone(spark):
    both = events(spark, 40).withColumn("own", F.col("seq") % 2)
    apart = {(r.own, r.seq): r.log_hash for r in audit.append(both, chain=["own"]).collect()}
    for own in (0, 1):
        alone = {r.seq: r.log_hash for r in audit.append(both.filter(F.col("own") == own)).collect()}
        assert alone == {seq: h for (o, seq), h in apart.items() if o == own}


def test_genesis_rows_are_not_checked(spark):
    row = (0, audit.GENESIS, "system", "x", None, "now", "{}", "?", "f" * 64)
    log = spark.createDataFrame([row], f"{EVENT}, prev_hash string, log_hash string")
    after = audit.append(events(spark, 3).filter("seq > 0"), prev="f" * 64)
    assert audit.broken(log.unionByName(after)).count() == 0
