"""Rows that share an id or have none, columns with clashing names, and run() against plain stages."""

import pyspark.sql.functions as F

import corpus_pipeline
from ballotlake.llm import mixing, packing, quality, toxicity
from ballotlake.llm.common import table

from .test_simhash_similarity import plain_labels

KIND = "doc_id long, text string, lang string, source string, n_chars long"


def test_texts_under_one_id_stay(spark):
    texts = ["red apples fall in autumn", "an engine needs oil and air", "the committee met on tuesday night", "blue whales sing under water"]
    rows = [(i, t, "en", "x", 1) for i, t in zip((1, 5, 5, 6), texts)] + [(6, texts[2], "en", "x", 1), (6, texts[3], "en", "x", 1)]
    kept = corpus_pipeline.keep_one_of_each(spark, spark.createDataFrame(rows, KIND), "")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted((r[0], r[1]) for r in rows[:4])


def test_rows_without_an_id_come_as_planned(spark):
    docs = spark.createDataFrame([(None, f"text {'word ' * (i % 7)}{i}", "en", "x" if i % 3 else "y", 1) for i in range(40)] + [(None, "same", "en", "x", 1)] * 3, KIND)
    planned = mixing.mix(docs).agg(F.sum("passes")).first()[0]
    assert corpus_pipeline.mix_sources(spark, docs, "").count() == planned


def test_clashing_columns(spark, data):
    docs = table(spark, data, "documents").limit(60)
    for name in ("passes", "copy", "own_id", "own", "tie", "draw", "times", "origin", "row", "alike", "Tie_"):
        docs = docs.withColumn(name, F.lit("own value"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data)
        assert out.columns == docs.columns
        assert out.filter("copy <> 'own value' or tie <> 'own value' or own <> 'own value'").count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() >= 60


def test_run_equals_plain_stages(spark, data):
    """Plain stages: each operator's judgement of single texts, all pairs of texts, and passes by row."""
    docs = table(spark, data, "documents")
    model = quality.fit(docs)
    rows = [r for r in docs.collect() if quality.verdict(r.text.encode() if r.text is not None else None, model)[2] == 1]
    kept = spark.createDataFrame(rows, docs.schema)
    toxic = toxicity.fit(kept, table(spark, data, "labels"))
    rows = [r for r in rows if toxic.score(toxic.evidence(toxic.passages(toxicity.words((r.text or "").encode())))) < toxicity.THRESHOLD]
    first = set(plain_labels({r.doc_id: r.text for r in rows}).values())
    rows = [r for r in rows if r.doc_id in first]
    mixed = spark.createDataFrame(rows, docs.schema)
    passes = {r.doc_id: r.passes for r in mixing.mix(mixed).collect()}
    want = sorted((r.doc_id, p.piece, p.ids_crc32) for r in rows for p in _pieces(spark, r) for _ in range(passes[r.doc_id]))
    got = corpus_pipeline.run(spark, data).toPandas()
    assert sorted(zip(got.doc_id, got.piece, got.ids_crc32)) == want
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert s.offset.tolist() == [0, *s.length.cumsum().tolist()[:-1]] and s.length.sum() <= 1024


_seen: dict = {}


def _pieces(spark, row):
    from collections import namedtuple
    import zlib

    import numpy as np
    from tokenizers import Tokenizer

    coder = _seen.setdefault("coder", Tokenizer.from_file(packing.default_tokenizer()))
    ids = np.array([*coder.encode(row.text or "", add_special_tokens=False).ids, 2], "<u4")
    first = len(ids) % 1024 or 1024
    cuts = [0, *range(first, len(ids) + 1, 1024)]
    piece = namedtuple("piece", "piece ids_crc32")
    return [piece(k, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
