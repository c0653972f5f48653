"""The pipeline, stage by stage, against what each stage's operator says of the rows it was given."""

import corpus_pipeline
from ballotlake.llm import quality, toxicity
from ballotlake.llm.common import materialize, table

from .test_simhash_similarity import plain_labels


def test_stages_take_effect(spark, data):
    docs = table(spark, data, "documents")
    for (name, stage), check in zip(corpus_pipeline.STAGES, (_quality, _toxicity, _copies, _mix, _packed)):
        out = materialize(stage(spark, docs, data), "test")
        check(spark, data, docs, out)
        docs = out


def _ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def _quality(spark, data, docs, out):
    assert out.columns == docs.columns
    assert _ids(out) == _ids(quality.score(docs, quality.fit(docs)).filter("predicted = 1"))


def _toxicity(spark, data, docs, out):
    model = toxicity.fit(docs, table(spark, data, "labels"))
    assert out.columns == docs.columns and _ids(out) == _ids(toxicity.score(docs, model).filter("predicted = 0"))


def _copies(spark, data, docs, out):
    label = plain_labels({r.doc_id: r.text for r in docs.collect()})
    assert _ids(out) == sorted(set(label.values()))


def _mix(spark, data, docs, out):
    assert out.columns == docs.columns
    times = out.groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert times <= 3 and set(_ids(out)) <= set(_ids(docs))


def _packed(spark, data, docs, out):
    assert out.groupBy("sequence_id").agg({"length": "sum"}).filter("`sum(length)` > 1024").count() == 0
    assert sorted(r.doc_id for r in out.filter("piece = 0").collect()) == _ids(docs)


def test_repeated_and_nameless_rows(spark):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    text = "A plain sentence of words that nobody would call unusual."
    docs = spark.createDataFrame([(1, text, "en", "x", 1), (1, text, "en", "x", 1), (2, text, "en", "x", 1), (None, "Some other words.", None, None, None), (4, None, None, None, None)], kind)
    kept = corpus_pipeline.keep_one_of_each(spark, docs, "")
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 4, None]
    mixed = corpus_pipeline.mix_sources(spark, kept, "")
    assert mixed.columns == docs.columns and mixed.filter("doc_id is null").count() > 0
    empty = docs.limit(0)
    assert corpus_pipeline.mix_sources(spark, corpus_pipeline.keep_one_of_each(spark, empty, ""), "").count() == 0
