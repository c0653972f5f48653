"""Equal rows, short texts and empty samples."""

from pyspark.sql import functions as F

from ballotlake.llm import chat, quality


def test_many_equal_rows_are_learned_from(spark):
    junk = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("|| ## $$ %% && ** || ## $$ %% && **").alias("text"))
    got = quality.score(junk, quality.fit(junk)).select("predicted").distinct().collect()
    assert [r.predicted for r in got] == [0]


def test_every_text_meets_the_scorer(spark):
    model = ({"-" * len(quality.LABELLERS): 0.99}, quality.np.r_[quality.np.zeros(quality.FEATURES), -9.0])
    assert quality.verdict(b"one two", model)[1] < 0.01


def test_long_conversations_in_slices(spark, monkeypatch):
    monkeypatch.setattr(chat, "SLICE", 100)
    rows = [(1, t, "user" if t % 2 else "assistant", f"text {t} " * 9) for t in range(50)] + [(2, 0, "assistant", "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    monkeypatch.undo()
    whole = sorted(map(tuple, chat.read_back(chat.format_conversations(frame)).collect()))
    monkeypatch.setattr(chat, "SLICE", 100)
    batch = chat.pa.RecordBatch.from_pydict({"conv_id": [1, 1, 2], "role": ["a", None, "b"], "text": ["x" * 90, "y" * 90, None]})
    assert [b.num_rows for b in chat._slices(iter([batch]))] == [1, 2]
    assert [(r[0], r[1]) for r in whole] == [(1, 50), (2, 1)]
