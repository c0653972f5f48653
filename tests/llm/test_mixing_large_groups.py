"""A group of one source and length that is dealt into parts, from files split in two ways."""

from pyspark.sql import functions as F

from ballotlake.llm import mixing


def test_large_groups_take_the_same_documents(spark):
    docs = spark.range(3 * mixing.RANKED).select(F.col("id").alias("doc_id"), F.lit("two words").alias("text"), (F.col("id") % 5 == 0).cast("string").alias("source"))
    one, two = (sorted(map(tuple, mixing.mix(docs.repartition(n, "doc_id")).select("doc_id", "passes").collect())) for n in (2, 7))
    assert one == two and len({p for _, p in one}) > 1
