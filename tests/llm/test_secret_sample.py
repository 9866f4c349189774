"""The forest's sample has both labels, whatever is copied."""

from pyspark.sql import functions as F

from graphmill.llm import secrets


def test_copies_do_not_fill_the_sample(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("see build 20240101x9 here").alias("text"), F.lit("a").alias("source"))
    rare = spark.range(1000, 1003).select(F.col("id").alias("doc_id"), F.concat(F.lit("password=deadbeef1234"), F.col("id")).alias("text"), F.lit("b").alias("source"))
    found = secrets.candidates(docs.unionByName(rare))
    rows = secrets.features(found, secrets.dictionary(docs)).withColumn("label", (secrets.kind(F.col("candidate"), F.col("before")) != "other").cast("int"))
    chosen = [(r["label"], r["copies"]) for r in secrets.sample(rows, 2).collect()]
    assert sorted(chosen) == [(0.0, 300), (1.0, 1), (1.0, 1)]
    for y in (0, 1):  # whichever label is copied
        forest = secrets.train(rows.withColumn("label", F.abs(F.col("label") - y)), 2)
        assert forest.model is not None
