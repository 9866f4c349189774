"""The digest index over sessions, batches and crashes; samples that repeated rows cannot fill."""

import uuid

from pyspark.sql import functions as F

from graphmill.llm import exact_dedup, langid, mixing

SCHEMA = "doc_id long, text string"


def test_an_index_is_opened_with_other_partitions(spark):
    name = f"t_{uuid.uuid4().hex}"
    exact_dedup.DigestIndex(spark, name, buckets=7).add(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA))
    again = exact_dedup.DigestIndex(spark, name)
    assert again.buckets == 7
    found = {r["doc_id"]: r["kept"] for r in again.add(spark.createDataFrame([(3, "a"), (4, "c")], SCHEMA)).collect()}
    assert found == {3: False, 4: True} and again.groups().count() == 3
    again.drop()


def test_a_batch_that_is_tried_again_counts_once(spark):
    index = exact_dedup.DigestIndex(spark, f"t_{uuid.uuid4().hex}")
    rows = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], SCHEMA)
    for _ in range(2):
        out = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in index.add(rows, batch="one").collect()}
        assert out == {1: (2, 2, False), 2: (2, 2, True), 3: (3, 1, True)}
    index.add(spark.createDataFrame([(9, "a")], SCHEMA), batch="two")
    index.add(spark.createDataFrame([(9, "a")], SCHEMA), batch="two")
    assert {r["keep_id"]: r["group_size"] for r in index.groups().collect()} == {2: 3, 3: 1}
    index.drop()


def test_a_crash_in_compaction_loses_nothing(spark):
    name = f"t_{uuid.uuid4().hex}"
    index = exact_dedup.DigestIndex(spark, name)
    index.add(spark.createDataFrame([(1, "a"), (2, "b")], SCHEMA))
    spark.sql(f"CREATE TABLE {name}_compacted (x int)")  # of a compaction that did not end
    index.compact()
    assert index.groups().count() == 2
    spark.sql(f"ALTER TABLE {name} RENAME TO {name}_compacted")  # a crash after the old table went
    assert exact_dedup.DigestIndex(spark, name).groups().count() == 2
    spark.sql(f"DROP TABLE {name}")


def test_a_repeated_id_does_not_fill_the_sample(spark):
    english = [(k, "the cat sat on the mat with the other cats", "en") for k in range(50)]
    german = [(100 + k, "der hund und die katze sind nicht im haus", "de") for k in range(50)]
    rows = spark.createDataFrame(english + german, "doc_id long, text string, lang string")
    many = rows.unionByName(spark.range(300_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the cat sat on the mat with the other cats").alias("text"), F.lit("en").alias("lang")))
    model = langid.train(many, train_docs=40)
    assert model.languages == ["de", "en"]
    out = {r["doc_id"]: r["lang_pred"] for r in langid.identify(rows, model).collect()}
    assert all(out[k] == ("en" if k < 100 else "de") for k in out)


def test_a_bound_is_loosened_until_the_targets_are_met(spark):
    rows = [(k, " ".join(["good"] * 19 + [f"w{k}"])) for k in range(90)] + [(100 + k, " ".join(["bad"] * 19 + [f"w{k}"])) for k in range(10)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, 1 if k < 100 else 0) for k, _ in rows], "doc_id long, quality int")
    model = mixing.train(docs, labels, F.when(F.col("quality") == 1, "clean").otherwise("poor"))
    clean = F.col("p")[model.domains.index("clean")] >= 0.5
    mixed = mixing.mix(docs, model, {"clean": 0.5, "poor": 0.5}, least=clean.cast("double"), loosen=True)
    row = mixed.agg(F.first("met"), F.first("bound"), F.first("reached"), F.min(F.when(clean, F.col("rate")))).first()
    # half of all tokens can't be the clean ones' if each clean document stays
    assert row[0] and 0.3 < row[1] < 0.6 and all(abs(s - 0.5) < 1e-3 for s in row[2]) and row[3] >= row[1] - 1e-9
