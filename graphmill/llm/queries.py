"""The registered queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphmill.llm import bpe, decontaminate, divergence, exact_dedup, hardneg, langid, lm, media, mixing, quality, secrets, simhash, toxicity
from graphmill.llm.common import fold, table, written


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = exact_dedup.DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}")
    try:
        return written(exact_dedup.dedup(table(spark, sf_dir, "documents"), index), "deduplicated")
    finally:
        index.drop()  # of this query alone


OP1_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = written(media.encode_media(table(spark, sf_dir, "documents")), "media")
    features = written(media.audio_features(stored), "media-features")  # with tensors, spans and segments
    return features.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.filter(fold("doc_id", 5) != 0))
    return langid.identify(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def _learnable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").filter(fold("doc_id", 3) != 1)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _learnable(spark, sf_dir))
    return toxicity.assess(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm.score(docs, fold("doc_id", 5) != 1)
    return scored.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


#: Shares of tokens that the mix is to have.
MIX = {"clean": 0.9, "poor": 0.07, "toxic": 0.03}


def domain() -> Column:
    """The domain of a labelled document."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "poor").when(F.col("quality") == 1, "clean")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = mixing.train(docs, table(spark, sf_dir, "labels"), domain())
    mixed = mixing.mix(docs, model, MIX)
    share = [F.col("p")[k].alias(f"p_{name}") for k, name in enumerate(model.domains)]
    reached = [F.col("reached")[k].alias(f"reached_{name}") for k, name in enumerate(model.domains)]
    return mixed.select("doc_id", "tokens", *share, "rate", "copies", "met", *reached)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, _learnable(spark, sf_dir))
    return quality.assess(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "path", "start", F.length("candidate").alias("size"), F.sha2(F.col("candidate").cast("binary"), 256).alias("candidate_sha256"), "kind", "score", "is_secret")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    index = hardneg.build(hardneg.whole_vectors(table(spark, sf_dir, "embeddings"), label=moved))
    return hardneg.mine(index, F.col("id") % 50 == 0)


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    listed = F.sha2(F.concat_ws(",", "items").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_media_columns, op3_language_id, op4_toxicity, op5_byte_bpe, op6_lm_scoring, op7_mixing, op8_quality, op9_simhash, op10_secret_scan, op11_source_divergence, op12_hard_negatives, op13_decontamination)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op11_source_divergence": divergence.SQL, "op12_hard_negatives": hardneg.SQL, "op13_decontamination": decontaminate.SQL}
