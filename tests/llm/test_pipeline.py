"""The stages against brute force, each on what its predecessor kept, and on odd tables."""

import base64
import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
import xxhash

import corpus_pipeline
from graphmill.llm import mixing, queries, toxicity
from graphmill.llm.common import fold, written

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def rows_of(docs):
    return Counter(tuple(r) for r in docs.collect())


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and gave."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SF), "test-pipeline")
        if name != "byte_bpe":
            assert after.columns == docs.columns
        out[name] = docs, after
        docs = after
    return out


def test_toxic_documents_go(spark, stages):
    before, after = stages["toxicity"]
    model = toxicity.train(before, spark.read.parquet(f"{SF}/labels.parquet").filter(fold("doc_id", 3) != 1))
    gone = {r["doc_id"] for r in toxicity.assess(before, model).filter("predicted = 1").collect()}
    assert rows_of(after) == Counter({r: n for r, n in rows_of(before).items() if r[0] not in gone})


def test_equal_texts_go(stages):
    before, after = stages["exact_dedup"]
    best = {}
    for r in before.collect():
        best[r["text"]] = max(r["doc_id"], best.get(r["text"], -1))
    assert rows_of(after) == Counter({tuple(r): 1 for r in before.collect() if best[r["text"]] == r["doc_id"]})


def test_near_copies_go(stages):
    before, after = stages["simhash_near_dedup"]
    fps = {r["doc_id"]: fingerprint(r["text"]) for r in before.collect()}
    root = {k: k for k in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {r["doc_id"] for r in after.collect()} == {find(k) for k in fps} and after.count() < before.count()


def test_the_mix_has_the_rates_copies(spark, stages):
    before, after = stages["mixing"]
    model = mixing.train(before, spark.read.parquet(f"{SF}/labels.parquet"), queries.domain())
    mixed = mixing.mix(before, model, queries.MIX).collect()
    assert Counter(r["doc_id"] for r in after.collect()) == Counter({r["doc_id"]: r["copies"] for r in mixed if r["copies"]})
    target, tokens = sum(queries.MIX[d] for d in model.domains), sum(r["tokens"] for r in mixed)
    shares = [sum(r["tokens"] * r["rate"] * r["p"][k] for r in mixed) / tokens for k in range(len(model.domains))]
    assert mixed[0]["met"] and all(abs(s - queries.MIX[d] / target) < 1e-3 for s, d in zip(shares, model.domains))


def test_tokens_are_those_of_the_public_library(stages):
    before, after = stages["byte_bpe"]
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in before.collect():
        ids = known.encode_ordinary(r["text"])
        want[r["doc_id"], len(ids), hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest(), hashlib.sha256(r["text"].encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after.collect()) == want


LONG = "the quick brown fox jumps over the lazy dog " * 20_000
ODD = [
    (1, "same text here", "en", None, "a", 1), (2, "same text here", "en", "s", "b", 2), (3, None, None, None, None, None), (4, "", "en", "s", "c", 3), (5, LONG, "de", "s", "d", 4), (5, "of that id another text", "de", "s", "d", 4),
    (6, "same text here", "en", "s", "e", 5), (6, "same text here", "en", "s", "e", 5), (None, "no id", "en", "s", "f", 6), (None, "no id", "en", "s", "g", 7), (None, None, "en", "s", "h", 8), (9, " \t\n", "en", "s", "i", 9),
]
SCHEMA = "doc_id long, text string, lang string, source string, text_sha256 string, mix_copies int"


def test_odd_tables(spark):
    odd, none = spark.createDataFrame(ODD, SCHEMA), spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        empty = stage(spark, none, SF)
        assert empty.count() == 0 and (name == "byte_bpe" or empty.columns == none.columns)
    copies = corpus_pipeline.drop_copies(spark, odd, SF)
    assert copies.columns == odd.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in copies.collect()) == sorted([(6, "same text here"), (4, ""), (5, LONG), (5, "of that id another text"), (0, "no id"), (9, " \t\n")])
    # rows that repeat an id and a text, many times over, and not only those
    many = spark.createDataFrame([(6, "same text here", "en", "s", "e", 5)] * 3000 + ODD[:3], SCHEMA)
    assert sorted((r["doc_id"], r["text"] or "") for r in corpus_pipeline.drop_copies(spark, many, SF).collect()) == [(3, ""), (6, "same text here")]
    assert sorted((r["doc_id"], r["text"] or "") for r in corpus_pipeline.drop_near_copies(spark, many, SF).collect()) == [(1, "same text here"), (3, "")]
    near = corpus_pipeline.drop_near_copies(spark, odd, SF)
    # blanks have the fingerprint zero of the empty text
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in near.collect()) == sorted([(1, "same text here"), (3, ""), (5, LONG), (5, "of that id another text"), (0, "no id")])
    kept = corpus_pipeline.drop_toxic(spark, odd, SF)
    assert kept.columns == odd.columns and kept.count() == len(ODD)
    mixed = corpus_pipeline.mix(spark, odd, SF)
    assert mixed.columns == odd.columns and set(rows_of(mixed)) <= set(rows_of(odd))
    assert corpus_pipeline.encode(spark, odd, SF).count() == len(ODD)
