"""The contracts of the registered queries, on the smallest tables, against brute force."""

import hashlib
import math
import zlib

import pytest
import xxhash

from graphmill.llm import media, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def run(spark, name):
    rows = queries.queries()[name](spark, SF).collect()
    return rows


def crc(k):
    return zlib.crc32(str(k).encode())


def test_all_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_op1(spark, docs):
    import duckdb

    duckdb_rows = duckdb.sql(queries.OP1_SQL.replace("FROM documents", f"FROM '{SF}/documents.parquet'")).fetchall()
    assert {tuple(r) for r in run(spark, "op1_exact_dedup")} == set(duckdb_rows) and len(duckdb_rows) == len(docs)


def test_op2(spark, docs):
    rows = run(spark, "op2_media_columns")
    assert len(rows) == len(docs)
    for r in rows:
        t = (docs[r["doc_id"]]["text"] or "").encode()
        payload = t.ljust(max(64, -(-len(t) // 64) * 64), b"\0")
        assert r["n_bytes"] == len(t) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(media.to_wav(payload)).hexdigest() and r["feature"] == media.features_of(payload)["feature"]


def test_op3(spark, docs):
    rows = run(spark, "op3_language_id")
    assert len(rows) == len(docs) and all(r["held_out"] == (crc(r["doc_id"]) % 5 == 0) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in held) >= 0.9 * len(held)


@pytest.mark.parametrize(("name", "limit"), [("op4_toxicity", 0.7), ("op8_quality", 0.5)])
def test_op4_op8(spark, docs, name, limit):
    rows = run(spark, name)
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (crc(r["doc_id"]) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= limit)


def test_op5(spark, docs):
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    known = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = run(spark, "op5_byte_bpe")
    assert len(rows) == len(docs)
    for r in rows:
        text = docs[r["doc_id"]]["text"] or ""
        ids = known.encode_ordinary(text)
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_op6(spark, docs):
    from collections import Counter

    tokens = {k: (r["text"] or "").encode().lower().split() + [None] for k, r in docs.items()}
    count = Counter(w for k, t in tokens.items() if crc(k) % 5 != 1 for w in t)
    n, v = sum(count.values()), len(count)
    rows = run(spark, "op6_lm_scoring")
    assert len(rows) == len(docs)
    for r in rows:
        t = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (crc(r["doc_id"]) % 5 == 1, len(t), sum(count[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_op7(spark, docs):
    rows = run(spark, "op7_mixing")
    assert len(rows) == len(docs)
    shares = [c for c in rows[0].asDict() if c.startswith("p_")]
    assert all(math.isclose(sum(r[c] for c in shares), 1, rel_tol=1e-6) and r["rate"] >= 0 and r["copies"] in (math.floor(r["rate"]), math.floor(r["rate"]) + 1) for r in rows)
    total = sum(r["tokens"] for r in rows)
    for c in shares:
        assert abs(sum(r["tokens"] * r["rate"] * r[c] for r in rows) / total - queries.MIX[c[2:]]) < 0.02


def test_op9(spark, docs):
    def fingerprint(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 4]), 42) for k in range(max(1, len(w) - 3))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    fps = {k: fingerprint(r["text"]) for k, r in docs.items()}
    root = {k: k for k in fps}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sorted(fps):
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    rows = run(spark, "op9_simhash")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows} == {k: (f"{f:016x}", find(k)) for k, f in fps.items()}


def test_op10(spark, docs):
    rows = run(spark, "op10_secret_scan")
    for r in rows:
        text = docs[r["doc_id"]]["text"]
        assert hashlib.sha256(text[r["start"] : r["start"] + r["size"]].encode()).hexdigest() == r["candidate_sha256"]


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_hard_negatives", "op13_decontamination"])
def test_new_operators_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    rows = run(spark, name)
    assert rows and sorted(want.columns) == sorted(rows[0].asDict())
    assert sorted(tuple(r[c] for c in want.columns) for r in rows) == sorted(want.fetchall())
