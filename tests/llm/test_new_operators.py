"""Source divergence, hard negatives and decontamination against plain versions, on odd and adverse tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.llm import decontaminate, divergence, hardneg

SCHEMA = "doc_id long, text string, lang string, source string, other string, n int"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, extra columns whose names the operators use inside."""
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "déjà", "vu", "x1", "of", "the"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30))), rng.choice(["en", "de", None]), rng.choice(["a", "b", None, "é"]), "x", 1) for k in range(60)]
    rows += [(70, None, "en", "quiet", None, None), (71, "", None, None, "", 0), (72, "the " * 300_000 + "end", "en", "a", "x", 2), (None, "alpha beta", "en", "a", "x", 3)]
    rows += [(73, "alpha alpha beta", "en", "b", "x", 4)] * 3 + [(74, "12 34 !!", "fr", "only", "x", 5)]
    return spark.createDataFrame(rows, SCHEMA)


def plain_divergence(rows, least, top):
    find = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    group, in_docs = defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        lang, own = r["lang"] or "", find.findall((r["text"] or "").translate(lower))
        group[lang, r["source"] or ""].update(own)
        in_docs[lang].update(set(own))
    out = []
    for lang in {k[0] for k in group}:
        kept = sorted((t for t, n in in_docs[lang].items() if n >= least), key=str.encode)
        own = {s: c for (other, s), c in group.items() if other == lang}

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in own.items()}, shares(sum(own.values(), Counter()))
        for s, c in own.items():
            pairs = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s))
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pairs)]
            more = sorted((q[t] - p[s][t], t.encode()) for t in kept if c[t] > 0 and p[s][t] > q[t])[:top]
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(more)]
    return out


@pytest.mark.parametrize(("least", "top"), [(3, 2), (10, 50), (1000, 50)])
def test_divergence(odd, least, top):
    found = [tuple(r) for r in divergence.audit(odd, least, top).collect()]
    assert sorted(found) == sorted(plain_divergence(odd.collect(), least, top))


def test_divergence_of_nothing_and_in_parts(spark, odd, monkeypatch):
    assert divergence.audit(odd.limit(0)).count() == 0
    whole = sorted(tuple(r) for r in divergence.term_counts(odd).collect())
    text = b"ab cd " * 1000 + b"e" * 500 + b" f"
    monkeypatch.setattr(divergence, "SLICE", 64)
    assert Counter(w for part in divergence.terms(text) for w in part) == Counter(text.split())
    assert max(len(part) for part in divergence.terms(text)) < 40 and whole


def plain_negatives(rows, every, positives=5, negatives=3):
    rows = [r for r in rows if r[0] is not None and r[1] is not None and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[2])]
    dims = max((len(r[2]) for r in rows), default=0)
    v = [[int(np.floor(256 * float(x))) for x in r[2]] + [0] * (dims - len(r[2])) for r in rows]
    out = []
    for a, r in enumerate(rows):
        if r[0] % every:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v[a], v[b])), rows[b][0], rows[b][1] == r[1]) for b in range(len(rows)) if rows[b][0] != r[0])
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            fits = [x for x in scored if not x[2] and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(r[0], p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fits)]
    return sorted(out)


def vectors(rng, n, dims, spread):
    centre = rng.normal(size=(6, dims))
    return [(int(k), int(rng.integers(4)), [float(x) for x in np.float32((centre[k % 6] + spread * rng.normal(size=dims)) / 8)]) for k in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_hard_negatives(spark, spread, monkeypatch):
    rng = np.random.default_rng(5)
    rows = vectors(rng, 400, 8, spread)
    rows += [(1000 + k, 1, [0.25] * 8) for k in range(300)]  # a hot vector
    rows += [(2000, None, [0.1] * 8), (2001, 1, None), (2002, 1, [0.1, None]), (2003, 1, [float("nan")] * 8), (2004, 1, [float("inf")] * 8), (2005, 2, []), (2006, 2, [0.5]), (None, 1, [0.1] * 8), (2007, 3, [0.2] * 8), (2007, 3, [0.2] * 8)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, v string")
    monkeypatch.setattr(hardneg, "PART", 64)
    want = plain_negatives(rows, 50)
    index = hardneg.build(hardneg.whole_vectors(df), sample=200)
    assert sorted(tuple(r) for r in hardneg.mine(index, F.col("id") % 50 == 0).collect()) == want and want
    # the same in several blocks of anchors, lists and tasks, and from a sample that bounds nothing
    index = hardneg.build(hardneg.whole_vectors(df), sample=2, lists=3, partitions=4)
    monkeypatch.setattr(hardneg, "HELD", 500)
    assert sorted(tuple(r) for r in hardneg.mine(index, F.col("id") % 50 == 0, block=5).collect()) == want


def test_hard_negatives_of_nothing_and_beyond(spark):
    none = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert hardneg.mine(hardneg.build(hardneg.whole_vectors(none)), F.col("id") % 50 == 0).count() == 0
    with pytest.raises(ValueError):
        hardneg.build(hardneg.whole_vectors(spark.createDataFrame([(1, 1, [1e9])], none.schema)))


def test_lists_are_skipped_and_visits_stop():
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(20, 8)) * 100
    lists = [(n, np.arange(50) * 20 + n, np.zeros(50, np.int64), np.round(c + rng.normal(size=(50, 8)))) for n, c in enumerate(centre)]
    a = hardneg.Anchors(np.array([-1]), np.array([0]), lists[3][3][:1])
    free = np.array([-np.inf])
    want = hardneg.Wanted(np.zeros(1, np.int64), free, -free, free, True, 5)
    (query, ids, score), visits = hardneg.visit(a, want, centre, lists)
    every = sorted(((-float(a.x[0] @ x), i) for _, names, _, rows in lists for i, x in zip(names.tolist(), rows)))[:5]
    assert [(-s, i) for s, i in zip(score.tolist(), ids.tolist())] == every and visits < 5
    top = score[0]
    window = hardneg.Wanted(np.zeros(1, np.int64), np.array([-1e9]), np.array([-top / 2.0]), free, True, 5)
    (_, _, score), fewer = hardneg.visit(a, window, centre, lists)
    assert fewer < 20 and (score <= -top / 2).all()


def plain_contamination(docs, items, window):
    find = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = lambda t: find.findall((t or "").translate(lower))
    known = defaultdict(set)
    for name, text in items:
        w = words(text)
        size = min(window, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            known[tuple(w[k : k + size])].add(name)
    out = []
    for doc, text in docs:
        w, hit, names = words(text), set(), set()
        for size in {len(k) for k in known}:
            for k in range(len(w) - size + 1):
                if (own := known.get(tuple(w[k : k + size]))) is not None:
                    hit.update(range(k, k + size))
                    names |= own
        spans = []
        for k in sorted(hit):
            if spans and spans[-1][1] == k:
                spans[-1][1] = k + 1
            else:
                spans.append([k, k + 1])
        out.append((doc, len(w), [tuple(s) for s in spans], sorted(str(x) for x in names if x is not None)))
    return out


def contaminated_case():
    rng = random.Random(8)
    word = lambda: rng.choice("ab cd ef 12 é ß x yz".split())
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 2, 3, 5, 9, 14])))) for k in range(25)] + [(3, "ab ab ab ab ab ab ab"), (None, "nobody's item here is long"), (90, None), (91, "..."), (92, "yz, " * 3000)]
    docs = [(k, rng.choice([" ", ", ", "\n"]).join(word() for _ in range(rng.choice([0, 1, 5, 40])))) for k in range(80)]
    docs += [(200, None), (201, ""), (202, "AB " * 5000), (None, "nobody s item here is long!"), (203, "yz " * 9000), (204, items[5][1] + " qq " + items[7][1])] + [(205, "ab cd ef 12 é ß")] * 3
    return docs, items


@pytest.mark.parametrize("sizes", [{}, {"block": 20, "shard": 300, "piece": 16}, {"block": 400, "shard": 50, "piece": 7}])
def test_contamination(spark, sizes):
    docs, items = contaminated_case()
    docs_df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, spans string, window int").repartition(3)
    items_df = spark.createDataFrame([(*i, "x") for i in items], "item_id long, text string, words string")
    found = decontaminate.contamination(docs_df, items_df, window=4, **sizes)
    got = sorted(((r["doc_id"], r["n_words"], [(s["start"], s["end"]) for s in r["spans"]], r["items"]) for r in found.collect()), key=repr)
    want = sorted(plain_contamination(docs, items, 4), key=repr)
    assert got == want and any(w[2] for w in want) and not all(w[2] for w in want)


def test_longest_matches_and_removal(spark):
    docs = [(1, "p q one two three four five six r"), (2, "one two three four five x"), (3, "three four five six seven"), (4, "nothing of it"), (5, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    items = spark.createDataFrame([("t", "Zero one TWO three, four five six seven")], "item_id string, text string")
    found = decontaminate.contamination(df, items, window=3)
    best = {(r["item_at"], r["words"], r["doc_id"], r["doc_at"]) for r in decontaminate.longest(found).collect()}
    assert (1, 6, 1, 2) in best and any(a == 3 and n == 5 and d == 3 and at == 0 for a, n, d, at in best)
    assert sorted(r["doc_id"] for r in decontaminate.remove(df, found).collect()) == [4, 5]
    assert decontaminate.contamination(df.limit(0), items).count() == 0
    assert decontaminate.contamination(df, items.limit(0)).agg(F.max(F.size("spans"))).first()[0] == 0


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(2)
    for high in (2, 3, 9):
        words = np.append(rng.integers(0, high, 300), 0)
        tail = [tuple(words[k : k + int(np.argmax(words[k:] == 0))]) for k in range(len(words))]
        order = decontaminate.suffix_array(words, 1000)
        assert sorted(order.tolist()) == np.flatnonzero(words).tolist()
        assert all(tail[a] <= tail[b] for a, b in zip(order, order[1:]))
