"""op6_lm_scoring: what the language model's tasks do no more than once, and that sorts and steps done otherwise are the same."""

import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphmill.llm import lm
from graphmill.scratch import scratch


def test_looking_up_few_pairs_costs_less_than_the_bucket():
    rng = np.random.default_rng(0)
    words, contexts = (np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64)) for n in (20_000, 100))
    known = lm.Cells(words, np.full(len(words), len(contexts)), contexts, np.tile(np.arange(len(contexts)), len(words)), np.ones(len(words) * len(contexts), np.int64))
    few = lm.Cells(np.sort(np.append(words[5:8], np.uint64(3))), np.array([1, 2, 1, 1]), contexts[:2], np.array([0, 0, 1, 1, 0]), np.ones(5, np.int64))
    pair, context = known.find(few)
    n = len(contexts)
    assert context.tolist() == [0, 1]
    assert pair.tolist() == [-1, 5 * n, 5 * n + 1, 6 * n + 1, 7 * n]  # the word 3 is not known
    began = time.process_time()
    for _ in range(50):
        known.find(few)
    asked = time.process_time()
    for _ in range(50):
        known.word()
    assert asked - began < (time.process_time() - asked) / 2


@pytest.mark.parametrize("top", [2, 1 << 20, 1 << 40, (1 << 64) - 1])
@pytest.mark.parametrize("n", [0, 1, 2, 5000])
def test_order_and_distinct_numbers_are_those_of_numpy(n, top):
    key = np.random.default_rng(n).integers(0, top, n, dtype=np.uint64)
    if top > 1 << 50 and n > 2:  # numbers that differ only in the bits that give way to places
        key[: n // 2] = key[0] + np.arange(n // 2, dtype=np.uint64)[::-1] % np.uint64(7)
    order, ranked = lm.rising(key)
    assert (order == np.argsort(key, kind="stable")).all() and (ranked == np.sort(key)).all()
    for x, y in zip(lm.distinct(key), np.unique(key, return_inverse=True)):
        assert (x == y).all() and len(x) == len(y)


@pytest.mark.parametrize("most", [0, 1, 255, 256, 65_536, 1 << 24, 1 << 40, (1 << 63) - 1])
def test_packed_numbers_come_back(most):
    x = np.array([0, most, most // 2, 1 if most else 0], np.int64)
    assert (lm.unpack(lm.pack(x)) == x).all() and (lm.unpack(lm.pack(-x)) == -x).all() and len(lm.unpack(lm.pack(x[:0]))) == 0
    assert (lm.unpack(lm.pack(np.arange(5, dtype=np.uint32)), "<u4") == np.arange(5)).all()


def test_pairs_of_a_hot_context_lie_by_word():
    rng = np.random.default_rng(4)
    words, contexts = np.sort(rng.integers(2, 1 << 63, 40, dtype=np.uint64)), np.sort(rng.integers(2, 1 << 63, 3, dtype=np.uint64))
    layout = lm.Layout(50, contexts[1:2])
    word, context = np.repeat(np.arange(40), 3), np.tile(np.arange(3), 40)
    found = layout.of_pairs(words, contexts, word, context)
    assert all(len(set(found[context == c])) == 1 for c in (0, 2)) and len(set(found[context == 1])) > 10
    rest = rng.permutation(120)
    assert (layout.of_pairs(words, contexts, word[rest], context[rest]) == found[rest]).all()


def test_merged_pairs_leave_out_what_has_no_count():
    a = lm.Cells(np.array([2, 5], np.uint64), np.array([2, 1]), np.array([1, 4], np.uint64), np.array([0, 1, 1]), np.array([3, 0, 2]))
    b = lm.Cells(np.array([2, 9], np.uint64), np.array([1, 1]), np.array([1, 7], np.uint64), np.array([0, 1]), np.array([4, 0]))
    both = lm.Cells.merged([a, b])
    assert [x.tolist() for x in (both.words, both.many, both.contexts, both.context, both.count)] == [[2, 5], [1, 1], [1, 4], [0, 1], [7, 2]]
    assert not len(lm.Cells.merged([lm.Cells(b.words[:1], b.many[:1], b.contexts[:1], b.context[:1], np.zeros(1, np.int64))]).words)


def _exact_tables(n, theta, d, base):
    """Mean tables of a dish of n customers alone in a restaurant."""
    stirling = np.zeros((n + 1, n + 1))
    stirling[0, 0] = 1
    for c in range(1, n + 1):
        for t in range(1, c + 1):
            stirling[c, t] = stirling[c - 1, t - 1] + (c - 1 - t * d) * stirling[c - 1, t]
    p = np.array([stirling[n, t] * np.prod([(theta + d * k) * base for k in range(t)]) for t in range(1, n + 1)])
    return (p * np.arange(1, n + 1)).sum() / p.sum()


def test_dishes_of_one_two_and_more_customers_side_by_side():
    theta, d, base, sizes_of = 2.0, 0.5, 0.2, np.array([2, 1, 3, 30, 2, 5])
    rng, many = np.random.default_rng(8), 3000
    c = np.tile(sizes_of, many)
    place, p0 = np.arange(len(c)), np.full(len(c), base)
    tables = lm.seat(c, np.zeros(len(c)), p0, theta, d, rng)
    sizes, totals = lm.split(c, tables, d, rng), tables.copy()
    for _ in range(150):
        tables, sizes = lm.reseat(c, tables, sizes, place, totals, p0, theta, d, rng)
        assert (totals == tables).all() and (tables[c == 1] == 1).all() and (sizes > 0).all()
        assert (np.add.reduceat(sizes, np.cumsum(tables) - tables) == c).all()
    for k, n in enumerate(sizes_of.tolist()):
        own = tables[k :: len(sizes_of)]
        assert abs(own.mean() - _exact_tables(n, theta, d, base)) <= 4 * own.std() / many**0.5


def test_nothing_of_the_sweeps_stays_on_disk(spark):
    before = {t.name for t in spark.catalog.listTables()}, {p.name for p in Path(scratch(spark).removeprefix("file:")).glob("lm-sweep*")}
    df = spark.createDataFrame([(k, f"a b {k % 3} c") for k in range(20)], "doc_id long, text string")
    assert lm.score(df, F.col("doc_id") % 5 != 1).count() == 20
    assert {t.name for t in spark.catalog.listTables()} == before[0]
    assert {p.name for p in Path(scratch(spark).removeprefix("file:")).glob("lm-sweep*")} == before[1]


def test_spent_sweeps_go_before_the_chain_ends(spark):
    df = spark.createDataFrame([(k, f"a b {k % 3} c a b") for k in range(20)], "doc_id long, text string")
    parts = lm.written(lm.chunks(df, F.lit(True)), "lm-test")
    layout = lm.Layout(4, np.zeros(0, np.uint64))
    before = {t.name for t in spark.catalog.listTables()}
    model = lm.gathered(lm.sent(parts, layout))
    done = lm.sample(spark.table(model).filter("chunk = ''"), layout, 2, 2)
    left = {t.name for t in spark.catalog.listTables()} - before
    for used in left:
        spark.sql(f"DROP TABLE {used}")
    assert left == {model, done.index, *done.tables} and len(done.tables) == 4


def test_buckets_write_to_an_eighth_as_many_root_buckets():
    rng = np.random.default_rng(2)
    words = np.unique(rng.integers(2, 1 << 63, 5000, dtype=np.uint64) << np.uint64(1))
    cells = lm.Cells(words, np.ones(len(words), np.int64), np.array([7], np.uint64), np.zeros(len(words), np.int64), np.ones(len(words), np.int64))
    for buckets, roots in ((1, 1), (8, 1), (64, 8), (65, 9)):
        layout = lm.Layout(buckets, np.zeros(0, np.uint64))
        sent = list(lm.Restaurants(cells, layout, lm.Shared()).up(0, layout))
        assert [m[1] for m in sent] == list(range(roots))
        assert (np.concatenate([lm.unpack_sorted(m[3]) for m in sent]) == words).all()
