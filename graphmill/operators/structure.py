"""Features of graphs by built-in functions and joins: sizes, degrees, triangles and components as expressions over the
neighbour masks, cycles by growing paths, separated pairs and what meets them by joins within a graph.

Paths grow by one vertex with each ``explode`` of their possible ends. A row carries its graph's masks, so growing moves
nothing between tasks; only cycles, as masks, are shuffled by their graph.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.functions.graph6 import g6_adj, g6_n


def _bit(v: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), v.cast("int"))


def _has(mask: Column, v: Column) -> Column:
    return F.call_function("getbit", mask, v.cast("int")) == 1


def _near(adj: Column, mask: Column) -> Column:
    """All neighbours of the vertices of a mask."""
    own = F.transform(adj, lambda a, v: F.when(_has(mask, v), a).otherwise(F.lit(0).cast("long")))
    return F.aggregate(own, F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("double"), lambda x, y: x + y.cast("double"))


def with_masks(graphs: DataFrame, g6_col: str = "graph6") -> DataFrame:
    """With ``n, adj, deg``."""
    rows = graphs.withColumns({"n": g6_n(F.col(g6_col)), "adj": g6_adj(F.col(g6_col))})
    return rows.withColumn("deg", F.transform("adj", lambda a: F.bit_count(a)))


def sizes(rows: DataFrame) -> DataFrame:
    """``m, m_minus_n, density`` of graphs with masks."""
    m = (_sum(F.col("deg")) / 2).cast("long")
    return rows.withColumn("m", m).withColumns({"m_minus_n": F.col("m") - F.col("n"), "density": 2 * F.col("m") / (F.col("n") * (F.col("n") - 1))})


def degrees(rows: DataFrame) -> DataFrame:
    """Least, largest and mean degree, its population deviation, and how many vertices have 2, 3, 4, or 5 and more."""
    n, deg = F.col("n"), F.col("deg")
    mean = _sum(deg) / n
    count = lambda test: F.size(F.filter(deg, test)).cast("long")
    return rows.withColumns({
        "deg_min": F.array_min(deg), "deg_max": F.array_max(deg), "deg_mean": mean, "deg_std": F.sqrt(F.greatest(_sum(F.transform(deg, lambda d: d * d)) / n - mean * mean, F.lit(0.0))),
        "deg_count_2": count(lambda d: d == 2), "deg_count_3": count(lambda d: d == 3), "deg_count_4": count(lambda d: d == 4), "deg_count_5plus": count(lambda d: d >= 5), "frac_deg_2": count(lambda d: d == 2) / n,
    })


def triangles(rows: DataFrame) -> DataFrame:
    """``n_triangles``, the mean of the local clustering over all vertices, and the transitivity (0 without two edges that
    meet)."""
    adj, pairs = F.col("adj"), F.transform("deg", lambda d: d * (d - 1) / 2)
    inside = lambda a: _sum(F.transform(adj, lambda b, w: F.when(_has(a, w), F.bit_count(a.bitwiseAND(b))).otherwise(0))) / 2
    rows = rows.withColumns({"_t": F.transform(adj, inside), "_p": pairs})
    local = F.zip_with("_t", "_p", lambda t, p: F.when(p > 0, t / p).otherwise(0.0))
    of_all = F.when(_sum(F.col("_p")) > 0, _sum(F.col("_t")) / _sum(F.col("_p"))).otherwise(0.0)
    return rows.withColumns({"n_triangles": (_sum(F.col("_t")) / 3).cast("long"), "avg_clustering": _sum(local) / F.col("n"), "transitivity": of_all}).drop("_t", "_p")


def components(rows: DataFrame) -> DataFrame:
    """``n_components``, of any graph: the vertices that reach none before them."""
    vertices = F.sequence(F.lit(0), F.col("n") - 1)
    reach = lambda v: F.aggregate(vertices, _bit(v), lambda s, _: s.bitwiseOR(_near(F.col("adj"), s)))
    first = F.filter(vertices, lambda v: reach(v).bitwiseAND(_bit(v) - 1) == 0)
    return rows.withColumn("n_components", F.size(first).cast("long"))


def cycles(rows: DataFrame, key: str, most: int, chordless: bool) -> DataFrame:
    """``key, mask, len``: every cycle of graphs of at most ``most`` vertices once, or only those without a chord. A path
    begins at a cycle's least vertex; of a cycle's two directions that with the smaller second vertex counts."""
    state = rows.select(key, "n", "adj", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("start"))
    state = state.select(key, "n", "adj", "start", F.lit(-1).alias("second"), F.col("start").alias("at"), _bit(F.col("start")).alias("mask"), F.lit(1).alias("len"), F.lit(False).alias("closed"))
    fields = ("second", "at", "mask", "len", "closed")
    for step in range(1, most):
        own = lambda w: F.get("adj", w).bitwiseAND(F.col("mask"))  # noqa: E731  neighbours on the path
        back = lambda w: _has(F.get("adj", w), F.col("start"))
        fits = lambda w: _has(F.get("adj", F.col("at")), w) & ~_has(F.col("mask"), w)
        alone = lambda w: (own(w) == _bit(F.col("at"))) if chordless else F.lit(True)
        ring = lambda w: (own(w) == _bit(F.col("at")).bitwiseOR(_bit(F.col("start")))) if chordless else back(w)
        ends = F.filter(F.sequence(F.col("start") + 1, F.col("n")), lambda w: (w < F.col("n")) & fits(w))
        grown = lambda w, closed: F.struct(F.when(F.col("len") == 1, w).otherwise(F.col("second")).alias("second"), w.alias("at"), F.col("mask").bitwiseOR(_bit(w)).alias("mask"), (F.col("len") + 1).alias("len"), F.lit(closed).alias("closed"))
        longer = F.transform(F.filter(ends, alone), lambda w: grown(w, False))
        if step > 1:
            shut = F.transform(F.filter(ends, lambda w: ring(w) & (w > F.col("second"))), lambda w: grown(w, True))
            longer = F.concat(shut, longer) if step < most - 1 else shut
        kept = F.array(F.struct(*fields))
        state = state.select(key, "n", "adj", "start", F.explode(F.when(F.col("closed"), kept).otherwise(longer)).alias("s")).select(key, "n", "adj", "start", "s.*")
    found = state.filter("closed")
    return found.select(key, "mask", "len", F.col("mask").bitwiseOR(_near(F.col("adj"), F.col("mask"))).alias("closure"))


def separated(odd: DataFrame, key: str) -> DataFrame:
    """``key, a, b, len_a, len_b``: pairs of chordless odd cycles, the smaller mask first, that neither meet nor touch."""
    left = odd.select(key, F.col("mask").alias("a"), F.col("len").alias("len_a"), "closure")
    right = odd.select(key, F.col("mask").alias("b"), F.col("len").alias("len_b"))
    return left.join(right, key).filter((F.col("a") < F.col("b")) & (F.col("closure").bitwiseAND(F.col("b")) == 0)).drop("closure")


def pair_counts(rows: DataFrame, odd: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """``key, n_chordless_odd_cycles, sep_pairs, sep_pairs_3_3, sep_pairs_3_5, sep_pairs_other, normalization_gap`` of every
    graph of ``rows``; ``normalization_gap`` counts the different unions of a pair."""
    total = F.col("len_a") + F.col("len_b")
    counts = pairs.groupBy(key).agg(
        F.count(F.lit(1)).alias("sep_pairs"), F.count_if(total == 6).alias("sep_pairs_3_3"), F.count_if(total == 8).alias("sep_pairs_3_5"), F.count_if(total > 8).alias("sep_pairs_other"),
        F.count_distinct(F.col("a").bitwiseOR(F.col("b"))).alias("normalization_gap"),
    )
    number = odd.groupBy(key).agg(F.count(F.lit(1)).alias("n_chordless_odd_cycles"))
    names = ["n_chordless_odd_cycles", "sep_pairs", "sep_pairs_3_3", "sep_pairs_3_5", "sep_pairs_other", "normalization_gap"]
    return rows.select(key).join(number, key, "left").join(counts, key, "left").fillna(0, names).select(key, *names)


def meeting(rows: DataFrame, even: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """``key, even_cycles_meeting_pair, even_cycle_meets_pair, even_meeting_len_min``: even cycles that share a vertex with
    either cycle of some separated pair, each counted once."""
    of = lambda c: F.col(c).bitwiseAND(F.col("mask")) != 0
    own = even.groupBy(key, "mask", "len").agg(F.count(F.lit(1)).alias("c")).alias("e")
    met = own.join(pairs.select(F.col(key).alias("_key"), "a", "b"), (F.col(f"e.{key}") == F.col("_key")) & of("a") & of("b"), "left_semi")
    sums = met.groupBy(key).agg(F.sum("c").alias("even_cycles_meeting_pair"), F.min("len").cast("long").alias("even_meeting_len_min"))
    out = rows.select(key).join(sums, key, "left").withColumn("even_cycle_meets_pair", F.col("even_meeting_len_min").isNotNull().cast("long"))
    return out.fillna(0, ["even_cycles_meeting_pair"]).select(key, "even_cycles_meeting_pair", "even_cycle_meets_pair", "even_meeting_len_min")


def threads(rows: DataFrame) -> DataFrame:
    """``n_threads, thread_max_len``: components of what the vertices of degree two induce, and one more than the vertices of
    the largest (0 if there is none)."""
    two = F.aggregate(F.transform("deg", lambda d, v: F.when(d == 2, _bit(v)).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda x, y: x.bitwiseOR(y))
    rows = rows.withColumn("_two", two).withColumn("_inside", F.transform("adj", lambda a: a.bitwiseAND(F.col("_two"))))
    vertices = F.sequence(F.lit(0), F.col("n") - 1)
    reach = lambda v: F.aggregate(vertices, _bit(v), lambda s, _: s.bitwiseOR(_near(F.col("_inside"), s)))
    first = F.filter(F.transform(vertices, lambda v: F.struct(v.alias("v"), reach(v).alias("s"))), lambda x: _has(F.col("_two"), x["v"]) & (x["s"].bitwiseAND(_bit(x["v"]) - 1) == 0))
    rows = rows.withColumn("_first", first)
    longest = F.coalesce(F.array_max(F.transform("_first", lambda x: F.bit_count(x["s"]))) + 1, F.lit(0))
    return rows.withColumns({"n_threads": F.size("_first").cast("long"), "thread_max_len": longest.cast("long")}).drop("_two", "_inside", "_first")


def distances(rows: DataFrame) -> DataFrame:
    """``diameter, radius, avg_shortest_path``, by growing the reach of every vertex; null for a graph that is not
    connected."""
    everything = _bit(F.col("n")) - 1
    vertices = F.sequence(F.lit(0), F.col("n") - 1)

    def wider(s: Column, step: Column) -> Column:
        reach = s["seen"].bitwiseOR(_near(F.col("adj"), s["seen"]))
        new = F.bit_count(reach) - F.bit_count(s["seen"])
        return F.struct(reach.alias("seen"), F.when(new > 0, step).otherwise(s["far"]).alias("far"), (s["total"] + new * step).alias("total"))

    of = lambda v: F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n") - 1, F.lit(1))), F.struct(_bit(v).alias("seen"), F.lit(0).alias("far"), F.lit(0).alias("total")), wider)
    rows = rows.withColumn("_from", F.transform(vertices, of))
    whole = F.get("_from", F.lit(0))["seen"] == everything
    far = F.transform("_from", lambda s: s["far"])
    mean = _sum(F.transform("_from", lambda s: s["total"])) / (F.col("n") * (F.col("n") - 1))
    return rows.withColumns({"diameter": F.when(whole, F.array_max(far)).cast("long"), "radius": F.when(whole, F.array_min(far)).cast("long"), "avg_shortest_path": F.when(whole, mean)}).drop("_from")


def cycle_counts(rows: DataFrame, found: DataFrame, key: str, lengths: range, chordless: bool) -> DataFrame:
    """Cycles by length, odd and even ones, and girths (null without such a cycle); of chordless cycles those by length and
    the even ones. A graph has a row whether it has cycles or not."""
    length, one = F.col("len"), "chordless_len" if chordless else "cyc_len"
    counts = {f"{one}_{k}": F.count_if(length == k) for k in lengths} | {"n_chordless_even_cycles" if chordless else "n_even_cycles": F.count_if(length % 2 == 0)}
    if not chordless:
        counts["n_odd_cycles"] = F.count_if(length % 2 == 1)
    girths = {} if chordless else {"girth": F.min(length), "odd_girth": F.min(F.when(length % 2 == 1, length)), "even_girth": F.min(F.when(length % 2 == 0, length))}
    sums = found.groupBy(key).agg(*[c.alias(name) for name, c in counts.items()], *[c.cast("long").alias(name) for name, c in girths.items()])
    return rows.select(key).join(sums, key, "left").fillna(0, list(counts))


def hamiltonian(rows: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """``is_hamiltonian``: whether some cycle has all vertices."""
    whole = found.join(rows.select(F.col(key).alias("_key"), "n"), (F.col(key) == F.col("_key")) & (F.col("len") == F.col("n"))).select(key).distinct().withColumn("is_hamiltonian", F.lit(1).cast("long"))
    return rows.select(key).join(whole, key, "left").fillna(0, ["is_hamiltonian"])
