"""Solver texts as columns, by built-in functions. Bad input gives null (or an error where ``strict``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERM = r"(?:\d+(?:\*?T(?:\^\d+)?)?|T(?:\^\d+)?)"
SERIES = rf"^\(([+-]?{TERM}(?:[+-]{TERM})*)\)/\(\(1-T\)\^(\d+)\)$"
ANY_SERIES = r"^\(.*\)/\(\(1-T\)\^(\d+)\)$"


def _series(s: Column) -> Column:
    return F.replace(s, F.lit(" "), F.lit(""))


def hilbert_dim(s: Column) -> Column:
    """The exponent k of ``(...)/((1-T)^k)``."""
    return F.nullif(F.regexp_extract(_series(s), ANY_SERIES, 1), F.lit("")).cast("int")


def h_vector(s: Column, strict: bool = False) -> Column:
    """Coefficients of the numerator by rising power, zeros in the gaps; equal powers add up. Numbers beyond 32 bits are
    bad input. Each term is parsed once, and only digits are cast: a cast that fails costs more than all the rest."""
    numerator = F.nullif(F.regexp_extract(_series(s), SERIES, 1), F.lit(""))
    plain = F.replace(F.replace(numerator, F.lit("*"), F.lit("")), F.lit("-"), F.lit("+-"))
    power = lambda t: F.when(F.contains(t, F.lit("^")), F.substring_index(t, "^", -1).try_cast("int")).when(F.contains(t, F.lit("T")), 1).otherwise(0)
    head = lambda t: F.substring_index(t, "T", 1)
    factor = lambda t: F.when(head(t) == "", 1).when(head(t) == "-", -1).otherwise(head(t).try_cast("int"))
    terms = F.transform(F.split(F.ltrim(plain, F.lit("+")), r"\+"), lambda t: F.struct(power(t).alias("p"), factor(t).alias("c")))
    add = lambda acc, t: F.transform(
        F.sequence(F.lit(0), F.greatest(F.size(acc) - 1, t["p"])), lambda k: F.when(k < F.size(acc), F.get(acc, k)).otherwise(0) + F.when(k == t["p"], t["c"]).when(t["p"].isNotNull(), 0)
    )
    whole = lambda acc: F.when((F.size(acc) > 0) & F.forall(acc, F.isnotnull), acc).otherwise(F.lit(None).cast("array<int>"))
    dense = F.aggregate(terms, F.array().cast("array<int>"), add, whole)
    return F.coalesce(dense, F.raise_error(F.concat(F.lit("bad Hilbert series: "), s)).cast("array<int>")) if strict else dense


def ideal_generators(s: Column) -> Column:
    """The generators inside ``ideal(...)``; an empty array for anything else."""
    inside = F.regexp_extract(F.trim(s), r"(?s)^ideal\s*\((.*)\)$", 1)
    return F.when(F.trim(s).rlike(r"(?s)^ideal\s*\(.*\)$") & (F.trim(inside) != ""), F.transform(F.split(inside, ","), lambda g: F.trim(g))).otherwise(F.array().cast("array<string>"))


def binomial_degree(s: Column) -> Column:
    """Degree of the first monomial of a binomial."""
    first = F.split_part(F.regexp_replace(F.trim(s), r"^-", ""), F.lit("-"), F.lit(1))
    power = lambda f: F.when(F.trim(f).rlike(r"^\d*$"), 0).otherwise(F.coalesce(F.nullif(F.regexp_extract(f, r"\^(\d+)", 1), F.lit("")).try_cast("int"), F.lit(1)))
    return F.aggregate(F.split(first, r"\*"), F.lit(0), lambda acc, f: acc + power(f))


def gen_degrees(s: Column) -> Column:
    """``{2, 5}`` as an array."""
    return F.transform(F.regexp_extract_all(s, F.lit(r"\d+"), F.lit(0)), lambda d: d.cast("int"))


def is_symmetric(h: Column) -> Column:
    return h == F.reverse(h)


def negative_only_at_top(h: Column) -> Column:
    return (F.element_at(h, -1) < 0) & F.coalesce(F.array_min(F.slice(h, F.lit(1), F.size(h) - 1)) >= 0, F.lit(True))


def h_text(h: Column) -> Column:
    """Signed terms such as ``1+3*T-T^2``; zero terms and coefficients of one are left out."""
    term = F.transform(
        h,
        lambda c, p: F.when(c == 0, "").otherwise(
            F.concat(
                F.when(c < 0, "-").otherwise("+"),
                F.when((F.abs(c) == 1) & (p > 0), "").when(p == 0, F.abs(c).cast("string")).otherwise(F.concat(F.abs(c).cast("string"), F.lit("*"))),
                F.when(p == 0, "").when(p == 1, "T").otherwise(F.concat(F.lit("T^"), p.cast("string"))),
            )
        ),
    )
    return F.regexp_replace(F.regexp_replace(F.array_join(term, ""), r"^\+", ""), "^$", "0")


def series_text(h: Column, dim: Column) -> Column:
    return F.concat(F.lit("("), h_text(h), F.lit(")/((1-T)^"), dim.cast("string"), F.lit(")"))
