"""Audit of how far sources diverge in their vocabulary, within a language.

A language keeps the V terms that are in at least ``least_docs`` of its documents. A group (language, source) gives each
kept term the smoothed share p = 1 + floor(10^9 * (n + 5) / (N + 5 V)), where n counts the term's occurrences in the group
and N those of all kept terms; the language itself has such shares too.

Two groups a, b differ by the sum of abs(p_a - p_b) over all kept terms. That sum is never taken over the V terms: a pair
starts at V * abs(z_a - z_b), where z is the share of a count of zero, and an inverted index (the groups of each term,
with their shares) corrects it where counts are not zero:

* a term of a alone adds abs(p_a - z_b) - abs(z_a - z_b). It depends on p_a only, so terms of equal share are counted
  first, and the counts meet the other groups of the language;
* a term of both adds abs(p_a - p_b) + abs(z_a - z_b) - abs(p_a - z_b) - abs(z_a - p_b) beyond that, by a join of the
  postings with themselves; zeros go at once and the rest is summed before it is shuffled. A posting has a row for each source
  of a language at most, so a term gives no more pairs than the result has.

The terms that a group has more of than its language are ranked by abs(p_group - p_language) in a window that keeps the
first ``top`` of each task before anything is shuffled.

Counting is one pass over whole texts: each task counts in dictionaries of bounded size, Spark sums them up by (language,
source, term), and only then are rows gathered by (language, term), at most one for each source. Shares are exact in
64-bit arithmetic up to 9 * 10^15 occurrences.

Defined cases: null texts, languages and sources count as ''; a text without terms makes its group occur; without kept
terms all differences are 0 and no terms are ranked; equal values are ranked by the item's bytes; repeated rows are
documents of their own; very long texts are cut at separators and counted whole; an empty table gives no rows; columns
other than those named are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphmill.llm.common import text_of, written

LEAST_DOCS, TOP = 30, 50
#: Bytes of a text that are split at a time, and entries that a task counts before it hands them on.
SLICE, ENTRIES = 4_000_000, 200_000

#: Terms are runs of letters and of bytes beyond ASCII, A-Z lower-cased; all else separates.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, in parts of bounded size."""
    plain, a = text.translate(_TERM), 0
    while len(plain) - a > SLICE:
        end = plain.rfind(b" ", a + 1, a + SLICE)  # beyond the separator that the last part ended at
        if end < 0 and (end := plain.find(b" ", a + SLICE)) < 0:
            break
        yield plain[a:end].split()
        a = end
    yield plain[a:].split()


_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])


def term_counts(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each term of each group; an empty term marks the group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def handed() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, docs) in held.items():
                size = len(n) + 1
                columns = [[lang] * size, [source] * size, [b"", *n], [0, *n.values()], [0, *(docs[t] for t in n)]]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _COUNTED)], schema=_COUNTED)
            held.clear()

        for batch in batches:
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                n, docs = held.setdefault((lang, source), (Counter(), Counter()))
                seen: set[bytes] = set()
                for part in terms(text.as_py()):
                    n.update(part)
                    seen.update(part)
                docs.update(seen)
            if sum(len(n) for n, _ in held.values()) > ENTRIES:
                yield from handed()
        yield from handed()

    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"))]
    rows = docs.select(*named, text_of(text_col).cast("binary").alias("text")).mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: str, total: str, kept: str) -> Column:
    """1 + floor(10^9 * (n + 5) / (total + 5 * kept)), three digits at a time so that nothing leaves 64 bits."""
    d = f"greatest({total} + 5 * {kept}, 1)"
    digits, rest = [], f"({n} + 5)"
    for _ in range(3):
        digits.append(f"(({rest} * 1000) div {d})")
        rest = f"(({rest} * 1000) % {d})"
    return F.expr(f"1 + 1000000 * {digits[0]} + 1000 * {digits[1]} + {digits[2]}")


def postings(docs: DataFrame, least_docs: int = LEAST_DOCS, **columns: str) -> tuple[DataFrame, DataFrame]:
    """The index, written: ``lang, source, term, n, p, zero, of_lang`` for each kept term of a group (``zero``: the group's
    share of a count of zero, ``of_lang``: the language's share), and the groups ``lang, source, kept, zero``."""
    of_term = Window.partitionBy("lang", "term")
    rows = term_counts(docs, **columns).withColumns({"in_docs": F.sum("docs").over(of_term), "total": F.sum("n").over(of_term), "row": F.row_number().over(of_term.orderBy("source"))})
    kept = written(rows.filter((F.length("term") == 0) | (F.col("in_docs") >= least_docs)).select("lang", "source", "term", "n", "total", "row"), "divergence-terms")
    size = kept.groupBy("lang").agg(F.count_if((F.length("term") > 0) & (F.col("row") == 1)).alias("kept"), F.sum("n").alias("lang_n"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("group_n"))
    groups = written(own.join(size, "lang").withColumn("zero", F.when(F.col("kept") > 0, _share("0", "group_n", "kept")).otherwise(0)), "divergence-groups")
    index = kept.filter(F.length("term") > 0).join(groups, ["lang", "source"])
    index = index.select("lang", "source", "term", "n", _share("n", "group_n", "kept").alias("p"), "zero", _share("total", "lang_n", "kept").alias("of_lang"))
    return written(index, "divergence-postings"), groups.select("lang", "source", "kept", "zero")


def pair_values(index: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for each group and each other source of its language."""
    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    apart = F.abs(F.col("zero") - F.col("other_zero"))
    both = [F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")]
    start = groups.join(other, "lang").filter("source < other").select("lang", *both, (F.col("kept") * apart).alias("value"))
    same = index.groupBy("lang", "source", "p", "zero").agg(F.count(F.lit(1)).alias("terms"))
    alone = same.join(other, "lang").filter("source <> other").select("lang", *both, (F.col("terms") * (F.abs(F.col("p") - F.col("other_zero")) - apart)).alias("value"))
    left = index.select("lang", "term", "source", "p", "zero")
    right = index.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("other_p"), F.col("zero").alias("other_zero"))
    met = F.abs(F.col("p") - F.col("other_p")) + apart - F.abs(F.col("p") - F.col("other_zero")) - F.abs(F.col("zero") - F.col("other_p"))
    shared = left.join(right.hint("merge"), ["lang", "term"]).filter("source < other").select("lang", *both, met.alias("value")).filter("value <> 0")
    total = start.unionByName(alone).unionByName(shared).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    sides = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return total.select("lang", sides.alias("s"), "value").select("lang", "s.source", "s.item", "value")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, **columns: str) -> DataFrame:
    """``lang, source, part, item, value, rank``: part ``pair`` has every other source of the language, part ``term`` the
    ``top`` terms that the group has more of than its language. ``columns``: ``lang_col``, ``source_col``, ``text_col``."""
    index, groups = postings(docs, least_docs, **columns)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = pair_values(index, groups).select("lang", "source", F.lit("pair").alias("part"), "item", "value", place)
    more = index.filter("p > of_lang").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("of_lang")).alias("value"))
    ranked = more.select("lang", "source", "part", "item", "value", place).filter(F.col("rank") <= top).withColumn("item", F.col("item").cast("string"))
    return pairs.unionByName(ranked)


SQL = """
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text, row_number() OVER () AS doc FROM documents),
w AS (SELECT lang, source, doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS total FROM w GROUP BY 1, 2 HAVING count(DISTINCT doc) >= 30),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT g.lang, count(DISTINCT term)::HUGEINT AS kept FROM g LEFT JOIN k USING (lang) GROUP BY 1),
c AS (SELECT w.lang, w.source, w.term, count(*)::HUGEINT AS n FROM w JOIN k USING (lang, term) GROUP BY 1, 2, 3),
gn AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS group_n FROM g LEFT JOIN c USING (lang, source) GROUP BY 1, 2),
ln AS (SELECT lang, sum(total)::HUGEINT AS lang_n FROM k GROUP BY 1),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 5) // (group_n + 5 * kept) AS p, 1 + 1000000000 * (total + 5) // (lang_n + 5 * kept) AS q
  FROM g JOIN k USING (lang) JOIN v USING (lang) JOIN gn USING (lang, source) JOIN ln USING (lang) LEFT JOIN c USING (lang, source, term)),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= 50
"""
