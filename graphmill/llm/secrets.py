"""Secret scanning with a random forest that removes false positives.

Candidates are the runs of key-like characters with a digit in them or in an issuer's format, and whatever is assigned
to a key like ``password``: up to the closing quote, or else up to a blank, quote, bracket, comma, semicolon or ``&``.
Of each the scan knows its length, its shares of
character classes, how often and how unusually its characters change, how much of it words of a dictionary cover, the
path that it comes from and the words around it. A random forest learned from labelled findings turns that into a
probability. Everything is DataFrame code and MLlib: candidates are cut out by regular expressions with their offsets,
the dictionary is the words that a share of all documents has. Work grows with the length of a text and of a candidate:
offsets are summed up in two levels, characters are taken apart once, and coverage looks at pieces of a candidate.

Defined cases: null counts as empty and has no candidate; texts of any length are scanned whole; a null path is an
empty path; where the labelled findings have one class, or there are none, every score is the share of secrets among
them (0 without any); repeated rows give repeated findings; an empty table gives none; columns other than those named
are not looked at.
"""

from __future__ import annotations

import math
import string

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import HashingTF, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphmill.llm.common import text_of, written

#: Characters of context on either side, and different findings of either label that a forest is fitted on (chosen by a
#: hash of candidate and context).
CONTEXT, TRAIN_FINDINGS = 48, 20_000
#: Share of the documents (and two at least) that a word of the dictionary stands in, and its letters.
DICTIONARY_SHARE, WORD_LENGTHS = 1e-4, (3, 16)
#: Hits, and characters of a candidate, that are taken together.
HITS, PIECE = 64, 256
TREES, DEPTH, NEIGHBOUR_CELLS, SEED = 30, 8, 128, 11

#: Formats of issuers, and words before an assigned secret: fixed values.
FORMATS = {
    "cloud_key": r"^(AKIA|ASIA)[0-9A-Z]{16}$",
    "vcs_token": r"^(gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20})$",
    "payment_key": r"^(sk|rk)_(live|test)_[0-9A-Za-z]{16,}$",
    "chat_token": r"^xox[abprs]-[0-9A-Za-z-]{10,}$",
}
ASSIGNED = {"password": r"(?i)(password|passwd|pwd|passphrase)[\"']?\s*[:=]\s*[\"']?$", "token": r"(?i)(token|secret|api[_-]?key|access[_-]?key)[\"']?\s*[:=]\s*[\"']?$"}
ISSUED = "|".join(p.strip("^$") for p in FORMATS.values())
CANDIDATE = rf"(?<![A-Za-z0-9_+/.-])(?:(?=[A-Za-z_+/.-]*[0-9])|(?={ISSUED}))[A-Za-z0-9_+/.-]{{8,}}={{0,2}}"
_BARE = "(?:" + "|".join(p.removesuffix(r"""[\"']?$""").replace("(?i)", "(?i:", 1).replace(")", "))", 1) for p in ASSIGNED.values()) + ")"
KEY = _BARE + r"""["']?"""
ASSIGNMENT = _BARE + r"""(?:"[^"\r\n]+"|'[^'\r\n]+'|["']?[^\s"',;&<>(){}\[\]]+)"""


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``doc_id, path, start, candidate, before, after``: ``start`` counts characters from 0."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(path_col).cast("string"), F.lit("")).alias("path"), text_of(text_col).alias("t"))
    rows = rows.filter(F.col("t").rlike(CANDIDATE) | F.col("t").rlike(ASSIGNMENT))
    for name, pattern in (("run", CANDIDATE), ("assigned", ASSIGNMENT)):
        rows = rows.withColumn(f"{name}_hit", F.regexp_extract_all("t", F.lit(pattern), F.lit(0))).withColumn(f"{name}_gap", F.split("t", pattern, -1))
    rows = rows.select("doc_id", "path", _spans("run").alias("runs"), F.filter(F.transform(_spans("assigned"), _value), lambda f: F.trim(f["candidate"]) != "").alias("values"))
    # a value holds the run that begins where it does
    runs = F.filter("runs", lambda f: ~F.exists("values", lambda v: v["start"] == f["start"]))
    return rows.select("doc_id", "path", F.explode(F.concat(runs, "values")).alias("f")).select("doc_id", "path", "f.start", "f.candidate", "f.before", "f.after")


def _spans(name: str) -> Column:
    """Hits with their offsets and context."""
    hit, gap = F.col(f"{name}_hit"), F.col(f"{name}_gap")
    # where each gap begins: running sums within blocks of hits, and of the blocks' totals
    steps = F.zip_with(gap, hit, lambda g, h: F.length(g) + F.coalesce(F.length(h), F.lit(0)))
    add = lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)
    blocks = F.transform(F.sequence(F.lit(0), F.size(hit), F.lit(HITS)), lambda b: F.aggregate(F.slice(steps, b + 1, F.lit(HITS)), F.array(F.lit(0)), add))
    starts = F.slice(F.aggregate(blocks, F.array(F.lit(0)), lambda acc, b: add(acc, F.element_at(b, -1))), F.lit(1), F.size(blocks))
    begins = F.flatten(F.zip_with(blocks, starts, lambda b, s: F.transform(F.slice(b, F.lit(1), F.size(b) - 1), lambda v: v + s)))
    return F.transform(
        F.zip_with(F.slice(begins, F.lit(1), F.size(hit)), hit, lambda begin, h: F.struct(begin.alias("begin"), h.alias("h"))),
        lambda x, k: F.struct(
            (x["begin"] + F.length(F.get(gap, k))).alias("start"), F.regexp_replace(x["h"], r"[.]+$", "").alias("candidate"),
            F.right(F.get(gap, k), F.lit(CONTEXT)).alias("before"), F.left(F.get(gap, k + 1), F.lit(CONTEXT)).alias("after"),
        ),
    )


def _value(f: Column) -> Column:
    """The value of an assignment: its key joins what stands before."""
    key = F.regexp_extract(f["candidate"], f"^{KEY}", 0)
    value = F.regexp_replace(F.substr(f["candidate"], F.length(key) + 1), r"""["'.]+$""", "")
    return F.struct((f["start"] + F.length(key)).alias("start"), value.alias("candidate"), F.right(F.concat(f["before"], key), F.lit(CONTEXT)).alias("before"), f["after"].alias("after"))


def dictionary(docs: DataFrame, share: float = DICTIONARY_SHARE, text_col: str = "text") -> DataFrame:
    """``word``: the words that stand in at least ``share`` of the documents and in two. Counted over all documents,
    combined before the shuffle."""
    low, high = WORD_LENGTHS
    words = F.filter(F.array_distinct(F.split(F.lower(text_of(text_col)), r"[^\p{L}]+")), lambda w: F.length(w).between(low, high))
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter(F.col("n") >= max(2, math.ceil(share * docs.count()))).select("word")


def _classes(c: Column) -> Column:
    return F.regexp_replace(F.translate(c, string.ascii_lowercase + string.ascii_uppercase + string.digits, "l" * 26 + "u" * 26 + "d" * 10), "[^lud]", "s")


def _key(candidate: Column) -> Column:
    return F.sha2(candidate.cast("binary"), 256)


def coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """Share of each different candidate's characters that words of the dictionary cover: ``key`` (the candidate's
    digest), ``covered``. A candidate is looked at in pieces, each with what a word may reach beyond its end."""
    low, high = WORD_LENGTHS
    c = F.col("candidate")
    parts = found.select("candidate").distinct().filter(c.rlike(rf"\p{{L}}{{{low}}}")).select(_key(c).alias("key"), F.length(c).alias("size"), F.regexp_extract_all(c, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("pieces"))
    parts = parts.select("key", "size", F.posexplode(F.zip_with("pieces", F.slice("pieces", F.lit(2), F.size("pieces")), lambda a, b: F.struct(F.length(a).alias("own"), F.lower(F.concat(a, F.coalesce(F.left(b, F.lit(high - 1)), F.lit("")))).alias("text")))).alias("at", "p"))
    starts = F.sequence(F.lit(1), F.col("p.own"))
    cut = F.flatten(F.transform(starts, lambda k: F.transform(F.sequence(F.lit(low), F.lit(high)), lambda n: F.struct(k.alias("k"), n.alias("n"), F.substr(F.col("p.text"), k, n).alias("word")))))
    cut = F.filter(cut, lambda p: (F.length(p["word"]) == p["n"]) & p["word"].rlike(r"^\p{L}+$"))
    hits = parts.select("key", "size", "at", F.explode(cut).alias("q")).select("key", "size", "at", "q.*").join(words, "word")
    spots = hits.select("key", "size", F.explode(F.sequence(F.col("at") * PIECE + F.col("k"), F.col("at") * PIECE + F.col("k") + F.col("n") - 1)).alias("spot")).distinct()
    return spots.groupBy("key").agg((F.count(F.lit(1)) / F.first("size")).alias("covered"))


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    """Findings with a number column for each property and ``neighbours``, the marked words around."""
    c = F.col("candidate")
    size = F.greatest(F.length(c), F.lit(1)).cast("double")
    kind = _classes(c)
    changes = F.greatest(F.length(F.regexp_replace(kind, r"(?s)(.)\1*", "$1")) - 1, F.lit(0))
    chars = F.regexp_extract_all(F.lower(c), F.lit("(?s)."), F.lit(0))
    shorter = F.greatest(F.size(chars) - 1, F.lit(0))
    pairs = F.greatest(F.size(F.array_distinct(F.zip_with(F.slice(chars, F.lit(1), shorter), F.slice(chars, F.lit(2), shorter), lambda a, b: F.concat(a, b)))), F.lit(1))
    share = lambda name: (F.length(kind) - F.length(F.replace(kind, F.lit(name), F.lit("")))) / size
    around = lambda col, mark: F.transform(F.filter(F.split(F.lower(col), r"[^\p{L}=:@(]+"), lambda w: w != ""), lambda w: F.concat(F.lit(mark), w))
    covered = coverage(found, words)
    rows = found.join(covered, _key(c) == covered["key"], "left")
    return rows.select(
        "doc_id", "path", "start", "candidate", "before", "after", size.alias("size"), share("d").alias("digits"), share("u").alias("upper"), share("l").alias("lower"), share("s").alias("symbols"),
        (changes / size).alias("changes"), (pairs / size).alias("variety"), c.rlike("^[0-9a-f]+$").cast("double").alias("hex"), F.coalesce("covered", F.lit(0.0)).alias("covered"),
        F.concat(F.slice(F.reverse(around(F.col("before"), "<")), 1, 2), F.slice(around(F.col("after"), ">"), 1, 1), F.transform(F.split("path", r"[/\\.]"), lambda p: F.concat(F.lit("/"), p))).alias("neighbours"),
    )


NUMBERS = ["size", "digits", "upper", "lower", "symbols", "changes", "variety", "hex", "covered"]


def kind(candidate: Column, before: Column) -> Column:
    """The rule that a finding meets, or ``other``."""
    out = F.lit("other")
    for name, pattern in ASSIGNED.items():
        out = F.when(before.rlike(pattern), name).otherwise(out)
    for name, pattern in FORMATS.items():
        out = F.when(candidate.rlike(pattern), name).otherwise(out)
    return out


class Forest:
    """``model`` is None where there was nothing to tell apart; then every score is ``share``."""

    def __init__(self, model, share: float):
        self.model, self.share = model, share

    def score(self, rows: DataFrame) -> DataFrame:
        if self.model is None:
            return rows.withColumn("score", F.lit(self.share))
        return self.model.transform(rows).withColumn("score", vector_to_array("probability")[1])


def sample(labelled: DataFrame, findings: int = TRAIN_FINDINGS) -> DataFrame:
    """One row for each different ``candidate, before, label`` with the number of its copies, at most ``findings`` of
    either label: ``NUMBERS, neighbours, label, copies``."""
    own = F.struct(*NUMBERS, "neighbours")
    groups = labelled.filter(F.col("label").isin(0, 1)).groupBy("candidate", "before", F.col("label").cast("double").alias("label")).agg(F.min_by(own, F.struct("doc_id", "start")).alias("own"), F.count(F.lit(1)).alias("copies"))
    key = F.xxhash64("candidate", "before", F.lit(SEED))
    part = lambda y: groups.filter(F.col("label") == y).orderBy(key, "candidate", "before").limit(findings)
    return part(0).unionByName(part(1)).select("own.*", "label", "copies")


def train(labelled: DataFrame, findings: int = TRAIN_FINDINGS) -> Forest:
    """``labelled``: rows of ``features`` with ``label`` 0 or 1; those of ``sample`` are used. Copies weigh as often as
    they stand there, and both labels weigh the same."""
    chosen = written(sample(labelled, findings), "labelled-findings")
    sizes = {r[0]: r[1] for r in chosen.groupBy("label").agg(F.sum("copies")).collect()}
    if len(sizes) < 2:
        return Forest(None, float(1.0 in sizes))
    weight = F.when(F.col("label") == 1, 0.5 / sizes[1.0]).otherwise(0.5 / sizes[0.0]) * F.col("copies") * chosen.count()
    stages = [
        HashingTF(inputCol="neighbours", outputCol="cells", numFeatures=NEIGHBOUR_CELLS, binary=True),
        VectorAssembler(inputCols=[*NUMBERS, "cells"], outputCol="features"),
        RandomForestClassifier(labelCol="label", featuresCol="features", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=SEED),
    ]
    return Forest(Pipeline(stages=stages).fit(chosen.withColumn("weight", weight)), sizes[1.0] / sum(sizes.values()))


def scan(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """``doc_id, path, start, candidate, kind, score, is_secret`` for each candidate.

    ``labels`` has labelled findings (``doc_id, start, label``). Without it findings are labelled by the issuers'
    formats and by what they are assigned to; the forest then carries that over to findings which meet no rule, and
    removes those that meet one but look like none.
    """
    found = written(candidates(docs, id_col, text_col, path_col), "candidates")
    words = written(dictionary(docs, text_col=text_col), "dictionary")
    rows = written(features(found, words), "findings").withColumn("kind", kind(F.col("candidate"), F.col("before")))
    if labels is None:
        labelled = rows.withColumn("label", (F.col("kind") != "other").cast("int"))
    else:
        own = labels.select(F.col("doc_id").alias("doc_id"), F.col("start").alias("start"), F.col("label").alias("label"))
        labelled = rows.join(own, ["doc_id", "start"])
    scored = train(labelled).score(rows)
    return scored.select("doc_id", "path", "start", "candidate", "kind", "score", (F.col("score") >= 0.5).cast("int").alias("is_secret"))
