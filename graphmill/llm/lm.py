"""A hierarchical Pitman-Yor language model, sampled by Gibbs over the cluster.

Tokens are words (64-bit hashes) and an end for each text. Every word that precedes a training token has a restaurant
of its own, as has the start of a text; all of them share one parent, the root, whose base is uniform over the known
words and one unknown word. A customer of a context restaurant who opens a table sends a customer to the root.

**Where things are.** A pair of context and word lies in the bucket of its context, so a restaurant's tables are counted
where they are. Contexts with more than their share of all tokens (``hot``; at most 4/3 of them for each bucket or for
each 1/1024 of the tokens) are split by word, and their tables are summed by the driver after each sweep. Root dishes
lie in an eighth as many buckets, by the word. The number of buckets follows from the number of tokens, not from the cluster, and each
bucket has a random stream of its own, so scores do not change with the partitioning.

**A sweep** removes and re-seats ``min(customers, STEPS)`` customers of every dish, drawn at random, one at a time: an
existing table takes the customer in proportion to its customers less the discount, a new one in proportion to the
strength, the tables of the restaurant and the parent's probability. Each such step leaves the posterior given the
parent as it is, whatever was drawn, so dishes of any size go through the same steps; restaurants go side by side. The
chain starts from a seating of one customer after the other (in growing blocks), drawn by weight out of several. Then each bucket
tells the root buckets how many tables its words have, these seat their customers likewise, and tell the buckets the
words' numbers: packed arrays over word lists that both sides know. Predictive probabilities are averaged over the
sweeps after the burn-in.

Texts are read once and become chunks: token numbers within a chunk and the chunk's words. A chunk sends its pairs with
their training counts to the buckets, which keep where these lie among their own, and gets for each pair, context and
word its customers and tables back, from which it computes its texts' probabilities. So nothing of the size of the vocabulary goes through the driver or a
broadcast; an empty message is not sent, so there are never more messages than pairs.

Defined cases: null counts as empty, which is one end; without training texts every score is that of the uniform base
over one unknown word (0); very long texts are scored whole; repeated rows give repeated rows, and are counted as often
as they stand there; an empty table gives none; columns other than those named are not looked at.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphmill.llm.arrays import slices
from graphmill.llm.common import text_of, written
from graphmill.llm.words import mix, word_hashes

START, END = np.uint64(0), np.uint64(1)
BURN_IN, SAMPLES, STEPS, TRIES, SEED = 2, 2, 16, 4, 7
#: Strengths of the context restaurants and of the root.
THETA, THETA_ROOT = 2.0, 1.0
#: Tokens for each bucket, and the least number of shares above one of which a context is hot.
BUCKET_TOKENS, LEAST_SHARES = 1_000_000, 1024
#: Buckets of pairs for each root bucket: every one of the former writes to every one of the latter in each sweep.
PER_ROOT = 8
#: Bytes of text in a chunk, and of text hashed at a time.
CHUNK, SLICE = 6_000_000, 2_000_000

CHUNK_SCHEMA = "chunk string, n long, doc_id binary, learn binary, length binary, vocabulary binary, tokens binary"
SENT_SCHEMA = "bucket int, chunk string, words binary, many binary, contexts binary, context binary, count binary"
#: A row of an empty ``chunk`` has the pairs of a bucket; one of a chunk says by two masks and two lists of places
#: which of these the chunk's pairs and contexts are.
MODEL_SCHEMA = SENT_SCHEMA
INDEX_SCHEMA = "bucket int, other int, words binary, count binary"
#: Messages of a sweep. ``up``: to root bucket ``bucket`` from ``other``; ``down``: the other way; ``own``, ``root``: what
#: a bucket or root bucket keeps; ``sum``: figures to be added up.
SWEEP_SCHEMA = "kind string, bucket int, other int, a binary, b binary, c binary, figures array<long>"
BACK_SCHEMA = "chunk string, kind string, bucket int, a binary, b binary, c binary, d binary"
SCORE_SCHEMA = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def rising(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of numbers from 0, and the numbers in it. The numbers' upper bits are sorted as they stand with the
    places in the bits below; where these bits are too few to tell numbers apart, by an argsort."""
    if not len(key):
        return np.zeros(0, np.int64), key
    bits, spare = np.uint64(len(key).bit_length()), np.uint64(64 - max(1, int(key.max()).bit_length()))
    both = (key.astype(np.uint64) << spare) >> bits << bits
    both |= np.arange(len(key), dtype=np.uint64)
    both.sort()
    order = (both & (np.uint64(1) << bits) - np.uint64(1)).view(np.int64)
    ranked = key[order]
    if (ranked[1:] < ranked[:-1]).any():
        order = np.argsort(key, kind="stable")
        ranked = key[order]
    return order, ranked


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers, sorted, and for each number its place among these."""
    order, ranked = rising(key)
    new = np.ones(len(key), bool)
    np.not_equal(ranked[1:], ranked[:-1], out=new[1:])
    at = np.empty(len(key), np.int64)
    at[order] = np.cumsum(new) - 1
    return ranked[new], at


def pack(x: np.ndarray) -> bytes:
    """Compressed: the number of bytes that the largest number needs, then the first bytes of all numbers, and so on."""
    x = np.ascontiguousarray(x).ravel()
    x = x.view(f"u{x.itemsize}")
    width = max(1, -(-int(x.max()).bit_length() // 8)) if len(x) else 1
    x = x.astype(f"<u{1 << (width - 1).bit_length()}", copy=False)
    planes = x.view(np.uint8).reshape(-1, x.itemsize).T[:width]
    return zstandard.ZstdCompressor(level=1).compress(bytes([width]) + planes.tobytes())


def unpack(raw: bytes, kind: str = "<i8") -> np.ndarray:
    plain = zstandard.ZstdDecompressor().decompress(raw)
    planes = np.frombuffer(plain, np.uint8, offset=1).reshape(plain[0], -1)
    if len(planes) == 1:
        return planes[0].astype(kind)
    out = np.zeros((planes.shape[1], np.dtype(kind).itemsize), np.uint8)
    for k, plane in enumerate(planes):
        out[:, k] = plane
    return out.view(kind).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(raw: bytes, kind: str = "<u8") -> np.ndarray:
    return np.cumsum(unpack(raw, kind), dtype=kind)


def pack_signed(x: np.ndarray) -> bytes:
    """Small numbers of either sign."""
    return pack(x << 1 ^ x >> 63)


def unpack_signed(raw: bytes) -> np.ndarray:
    x = unpack(raw)
    return x >> 1 ^ -(x & 1)


def pack_places(at: np.ndarray) -> tuple[bytes, bytes]:
    """Rising places, -1 where there is none: a mask and the others."""
    return pack((at >= 0).astype(np.uint8)), pack_sorted(at[at >= 0])


def unpack_places(mask: bytes, places: bytes) -> np.ndarray:
    known = unpack(mask, "u1").astype(bool)
    at = np.full(len(known), -1)
    at[known] = unpack_sorted(places, "<i8")
    return at


def pack_lines(lines: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers of customers, and of tables (or customers again) after some sweeps. One customer sits at one table, so the
    later lines hold those of two and more only, and each what it differs from the line before."""
    rest = np.diff(lines[1:, lines[0] > 1], axis=0, prepend=0)
    return pack(lines[0]), pack_signed(rest)


def unpack_lines(first: bytes, rest: bytes, lines: int) -> np.ndarray:
    own = unpack(first)
    out = np.tile(own, (lines, 1))
    out[1:, own > 1] = np.cumsum(unpack_signed(rest).reshape(lines - 1, -1), axis=0)
    return out


def _record(schema: str, columns: list[list]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "binary": pa.binary(), "int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "double": pa.float64()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields])


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_record(schema, [list(c) for c in zip(*rows)] if rows else [[] for _ in schema.split(", ")])])


def _rows(batch: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    for part in batch.to_batches() if isinstance(batch, pa.Table) else [batch]:
        columns = list(zip(part.schema.names, part.columns))
        for k in range(part.num_rows):  # one at a time: a row may have megabytes
            yield {name: column[k].as_py() for name, column in columns}


def chunks(docs: DataFrame, learn: F.Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as chunks of token numbers; ``learn`` says which rows the model learns from."""

    def make(ids: list, learns: list, texts: list[bytes], name: str) -> pa.RecordBatch:
        found, sizes = [], []
        for a, b in slices([len(t) for t in texts], SLICE):
            h, n = word_hashes(texts[a:b])
            found.append(np.where(h <= END, h + np.uint64(2), h))
            sizes.append(n)
        size = np.concatenate(sizes)
        tokens = np.empty(int(size.sum()) + len(size), np.uint64)
        last = np.cumsum(size + 1) - 1
        word = np.ones(len(tokens), bool)
        word[last] = False
        tokens[last], tokens[word] = END, np.concatenate(found)
        vocabulary, at = distinct(tokens)
        valid = pa.array(ids, pa.int64())
        own = np.stack([valid.fill_null(0).to_numpy(zero_copy_only=False), valid.is_null().to_numpy(zero_copy_only=False).astype(np.int64)])
        return _record(CHUNK_SCHEMA, [[name], [len(tokens)], [pack(own)], [pack(np.array(learns, np.uint8))], [pack((size + 1).astype(np.int64))], [pack_sorted(vocabulary)], [pack(at.astype(np.uint32))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, learns, texts, size, k = [], [], [], 0, 0
        name = f"{TaskContext.get().partitionId()}"
        for batch in batches:
            for doc, own, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                text = text.as_py()
                if texts and size + len(text) > CHUNK:
                    yield make(ids, learns, texts, f"{name}-{k}")
                    ids, learns, texts, size, k = [], [], [], 0, k + 1
                ids.append(doc)
                learns.append(bool(own))
                texts.append(text)
                size += len(text)
        if texts:
            yield make(ids, learns, texts, f"{name}-{k}")

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), text_of(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, CHUNK_SCHEMA)


def _share(hashes: np.ndarray, n: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


@dataclass
class Layout:
    """Where pairs and words lie: the number of buckets and the sorted hot contexts."""

    buckets: int
    hot: np.ndarray

    def of(self, hashes: np.ndarray) -> np.ndarray:
        return _share(hashes, self.buckets)

    def of_words(self, words: np.ndarray) -> np.ndarray:
        """Root buckets: fewer, as a word has one place there."""
        return _share(words, -(-self.buckets // PER_ROOT))

    def is_hot(self, context: np.ndarray) -> np.ndarray:
        return _places(self.hot, context) >= 0 if len(self.hot) else np.zeros(len(context), bool)

    def of_pairs(self, words: np.ndarray, contexts: np.ndarray, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Of pairs given as places among words and contexts: nearly all are where their contexts are."""
        out = self.of(mix(contexts))[context]
        split = np.flatnonzero(self.is_hot(contexts)[context])
        out[split] = self.of(mix(contexts[context[split]] ^ mix(words + np.uint64(9))[word[split]]))
        return out


@dataclass
class Message:
    """What a chunk has to say to, and to ask of, a bucket: places of its pairs among the chunk's, their words and
    contexts."""

    bucket: int
    at: np.ndarray
    words: np.ndarray
    many: np.ndarray
    contexts: np.ndarray
    context: np.ndarray


@dataclass
class Chunk:
    name: str
    doc_id: np.ndarray
    learn: np.ndarray
    length: np.ndarray
    vocabulary: np.ndarray
    tokens: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Chunk:
        return cls(row["chunk"], unpack(row["doc_id"]).reshape(2, -1), unpack(row["learn"], "u1"), unpack(row["length"]), unpack_sorted(row["vocabulary"]), unpack(row["tokens"], "<u4"))

    def before(self) -> np.ndarray:
        """For each token the number of the word before it, counted from 1 (0: the start of a text)."""
        before = np.empty(len(self.tokens), np.int64)
        before[1:] = self.tokens[:-1] + np.int64(1)
        before[np.cumsum(self.length) - self.length] = 0
        return before

    def keys(self) -> tuple[np.ndarray, int]:
        """For each token its pair as one number, word first, and the bits of a context."""
        bits = len(self.vocabulary).bit_length()
        key = self.tokens.astype(np.int64)
        key <<= bits
        key |= self.before()
        return key, bits

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words and contexts (as of ``before``) of the different pairs, sorted; for each token its pair."""
        key, bits = self.keys()
        pair, at = distinct(key)
        return pair >> bits, pair & (1 << bits) - 1, at

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same with training counts instead of the tokens' pairs, by one sort in place."""
        key, bits = self.keys()
        key <<= 1
        key |= np.repeat(self.learn, self.length)
        key.sort()
        first = np.flatnonzero(np.diff(key >> 1, prepend=-1))
        count = np.add.reduceat(key & 1, first) if len(first) else np.zeros(0, np.int64)
        pair = key[first] >> 1
        return pair >> bits, pair & (1 << bits) - 1, count

    def messages(self, word: np.ndarray, context: np.ndarray, layout: Layout) -> Iterator[Message]:
        names = np.concatenate([[START], self.vocabulary])
        order, bucket = rising(layout.of_pairs(self.vocabulary, names, word, context))
        slot = np.empty(len(names), np.int64)
        for b, part in _slices(bucket):
            at = order[part]
            own, asked, place = word[at], context[at], np.arange(len(at))
            new = np.flatnonzero(np.diff(own, prepend=-1))
            slot[asked] = place
            contexts = np.sort(asked[slot[asked] == place])  # each where it stands last
            slot[contexts] = place[: len(contexts)]
            yield Message(b, at, self.vocabulary[own[new]], np.diff(new, append=len(own)), names[contexts], slot[asked])


def hot_contexts(parts: DataFrame, shares: int) -> np.ndarray:
    """Contexts that precede more than 1 / ``shares`` of all tokens, and some that precede three quarters of it. Every
    chunk names those beyond a quarter of a share of its own, so what goes unnamed is a quarter of a share at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                c = Chunk.of(row)
                count = np.bincount(c.before(), minlength=len(c.vocabulary) + 1).astype(np.int64)
                own = np.flatnonzero(count > len(c.tokens) / (4 * shares))
                yield pa.record_batch([pa.array(np.concatenate([[START], c.vocabulary])[own].view(np.int64)), pa.array(count[own])], ["context", "n"])

    total = parts.agg(F.sum("n")).first()[0] or 0
    counts = parts.mapInArrow(run, "context long, n long").groupBy("context").agg(F.sum("n").alias("n"))
    return np.sort(np.array([r[0] for r in counts.filter(F.col("n") > 0.75 * total / shares).select("context").collect()], np.int64).view(np.uint64))


def sent(parts: DataFrame, layout: Layout) -> DataFrame:
    """The pairs of each chunk by their bucket: words, pairs of each word, contexts, training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                c = Chunk.of(row)
                word, context, count = c.counted()
                for m in c.messages(word, context, layout):
                    yield _record(SENT_SCHEMA, [[x] for x in (m.bucket, c.name, pack_sorted(m.words), pack(m.many.astype(np.uint32)), pack_sorted(m.contexts), pack(m.context.astype(np.uint32)), pack(count[m.at]))])

    return parts.mapInArrow(run, SENT_SCHEMA)


@dataclass
class Cells:
    """Pairs sorted by word and context: words, pairs of each word, contexts, each pair's context among them, counts."""

    words: np.ndarray
    many: np.ndarray
    contexts: np.ndarray
    context: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, row: dict) -> Cells:
        return cls(unpack_sorted(row["words"]), unpack(row["many"], "<u4").astype(np.int64), unpack_sorted(row["contexts"]), unpack(row["context"], "<u4").astype(np.int64), unpack(row["count"]))

    def packed(self) -> tuple[bytes, ...]:
        return pack_sorted(self.words), pack(self.many.astype(np.uint32)), pack_sorted(self.contexts), pack(self.context.astype(np.uint32)), pack(self.count)

    def word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.words)), self.many)

    @classmethod
    def merged(cls, parts: list[Cells]) -> Cells:
        """Those with a count, as one."""
        words, word = _joined([p.words for p in parts], [p.word() for p in parts])
        contexts, context = _joined([p.contexts for p in parts], [p.context for p in parts])
        count, many = np.concatenate([p.count for p in parts]), max(1, len(contexts))
        keep = np.flatnonzero(count)
        order, pair = rising((word * many + context)[keep])
        first = np.flatnonzero(np.diff(pair, prepend=-1))
        total = np.add.reduceat(count[keep[order]], first) if len(first) else np.zeros(0, np.int64)
        word, context = np.divmod(pair[first], many)
        of_word, of_context = np.bincount(word, minlength=len(words)), np.bincount(context, minlength=len(contexts)) > 0
        return cls(words[of_word > 0], of_word[of_word > 0], contexts[of_context], (np.cumsum(of_context) - 1)[context], total)

    @cached_property
    def keys(self) -> np.ndarray:
        return self.word() * len(self.contexts) + self.context

    def find(self, other: Cells) -> tuple[np.ndarray, np.ndarray]:
        """Places of the other's pairs and contexts here, -1 where they are not."""
        if not len(self.words):
            return np.full(len(other.context), -1), np.full(len(other.contexts), -1)
        context, word = _places(self.contexts, other.contexts), _places(self.words, other.words)
        a, b, pair = np.repeat(word, other.many), context[other.context], np.full(len(other.context), -1)
        both = np.flatnonzero((a >= 0) & (b >= 0))
        pair[both] = _places(self.keys, a[both] * len(self.contexts) + b[both])
        return pair, context


def _joined(names: list[np.ndarray], places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted names of several lists, and the places among them of what was given as places in each list."""
    found, at = distinct(np.concatenate(names))
    start = np.cumsum([0, *map(len, names)])
    return found, np.concatenate([at[a:b][p] for a, b, p in zip(start, start[1:], places)])


def _places(known: np.ndarray, asked: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return np.where(known[at] == asked, at, -1)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows sorted by bucket: buckets one after the other, with their rows as a stream."""
    rows = (row for batch in batches for row in _rows(batch))
    ahead = next(rows, None)
    while ahead is not None:
        now = ahead["bucket"]

        def own() -> Iterator[dict]:
            nonlocal ahead
            while ahead is not None and ahead["bucket"] == now:
                yield ahead
                ahead = next(rows, None)

        yield now, own()


def _bucketed(rows: DataFrame, run: Callable, schema: str) -> str:
    """A table, bucketed and sorted by ``bucket``, of what ``run`` makes of the rows of each bucket."""
    spark = rows.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"lm_{uuid.uuid4().hex}"
    made = rows.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, schema)
    made.write.bucketBy(n, "bucket").sortBy("bucket").saveAsTable(name)
    return name


def gathered(rows: DataFrame) -> str:
    """The training pairs of all chunks, a row for each bucket, and a row for each chunk that says where its own are.
    What a bucket was sent stays packed until its pairs are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, own in _by_bucket(batches):
            held: list[Cells] = []
            told, size = [], 0
            for row in own:
                told.append(row)
                held.append(Cells.of(row))
                size += len(held[-1].count)
                if size > 4_000_000:  # a pair in very many chunks must not pile up
                    held = [Cells.merged(held)]
                    size = len(held[0].count)
            cells = Cells.merged(held)
            del held
            yield _record(MODEL_SCHEMA, [[x] for x in (bucket, "", *cells.packed())])
            for row in told:
                pair, context = cells.find(Cells.of(row))
                yield _record(MODEL_SCHEMA, [[x] for x in (bucket, row["chunk"], *pack_places(pair), *pack_places(context), b"")])

    return _bucketed(rows, run, MODEL_SCHEMA)


def _falling(customers: np.ndarray) -> np.ndarray:
    return rising(customers.max(initial=0) - customers)[0]


def seat(customers: np.ndarray, others: np.ndarray, base: np.ndarray, theta: float, discount: float, rng: np.random.Generator, tries: int = TRIES) -> np.ndarray:
    """A first seating: tables after the customers of each dish sat down one after the other, beyond 64 in blocks of a
    sixteenth. Of ``tries`` such seatings one is drawn by the product of what each step was normalised by, which is how
    much the later customers speak for it. ``others``: tables of other dishes in the restaurant, ``base``: the dish's
    probability at the parent."""
    order = _falling(customers)
    c, o, b = customers[order], others[order], base[order]
    t, weight, seated = np.ones((tries, len(c))), np.zeros((tries, len(c))), 1
    left = len(c)
    while True:
        left = int(np.searchsorted(-c[:left], -seated, "left"))  # those with more customers than are seated
        if not left:
            break
        own = t[:, :left]
        opening = (theta + discount * (o[:left] + own)) * b[:left]
        either = opening + seated - discount * own
        if seated < 64:
            weight[:, :left] += np.log(either)
            own += rng.random(own.shape) < opening / either
            seated += 1
        else:
            block = np.minimum(seated // 16, c[:left] - seated).astype(np.int64)
            weight[:, :left] += block * np.log(either)
            own += rng.binomial(block, np.clip(opening / either, 0, 1))
            seated += seated // 16
    out = np.empty(len(c), np.int64)
    out[order] = t[(weight + rng.gumbel(size=weight.shape)).argmax(axis=0), np.arange(len(c))] if tries > 1 else t[0]
    return out


def split(customers: np.ndarray, tables: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """First sizes of the tables of all dishes, one dish after the other."""
    start = np.cumsum(tables) - tables
    g = rng.gamma(1 - discount, size=int(tables.sum())) + 1e-12
    dish = np.repeat(np.arange(len(tables)), tables)
    sizes = 1 + np.floor(g / np.add.reduceat(g, start)[dish] * (customers - tables)[dish]).astype(np.int64) if len(tables) else np.empty(0, np.int64)
    if len(tables):
        sizes[start] += customers - np.add.reduceat(sizes, start)
    return sizes


def reseat(customers: np.ndarray, tables: np.ndarray, sizes: np.ndarray, place: np.ndarray, totals: np.ndarray, base: np.ndarray, theta: float, discount: float, rng: np.random.Generator, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Gibbs steps of single customers: ``tables`` and ``sizes`` after ``min(customers, steps)`` of each dish, drawn at
    random, were removed and seated again. ``place``: the restaurant of each dish, ``totals``: tables of each
    restaurant, kept up to date in place. A lone customer always comes back to a table of its own, and of two it makes no
    difference which one goes, so only dishes of three and more have their tables laid out."""
    order = _falling(customers)
    c, t, where, p0 = customers[order], tables[order].copy(), place[order], base[order]
    slots, pairs = (int(np.searchsorted(-c, -k, "left")) for k in (2, 1))  # dishes of more than two, and of two customers
    room = np.minimum(c, t + steps)[:slots]  # a dish's tables stand first in its room
    start = np.concatenate([[0], np.cumsum(room)])
    n = np.zeros(start[-1], np.int64)
    old, inner = (np.cumsum(tables) - tables)[order], _within(t[:slots])
    n[np.repeat(start[:-1], t[:slots]) + inner] = sizes[np.repeat(old[:slots], t[:slots]) + inner]
    first_customer = (np.cumsum(c) - c)[:slots]
    for j in range(steps):
        e = min(pairs, int(np.searchsorted(-c, -j, "left")))  # dishes with more than j customers
        d = min(slots, e)
        if not e:
            break
        own = n[: start[d]]
        out = np.searchsorted(np.cumsum(own), first_customer[:d] + (rng.random(d) * c[:d]).astype(np.int64), "right")
        own[out] -= 1
        closed = np.concatenate([own[out] == 0, t[d:e] == 2])
        weight = np.maximum(own - discount, 0.0)
        upto = np.cumsum(weight)
        joining = c[:e] - 1 - discount * (t[:e] - closed)
        opening = (theta + discount * (totals[where[:e]] - closed)) * p0[:e]
        drawn = rng.random(e) * (opening + joining)
        opens = drawn >= joining
        to, joins = np.where(closed[:d], out, start[:d] + t[:d]), np.flatnonzero(~opens[:d])
        first = start[joins]
        found = np.searchsorted(upto, upto[first] - weight[first] + drawn[joins], "right")
        found = np.clip(found, first, start[joins + 1] - 1)
        opens[joins] = own[found] == 0  # by rounding at a dish's end only
        to[joins] = np.where(opens[joins], to[joins], found)
        own[to] += 1
        gone = np.flatnonzero(closed[:d] & ~opens[:d])
        last = start[gone] + t[gone] - 1
        own[out[gone]] = own[last]  # the last table moves into the gap
        own[last] = 0
        moved = np.flatnonzero(opens != closed)
        change = opens[moved].astype(np.int64) - closed[moved]
        t[moved] += change
        np.add.at(totals, where[moved], change.astype(totals.dtype))
    out_tables = np.empty(len(c), np.int64)
    out_tables[order] = t
    place = np.repeat((np.cumsum(out_tables) - out_tables)[order], t) + _within(t)
    out_sizes = np.empty(len(place), np.int64)
    out_sizes[place] = np.concatenate([n[n > 0], np.repeat(c[slots:] // t[slots:], t[slots:])])
    return out_tables, out_sizes


def _within(many: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of ``many``."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


@dataclass
class Shared:
    """What all buckets know of the model: few figures, and two for each hot context."""

    words: int = 0
    tokens: int = 0
    discount: float = 0.5
    discount_root: float = 0.5
    hot_customers: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    #: Tables of the hot contexts, customers and tables of the root, after each sweep.
    hot_tables: list[np.ndarray] = field(default_factory=list)
    root_customers: list[int] = field(default_factory=list)
    root_tables: list[int] = field(default_factory=list)

    def root(self, customers: np.ndarray, tables: np.ndarray, sweep: int) -> np.ndarray:
        """Probability of words at the root, by their customers and tables there after a sweep."""
        if not self.root_customers:
            return np.ones(len(customers))
        base = (THETA_ROOT + self.discount_root * self.root_tables[sweep]) / (self.words + 1)
        return (np.where(customers > 0, customers - self.discount_root * tables, 0) + base) / (THETA_ROOT + self.root_customers[sweep])

    def context(self, pair: np.ndarray, pair_tables: np.ndarray, customers: np.ndarray, tables: np.ndarray, root: np.ndarray) -> np.ndarray:
        own = THETA + self.discount * tables
        return (np.where(pair > 0, pair - self.discount * pair_tables, 0) + own * root) / (THETA + customers)


def _discount(ones: int, twos: int) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5


def _rng(sweep: int, bucket: int, root: bool) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[SEED * 1_000_003 + 2 * sweep + root, bucket]))


class Restaurants:
    """The pairs of one bucket: their tables, and the restaurants' totals."""

    def __init__(self, cells: Cells, layout: Layout, shared: Shared):
        self.cells, self.shared, self.word = cells, shared, cells.word()
        self.hot = np.flatnonzero(layout.is_hot(cells.contexts))
        self.hot_at = np.searchsorted(layout.hot, cells.contexts[self.hot])
        self.open = np.flatnonzero(cells.count > 1)
        self.tables = np.ones(len(cells.count), np.int64)
        self.sizes = cells.count[self.open]

    def totals(self, sweep: int, tables: np.ndarray) -> np.ndarray:
        """Tables of each restaurant: those of hot ones as the driver summed them."""
        out = np.bincount(self.cells.context, tables, len(self.cells.contexts)).astype(np.int64)
        if self.shared.hot_tables:
            out[self.hot] = self.shared.hot_tables[sweep][self.hot_at]
        return out

    def customers(self) -> np.ndarray:
        out = np.bincount(self.cells.context, self.cells.count, len(self.cells.contexts)).astype(np.int64)
        out[self.hot] = self.shared.hot_customers[self.hot_at]
        return out

    def sweep(self, k: int, root: np.ndarray, rng: np.random.Generator) -> None:
        """The k-th sweep (from 1), with the parent's probabilities of the words."""
        own, d = self.open, self.shared.discount
        totals, place, base = self.totals(k - 1, self.tables), self.cells.context[own], root[self.word[own]]
        count, tables = self.cells.count[own], self.tables[own]
        if k == 1:
            tables = seat(count, (totals[place] - tables).astype(np.float64), base, THETA, d, rng)
            totals = totals + np.bincount(place, tables - self.tables[own], len(totals)).astype(np.int64)
            self.sizes = split(count, tables, d, rng)
        self.tables[own], self.sizes = reseat(count, tables, self.sizes, place, totals, base, THETA, d, rng)

    def up(self, bucket: int, layout: Layout, before: np.ndarray | None = None) -> Iterator[tuple]:
        """Messages to the root buckets: by how much the words' tables differ from those ``before``; the first time all
        tables, with the words and their counts."""
        cells, n, first = self.cells, len(self.cells.words), before is None
        tables, count = (np.bincount(self.word, x, n).astype(np.int64) for x in (self.tables if first else self.tables - before, cells.count))
        for r, part in _slices(layout.of_words(cells.words)):
            yield "up", r, bucket, pack_sorted(cells.words[part]) if first else b"", pack(count[part]) if first else b"", pack_signed(tables[part]), []

    def figures(self, layout: Layout) -> list[int]:
        """Pairs of count one and two, then customers and tables of the hot contexts."""
        hot = np.zeros((2, len(layout.hot)), np.int64)
        for row, x in zip(hot, (self.cells.count, self.tables)):
            row[self.hot_at] = np.bincount(self.cells.context, x, len(self.cells.contexts)).astype(np.int64)[self.hot]
        return [int((self.cells.count == 1).sum()), int((self.cells.count == 2).sum()), *hot.ravel().tolist()]


def _slices(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal numbers."""
    edge = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    for a, b in zip(edge, [*edge[1:], len(bucket)]):
        yield int(bucket[a]), slice(a, b)


def _summed(rows: DataFrame, sums: str = "figures") -> np.ndarray:
    """The sum of all arrays of one column, added up in the tasks and then by the driver (one array a task)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.column(0).to_pylist():
                total = np.array(row, np.int64) + (0 if total is None else total)
        if total is not None:
            yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.int64()))], ["x"])

    found = [np.array(r[0], np.int64) for r in rows.select(sums).mapInArrow(run, "x array<long>").collect()]
    return np.sum(found, axis=0) if found else np.zeros(0, np.int64)


def _stored(rows: DataFrame) -> str:
    name = f"lm_{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").saveAsTable(name)
    return name


def _of_kind(rows: DataFrame, kind: str) -> DataFrame:
    return rows.filter(F.col("kind") == kind)


def indexed(first: DataFrame) -> str:
    """For each root bucket its words with their counts and numbers of contexts, and where the words of each bucket of
    pairs stand among them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, own in _by_bucket(batches):
            others, words, figures = [], [], []
            for row in own:
                others.append(row["other"])
                words.append(unpack_sorted(row["a"]))
                figures.append(np.stack([unpack(row["b"]), unpack_signed(row["c"])]))
            all_words, at = np.unique(np.concatenate(words), return_inverse=True)
            total = np.zeros((2, len(all_words)), np.int64)
            for line, x in zip(total, np.concatenate(figures, axis=1)):
                np.add.at(line, at, x)
            places = np.split(at, np.cumsum([len(w) for w in words])[:-1])
            rows = [(bucket, -1, pack_sorted(all_words), pack(total)), *((bucket, b, pack_sorted(p.astype(np.int64)), b"") for b, p in zip(others, places))]
            yield _record(INDEX_SCHEMA, [list(c) for c in zip(*rows)])

    return _bucketed(_of_kind(first, "up").select("bucket", "other", "a", "b", "c"), run, INDEX_SCHEMA)


def _index_figures(index: DataFrame) -> np.ndarray:
    """Words, tokens, words with one and with two contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                count, contexts = unpack(raw.as_py()).reshape(2, -1)
                total += np.array([len(count), count.sum(), (contexts == 1).sum(), (contexts == 2).sum()])
        yield pa.record_batch([pa.array([total.tolist()], pa.list_(pa.int64()))], ["x"])

    return _summed(index.filter("other = -1").select("count").mapInArrow(run, "x array<long>"), "x")


def swept_pairs(model: DataFrame, messages: DataFrame, layout: Layout, shared: Shared, k: int) -> DataFrame:
    """The k-th sweep of the context restaurants, from what the root said and what the buckets kept."""
    known = model.sparkSession.sparkContext.broadcast((layout, shared))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        layout, shared = known.value
        out = []
        for row in _rows(left):
            own = Restaurants(Cells.of(row), layout, shared)
            told = {}
            for r in _rows(right):
                if r["kind"] == "own":
                    own.tables, own.sizes = unpack(r["a"]), unpack(r["b"])
                else:
                    told[r["other"]] = r
            root = shared.root(*(np.concatenate([unpack(told[b][x]) for b in sorted(told)]) if told else np.zeros(0) for x in "ab"), k - 1)
            before = own.tables.copy()
            own.sweep(k, root, _rng(k, row["bucket"], False))
            out += [*own.up(row["bucket"], layout, before), ("own", row["bucket"], -1, pack(own.tables), pack(own.sizes), b"", []), ("sum", row["bucket"], -1, b"", b"", b"", own.figures(layout))]
        return _table(SWEEP_SCHEMA, out)

    return model.groupBy("bucket").cogroup(messages.groupBy("bucket")).applyInArrow(run, SWEEP_SCHEMA)


def swept_root(index: DataFrame, up: DataFrame, shared: Shared, k: int) -> DataFrame:
    """The root's seating for the tables of the k-th sweep: customers sit down anew, then the Gibbs steps. ``up``: what the
    buckets say and, after the first time, the customers that the root bucket kept."""
    known = index.sparkSession.sparkContext.broadcast(shared)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        shared, out, places, n = known.value, [], {}, 0
        for row in _rows(left):
            bucket = row["bucket"]
            if row["other"] < 0:
                n = len(unpack_sorted(row["words"]))
            else:
                places[row["other"]] = unpack_sorted(row["words"], "<i8")
        if not n:
            return _table(SWEEP_SCHEMA, [])
        customers, rng = np.zeros(n, np.int64), _rng(k, bucket, True)
        for row in _rows(right):
            if row["kind"] == "root":
                customers += unpack(row["a"])
            else:
                customers[places[row["other"]]] += unpack_signed(row["c"])
        tables_before = shared.root_tables[-1] if shared.root_tables else shared.words
        flat, d = np.full(n, 1 / (shared.words + 1)), shared.discount_root
        tables = seat(customers, np.full(n, tables_before - 1.0), flat, THETA_ROOT, d, rng, 1)
        tables, _ = reseat(customers, tables, split(customers, tables, d, rng), np.zeros(n, np.int64), np.array([max(tables_before, tables.sum())]), flat, THETA_ROOT, d, rng)
        out = [("down", b, bucket, pack(customers[at]), pack(tables[at]), b"", []) for b, at in places.items()]
        out += [("root", bucket, -1, pack(customers), pack(tables), b"", []), ("sum", bucket, -1, b"", b"", b"", [int(customers.sum()), int(tables.sum())])]
        return _table(SWEEP_SCHEMA, out)

    return index.groupBy("bucket").cogroup(up.filter("kind in ('up', 'root')").groupBy("bucket")).applyInArrow(run, SWEEP_SCHEMA)


@dataclass
class Sampled:
    """What the chain left behind: the figures, and the tables of the sweeps after the burn-in."""

    shared: Shared
    index: str
    pairs: dict[int, DataFrame]
    roots: dict[int, DataFrame]
    #: Their tables.
    tables: list[str]


def sample(model: DataFrame, layout: Layout, burn_in: int = BURN_IN, samples: int = SAMPLES) -> Sampled:
    """Run the chain: two small exchanges a sweep. A sweep's tables go when the next sweep has no need of them, unless it
    is one of the samples."""
    spark, shared, hot = model.sparkSession, Shared(), len(layout.hot)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                own = Restaurants(Cells.of(row), layout, Shared(hot_customers=np.zeros(hot, np.int64)))
                rows = [*own.up(row["bucket"], layout), ("sum", row["bucket"], -1, b"", b"", b"", own.figures(layout))]
                yield _record(SWEEP_SCHEMA, [list(c) for c in zip(*rows)])

    first = _stored(model.mapInArrow(begin, SWEEP_SCHEMA))
    up = spark.table(first)
    figures = _summed(_of_kind(up, "sum"))
    if len(figures):
        shared.discount, shared.hot_customers = _discount(*figures[:2].tolist()), figures[2 : 2 + hot]
    shared.hot_tables.append(figures[2 + hot :])
    index = indexed(up)
    table = spark.table(index)
    shared.words, shared.tokens, ones, twos = (_index_figures(table).tolist() or [0] * 4)[:4]
    shared.discount_root = _discount(ones, twos)
    done, kept, spent = Sampled(shared, index, {}, {}, []), None, []
    for k in range(burn_in + samples + 1):
        names = [first]
        if k:
            messages = _of_kind(down, "down")
            names = [_stored(swept_pairs(model, messages if kept is None else messages.unionByName(kept), layout, shared, k))]
            up = spark.table(names[0])
            figures = _summed(_of_kind(up, "sum"))
            shared.hot_tables.append(figures[2 + hot :] if len(figures) else shared.hot_tables[-1])
            kept = _of_kind(up, "own")
        names.append(_stored(swept_root(table, up.unionByName(_of_kind(down, "root")) if k else up, shared, k)))
        down = spark.table(names[1])
        figures = _summed(_of_kind(down, "sum")).tolist() or [0, 0]
        shared.root_customers.append(figures[0])
        shared.root_tables.append(figures[1])
        for used in spent:
            spark.sql(f"DROP TABLE {used}")
        spent = names
        if k > burn_in:
            done.pairs[k], done.roots[k] = kept, _of_kind(down, "root")
            done.tables, spent = done.tables + names, []
        elif not k:
            spark.sql(f"DROP TABLE {first}")  # its words are in the index now
            spent = names[1:]
    done.tables += spent
    return done


def answered(table: DataFrame, sampled: Sampled, layout: Layout) -> DataFrame:
    """For the pairs and contexts of each chunk in each bucket, of every pair the training count and, for every sample,
    the tables; of every context customers and tables likewise. Hot contexts are left to the chunk."""
    known = table.sparkSession.sparkContext.broadcast((layout, sampled.shared))
    sweeps = sorted(sampled.pairs)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        layout, shared = known.value
        own, out = next(Restaurants(Cells.of(row), layout, shared) for row in _rows(left) if not row["chunk"]), []
        tables = {row["k"]: unpack(row["a"]) for row in _rows(right)}
        of_pair = [own.cells.count, *(tables[k] for k in sweeps)]
        of_context = [own.customers(), *(own.totals(k, tables[k]) for k in sweeps)]
        for row in _rows(left):
            if row["chunk"]:
                cells = []
                for values, at in ((of_pair, unpack_places(row["words"], row["many"])), (of_context, unpack_places(row["contexts"], row["context"]))):
                    lines = np.zeros((1 + len(sweeps), len(at)), np.int64)
                    for line, x in zip(lines, values):
                        line[at >= 0] = x[at[at >= 0]]
                    cells += pack_lines(lines)
                out.append((row["chunk"], "pair", row["bucket"], *cells))
        return _table(BACK_SCHEMA, out)

    kept = None
    for k, df in sampled.pairs.items():
        one = df.select("bucket", F.lit(k).alias("k"), "a")
        kept = one if kept is None else kept.unionByName(one)
    return table.groupBy("bucket").cogroup(kept.groupBy("bucket")).applyInArrow(run, BACK_SCHEMA)


def answered_words(parts: DataFrame, sampled: Sampled, layout: Layout) -> DataFrame:
    """For the words of each chunk: training counts and, for every sample, customers and tables at the root."""
    sweeps = sorted(sampled.roots)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                words = unpack_sorted(row["vocabulary"])
                out = [(r, row["chunk"], pack_sorted(words[part]), b"") for r, part in _slices(layout.of_words(words))]
                yield _record("bucket int, chunk string, words binary, tables binary", [list(c) for c in zip(*out)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        known, count, root = np.zeros(0, np.uint64), np.zeros(0, np.int64), {}
        for row in _rows(left):
            if row["other"] < 0:
                known, count = unpack_sorted(row["words"]), unpack(row["count"]).reshape(2, -1)[0]
        for row in _rows(right):
            if row["chunk"].startswith("#"):
                root[int(row["chunk"][1:])] = unpack(row["words"]), unpack(row["tables"])
        out = []
        for row in _rows(right):
            if row["chunk"].startswith("#"):
                continue
            words = unpack_sorted(row["words"])
            cells = np.zeros((1 + 2 * len(sweeps), len(words)), np.int64)
            if len(known):
                at = _places(known, words)
                for line, x in zip(cells, [count, *(x for k in sweeps for x in root[k])]):
                    line[at >= 0] = x[at[at >= 0]]
            out.append((row["chunk"], "word", row["bucket"], *pack_lines(cells), b"", b""))
        return _table(BACK_SCHEMA, out)

    rows = parts.select("chunk", "vocabulary").mapInArrow(ask, "bucket int, chunk string, words binary, tables binary")
    for k, df in sampled.roots.items():
        rows = rows.unionByName(df.select("bucket", F.lit(f"#{k}").alias("chunk"), F.col("a").alias("words"), F.col("b").alias("tables")))
    index = parts.sparkSession.table(sampled.index).filter("other = -1")
    return index.groupBy("bucket").cogroup(rows.groupBy("bucket")).applyInArrow(run, BACK_SCHEMA)


def scores(parts: DataFrame, back: DataFrame, sampled: Sampled, layout: Layout) -> DataFrame:
    """Each chunk with its answers: a row for each text."""
    known = parts.sparkSession.sparkContext.broadcast((layout, sampled.shared))
    sweeps = sorted(sampled.roots)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        layout, shared = known.value
        words, pairs = [], {}
        for row in _rows(right):
            if row["kind"] == "word":
                words.append((row["bucket"], unpack_lines(row["a"], row["b"], 1 + 2 * len(sweeps))))
            else:
                pairs[row["bucket"]] = row  # packed until it is looked at
        root = np.concatenate([x for _, x in sorted(words, key=lambda w: w[0])], axis=1)
        out = []
        for row in _rows(left):
            c = Chunk.of(row)
            word, context, at = c.pairs()
            parents = [shared.root(root[1 + 2 * j], root[2 + 2 * j], k) for j, k in enumerate(sweeps)]
            mean = np.zeros(len(word))
            for m in c.messages(word, context, layout):
                row = pairs.pop(m.bucket)
                own, of_context = unpack_lines(row["a"], row["b"], 1 + len(sweeps)), unpack_lines(row["c"], row["d"], 1 + len(sweeps))
                hot = np.flatnonzero(layout.is_hot(m.contexts))
                if len(hot):
                    where = np.searchsorted(layout.hot, m.contexts[hot])
                    of_context[:, hot] = np.stack([shared.hot_customers[where], *(shared.hot_tables[k][where] for k in sweeps)])
                of_context, own_word = of_context[:, m.context], word[m.at]
                for j, parent in enumerate(parents):
                    mean[m.at] += shared.context(own[0], own[1 + j], of_context[0], of_context[1 + j], parent[own_word]) / len(sweeps)
            base = np.log10((root[0] + 0.5) / (shared.tokens + 0.5 * (shared.words + 1)))
            start = np.cumsum(c.length) - c.length
            ids = pa.array(c.doc_id[0], pa.int64(), mask=c.doc_id[1].astype(bool))
            columns = [
                ids, pa.array(c.length), pa.array(np.add.reduceat((root[0] > 0)[c.tokens].astype(np.int64), start)), pa.array(np.full(len(start), shared.tokens, np.int64)),
                pa.array(np.add.reduceat(base[c.tokens], start)), pa.array(np.add.reduceat(np.log10(mean)[at], start)),
            ]
            out.append(pa.table(columns, [f.split()[0] for f in SCORE_SCHEMA.split(", ")]))
        return pa.concat_tables(out)

    return parts.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(run, SCORE_SCHEMA)


def score(docs: DataFrame, learn: F.Column, id_col: str = "doc_id", text_col: str = "text", burn_in: int = BURN_IN, samples: int = SAMPLES) -> DataFrame:
    """Learn from the rows for which ``learn`` holds and score all rows: ``doc_id, n_tokens, n_known, train_tokens,
    base_score, score`` (the last: the model's log10 probability of the text). ``perplexity`` derives from it."""
    spark = docs.sparkSession
    texts, n = f"lm_{uuid.uuid4().hex}", int(spark.conf.get("spark.sql.shuffle.partitions"))
    # by chunk, so that the answers come to the chunks and these stay where they are
    chunks(docs, learn, id_col, text_col).write.bucketBy(n, "chunk").sortBy("chunk").saveAsTable(texts)
    parts = spark.table(texts)
    tokens = parts.agg(F.sum("n")).first()[0] or 0
    buckets = max(4, -(-tokens // BUCKET_TOKENS))
    layout = Layout(buckets, hot_contexts(parts, max(LEAST_SHARES, buckets)))
    name = gathered(sent(parts, layout))
    table = spark.table(name)
    sampled = sample(table.filter("chunk = ''"), layout, burn_in, samples)
    back = answered(table, sampled, layout).unionByName(answered_words(parts, sampled, layout))
    out = written(scores(parts, back, sampled, layout), "lm-scores")
    for used in (texts, name, sampled.index, *sampled.tables):
        spark.sql(f"DROP TABLE {used}")
    return out


def perplexity(scored: DataFrame) -> DataFrame:
    """Corpus perplexity of scored rows."""
    return scored.agg(F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens")).alias("perplexity"), F.sum("n_tokens").alias("n_tokens"))
