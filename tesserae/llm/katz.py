"""Katz back-off scores.

For n from the order down to 2, with x the n - 1 words before w and x' the last n - 2 of them,

    P(w | x) = d(c(x w)) c(x w) / c(x)    where x w was seen in training,
               a(x) P(w | x')             where only x was, with a(x) = (1 - sum of P(v | x)) / (1 - sum of P(v | x')),
               P(w | x')                  where x was not seen,

both sums over the words v seen after x, so that every context's probabilities add up to one. P(w) is
d(c(w)) c(w) / N for known words and what is left over for the unknown one. d is the Good-Turing discount
(r + 1) n(r + 1) / (r n(r)) for every count r, the counts of counts of each order n(r) smoothed by a log-linear fit; its
slope is held under -1, so every count gives something up and every context has mass for unseen words. The
contexts of a text's first words are filled up with start marks, whose count is that of the training texts; the end
token closes every text.

Layout. Texts become blocks of about a million tokens with a vocabulary of their own. The tables of words, pairs and
longer n-grams are partitioned by a hash of the n-gram into a fixed number of buckets, a parameter of the cluster.
Order by order, each block sends each bucket its distinct n-grams with their training counts in a packed row, all
occurrences in the block pre-aggregated; the bucket adds up, stores its part of the table, and tells each block the
totals in the order in which it asked, the numbers of the n-grams, and which block owns each. Numbers
stand for words and contexts from then on: an n-gram is the number of its first n - 1 words and that of its last word,
so nothing is told apart by hashes. What holds an n-gram or a context not seen in training is not asked for at the
next order, and neither is what a block knows by itself: that an n-gram is the only one of its kind, because its
context or its last words are, and no held-out text has that context. Back-off weights follow in the same way: owners send the partial sums of each context that some held-out text
has (a mark that goes round with the counts; training texts never back off), and blocks with unseen events get them added up. No table, and no context with many followers, is ever in one task or on the driver, which
sees only counts of counts. Rows exchanged are blocks times buckets.

`keep` names a folder for the model: `grams` (order, bucket, keys, totals) and `contexts` (order, bucket, sums), as
Parquet; `model` scores other texts with it, its rows taking part in the exchanges like those of a block.

Defined cases: null and empty texts are the end token alone; rows without an id count as held in or out
by the rule for the empty text; repeated rows count each time; without training tokens every
probability is one; an empty table gives an empty result; other columns are ignored.
"""

import json
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import lean
from tesserae.session import forget, materialise, materialise_parts, release, ship

ORDER = 3
FIT = 6  # the counts of counts that the fit reads
LEAST_SLOPE = -1.1
BLOCK_TOKENS = 1_000_000
BUCKETS = 4  # buckets for each shuffle partition
NULL_ID = -(1 << 63)
MODEL = -1  # the block number of stored rows
END = b" "  # no word holds a space
START = 1 << 40  # the rank of a context that is start marks only
_ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))

TOKENS = "block long, ids binary, held_docs binary, sizes binary, buckets binary, places binary, codes binary, docs long, tokens long"
ASKED = "block long, bucket long, a binary, b binary, counts binary, held binary, singles long"
READ = f"words boolean, {TOKENS}, {ASKED.removeprefix('block long, ')}"  # rows of both
TOLD = "block long, bucket long, totals binary, ranks binary, a binary, b binary, types long, " + ", ".join(f"n{r} long" for r in range(1, FIT + 1))
PARTIAL = "block long, level long, bucket long, a binary, b binary, c binary, d binary"
SUMS = "block long, level long, bucket long, a binary, b binary, c binary"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def squeeze(values: np.ndarray) -> bytes:
    """Compressed bytes of an array, each byte of its items in a plane of its own."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T).tobytes() if len(values) else b""
    return len(values).to_bytes(8, "little") + (pa.compress(planes, "zstd", asbytes=True) if planes else b"")


def swell(data: bytes, kind: str) -> np.ndarray:
    """The array behind `squeeze`."""
    n, kind_ = int.from_bytes(data[:8], "little"), np.dtype(kind)
    if not n:
        return np.zeros(0, kind_)
    planes = np.frombuffer(pa.decompress(data[8:], decompressed_size=n * kind_.itemsize, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind_.itemsize, n).T).view(kind_).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def swell_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(swell(data, "u8"), dtype=np.uint64)


def words_of(data: bytes | None) -> list[bytes]:
    """The words, then the end token."""
    return [*(data or b"").translate(_ASCII_LOWER).split(), END]


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def slope(counts_of_counts: list[int]) -> float:
    """The b of n(r) = e^a r^b, by least squares over the counts that occur; -2 where fewer than two do."""
    seen = [(r, n) for r, n in enumerate(counts_of_counts, 1) if n > 0]
    if len(seen) < 2:
        return -2.0
    r, n = np.log(np.array(seen, np.float64)).T
    return float(min(np.polyfit(r, n, 1)[0], LEAST_SLOPE))


_UP: dict[float, np.ndarray] = {}  # what the counts below 4096 give up, by slope


def given_up(counts: np.ndarray, b: float) -> np.ndarray:
    """(1 - d(c)) c with the discount d(c) = (1 + 1 / c)^(b + 1)."""
    if b not in _UP:
        if len(_UP) > 8:
            _UP.clear()
        _UP[b] = np.concatenate([[0.0], _formula(np.arange(1.0, 4096), b)])
    out = _UP[b][np.minimum(counts, 4095)]
    large = np.flatnonzero(counts > 4095)
    out[large] = _formula(counts[large].astype(np.float64), b)
    return out


def _formula(c: np.ndarray, b: float) -> np.ndarray:
    return -c * np.expm1((b + 1) * np.log1p(1 / c))


def discounted(counts: np.ndarray, b: float) -> np.ndarray:
    """d(c) c."""
    return counts - given_up(counts, b)


def sorted_places(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-negative keys in order, and the place that each had; key and place are sorted as one number where both fit in it."""
    bits = max(len(keys) - 1, 1).bit_length()
    if len(keys) and int(keys.max()).bit_length() + bits <= 63:
        both = np.sort((keys << np.int64(bits)) | np.arange(len(keys)))
        return both >> np.int64(bits), both & np.int64((1 << bits) - 1)
    order = np.argsort(keys, kind="stable")
    return keys[order], order


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the number of each key among them."""
    ordered, places = sorted_places(keys)
    new = np.ones(len(keys), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    number = np.empty(len(keys), np.int32)
    number[places] = np.cumsum(new) - 1
    return ordered[new], number


def bucket_of(first: np.ndarray, second: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def tokenised(docs: DataFrame, block_tokens: int, buckets: int) -> DataFrame:
    """READ rows of docs: doc_id, held, text: a row of TOKENS for each block, and one of ASKED for each bucket that its words fall in.

    Words lie in the order of their buckets; places: that of each by frequency."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        first, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[int, bool, int]] = []
        number = _Numbers()
        codes: list[np.ndarray] = []
        tokens = 0

        def rows() -> pa.RecordBatch:
            code = np.concatenate(codes)
            rank = np.empty(len(number), np.uint32)
            rank[np.argsort(-np.bincount(code, minlength=len(number)), kind="stable")] = np.arange(len(number), dtype=np.uint32)
            words = list(number)
            bucket = np.array([xxhash.xxh64_intdigest(w, 1) % buckets for w in words], np.int64)
            order = np.argsort(bucket, kind="stable")
            trained = np.array([not h[1] for h in held])
            sizes = np.array([h[2] for h in held], np.uint32)
            bucket, words = bucket[order], [words[i] for i in order.tolist()]
            out_ = np.bincount(code[np.repeat(~trained, sizes)], minlength=len(words))[order]
            counts = np.bincount(code, minlength=len(words))[order] - out_
            parts = (
                squeeze(np.array([h[0] for h in held], np.int64)), squeeze(~trained), squeeze(sizes),
                squeeze(np.diff(bucket, prepend=0).astype(np.uint32)), squeeze(rank[order]), squeeze(rank[code]),
            )
            block, none = first + made, [None] * 6
            asked = [(True, block, *[None] * 8, b, squeeze(np.frombuffer(b"\n".join(words[s]), np.uint8)), None, squeeze(counts[s].astype(np.uint32)), squeeze(out_[s] > 0), 0) for b, s in _cut(bucket)]
            return _batch([(False, block, *parts, int(trained.sum()), int(sizes[trained].sum()), *none), *asked], READ)

        for batch in batches:
            for id_, out, text in zip(batch["doc_id"].to_pylist(), batch["held"].to_pylist(), batch["text"].cast(pa.binary()), strict=True):
                words = words_of(text.as_py())
                codes.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                held.append((NULL_ID if id_ is None else id_, bool(out), len(words)))
                tokens += len(words)
                if tokens >= block_tokens:
                    yield rows()
                    held, number, codes, tokens, made = [], _Numbers(), [], 0, made + 1
        if held:
            yield rows()

    return docs.mapInArrow(run, READ)


def _cut(b: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each of ascending bucket numbers, with where it lies."""
    if not len(b):
        return
    starts = np.flatnonzero(np.concatenate([[True], b[1:] != b[:-1]]))
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(b)], strict=True):
        yield int(b[s]), slice(s, e)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch[n][i].as_py() for n in batch.schema.names}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    types = {"long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "double": pa.float64()}
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True) if rows else [()] * len(fields), fields, strict=True)], names=[n for n, _ in fields])


class Facts:
    """What the driver knows of the model."""

    def __init__(self, order: int, buckets: int, docs: int, tokens: int, keep: bool = False):
        self.order, self.buckets, self.docs, self.tokens, self.keep = order, buckets, docs, tokens, keep
        self.types, self.slopes, self.unknown = 0, {}, 1.0


class Block:
    """One block's tokens, and its distinct n-grams order by order as far as the buckets have told of them."""

    def __init__(self, row: dict, facts: Facts, told: dict[int, list[tuple]]):
        self.facts = facts
        self.ids, self.held, self.sizes = swell(row["ids"], "i8"), swell(row["held_docs"], "u1").astype(bool), swell(row["sizes"], "u4").astype(np.int64)
        codes, places = swell(row["codes"], "u4"), swell(row["places"], "u4")
        self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.sizes)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)[:-1]]) if len(self.sizes) else np.zeros(0, np.int64)
        self.out = np.flatnonzero(self.held[self.doc])  # the events of held-out texts
        self.bucket = np.cumsum(swell(row["buckets"], "u4"), dtype=np.int64)  # of the words in the order of their buckets
        total, number, wanted, _ = self._answers(told[1], len(places), np.arange(len(places)), self.bucket)
        order = sorted_places(number)[1]
        where = np.empty(len(places), np.int32)
        where[places[order]] = np.arange(len(places))
        self.level, self.word = 1, where[codes]
        self.at, self.total, self.number, self.wanted, self.context_total = self.word, total[order], number[order], wanted[order], np.full(len(codes), facts.tokens)
        self.word_number, self.word_total = self.number, self.total

    def _counts(self, codes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """How often each code occurs in training and held-out events."""
        out = np.bincount(codes[self.out], minlength=n)
        return np.bincount(codes, minlength=n) - out, out

    def _answers(self, rows: list[tuple], n: int, asked: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Totals, numbers, and the marks of what is wanted as a context and of ownership, of n keys, of which those at `asked` were asked for, in this order."""
        answer = np.concatenate([np.zeros(0, np.uint64), *(swell(r[1], "u8") for r in rows)])
        total, number, wanted, owned = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n, bool)
        total[asked], wanted[asked], owned[asked] = (answer >> np.uint64(2)).astype(np.int64), (answer & np.uint64(2)) > 0, (answer & np.uint64(1)) > 0
        if rows and rows[0][2] is not None:
            number[asked] = np.concatenate([swell(r[2], "u8") for r in rows]).astype(np.int64) * self.facts.buckets + bucket
        return total, number, wanted, owned

    def up(self) -> None:
        """To the distinct n-grams of the next order: their contexts, last words, suffixes and training counts, and how to ask for them."""
        m = len(self.total)
        self.level += 1
        self.suffix_total, before = self.total, self.at
        self.context = np.concatenate([np.array([m], np.int32), before[:-1]])
        self.context[self.begins] = m
        self.contexts_total = np.append(self.total, self.facts.docs)  # the last for the start marks
        self.contexts_number = np.append(self.number, START * self.facts.buckets + self.level % self.facts.buckets)
        self.contexts_wanted = np.append(self.wanted, True)
        self.shorter_total = np.zeros(m + 1, np.int64)
        self.shorter_total[self.context] = self.context_total
        self.context_total = self.contexts_total[self.context]
        bits = np.int64(len(self.word_total).bit_length())
        keys, self.at = numbered((self.context.astype(np.int64) << bits) | self.word)
        self.counts, self.held_keys = self._counts(self.at, len(keys))
        self.of, last = (keys >> bits).astype(np.int32), (keys & ((np.int64(1) << bits) - 1)).astype(np.int32)
        del keys
        self.suffix = np.zeros(len(self.of), np.int32)
        self.suffix[self.at] = before
        most = np.minimum(self.contexts_total[self.of], self.suffix_total[self.suffix])  # no n-gram has more than what it is made of
        self.settled = np.flatnonzero((most == 1) & (self.counts > 0) & ~self.contexts_wanted[self.of])
        most[self.settled] = 0
        known = np.flatnonzero(most)
        a, b = self.contexts_number[self.of[known]], self.word_number[last[known]]
        bucket = bucket_of(a, b, self.facts.buckets)
        order = np.argsort(bucket.astype(np.uint16) if self.facts.buckets <= 1 << 16 else bucket, kind="stable")
        self.known, self.bucket, self.a, self.b = known[order], bucket[order], a[order], b[order]

    def hear(self, rows: list[tuple]) -> None:
        """Takes the buckets' answers, and puts n-grams that are contexts of the next order in the order of their numbers."""
        self.total, self.number, self.wanted, self.owned = self._answers(rows, len(self.counts), self.known, self.bucket)
        self.total[self.settled], self.owned[self.settled] = 1, True
        if self.level < self.facts.order:
            order = sorted_places(self.number)[1]
            where = np.empty(len(order), np.int32)
            where[order] = np.arange(len(order))
            self.at = where[self.at]
            self.total, self.number, self.wanted, self.owned, self.of, self.suffix = (x[order] for x in (self.total, self.number, self.wanted, self.owned, self.of, self.suffix))

    def climb(self, told: dict[int, list[tuple]]) -> Iterator["Block"]:
        """Itself at each order from 2 on that was told of."""
        while self.level + 1 in told:
            self.up()
            self.hear(told[self.level])
            yield self


def _told_by_level(table: pa.Table, levels: range) -> dict[int, list[tuple]]:
    rows = sorted(zip(*(table[c].to_pylist() for c in ("level", "bucket", "totals", "ranks")), strict=True), key=lambda r: r[:2])
    return {n: [] for n in levels} | {n: [r[1:] for r in group] for n, group in groupby(rows, lambda r: r[0])}


def asked_grams(tokens: DataFrame, replies: DataFrame, facts: Facts, level: int) -> DataFrame:
    """Each block's n-grams of this order as (number of the context, number of the word), and training counts, a row for each bucket."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        told, out = _told_by_level(right, range(1, level)), []
        for row in left.to_pylist():
            block = Block(row, facts, told)
            for _ in block.climb({n: told[n] for n in range(2, level)}):
                pass
            block.up()
            counts, held = block.counts[block.known].astype(np.uint32), block.held_keys[block.known] > 0
            cuts = list(_cut(block.bucket)) or [(0, slice(0, 0))]
            out += [(row["block"], b, squeeze_sorted(block.a[s].astype(np.uint64)), squeeze(block.b[s].astype(np.uint64)), squeeze(counts[s]), squeeze(held[s]) if level < facts.order else None, 0 if i else len(block.settled)) for i, (b, s) in enumerate(cuts)]
        return pa.Table.from_batches([_batch(out, ASKED)])

    return _met(tokens, replies).applyInArrow(run, ASKED)


def _met(tokens: DataFrame, replies: DataFrame):
    return tokens.groupBy("block").cogroup(replies.groupBy("block"))


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """The rows of one bucket after the other."""
    held: list[dict] = []
    for row in _each(batches):
        if held and held[0]["bucket"] != row["bucket"]:
            yield held
            held = []
        held.append(row)
    if held:
        yield held


def told(requests: DataFrame, facts: Facts, level: int) -> DataFrame:
    """For each block 4 x total, + 2 if a held-out text anywhere may need the key as a context, + 1 if the block owns the key;
    and the rank of each trained key, below the highest order. For MODEL the figures, and with `keep` the table itself."""
    words = level == 1

    def distinct(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray | list[bytes], np.ndarray | None]:
        """The number of keys of each row, the code of each key, and the keys that the codes stand for."""
        if words:
            number = _Numbers()
            codes = [[*map(number.__getitem__, swell(r["a"], "u1").tobytes().split(b"\n"))] for r in rows]
            return np.array([len(c) for c in codes]), np.concatenate([np.array(c, np.int64) for c in codes]), list(number), None
        first, last = [swell_sorted(r["a"]) for r in rows], np.concatenate([swell(r["b"], "u8") for r in rows])
        sizes = np.array([len(f) for f in first])
        (first, a), (last, b) = numbered(np.concatenate(first).astype(np.int64)), numbered(last.astype(np.int64))
        keys, codes = numbered(a.astype(np.int64) * len(last) + b)
        return sizes, codes, first[keys // len(last)].astype(np.uint64), last[keys % len(last)].astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lean()
        for rows in by_bucket(batches):
            sizes, codes, first, last = distinct(rows)
            counts = np.concatenate([swell(r["counts"], "u8" if r["block"] == MODEL else "u4").astype(np.int64) for r in rows])
            totals = np.bincount(codes, counts, len(first)).astype(np.int64)
            here = np.flatnonzero(totals)
            rank = np.zeros(len(first), np.uint64)
            rank[here] = np.arange(len(here), dtype=np.uint64)
            trained = np.flatnonzero(counts)
            owner = np.zeros(len(codes), np.int64)
            owner[trained[np.unique(codes[trained], return_index=True)[1]]] = 1
            held = [np.zeros(n, bool) if r["held"] is None else swell(r["held"], "u1") > 0 for r, n in zip(rows, sizes.tolist(), strict=True)]
            wanted = (np.bincount(codes, np.concatenate(held), len(first)) > 0) | facts.keep
            answer, ranks = (4 * totals[codes] + 2 * wanted[codes] + owner).astype(np.uint64), rank[codes]
            ends = np.cumsum(sizes)
            out = [(r["block"], r["bucket"], squeeze(answer[e - n : e]), squeeze(ranks[e - n : e]) if level < facts.order else None, None, None, *[None] * (FIT + 1)) for r, n, e in zip(rows, sizes.tolist(), ends.tolist(), strict=True) if r["block"] != MODEL]
            keys = (None, None)
            if facts.keep:
                keys = (squeeze(np.frombuffer(b"\n".join([first[i] for i in here.tolist()]), np.uint8)), None) if words else (squeeze_sorted(first[here]), squeeze(last[here]))
            singles = sum(r["singles"] or 0 for r in rows)
            if len(here) or singles:
                figures = np.bincount(np.minimum(totals, FIT + 1), minlength=FIT + 2)[1 : FIT + 1]
                figures[0] += singles
                out.append((MODEL, rows[0]["bucket"], squeeze(totals[here].astype(np.uint64)) if words or facts.keep else None, None, *keys, len(here) + singles, *figures.tolist()))
            for at in range(0, len(out), 256):
                yield _batch(out[at : at + 256], TOLD)

    return requests.repartition("bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, TOLD)


def _figures(table: DataFrame) -> tuple[int, list[int]]:
    names = ["types", *(f"n{r}" for r in range(1, FIT + 1))]
    row = table.where(F.col("block") == MODEL).agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
    return row["types"], [row[n] for n in names[1:]]


def _left_for_unknown(table: DataFrame, facts: Facts) -> float:
    """What all known words give up, as a share of the tokens."""
    b = facts.slopes[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([float(given_up(swell(t.as_py(), "u8").astype(np.int64), b).sum()) for t in batch["totals"]], pa.float64())], names=["s"])

    found = table.where(F.col("block") == MODEL).select("totals").mapInArrow(run, "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0))).first()[0]
    return found / facts.tokens if facts.tokens else 1.0


def partials(tokens: DataFrame, replies: DataFrame, facts: Facts) -> DataFrame:
    """For each block a row of level 0 with its documents' sums so far, rows of bucket MODEL with the events that wait for the
    weights of an order, and rows of contexts by bucket: rank, what seen words give up, what they have at the order
    below, whether the block needs the sums."""
    levels = range(1, facts.order + 1)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        lean()
        told, out = _told_by_level(right, levels), []
        for row in left.to_pylist():
            block = Block(row, facts, told)
            n = len(block.ids)
            per_doc = lambda values, block=block, n=n: np.bincount(block.doc, values, n)
            count = block.word_total[block.word]
            base = np.log10((count + 0.1) / (facts.tokens + 0.1 * (facts.types + 1)))
            own = np.where(count > 0, discounted(count, facts.slopes[1]) / max(facts.tokens, 1), facts.unknown)
            # from the lowest order up: the logarithm so far, and for each order the events that back off there
            logs, backed, asks = np.log10(own), {}, []
            for up in block.climb(told):
                total, before = up.total[up.at], up.context_total
                seen = total > 0
                with np.errstate(divide="ignore"):
                    logs = np.where(seen, np.log10(discounted(total, facts.slopes[up.level]) / np.maximum(before, 1)), logs)
                for open_ in backed.values():
                    open_[0] &= ~seen
                backed[up.level] = [~seen & (before > 0), up.context, up.contexts_total, up.shorter_total]
                mine = np.flatnonzero(up.owned & up.contexts_wanted[up.of])
                m = len(up.contexts_total)
                gives = np.bincount(up.of[mine], given_up(up.total[mine], facts.slopes[up.level]), m)
                below = np.bincount(up.of[mine], discounted(up.suffix_total[up.suffix[mine]], facts.slopes[up.level - 1]), m)
                asks.append((up.level, up.contexts_number, gives, below))
            for level, number, gives, below in asks:
                open_, context, total, shorter = backed[level]
                need = np.zeros(len(number), np.uint8)
                need[context[open_]] = 1
                codes = np.flatnonzero((gives > 0) | (need > 0))
                bucket, rank = number[codes] % facts.buckets, number[codes] // facts.buckets
                order = np.lexsort((rank, bucket))
                codes, bucket, rank = codes[order], bucket[order], rank[order].astype(np.uint64)
                wanted = codes[need[codes] > 0]
                place = np.zeros(len(number), np.uint32)
                place[wanted] = np.arange(len(wanted), dtype=np.uint32)
                events = np.flatnonzero(open_)
                out.append((row["block"], level, MODEL, squeeze(block.doc[events].astype(np.uint32)), squeeze(place[context[events]]), squeeze(total[wanted]), squeeze(shorter[wanted])))
                out += [(row["block"], level, b, squeeze_sorted(rank[s]), squeeze(gives[codes[s]]), squeeze(below[codes[s]]), squeeze(need[codes[s]])) for b, s in _cut(bucket)]
            sums = np.stack([block.sizes.astype(np.float64), per_doc(count > 0), per_doc(base), per_doc(logs)])
            out.append((row["block"], 0, MODEL, squeeze(block.ids), squeeze(block.held.astype(np.uint8)), squeeze(sums.ravel()), None))
        return pa.Table.from_batches([_batch(out, PARTIAL)])

    return _met(tokens, replies).applyInArrow(run, PARTIAL)


def sums(contexts: DataFrame) -> DataFrame:
    """For each block the sums that it needs, in the order of its contexts; for MODEL all contexts with theirs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (level, bucket), group in groupby(_each(batches), lambda r: (r["level"], r["bucket"])):
            rows = list(group)
            ranks = [swell_sorted(r["a"]) for r in rows]
            distinct, at = numbered(np.concatenate(ranks).astype(np.int64))
            gives, below = (np.bincount(at, np.concatenate([swell(r[c], "f8") for r in rows]), len(distinct)) for c in ("b", "c"))
            end, out = 0, []
            for r, k in zip(rows, ranks, strict=True):
                if r["block"] != MODEL:
                    wanted = at[end : end + len(k)][swell(r["d"], "u1") > 0]
                    out.append((r["block"], level, bucket, None, squeeze(gives[wanted]), squeeze(below[wanted])))
                end += len(k)
            out.append((MODEL, level, bucket, squeeze_sorted(distinct.astype(np.uint64)), squeeze(gives), squeeze(below)))
            for at_ in range(0, len(out), 256):
                yield _batch(out[at_ : at_ + 256], SUMS)

    return contexts.repartition("level", "bucket").sortWithinPartitions("level", "bucket", "block").mapInArrow(run, SUMS)


def finished(blocks: DataFrame, found: DataFrame, facts: Facts) -> DataFrame:
    """SCORES of every document."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = sorted(zip(*(right[c].to_pylist() for c in ("level", "bucket", "b", "c")), strict=True), key=lambda r: r[:2])
        told = {n: [np.concatenate([swell(r[i], "f8") for r in held]) for i in (2, 3)] for n, group in groupby(rows, lambda r: r[0]) for held in [list(group)]}
        mine = {r["level"]: r for r in left.to_pylist()}
        ids, held, parts = swell(mine[0]["a"], "i8").tolist(), swell(mine[0]["b"], "u1").tolist(), swell(mine[0]["c"], "f8").reshape(4, -1)
        for n in range(2, facts.order + 1):
            gives, below = told.get(n, (np.zeros(0), np.zeros(0)))
            total, shorter = swell(mine[n]["c"], "i8"), swell(mine[n]["d"], "i8")
            weight = np.log10(gives / total) - np.log10((shorter - below) / shorter)
            parts[3] += np.bincount(swell(mine[n]["a"], "u4"), weight[swell(mine[n]["b"], "u4")], len(ids))
        out = [(None if i == NULL_ID else i, bool(h), int(n), int(k), facts.tokens, b, s) for i, h, n, k, b, s in zip(ids, held, *parts.tolist(), strict=True)]
        return pa.Table.from_batches([_batch(out, SCORES)])

    return blocks.groupBy("block").cogroup(found.groupBy("block")).applyInArrow(run, SCORES)


def _stored(spark: SparkSession, model: str) -> tuple[DataFrame, DataFrame, dict]:
    meta = json.loads(spark.read.text(f"{model}/meta").first()[0])
    return spark.read.parquet(f"{model}/grams"), spark.read.parquet(f"{model}/contexts"), meta


def _columns(table: DataFrame, schema: str) -> DataFrame:
    out = table.select(*[f.split()[0] for f in schema.split(", ")])
    out._tesserae_path = table._tesserae_path
    return out


def score(docs: DataFrame, held_out: Column | None = None, text: str = "text", key: str = "doc_id", order: int = ORDER, block_tokens: int = BLOCK_TOKENS, buckets: int = BUCKETS, keep: str | None = None, model: str | None = None) -> DataFrame:
    """SCORES of every row under the model of those that are not held out, or under a model that `keep` stored."""
    spark = docs.sparkSession
    ship(spark)
    grams, contexts, meta = _stored(spark, model) if model else (None, None, {})
    order, buckets = meta.get("order", order), meta.get("buckets", buckets * int(spark.conf.get("spark.sql.shuffle.partitions")))
    held = F.lit(True) if model else held_out if held_out is not None else F.lit(False)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), held.alias("held"), F.col(text).alias("text"))
    tokens, words = materialise_parts(tokenised(rows, block_tokens, buckets), "tokens", "words", ("false", "true"))
    tokens, asked_words = _columns(tokens, TOKENS), _columns(words, ASKED)
    trained = tokens.agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    facts = Facts(order, buckets, meta.get("docs", trained[0]), meta.get("tokens", trained[1]), keep is not None)
    tables: list[DataFrame] = []
    for level in range(1, order + 1):
        replies = None
        for n, t in enumerate(tables, 1):
            part = t.where(F.col("block") != MODEL).select("block", F.lit(n).cast("long").alias("level"), "bucket", "totals", "ranks")
            replies = part if replies is None else replies.unionByName(part)
        asked = asked_words if level == 1 else asked_grams(tokens, replies, facts, level)
        if grams is not None:
            asked = asked.unionByName(grams.where(F.col("level") == level).select(F.lit(MODEL).cast("long").alias("block"), "bucket", "a", "b", F.col("totals").alias("counts"), F.lit(None).cast("binary").alias("held"), F.lit(0).cast("long").alias("singles")))
        tables.append(materialise(told(asked, facts, level), f"grams-{level}"))
        del asked
        types, counted = _figures(tables[-1])
        facts.slopes[level] = slope(counted)
        if level == 1:
            forget(words)
            facts.types = types
            facts.unknown = _left_for_unknown(tables[0], facts)
        release(spark)
    replies = None
    for n, t in enumerate(tables, 1):
        part = t.where(F.col("block") != MODEL).select("block", F.lit(n).cast("long").alias("level"), "bucket", "totals", "ranks")
        replies = part if replies is None else replies.unionByName(part)
    partial = materialise(partials(tokens, replies, facts), "partial")
    del replies
    if keep:
        for n, t in enumerate(tables, 1):
            own = t.where(F.col("block") == MODEL).select(F.lit(n).cast("long").alias("level"), "bucket", "a", "b", "totals")
            own.write.mode("append" if n > 1 else "errorifexists").partitionBy("level").parquet(f"{keep}/grams")
    for done in (tokens, *tables):
        forget(done)
    release(spark)
    asked = partial.where(F.col("bucket") != MODEL)
    if contexts is not None:
        asked = asked.unionByName(contexts.select(F.lit(MODEL).cast("long").alias("block"), "level", "bucket", "a", "b", "c", F.lit(None).cast("binary").alias("d")))
    found = materialise(sums(asked), "sums")
    if keep:
        found.where(F.col("block") == MODEL).select("level", "bucket", "a", "b", "c").write.parquet(f"{keep}/contexts")
        spark.createDataFrame([(json.dumps({"order": order, "buckets": buckets, "docs": facts.docs, "tokens": facts.tokens}),)], "value string").coalesce(1).write.text(f"{keep}/meta")
    return finished(partial.where(F.col("bucket") == MODEL), found.where(F.col("block") != MODEL), facts)
