"""Alignment of two tokenizers on the same texts, and how often their ids are linked in a corpus.

Both tokenizers cut the bytes of one string, so a text's alignment follows from the two arrays of token ends. Their union is
the ends of elementary intervals; by binary search each interval has one owner in either array. An A and a B token overlap in
one elementary interval or in none, so the intervals are the links. An end that both arrays have closes a group of tokens
that stand for the same bytes; the numbers of its A and B tokens multiply to the pairs that the group allows. All texts of a
block are laid end to end: the end of a text is an end of both, so one pass over arrays aligns them all.

Corpus-wide counts are of documents that hold an id pair linked. A block of texts writes its distinct pairs once, with the
number of its documents that hold each, and every document's pairs as places among these. Pairs are summed over blocks, the
highest count of each A id follows, and every block gets back the counts of its own pairs. Only pairs and places are
shuffled, no texts and no links; a pair that is in all documents is a row for each block, summed before the shuffle. What is
held at once is a block: BLOCK_CHARS of text, however many documents there are.

Defined cases: texts that are null, empty, or not given back byte for byte by either tokenizer have no tokens: zeros and an
empty digest; rows without an id, and repeated rows, are documents like all others and are counted each; texts of any length
are aligned whole; an empty table gives an empty one; other columns are passed through, except those that have the names of
the new ones.
"""

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.bytebpe import vocabulary_of
from tesserae.session import materialise, ship

BLOCK_CHARS = 8 << 20  # characters of the texts whose pairs are numbered together
PART_CHARS = 1 << 20  # characters that are aligned in one go
SPACE = "▁"
_NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_products")


class Alignment:
    """The aligned tokens of texts laid end to end; a, b: ids; of_a, of_b: owners by interval; group_a, group_b: by token."""

    def __init__(self, a: np.ndarray, b: np.ndarray, sizes_a: np.ndarray, sizes_b: np.ndarray):
        self.a, self.b = a, b
        self.ends_a, self.ends_b = np.cumsum(sizes_a), np.cumsum(sizes_b)
        self.ends = np.union1d(self.ends_a, self.ends_b)
        self.of_a, self.of_b = np.searchsorted(self.ends_a, self.ends), np.searchsorted(self.ends_b, self.ends)
        self.closes = (self.ends_a[self.of_a] == self.ends) & (self.ends_b[self.of_b] == self.ends)
        shared = self.ends[self.closes]
        self.groups = len(shared)
        self.group_a, self.group_b = np.searchsorted(shared, self.ends_a), np.searchsorted(shared, self.ends_b)
        self.shared = shared

    def products(self) -> np.ndarray:
        """For each group, how many pairs of its A and B tokens there are."""
        return np.bincount(self.group_a, minlength=self.groups) * np.bincount(self.group_b, minlength=self.groups)

    def expanded(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (A token, B token) of the same group: products of groups, as places in a and b."""
        n_a, n_b = np.bincount(self.group_a, minlength=self.groups), np.bincount(self.group_b, minlength=self.groups)
        wide = n_b[self.group_a]  # each A token meets all B tokens of its group
        left = np.repeat(np.arange(len(self.a)), wide)
        within = np.arange(len(left)) - np.repeat(np.cumsum(wide) - wide, wide)
        return left, (np.cumsum(n_b) - n_b)[self.group_a[left]] + within


class Digits:
    """Ids as decimal bytes that end with a separator, for arrays of ids at once."""

    def __init__(self, size: int):
        self.width = len(str(size)) + 1
        self.lengths = np.array([len(str(i)) + 1 for i in range(size)], np.int64)
        self.table = np.frombuffer(b"".join(str(i).encode().ljust(self.width, b" ") for i in range(size)), np.uint8).reshape(size, self.width)


class Aligner:
    """Encodes and aligns with one byte-level vocabulary (A) and one sentencepiece model (B)."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        byte = vocabulary_of(byte_path)
        self.encode_a, self.tokens_a, self.sizes_a = byte.encoder(special=False), byte.tokens, byte.sizes
        self.model = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        self.tokens_b = [self._piece(i) for i in range(self.model.get_piece_size())]
        self.sizes_b = np.array([len(t) for t in self.tokens_b], np.int64)
        if len(self.tokens_a) * len(self.tokens_b) >= 1 << 32:
            raise ValueError("the two vocabularies have over 2**32 pairs")
        self.digits = Digits(max(len(self.tokens_a), len(self.tokens_b)))

    def _piece(self, i: int) -> bytes:
        piece = self.model.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace(SPACE, " ").encode()

    def ids(self, texts: list[str | None]) -> tuple[list, list]:
        """The ids of each text by both; none for texts that have no tokens."""
        with_b = iter(self.model.encode([t for t in texts if t], num_threads=1))
        found_a, found_b = [], []
        for t in texts:
            a, b = ([], []) if not t else (self.encode_a(f" {t}"), next(with_b))
            whole = f" {t}".encode() if t else b""
            if b"".join(map(self.tokens_a.__getitem__, a)) != whole or b"".join(map(self.tokens_b.__getitem__, b)) != whole:
                a, b = [], []
            found_a.append(a)
            found_b.append(b)
        return found_a, found_b

    def align(self, texts: list[str | None]) -> tuple[Alignment, np.ndarray, np.ndarray]:
        """The alignment of all texts, and how many A and B tokens each has."""
        found_a, found_b = self.ids(texts)
        n_a, n_b = (np.array([len(x) for x in found], np.int64) for found in (found_a, found_b))
        flat = lambda found, n: np.fromiter(chain.from_iterable(found), np.int64, int(n.sum()))
        a, b = flat(found_a, n_a), flat(found_b, n_b)
        return Alignment(a, b, self.sizes_a[a], self.sizes_b[b]), n_a, n_b

    def group_lines(self, found: Alignment, n_a: np.ndarray, n_b: np.ndarray) -> list[bytes]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`."""
        if not found.groups:
            return [b""] * len(n_a)
        in_a, in_b = np.bincount(found.group_a, minlength=found.groups), np.bincount(found.group_b, minlength=found.groups)
        before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
        ids, last = np.empty(len(found.a) + len(found.b), np.int64), np.full(len(found.a) + len(found.b), ord(","), np.uint8)
        place_a = np.arange(len(found.a)) + before_b[found.group_a]  # a group's A tokens come after all tokens of the groups before
        place_b = np.arange(len(found.b)) + before_a[found.group_b] + in_a[found.group_b]
        ids[place_a], ids[place_b] = found.a, found.b
        ends_a, ends_b = np.cumsum(in_a) - 1, np.cumsum(in_b) - 1
        last[place_a[ends_a]], last[place_b[ends_b]] = ord("|"), ord(";")
        lengths = self.digits.lengths[ids]
        letters = self.digits.table[ids]
        letters[np.arange(len(ids)), lengths - 1] = last
        data = letters[np.arange(self.digits.width) < lengths[:, None]].tobytes()
        upto = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(n_a + n_b)])].tolist()
        return [data[i : j - 1] if j > i else b"" for i, j in zip(upto, upto[1:], strict=False)]

    def part(self, texts: list[str | None]) -> dict[str, np.ndarray | list]:
        """By text: the numbers, the digest, its distinct pairs (`n_pairs` of the flat arrays `pair` and `times`)."""
        found, n_a, n_b = self.align(texts)
        docs = len(texts)
        doc_ends = np.concatenate([[0], found.ends_a])[np.cumsum(n_a)]  # a text without tokens ends where the one before does
        until = lambda ends: np.searchsorted(ends, doc_ends, "right")
        per_doc = lambda ends: np.diff(until(ends), prepend=0)
        products = np.concatenate([[0], np.cumsum(found.products())])[until(found.shared)]
        n_links = per_doc(found.ends)
        pair = found.a[found.of_a] * len(self.tokens_b) + found.b[found.of_b]
        of = np.repeat(np.arange(docs, dtype=np.int64), n_links)
        order = np.sort((of << 32) | pair)
        first = np.flatnonzero(np.diff(order, prepend=-1))
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": per_doc(found.shared), "n_links": n_links, "n_products": np.diff(products, prepend=0),
            "groups_sha256": [hashlib.sha256(x).hexdigest() if x else "" for x in self.group_lines(found, n_a, n_b)],
            "n_pairs": np.bincount(order[first] >> 32, minlength=docs), "pair": order[first] & 0xFFFFFFFF, "times": np.diff(first, append=len(order)),
        }


_ALIGNERS: dict[tuple, Aligner] = {}


def aligner_of(*paths: str) -> Aligner:
    """The worker process's aligner, kept from task to task; one at a time."""
    if paths not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def aligned_blocks(docs: DataFrame, byte_path: str, piece_path: str, text: str, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the text, with block, the numbers and the digest; `places` and `times` (32-bit) are the row's distinct pairs
    among those of the block, which its first row carries: `pairs`, and in how many of its documents each is (`in_docs`)."""
    ship(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != text]
    names = [f.name for f in kept]
    new = [T.StructField("__t_block", T.LongType()), *(T.StructField(n, T.LongType()) for n in _NUMBERS), T.StructField("groups_sha256", T.StringType()),
           T.StructField("__t_places", T.BinaryType()), T.StructField("__t_times", T.BinaryType()), T.StructField("__t_pairs", T.ArrayType(T.LongType())), T.StructField("__t_in_docs", T.ArrayType(T.IntegerType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        aligner, block = aligner_of(byte_path, piece_path), TaskContext.get().partitionId() << 24
        held, parts, chars = [], [], 0
        for batch in batches:
            at = 0
            sizes = [len(t or "") for t in batch["__t_text"].to_pylist()]
            while at < batch.num_rows:
                upto, size = at, 0
                while upto < batch.num_rows and (upto == at or size + sizes[upto] <= PART_CHARS):
                    size += sizes[upto]
                    upto += 1
                rows = batch.slice(at, upto - at)
                held.append(rows.select(names))
                parts.append(aligner.part(rows["__t_text"].to_pylist()))
                chars, at = chars + size, upto
                if chars >= block_chars:
                    yield from packed(held, parts, block)
                    held, parts, chars, block = [], [], 0, block + 1
        if parts:
            yield from packed(held, parts, block)

    def packed(held: list[pa.RecordBatch], parts: list[dict], block: int) -> Iterator[pa.RecordBatch]:
        pairs, places = np.unique(np.concatenate([p["pair"] for p in parts]), return_inverse=True)
        in_docs = np.bincount(places, minlength=len(pairs))
        places, used, first = places.astype("<u4"), 0, True
        for rows, p in zip(held, parts, strict=True):
            n, docs = p["n_pairs"], len(p["n_a"])
            mine = places[used : used + len(p["pair"])]
            used += len(p["pair"])
            cuts = pa.array(np.concatenate([[0], 4 * np.cumsum(n)]), pa.int32())
            binary = lambda x: pa.BinaryArray.from_buffers(pa.binary(), docs, [None, cuts.buffers()[1], pa.py_buffer(x.astype("<u4").tobytes())])  # noqa: B023, E731
            lists = [pa.array([x if first and i == 0 else None for i in range(docs)], pa.list_(t)) for x, t in ((pairs, pa.int64()), (in_docs, pa.int32()))]
            first = False
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.array(np.full(docs, block)), *(pa.array(p[c]) for c in _NUMBERS), pa.array(p["groups_sha256"], pa.string()), binary(mine), binary(p["times"]), *lists],
                names=[*names, *(f.name for f in new)],
            )

    return docs.select(*[F.col(f"`{n}`") for n in names], F.col(text).alias("__t_text")).mapInArrow(run, T.StructType([*kept, *new]))


def pair_counts(blocks: DataFrame, size_b: int) -> tuple[DataFrame, DataFrame]:
    """((of_block, pair) of every block, (pair, count, best)): in how many documents each pair is linked, and whether no pair of
    its A id is in more. There are no more A ids than the vocabulary has, so their highest counts are broadcast."""
    met = blocks.where("__t_pairs IS NOT NULL").select("__t_block", F.explode(F.arrays_zip(F.col("__t_pairs").alias("p"), F.col("__t_in_docs").alias("n"))).alias("z")).select("__t_block", F.col("z.p").alias("pair"), F.col("z.n").alias("n"))
    counts = met.groupBy("pair").agg(F.sum("n").cast("long").alias("count")).withColumn("_a", F.floor(F.col("pair") / size_b).cast("long"))
    counts = materialise(counts, "pair-counts")
    highest = counts.groupBy("_a").agg(F.max("count").alias("_highest"))
    return met.select(F.col("__t_block").alias("of_block"), "pair"), counts.join(F.broadcast(highest), "_a").select("pair", "count", (F.col("count") == F.col("_highest")).alias("best"))


def align(docs: DataFrame, byte_path: str, piece_path: str, text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """docs without the text, with n_a, n_b, n_groups, n_links, n_products (pairs that the groups allow), groups_sha256, n_best and count_sum added."""
    import sentencepiece

    added = (*_NUMBERS, "groups_sha256", "n_best", "count_sum")
    docs = docs.select(*[F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in added])
    blocks = materialise(aligned_blocks(docs, byte_path, piece_path, text, block_chars), "aligned")
    size_b = sentencepiece.SentencePieceProcessor(model_file=piece_path).get_piece_size()
    met, counts = pair_counts(blocks, size_b)
    answers = met.join(counts, "pair")
    rows = blocks.drop("__t_pairs", "__t_in_docs")
    out = T.StructType([f for f in rows.schema.fields if not f.name.startswith("__t_")] + [T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    names = out.names[:-2]

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["pair"].to_numpy())
        count, best = right["count"].to_numpy()[order], right["best"].to_numpy()[order]
        n_best, count_sum = np.zeros(left.num_rows, np.int64), np.zeros(left.num_rows, np.int64)
        for i, (p, t) in enumerate(zip(left["__t_places"], left["__t_times"], strict=True)):
            places, times = np.frombuffer(p.as_buffer(), "<u4"), np.frombuffer(t.as_buffer(), "<u4").astype(np.int64)
            n_best[i], count_sum[i] = times @ best[places], times @ count[places]
        return left.select(names).append_column("n_best", pa.array(n_best)).append_column("count_sum", pa.array(count_sum))

    return rows.groupBy("__t_block").cogroup(answers.groupBy("of_block")).applyInArrow(run, out)
