"""Line deduplication by range-partitioned hashes, returning keep bitmaps instead of text.

1. `line_blocks` reads every text once and writes, for each block of documents, the 128-bit hashes of
   its lines' keys. Blocks are rows of a table in the shared folder.
2. Each block sends one row for each distinct hash (its smallest document there with the line's position, and
   its largest document), so that a line that most documents share costs a row for each block, not for each line.
3. These rows are range-partitioned by hash and sorted by hash, document, position and block; one streaming
   pass sees the first occurrence of each hash and tells the blocks that hold it which document keeps it.
4. Blocks meet their decisions and return, for each document, a compressed bitmap of the lines to keep.

Up to here (`keep_bitmaps`) no text is moved. `drop_repeated_lines` applies the bitmaps, and for that the texts are
shuffled once, by document.

A key is the line without ASCII white space at its ends and with A-Z lowered. Keys of at least
`min_chars` code points that occur in two documents or more are kept in the smallest document only.

Defined cases: a null or empty text is one empty line and is kept; rows without a document id keep all
lines and make no others go; rows that share a document id are one document, so repeated rows lose
nothing to each other; an empty table gives an empty result; other columns are passed through.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm.common import LOWER, WHITE
from tesserae.session import materialise, ship

MIN_CHARS = 10
BLOCK_LINES = 100_000
_HASH = np.dtype([("hi", ">u8"), ("lo", ">u8")])

BLOCKS = "block long, ids binary, texts binary, sizes binary, hashes binary"
MARKS = "doc_id long, text_hash long, n_lines long, n_dropped long, bitmap binary"


def line_hashes(text: str | None, min_chars: int = MIN_CHARS) -> tuple[int, bytes]:
    """The number of lines and 16 bytes for each; sixteen zero bytes for keys that are too short."""
    out = []
    for line in (text or "").split("\n"):
        key = line.strip(WHITE)
        if len(key) >= min_chars:
            key = key.lower() if key.isascii() else key.translate(LOWER)
            out.append(xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass")))
        else:
            out.append(bytes(16))
    return len(out), b"".join(out)


def line_blocks(docs: DataFrame, min_chars: int = MIN_CHARS, block_lines: int = BLOCK_LINES) -> DataFrame:
    """A row for each block of neighbouring documents of a scan partition. docs: doc_id, text_hash, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[int, int, int, bytes]] = []
        lines = 0

        def row() -> pa.RecordBatch:
            ids, texts, sizes = (np.array([h[i] for h in held], np.int64).tobytes() for i in range(3))
            return pa.RecordBatch.from_arrays([pa.array([first + made], pa.int64()), *(pa.array([x], pa.binary()) for x in (ids, texts, sizes, b"".join(h[3] for h in held)))], names=["block", "ids", "texts", "sizes", "hashes"])

        for batch in batches:
            for doc, text_hash, text in zip(batch[0], batch[1], batch[2], strict=True):
                n, hashes = line_hashes(text.as_py(), min_chars)
                held.append((doc.as_py(), text_hash.as_py(), n, hashes))
                lines += n
                if lines >= block_lines:
                    yield row()
                    held, lines, made = [], 0, made + 1
        if held:
            yield row()

    return docs.where("doc_id IS NOT NULL").select("doc_id", "text_hash", "text").mapInArrow(run, BLOCKS)


def _unpack(block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    ids, texts, sizes = (np.frombuffer(block[n].as_py(), np.int64) for n in ("ids", "texts", "sizes"))
    return ids, texts, sizes, np.frombuffer(block["hashes"].as_py(), _HASH)


def block_keys(blocks: DataFrame) -> DataFrame:
    """(hi, lo, first_doc, first_line, last_doc, block): a row for each distinct key of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, _, sizes, hashes = _unpack({n: batch[n][row] for n in ("ids", "sizes", "hashes", "texts")})
                full = (hashes["hi"] != 0) | (hashes["lo"] != 0)
                hi, lo, docs = hashes["hi"][full].astype(np.uint64), hashes["lo"][full].astype(np.uint64), np.repeat(ids, sizes)[full]
                lines = (np.arange(len(hashes)) - np.repeat(np.cumsum(sizes) - sizes, sizes))[full]
                order = np.lexsort((lines, docs, lo, hi))
                hi, lo, docs, lines = hi[order], lo[order], docs[order], lines[order]
                starts = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])])) if len(hi) else np.zeros(0, np.int64)
                ends = np.append(starts[1:], len(hi)) - 1 if len(starts) else starts
                columns = (hi[starts].view(np.int64), lo[starts].view(np.int64), docs[starts], lines[starts], docs[ends], np.full(len(starts), batch["block"][row].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["hi", "lo", "first_doc", "first_line", "last_doc", "block"])

    return blocks.mapInArrow(run, "hi long, lo long, first_doc long, first_line long, last_doc long, block long")


def decisions(keys: DataFrame) -> DataFrame:
    """(block, hi, lo, keeper) for keys of two documents or more.

    Streams the range-partitioned, sorted rows. The rows of one hash lie in one partition, a row for each
    block at most; only the first is held back until a second document shows that the key is shared.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, keeper, shared, waiting = None, 0, False, []  # waiting: blocks of the open key while it has one document
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for hi, lo, first, last, block in zip(*(batch[c].to_pylist() for c in ("hi", "lo", "first_doc", "last_doc", "block")), strict=True):
                if (hi, lo) != key:
                    key, keeper, shared, waiting = (hi, lo), first, False, []
                waiting.append(block)
                if shared or last != keeper:
                    shared = True
                    out += [(b, hi, lo, keeper) for b in waiting]
                    waiting = []
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["block", "hi", "lo", "keeper"])

    ordered = keys.repartitionByRange("hi", "lo").sortWithinPartitions("hi", "lo", "first_doc", "first_line", "block")
    return ordered.mapInArrow(run, "block long, hi long, lo long, keeper long")


def keep_marks(blocks: DataFrame, decided: DataFrame) -> DataFrame:
    """MARKS for every document of the blocks; bitmap: zlib over packed bits, null if no line goes."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        gone = np.zeros(right.num_rows, _HASH)
        gone["hi"], gone["lo"] = right["hi"].to_numpy().view(np.uint64), right["lo"].to_numpy().view(np.uint64)
        gone, keeper = gone.view("S16"), right["keeper"].to_numpy()
        order = np.argsort(gone)
        gone, keeper = gone[order], keeper[order]
        parts = []
        for k in range(left.num_rows):
            ids, texts, sizes, hashes = _unpack({c: left[c][k] for c in ("ids", "texts", "sizes", "hashes")})
            keep = np.ones(len(hashes), bool)
            if len(gone):
                raw = hashes.view("S16")
                at = np.minimum(np.searchsorted(gone, raw), len(gone) - 1)
                keep = (gone[at] != raw) | (keeper[at] == np.repeat(ids, sizes))
            first = np.cumsum(sizes) - sizes
            dropped = sizes - np.add.reduceat(keep, first, dtype=np.int64)
            bitmaps = [zlib.compress(np.packbits(keep[a : a + n]).tobytes()) if d else None for a, n, d in zip(first.tolist(), sizes.tolist(), dropped.tolist(), strict=True)]
            parts.append(pa.table([pa.array(ids), pa.array(texts), pa.array(sizes), pa.array(dropped), pa.array(bitmaps, pa.binary())], names=["doc_id", "text_hash", "n_lines", "n_dropped", "bitmap"]))
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], t) for t in (*[pa.int64()] * 4, pa.binary())], names=["doc_id", "text_hash", "n_lines", "n_dropped", "bitmap"])

    return blocks.groupBy("block").cogroup(decided.groupBy("block")).applyInArrow(run, MARKS)


def keep_bitmaps(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS, block_lines: int = BLOCK_LINES) -> DataFrame:
    """MARKS for every row with an id: which lines of the whole table's texts stay, as bitmaps."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("text_hash"), F.col(text).alias("text"))
    blocks = materialise(line_blocks(rows, min_chars, block_lines), "lines")
    return keep_marks(blocks, decisions(block_keys(blocks)))


def kept_lines(text: str | None, bitmap: bytes | None) -> str:
    """The text without the lines whose bit is 0."""
    if bitmap is None:
        return text or ""
    lines = (text or "").split("\n")
    keep = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=len(lines)).tolist()
    return "\n".join([x for x, k in zip(lines, keep, strict=True) if k])


def drop_repeated_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_chars: int = MIN_CHARS, block_lines: int = BLOCK_LINES) -> DataFrame:
    """docs with the text's repeated lines gone, and n_lines and n_dropped (long) added."""
    added = ("n_lines", "n_dropped")
    fields = [f for f in docs.schema.fields if f.name not in added]
    docs = docs.select(*[F.col(f"`{f.name}`") for f in fields])
    marks = keep_bitmaps(docs, text, key, min_chars, block_lines).groupBy(F.col("doc_id").alias("__t_id"), F.col("text_hash").alias("__t_hash")).agg(F.first(F.struct("n_lines", "n_dropped", "bitmap")).alias("__t_mark"))
    keyed = docs.withColumn("__t_id", F.col(key).cast("long")).withColumn("__t_hash", F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    joined = keyed.join(marks, ["__t_id", "__t_hash"], "left").select(*[F.col(f"`{f.name}`") for f in fields], F.col("__t_mark.n_dropped").alias("__t_n"), F.col("__t_mark.bitmap").alias("__t_bitmap"))
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                texts = batch[at].to_pylist()
                kept = [t if b is None else kept_lines(t, b) for t, b in zip(texts, batch["__t_bitmap"].to_pylist(), strict=True)]
                columns = [pa.array(kept, pa.string()) if i == at else batch.column(i) for i in range(len(names))]
                counts = [pa.array([(t or "").count("\n") + 1 for t in texts], pa.int64()), pa.array([n or 0 for n in batch["__t_n"].to_pylist()], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *counts], names=[*names, *added])

    return joined.mapInArrow(run, T.StructType([*fields, *(T.StructField(n, T.LongType()) for n in added)]))
