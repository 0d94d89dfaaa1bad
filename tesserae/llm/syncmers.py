"""Document fingerprints from closed syncmers.

A k-mer of code points is an anchor if the least of its inner s-mers, by hash, is its first or last one.
That depends on the k-mer alone, so equal stretches have equal anchors wherever they stand.

`anchors` gives all (position, hash) pairs of a text. A fingerprint has the hashes of all (anchor, occurrence)
with their places, so it grows with the text.
`likeness` is the share of common anchors among all of two texts; common ones count only as far
as they follow in the same order in both, so stray matches of unrelated texts drop out.

`with_successors` pairs each document with the next in descending order of id without a global sort in
one task: ids are cut at quantiles into buckets, and each bucket also gets the first row of the next.

Defined cases: a null text counts as empty; an empty text has the empty fingerprint, which is wholly like
itself and wholly unlike any other; a text without anchors has one, of the whole text; rows with equal
ids follow in the order of their texts' hashes; null ids come last; a single row is its own successor;
an empty table gives an empty result; other columns are ignored.
"""

import base64
import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import code_points
from tesserae.session import ship

K, S = 8, 3
CHUNK = 1 << 18
NULL_ID = -(1 << 63)
_ENTRY = np.dtype([("hash", "<u4"), ("at", "<u4")])


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return h ^ (h >> np.uint32(16))


def anchors(text: str | None, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Positions and 32-bit hashes of all closed syncmers of the whole text, in order of position."""
    points = code_points(text or "")
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    places, hashes = [], []
    with np.errstate(over="ignore"):
        for start in range(0, max(len(points) - k + 1, 0), CHUNK):
            piece = points[start : start + CHUNK + k - 1]
            inner = piece[: len(piece) - s + 1] * np.uint32(0x9E3779B1)
            for i in range(1, s):
                inner = (inner ^ (inner >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + piece[i : len(piece) - s + 1 + i] * np.uint32(0x297A2D39)
            inner = _mix(inner)
            n, w = len(piece) - k + 1, k - s + 1
            least = inner[:n]
            for i in range(1, w):
                least = np.minimum(least, inner[i : n + i])
            at = np.flatnonzero((inner[:n] == least) | (inner[w - 1 : n + w - 1] == least))
            whole = np.zeros(len(at), np.uint32)
            for i in [*range(0, w, s), w - 1]:
                whole = _mix(whole * np.uint32(31) + inner[at + i])
            places.append(at + start)
            hashes.append(whole)
    if not sum(map(len, places)):
        return np.zeros(1, np.int64), np.array([xxhash.xxh32_intdigest((text or "").encode("utf-8", "surrogatepass"))], np.uint32)
    return np.concatenate(places), np.concatenate(hashes)


def fingerprint(text: str | None, k: int = K, s: int = S) -> np.ndarray:
    """The hashes of all anchors, ascending, with their positions.

    The n-th occurrence of an anchor is an element of its own, so repeated passages weigh by their length.
    """
    places, hashes = anchors(text, k, s)
    order = np.argsort(hashes, kind="stable")
    places, hashes = places[order], hashes[order]
    starts = np.concatenate([[0], np.flatnonzero(hashes[1:] != hashes[:-1]) + 1])[: len(hashes)]
    nth = np.arange(len(hashes)) - np.repeat(starts, np.diff(np.append(starts, len(hashes))))
    with np.errstate(over="ignore"):
        distinct, first = np.unique(_mix(hashes + nth.astype(np.uint32) * np.uint32(0x9E3779B1)), return_index=True)
    out = np.zeros(len(distinct), _ENTRY)
    out["hash"], out["at"] = distinct, places[first]
    return out


def written(print_: np.ndarray) -> str:
    """Base64 of the number of entries and their bytes, compressed, each byte of an entry in a plane of its own."""
    planes = np.ascontiguousarray(print_.view(np.uint8).reshape(-1, _ENTRY.itemsize).T).tobytes()
    return base64.b64encode(len(print_).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)).decode() if len(print_) else ""


def read(string: str) -> np.ndarray:
    """The fingerprint behind `written`."""
    if not string:
        return np.zeros(0, _ENTRY)
    data = base64.b64decode(string)
    n = int.from_bytes(data[:4], "little")
    planes = np.frombuffer(pa.decompress(data[4:], decompressed_size=n * _ENTRY.itemsize, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(_ENTRY.itemsize, n).T).view(_ENTRY).ravel()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: common anchors in a common order, of all anchors of both fingerprints."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    _, x, y = np.intersect1d(a["hash"], b["hash"], assume_unique=True, return_indices=True)
    order = np.lexsort((b["at"][y], a["at"][x]))
    tails: list[int] = []
    for v in b["at"][y][order].tolist():
        if not tails or v > tails[-1]:
            tails.append(v)
        else:
            tails[bisect_left(tails, v)] = v
    return len(tails) / (len(a) + len(b) - len(x))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by as many characters of the following text's start."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third]


def with_successors(docs: DataFrame, text: str = "text", key: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """(bucket, ghost, id, text_hash, data): zstd texts in buckets of descending ids, sorted so that each
    row is followed by its successor; a bucket's ghosts are copies of the next bucket's first rows."""
    spark = docs.sparkSession
    ship(spark)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text).alias("text"))
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = rows.agg(F.percentile_approx("id", [i / buckets for i in range(1, buckets)], max(10_000, 4 * buckets)).alias("q")).first()["q"] if buckets > 1 else []
    bounds = np.unique(np.array(cuts or [], np.int64))

    def highest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch["id"].to_numpy()
            b = np.searchsorted(bounds, ids, "left")
            own = np.unique(b)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.array([ids[b == x].max() for x in own], np.int64))], names=["bucket", "top"])

    tops = {r["bucket"]: r["top"] for r in rows.select("id").mapInArrow(highest, "bucket long, top long").groupBy("bucket").agg(F.max("top").alias("top")).collect()}
    filled = sorted(tops)
    # the bucket above each bucket, which the rows with its highest id follow; the lowest one wraps around
    above = {b: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id_, t in zip(batch["id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                b = int(np.searchsorted(bounds, id_, "left"))
                data = t or b""
                packed, text_hash = pa.compress(data, "zstd", asbytes=True), xxhash.xxh64_intdigest(data) >> 1
                # buckets ascend in the output as ids descend
                out.append((-b, 0, id_, text_hash, len(data), packed))
                if tops[b] == id_:
                    out.append((-above[b], 1, id_, text_hash, len(data), packed))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 6, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "ghost", "id", "text_hash", "size", "data"])

    dealt = rows.mapInArrow(deal, "bucket long, ghost long, id long, text_hash long, size long, data binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket", "ghost", F.col("id").desc(), "text_hash")


def compare_edits(docs: DataFrame, text: str = "text", key: str = "doc_id", k: int = K, s: int = S, buckets: int | None = None) -> DataFrame:
    """The fingerprints of each text and of its edited text, and the likeness to that and to the next text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (bucket, ghost, id, text, fingerprint) of the row that waits for its successor

        def rows(batch: pa.RecordBatch) -> Iterator[tuple]:
            nonlocal held
            for b, ghost, id_, _, size, data in zip(*(batch[i].to_pylist() for i in range(6)), strict=True):
                if ghost and (held is None or held[0] != b or held[1]):
                    continue  # a bucket needs one ghost
                t = pa.decompress(data, decompressed_size=size, codec="zstd", asbytes=True).decode() if size else ""
                mine = fingerprint(t, k, s)
                if held is not None and held[0] == b and not held[1]:
                    _, _, before, old, print_ = held
                    new = edited(old, t)
                    changed = fingerprint(new, k, s)
                    yield (None if before == NULL_ID else before, len(old), hashlib.sha256(new.encode()).hexdigest(), written(print_), written(changed), likeness(print_, changed), likeness(print_, mine))
                held = (b, ghost, id_, t, mine)

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                found = list(rows(batch.slice(at, 128)))
                types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True) if found else [()] * 7, types, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return with_successors(docs, text, key, buckets).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
