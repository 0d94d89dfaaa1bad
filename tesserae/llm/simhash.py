"""Near-duplicates by SimHash, joined through a hierarchical index in Gray order.

`fingerprints` takes the majority bits of the hashes of all word shingles of a text.

`links` joins the distinct fingerprints with themselves. Fingerprints that differ in at most `bits` bits
agree on one of bits + 1 blocks, so each goes, rotated, to the groups of its blocks' values; groups that
hold many are dealt again by blocks of the remaining bits, so no group stays large. In a task the
rotated fingerprints are sorted by Gray rank; runs of neighbours are leaves, whose shared bits and their
mask are factored into nodes, level by level. The join descends from pairs of upper nodes and adds up
the differences in bits that both share; a pair of nodes whose sum is over the limit is cut with all
the groups below it. Copies count once, as one fingerprint.

`similar_documents` links texts by the exact Jaccard similarity of their sets of shingles. The fingerprints of the sets go
through `links`, and what it connects in a group is a bucket of candidates (`print_buckets`). Sets of similarity 0.8 have
fingerprints that differ in about 10 of 64 bits, and blocks of agreeing bits for these would be four bits wide and hold
most of a corpus, so buckets of min-hashes are added for them. Minima under 96 keyed permutations, four to a band, name
24 buckets for each set: two sets of similarity 0.8 share none with a chance of 3 in a million, more alike ones with less.
Buckets of the same members count once. In a bucket the Gray index over the fingerprints of the sets prunes what differs
in over `far` bits (by the binomial model one pair of similarity 0.8 in 100,000), and what is left is compared set by
set, unless the two are connected already.

Defined cases: null and blank texts have the fingerprint zero and link like any other (as similar texts, with
each other); rows without a document id get a fingerprint and no component; repeated rows share everything; an empty
table gives an empty result; other columns are ignored.
"""

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.components import Forest, components
from tesserae.session import forget, materialise, ship

SHINGLE = 3
BITS = 3
LEAF, FAN = 16, 8
GROUP_LIMIT = 2000
LEAST = 0.8
BANDS, ROWS = 24, 4
FAR = 24
_KEYS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_ASCII_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def shingle_hashes(data: bytes | None, shingle: int) -> Iterator[np.ndarray]:
    """The hashes (XXH64, seed 42) of all word shingles of UTF-8 text, in parts; fewer words than a shingle are one, none give none."""
    words = (data or b"").translate(_ASCII_LOWER).split()
    if not words:
        return
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    k = min(shingle, len(words))
    starts, stops = (ends - size)[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 8192):
        yield np.array([hashed(joined[a:b], 42) for a, b in zip(starts[at : at + 8192], stops[at : at + 8192], strict=True)], np.uint64)


def majority(parts: Iterator[np.ndarray]) -> int:
    """Bit i is 1 if over half of the hashes have it; 0 for none."""
    counts, n = np.zeros(64, np.int64), 0
    for values in parts:
        counts += np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
        n += len(values)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprint(data: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of UTF-8 text over its shingles, repeats included."""
    return majority(shingle_hashes(data, shingle))


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id long, fp long) for every row; one pass, no shuffle."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch["text"].cast(pa.binary())], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the Gray sequence."""
    rank = codes.copy()
    for s in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(s)
    return rank


class GrayIndex:
    """Fingerprints in Gray order under a hierarchy of shared masked bit patterns."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []  # from leaves up: (mask of the bits that all below share, their values)
        both = either = self.codes
        width = LEAF
        while len(both):
            at = np.arange(0, len(both), width)
            both, either = np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(either, at)
            mask = ~(both ^ either)
            self.levels.append((mask, both & mask))
            if len(at) == 1:
                break
            width = FAN

    def join(self, bits: int, exact: int = 0, budget: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of positions (in the given array) that differ in at most `bits` bits and agree on all bits of `exact`."""
        if not self.levels:
            return
        exact_ = np.uint64(exact)
        stack = [(len(self.levels) - 1, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, np.uint64), np.zeros(1, np.int64))]
        while stack:
            level, a, b, known, sums = stack.pop()
            mask, pattern = self.levels[level]
            shared = mask[a] & mask[b]
            differ = (pattern[a] ^ pattern[b]) & shared
            sums = sums + np.bitwise_count(differ & ~known)  # only bits that the nodes above did not share
            on = (sums <= bits) & ((differ & exact_) == 0)
            a, b, shared, sums = a[on], b[on], shared[on], sums[on]
            if not len(a):
                continue
            n, fan = (len(self.levels[level - 1][0]), FAN) if level else (len(self.codes), LEAF)
            step = max(1, budget // (fan * fan))
            if len(a) > step:
                stack += [(level, a[i : i + step], b[i : i + step], shared[i : i + step], sums[i : i + step]) for i in range(0, len(a), step)]
                continue
            kids = np.arange(fan)
            x = (a[:, None] * fan + kids)[:, :, None] + np.zeros(fan, np.int64)
            y = (b[:, None] * fan + kids)[:, None, :] + np.zeros((fan, 1), np.int64)
            fits = (x < n) & (y < n) & ((x <= y) if level else (x < y))
            x, y = x[fits], y[fits]
            if level:
                per = fits.reshape(len(a), -1).sum(1)
                stack.append((level - 1, x, y, np.repeat(shared, per), np.repeat(sums, per)))
            else:
                differ = self.codes[x] ^ self.codes[y]
                hit = (np.bitwise_count(differ) <= bits) & ((differ & exact_) == 0)
                if hit.any():
                    yield self.order[x[hit]], self.order[y[hit]]


def _turn(value, low: int, by: int):
    """SQL: the `low` lowest bits of a long rotated left by `by`."""
    if low == 64:
        return F.shiftleft(value, by).bitwiseOR(F.shiftrightunsigned(value, 64 - by)) if by else value
    rest = F.lit((1 << low) - 1)
    tail = value.bitwiseAND(rest)
    turned = F.shiftleft(tail, by).bitwiseOR(F.shiftrightunsigned(tail, low - by)).bitwiseAND(rest) if by else tail
    return value.bitwiseAND(F.lit(~((1 << low) - 1))).bitwiseOR(turned)


def _deal(rows: DataFrame, matched: int, blocks: int) -> tuple[DataFrame, int]:
    """Each row once for each block of the bits below the `matched` upper ones, that block moved up to them."""
    low = 64 - matched
    size = low // blocks
    turns = F.array(*[F.struct(F.concat(F.col("path"), F.lit(f"{t}")).alias("path"), _turn(F.col("code"), low, t * size).alias("code")) for t in range(blocks)])
    dealt = rows.select("id", F.explode(turns).alias("d")).select("id", "d.path", "d.code")
    return dealt.withColumn("top", F.shiftrightunsigned("code", low - size)), matched + size


def links(codes: DataFrame, bits: int = BITS, group_limit: int = GROUP_LIMIT, depth: int = 3) -> DataFrame:
    """Links (a, b) that connect what is within `bits` bits. codes: id long, code long, codes distinct.

    Each task returns a spanning forest of the links it finds, so there are fewer than twice as many links as
    rows whatever the size of the groups, and the components are those of all links.
    """
    ship(codes.sparkSession)
    found, rows, matched = None, codes.select("id", "code", F.lit("").alias("path")), 0
    for level in range(depth):
        rows, matched = _deal(rows, matched, bits + 1)
        crowded = None
        if level < depth - 1:
            rows = materialise(rows, "codes")
            crowded = materialise(rows.groupBy("path", "top").agg(F.count("*").alias("n")).where(F.col("n") > group_limit).select("path", "top"), "crowded")
            if crowded.isEmpty():
                crowded = None
        calm = rows if crowded is None else rows.join(crowded, ["path", "top"], "left_anti")
        part = _joined(calm, bits, matched)
        found = part if found is None else found.unionByName(part)
        if crowded is None:
            break
        rows = rows.join(crowded, ["path", "top"], "left_semi").select("id", "code", "path")
    return found


def _joined(rows: DataFrame, bits: int, matched: int) -> DataFrame:
    exact = ((1 << matched) - 1) << (64 - matched)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        all_rows = pa.Table.from_batches(held)
        ids, codes = all_rows["id"].to_numpy(), all_rows["code"].to_numpy().view(np.uint64)
        paths = np.array(all_rows["path"].to_pylist())
        for path in np.unique(paths):
            own = np.flatnonzero(paths == path)
            forest = Forest(len(own))
            for x, y in GrayIndex(codes[own]).join(bits, exact):
                forest.link(x, y)
            root = forest.flatten()
            apart = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[own[apart]]), pa.array(ids[own[root[apart]]])], names=["a", "b"])

    return rows.repartition("path", "top").select("id", "code", "path").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", bits: int = BITS, shingle: int = SHINGLE, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id: the smallest doc_id that links reach."""
    prints = materialise(fingerprints(docs, text, key, shingle), "prints")
    classes = materialise(prints.where("doc_id IS NOT NULL").groupBy(F.col("fp").alias("code")).agg(F.min("doc_id").alias("id")), "classes")
    reached = components(links(classes, bits, group_limit))
    named = materialise(classes.join(reached, classes["id"] == reached["node"], "left").select(F.col("code").alias("fp"), F.coalesce("component", "id").alias("component_id")), "named")
    return prints.join(named, "fp", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def shingles(data: bytes | None, shingle: int) -> np.ndarray:
    """The distinct shingle hashes of UTF-8 text, ascending."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(data, shingle)]))


def bands(found: np.ndarray) -> np.ndarray:
    """The buckets of a set of shingles."""
    if not len(found):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        least = np.full(len(_KEYS), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(found), 1024):
            least = np.minimum(least, (_KEYS[:, None] * found[at : at + 1024]).min(1))
        out = np.arange(BANDS, dtype=np.uint64)
        for column in least.reshape(BANDS, ROWS).T:
            out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out.view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two ascending sets have a Jaccard similarity of `least` or more."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) < least * len(b) - 1e-9:
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return common >= least * (len(a) + len(b) - common) - 1e-9


def _set_hash(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), 7) - (1 << 63)


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, code, fp, buckets) of docs: doc_id, text; code tells sets of shingles apart, fp is the fingerprint of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingles(t.as_py(), shingle) for t in part["text"].cast(pa.binary())]
                prints = np.array([majority(iter([s])) for s in sets], np.uint64)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(map(_set_hash, sets), pa.int64()), pa.array(prints.view(np.int64)), pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], names=["doc_id", "code", "fp", "buckets"])

    return docs.mapInArrow(run, "doc_id long, code long, fp long, buckets array<long>")


def linked(prints: np.ndarray, sets: list[np.ndarray], least: float, far: int) -> np.ndarray:
    """The root of each member of a bucket, linked by similarity; pairs that differ in over `far` bits are not looked at."""
    forest = Forest(len(sets))
    for x, y in GrayIndex(prints).join(far):
        apart = forest.snapshot[x] != forest.snapshot[y]
        new = False
        for a, b in zip(x[apart].tolist(), y[apart].tolist(), strict=True):
            ra, rb = forest.root(a), forest.root(b)
            if ra != rb and alike(sets[a], sets[b], least):
                forest.up[max(ra, rb)] = min(ra, rb)
                new = True
        if new:
            forest.flatten()
    return forest.flatten()


def print_buckets(classes: DataFrame, bits: int = BITS, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """(bucket, code, id, fp): sets whose fingerprints `links` connects in a group, or that share one, by the group's root.

    classes: code, id, fp. A fingerprint is a member of its own bucket too, and of one for each group at most.
    """
    codes = materialise(classes.groupBy("fp").agg(F.min("id").alias("root")), "prints")
    near = links(codes.select(F.col("root").alias("id"), F.col("fp").alias("code")), bits, group_limit).distinct()
    met = near.select(F.col("b").alias("bucket"), F.col("a").alias("root")).unionByName(near.select(F.col("b").alias("bucket"), F.col("b").alias("root")))
    met = met.unionByName(codes.select(F.col("root").alias("bucket"), "root")).distinct()
    named = met.join(codes.hint("merge"), "root").select("bucket", "fp")
    return named.join(classes.select("code", "id", "fp").hint("merge"), "fp").select(F.xxhash64(F.lit("fp"), "bucket").alias("bucket"), "code", "id", "fp")


def similar_links(docs: DataFrame, members: DataFrame, shingle: int, least: float, far: int) -> DataFrame:
    """(a, b): a spanning forest of each bucket's members that are alike. members: bucket, code, id, fp."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [shingles(t.as_py(), shingle) for t in batch["text"].slice(at, 256).cast(pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(map(_set_hash, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["code", "data"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b[n].to_pylist() for n in ("bucket", "id", "fp", "data")), strict=True))
        for _, held in groupby(rows, lambda r: r[0]):
            ids, prints, sets = [], [], []
            for _, id_, fp, data in held:
                ids.append(id_)
                prints.append(fp)
                sets.append(np.frombuffer(data, np.uint64))
            if len(ids) == 2:
                pairs = [(ids[1], ids[0])] if ((prints[0] ^ prints[1]) & ((1 << 64) - 1)).bit_count() <= far and alike(*sets, least) else []
            else:
                root = linked(np.array(prints, np.int64).view(np.uint64), sets, least, far).tolist()
                pairs = [(ids[i], ids[r]) for i, r in enumerate(root) if i != r]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1)], names=["a", "b"])

    asked = members.select(F.col("id").alias("doc_id")).distinct()
    sets = docs.join(asked.hint("merge"), "doc_id", "left_semi").select("text").mapInArrow(read, "code long, data binary")
    sets = sets.groupBy("code").agg(F.first("data").alias("data"))  # rows that share an id, or a text, once
    met = members.join(sets.hint("merge"), "code").select("bucket", "id", "fp", "data")
    return met.repartition("bucket").sortWithinPartitions("bucket", "id").mapInArrow(join, "a long, b long")


def similar_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle: int = 5, least: float = LEAST, far: int = FAR) -> DataFrame:
    """(doc_id, fp, component_id) for every row; component_id: the smallest doc_id that links of similarity `least` or more reach."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    prints = materialise(_signed(rows, shingle), "prints")
    classes = materialise(prints.where("doc_id IS NOT NULL").groupBy("code").agg(F.min("doc_id").alias("id"), F.first("fp").alias("fp"), F.first("buckets").alias("buckets")), "classes")
    dealt = classes.select(F.explode("buckets").alias("bucket"), "code", "id", "fp").unionByName(materialise(print_buckets(classes), "agreeing"))
    shared = dealt.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("code")).alias("x"), F.min("code").alias("c")).where("n > 1")
    chosen = materialise(shared.groupBy("n", "x", "c").agg(F.min("bucket").alias("bucket")).select("bucket"), "chosen")
    members = materialise(dealt.join(chosen.hint("merge"), "bucket").select("bucket", "code", "id", "fp"), "members")
    reached = components(similar_links(rows, members, shingle, least, far))
    named = materialise(classes.join(reached, classes["id"] == reached["node"], "left").select("code", F.coalesce("component", "id").alias("component_id")), "named")
    for done in (chosen, members, classes):
        forget(done)
    return prints.join(named, "code", "left").select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
