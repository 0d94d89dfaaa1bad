"""Near-duplicate vectors by an exact metric range join over pivots.

Vectors are compared by cosine; on unit vectors that is a chord, so cosine >= t is distance <= eps with
eps = sqrt(2 - 2t), a metric. Pivots, a hashed sample of the vectors, partition them into cells of the
nearest pivot. By the triangle inequality a vector x with nearest pivot p can link with a member y of
the cell of q only if

    d(x, q) <= d(y, q) + eps <= reach(q) + eps      and      d(x, q) <= d(x, p) + 2 eps

and, by the bisector of p and q, only if (d(x, q)^2 - d(x, p)^2) / (2 d(p, q)) <= eps. Where all three
hold, x is replicated to that cell. A large cell is dealt in blocks of members, and cells and blocks join
independently of each other.

Two blocks meet once: of each two, a rule of their numbers tells which one is replicated to the other (both
conditions hold on both sides of a link, so either will do), and the meeting counts links for both. Members and
guests travel packed, those of a scan batch that go to the same block in one row. Equal vectors are one class with a
weight, so copies are not multiplied out. A block returns counts and a spanning forest of its links, never the pairs.

Defined cases: a vector that is null, of norm zero, or holds a null or non-finite component links with
nothing (n_links 0, a component of its own), and so do rows without an id, whose component is null; vectors
link only within one dimension; rows that share an id, with one vector or with several, are rows of their own and
count as others of each other; an empty table gives an empty result; other columns are ignored.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import unit_hash
from tesserae.llm.components import Forest, components
from tesserae.session import materialise, ship

CELL = 8192
BLOCK = 8192
MOST_PIVOTS = 4096
STEP = 1024  # vectors that are compared at once with a block, or dealt at once
SLACK = 1e-6  # a computed distance of a vector to itself is up to 4e-8 in 64 dimensions, as the square root of a rounding error


def unsure(dim: int) -> float:
    """Single precision decides outside this distance from the threshold, double precision within it."""
    return (dim + 8) * 1.2e-7


def _usable(value) -> np.ndarray | None:
    if value is None or not len(value) or None in value:
        return None
    x = np.array(value, np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        norm = np.sqrt((x * x).sum())
    return x if np.isfinite(norm) and norm > 0 else None


def keyed(vectors: DataFrame, vector: str, key: str) -> DataFrame:
    """(vec_id, class): a digest of the dimension and components, null for vectors that link with nothing; raw: the components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.tobytes() if i is not None and (x := _usable(v)) is not None else None for i, v in zip(batch["vec_id"].to_pylist(), batch["vector"].to_pylist(), strict=True)]
            digest = [xxhash.xxh3_128_digest(r) if r is not None else None for r in raw]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(digest, pa.binary()), pa.array(raw, pa.binary())], names=["vec_id", "class", "raw"])

    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    return rows.mapInArrow(run, "vec_id long, class binary, raw binary")


def _scaled(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _unit(raw: list[bytes]) -> np.ndarray:
    return _scaled(np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1))


class Cells:
    """Pivots of one dimension, the cells' reach and their numbers of blocks."""

    def __init__(self, pivots: np.ndarray, eps: float):
        self.pivots, self.eps = pivots, eps
        self.apart = np.sqrt(np.maximum(2 - 2 * pivots @ pivots.T, 0))
        self.reach = np.zeros(len(pivots))
        self.blocks = np.zeros(len(pivots), np.int64)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * x @ self.pivots.T, 0))

    def targets(self, d: np.ndarray, home: np.ndarray) -> np.ndarray:
        """For each row and cell whether the row is needed there."""
        own = d[np.arange(len(d)), home][:, None]
        bisector = (d * d - own * own) <= 2 * self.apart[home] * self.eps + SLACK
        return (self.blocks > 0) & (d <= self.reach + self.eps + SLACK) & (d <= own + 2 * self.eps + SLACK) & bisector


def _cells_of(classes: DataFrame, cosine: float, cell: int, block: int, most_pivots: int) -> dict[int, Cells]:
    """Cells by dimension. Pivots, at most about `most_pivots` in all, and a row for each cell come to the driver."""
    n = classes.count()
    want = min(most_pivots, -(-n // cell))
    picked = classes.where(unit_hash(F.col("class"), 11) < min(1.0, 1.5 * want / max(n, 1))).select("raw").collect() if want > 1 else []
    eps = float(np.sqrt(2 - 2 * cosine))
    by_size: dict[int, list[bytes]] = {}
    for r in sorted(bytes(r["raw"]) for r in picked):
        by_size.setdefault(len(r) // 8, []).append(r)
    cells = {r["dim"]: Cells(_unit(by_size[r["dim"]]) if r["dim"] in by_size else np.eye(1, r["dim"]), eps) for r in classes.select((F.octet_length("raw") / 8).cast("int").alias("dim")).distinct().collect()}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, rows in _by_dimension(batch["raw"].to_pylist()).items():
                d = cells[dim].distances(_unit([batch["raw"][i].as_py() for i in rows]))
                home = d.argmin(axis=1)
                own, first = np.unique(home, return_inverse=True)
                reach = np.zeros(len(own))
                np.maximum.at(reach, first, d[np.arange(len(d)), home])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), dim)), pa.array(own), pa.array(np.bincount(first)), pa.array(reach)], names=["dim", "cell", "n", "reach"])

    for r in classes.mapInArrow(measure, "dim long, cell long, n long, reach double").groupBy("dim", "cell").agg(F.sum("n").alias("n"), F.max("reach").alias("reach")).collect():
        cells[r["dim"]].reach[r["cell"]] = r["reach"]
        cells[r["dim"]].blocks[r["cell"]] = -(-r["n"] // block)
    return cells


def _by_dimension(raw: list[bytes]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, r in enumerate(raw):
        out.setdefault(len(r) // 8, []).append(i)
    return out


class BlockJoin:
    """Counts the links of one block's members with each other and with the guests that stream past, and keeps a forest of them."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, x: np.ndarray, cosine: float):
        self.ids, self.weights, self.x, self.cosine = ids, weights, x, cosine
        self.single = x.astype(np.float32)
        self.near = unsure(x.shape[1])
        self.counts = weights - 1
        self.label = np.arange(len(ids))
        self.edges: list[tuple[int, int]] = []
        for at in range(0, len(ids), STEP):
            self._links(ids[at : at + STEP], weights[at : at + STEP], x[at : at + STEP])

    def meet(self, ids: np.ndarray, weights: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The guests that link with members, and their numbers of links here."""
        mine, other = self._links(ids, weights, x)
        found = np.bincount(other, self.weights[mine], len(ids)).astype(np.int64)
        linked = np.flatnonzero(found)
        return ids[linked], found[linked]

    def _links(self, ids: np.ndarray, weights: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dots = self.single @ x.astype(np.float32).T
        mine, other = np.nonzero(dots >= np.float32(self.cosine - self.near))
        open_ = dots[mine, other] < np.float32(self.cosine + self.near)
        sure = ~open_
        if open_.any():
            sure[open_] = np.einsum("ij,ij->i", self.x[mine[open_]], x[other[open_]]) >= self.cosine
        keep = sure & (self.ids[mine] != ids[other])
        mine, other = mine[keep], other[keep]
        np.add.at(self.counts, mine, weights[other])
        self._connect(self.label[mine], other, ids)
        return mine, other

    def _connect(self, label: np.ndarray, other: np.ndarray, ids: np.ndarray) -> None:
        """Adds an edge from each other vector to one group of the members it links with, and an edge for each
        two groups that it joins: fewer edges than members and others together."""
        if not len(other):
            return
        pairs = np.unique(np.stack([other, label], axis=1), axis=0)
        first = np.concatenate([[True], pairs[1:, 0] != pairs[:-1, 0]])
        self.edges += zip(self.ids[pairs[first, 1]].tolist(), ids[pairs[first, 0]].tolist(), strict=True)
        again = np.flatnonzero(~first)
        if len(again):
            forest = Forest(len(self.ids))
            forest.link(pairs[again - 1, 1], pairs[again, 1])
            root = forest.flatten()
            joined = np.flatnonzero(root != np.arange(len(root)))
            self.edges += zip(self.ids[joined].tolist(), self.ids[root[joined]].tolist(), strict=True)
            self.label = root[self.label]

    def rows(self) -> list[tuple[int, int | None, int]]:
        return [*((i, None, n) for i, n in zip(self.ids.tolist(), self.counts.tolist(), strict=True)), *((a, b, 0) for a, b in self.edges)]


def _hosts(mine: np.ndarray, theirs: int) -> np.ndarray:
    """Which of the blocks numbered `mine` send their members to the block `theirs`; of two blocks one does."""
    return (mine < theirs) ^ ((mine ^ theirs) & 1 == 1) & (mine != theirs)


def join(classes: DataFrame, cosine: float, cell: int = CELL, block: int = BLOCK, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """(a, b, n). b null: class a has n links found in one place, own copies once; else a and b are linked. classes: id, n, raw."""
    cells = _cells_of(classes, cosine, cell, block, most_pivots)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw_all, ids, weights = batch["raw"].to_pylist(), batch["id"].to_numpy(), batch["n"].to_numpy()
            for dim, rows in _by_dimension(raw_all).items():
                for at in range(0, len(rows), STEP):
                    part = np.array(rows[at : at + STEP])
                    own = cells[dim]
                    d = own.distances(_unit([raw_all[i] for i in part]))
                    home = d.argmin(axis=1)
                    needed = own.targets(d, home)
                    first = np.cumsum(own.blocks) - own.blocks  # blocks numbered through all cells
                    mine = first[home] + np.array([xxhash.xxh64_intdigest(raw_all[i], 5) for i in part], np.uint64) % own.blocks[home].astype(np.uint64)
                    mine = mine.astype(np.int64)
                    out = []
                    for c in np.flatnonzero(needed.any(axis=0)).tolist():
                        for b in range(int(first[c]), int(first[c] + own.blocks[c])):
                            for guest, chosen in ((0, mine == b), (1, needed[:, c] & _hosts(mine, b) & (mine != b))):
                                picked = part[chosen]
                                if len(picked):
                                    out.append((dim, b, guest, ids[picked].tobytes(), weights[picked].tobytes(), b"".join([raw_all[i] for i in picked])))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (*[pa.int64()] * 3, *[pa.binary()] * 3), strict=True)], names=["dim", "block", "guest", "ids", "weights", "raw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, block_join = None, [], None

        def out(found: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 3, names=["a", "b", "n"])

        def closed() -> Iterator[pa.RecordBatch]:
            if block_join is not None or members:
                yield out((block_join or _block_of(members, cosine)).rows())

        for batch in batches:
            for i in range(batch.num_rows):
                now, guest = (batch["dim"][i].as_py(), batch["block"][i].as_py()), batch["guest"][i].as_py()
                row = (np.frombuffer(batch["ids"][i].as_py(), np.int64), np.frombuffer(batch["weights"][i].as_py(), np.int64), np.frombuffer(batch["raw"][i].as_py(), np.float64))
                if now != key:
                    yield from closed()
                    key, members, block_join = now, [], None
                if not guest:
                    members.append(row)
                    continue
                if block_join is None:
                    if not members:
                        continue  # a block without members needs no guests
                    block_join, members = _block_of(members, cosine), []
                linked, n = block_join.meet(row[0], row[1], _scaled(row[2].reshape(len(row[0]), -1)))
                if len(linked):
                    yield out([(a, None, k) for a, k in zip(linked.tolist(), n.tolist(), strict=True)])
        yield from closed()

    dealt = classes.select("id", "n", "raw").mapInArrow(deal, "dim long, block long, guest long, ids binary, weights binary, raw binary")
    return dealt.repartition("dim", "block").sortWithinPartitions("dim", "block", "guest").mapInArrow(run, "a long, b long, n long")


def _block_of(members: list[tuple[np.ndarray, np.ndarray, np.ndarray]], cosine: float) -> BlockJoin:
    """The block's members, already compared with each other."""
    ids, weights = (np.concatenate([m[i] for m in members]) for i in (0, 1))
    return BlockJoin(ids, weights, _scaled(np.concatenate([m[2] for m in members]).reshape(len(ids), -1)), cosine)


def near_vectors(vectors: DataFrame, cosine: float = 0.9, vector: str = "embedding", key: str = "vec_id", cell: int = CELL, block: int = BLOCK, most_pivots: int = MOST_PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id) for every row."""
    ship(vectors.sparkSession)
    rows = materialise(keyed(vectors, vector, key), "vectors")
    classes = rows.where("class IS NOT NULL").groupBy("class").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("n"), F.first("raw").alias("raw"))
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "classes")  # numbers of their own: an id may have several vectors
    found = materialise(join(classes, cosine, cell, block, most_pivots), "found")
    reached = components(found.where("b IS NOT NULL")).withColumnsRenamed({"node": "id", "component": "_c"})
    counts = found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n_links"))
    named = classes.select("class", "vec_id", "id").join(counts, "id").join(reached, "id", "left").withColumn("_c", F.coalesce("_c", "id"))
    named = materialise(named.select("class", "vec_id", "n_links", "_c"), "named")
    least = named.groupBy("_c").agg(F.min("vec_id").alias("component_id"))
    out = rows.select("vec_id", "class").join(named.drop("vec_id").join(least, "_c"), "class", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
