"""Connected components of a link table, by alternating large-star and small-star rounds.

No task sees more than a partition of the links: minima by node are pre-aggregated before the shuffle,
and the join that hands them back is one whose oversized partitions the adaptive planner splits, so a
node with very many links is dealt to many tasks. Each round is a table in the shared folder.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.session import forget, materialise


class Forest:
    """Union-find over the positions 0 to n - 1, for the links of one task."""

    def __init__(self, n: int):
        self.up = list(range(n))
        self.snapshot = np.arange(n)

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Links pairs of positions; pairs known to be connected are passed over in bulk."""
        new = self.snapshot[a] != self.snapshot[b]
        if not new.any():
            return
        for x, y in zip(a[new].tolist(), b[new].tolist(), strict=True):
            x, y = self.root(x), self.root(y)
            if x < y:
                self.up[y] = x
            elif y < x:
                self.up[x] = y
        self.flatten()

    def flatten(self) -> np.ndarray:
        """The root of each position."""
        up = np.array(self.up)
        while True:
            higher = up[up]
            if (higher == up).all():
                break
            up = higher
        self.up, self.snapshot = up.tolist(), up
        return up


def _state(links: DataFrame) -> tuple[int, int]:
    row = links.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0)).alias("h")).first()
    return row["n"], int(row["h"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One round over links a > b. Large: nodes above u go to the least neighbour of u; small: u and all its lower neighbours go there."""
    pairs = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = materialise(pairs.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m")), "least")
    met = pairs.join(least, F.col("a") == F.col("u"))
    if large:
        new = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        new = met.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b")))).alias("l")).select("l.a", "l.b")
    out = materialise(new.where("a <> b").distinct(), "links")
    forget(least)
    return out


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node long, component long) for every node of a link; component is the smallest node reachable.

    Links of a node with itself and links with a null end are ignored.
    """
    links = links.select(F.greatest(a, b).cast("long").alias("a"), F.least(a, b).cast("long").alias("b"), F.col(a).alias("_x"), F.col(b).alias("_y"))
    links = materialise(links.where("_x IS NOT NULL AND _y IS NOT NULL AND a <> b").select("a", "b").distinct(), "links")
    state = _state(links)
    for _ in range(most_rounds):
        if not state[0]:
            break
        before, links = links, _star(links, True)
        forget(before)
        before, links = links, _star(links, False)
        forget(before)
        now = _state(links)
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    nodes = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
