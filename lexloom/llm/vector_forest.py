"""Near-duplicate vectors by a forest of random-projection trees.

Trees split space again and again by random directions; rows close to a split go to both sides (spill overlap). Rows of a
leaf are compared exactly, so no pair below the threshold links; trees make up for each other's misses. A pair that meets
in several leaves is counted in the first leaf only, which the rows' own lists of leaves tell, so that no pair is ever
written out: a leaf returns each row's number of links and a spanning forest of its links.

How wide the overlap must be follows from the data. Along a random direction a pair at the threshold differs by
sqrt((2 - 2 * least) / dimension) as a rule; with the density of the rows at the cut that gives the part of such pairs
that a split loses. Each path from a tree's root has an allowance for these losses, and each split takes an overlap that
keeps to it. Where the overlap would eat up what the split gains, rows are too close together for trees, and the leaf is
compared whole, in blocks. Before the trees part, splits that can't lose any pair set tight groups apart.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import saved
from .components import components

#: Trees; rows that a leaf should hold.
TREES, LEAF_ROWS = 8, 256
#: A pair at the threshold is lost on its path through one tree with this probability at most, so by 8 trees in one of 250 cases.
LOST = 0.5
#: A split's overlap holds this part of its rows at most; of one that loses nothing, and then each side has ASIDE at least.
OVERLAP, NEAR, ASIDE = 0.3, 0.1, 0.1
#: The trees are fitted on about this many rows at most, and this many bytes of them, chosen by hash; every row is indexed. A
#: leaf has at least LEAST of them, so beyond some ten million rows leaves grow with the rows.
SAMPLE_ROWS, SAMPLE_BYTES, LEAST = 32_768, 16 << 20, 12
#: Bytes and rows of one side that a task compares, and rows of each side at once. Larger leaves are compared block by block.
BLOCK_BYTES, BLOCK_ROWS, TILE = 8 << 20, 8192, 1024

#: A copy of a row in a leaf costs about as much, in its shuffle, as so many comparisons.
COPY = 1000

#: Overlaps that a split may take, in units of what a pair at the threshold differs by as a rule, and by how much such a
#: pair differs beyond each on average (of a standard normal variable's size what is beyond twice the half width).
_HALVES = np.linspace(0, 2, 33)
_BEYOND = np.array([np.maximum(np.abs(np.random.default_rng(0).standard_normal(65536)) - 2 * h, 0).mean() for h in _HALVES])


@dataclass
class Forest:
    """Node k is a split (direction, cut, half of the overlap's width, two children) or a fork (a child for each tree).

    Children are nodes, or leaves as -1 - leaf.
    """

    nodes: list = field(default_factory=list)
    leaves: int = 0
    root: int = -1

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of x and the leaves that they are in, as pairs."""
        rows, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            name, own = todo.pop()
            if not len(own):
                continue
            if name < 0:
                rows.append(own)
                found.append(np.full(len(own), -1 - name))
                continue
            node = self.nodes[name]
            if len(node) == 1:
                todo += [(child, own) for child in node[0]]
            else:
                direction, cut, half, children = node
                side = x[own] @ direction - cut
                todo += [(children[0], own[side <= half]), (children[1], own[side >= -half])]
        return np.concatenate(rows), np.concatenate(found)


def grow(x: np.ndarray, total: int, least: float, trees: int, leaf_rows: float, rng: np.random.Generator) -> Forest:
    """A forest for `total` rows, fitted on the sample x of them (unit vectors)."""
    forest, scale = Forest(), total / max(1, len(x))
    apart = np.sqrt(max(0.0, 2 - 2 * least))  # the most that a pair at the threshold differs by
    differs = apart / np.sqrt(max(1, x.shape[1]))
    most = max(leaf_rows / scale, LEAST)

    def leaf() -> int:
        forest.leaves += 1
        return -forest.leaves

    def projections(own: np.ndarray, directions: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        length = np.linalg.norm(directions, axis=1)
        directions = (directions[length > 1e-9] / length[length > 1e-9, None]).astype(np.float32)
        return zip(directions, np.sort(directions @ x[own].T, axis=1), strict=True)

    def between(side: np.ndarray, low, high) -> np.ndarray:
        return (np.searchsorted(side, high, "right") - np.searchsorted(side, low, "left")) / len(side)

    def safe(own: np.ndarray):
        """A split that loses nothing: its overlap is as wide as any pair at the threshold."""
        best, half = None, apart / 2 + 1e-6
        for direction, side in projections(own, x[rng.choice(own, 6)] - x[rng.choice(own, 6)]):
            cuts = np.linspace(side[int(len(side) * ASIDE / 2)], side[int(len(side) * (1 - ASIDE / 2))], 24)
            both = between(side, cuts - half, cuts + half)
            left = np.searchsorted(side, cuts) / len(side)
            both[(left < ASIDE) | (left > 1 - ASIDE)] = 1
            k = int(np.argmin(both))
            if both[k] <= NEAR and (best is None or both[k] < best[0]):
                best = both[k], direction, float(cuts[k]), half, 0.0
        return best

    def loose(own: np.ndarray, allowance: float):
        """The split with the least overlap that keeps to its share of the allowance; and what it loses."""
        best = None
        allowed = allowance / (np.log2(max(2.0, len(own) / most)) + 1)
        for direction, side in projections(own, rng.standard_normal((3, x.shape[1]))):
            cuts = side[rng.integers(int(len(side) * 0.35), int(len(side) * 0.65) + 1, 4)]
            density = between(side, cuts - differs, cuts + differs) / 2  # per unit of differs
            taken = np.minimum((_BEYOND * density[:, None] > allowed).sum(axis=1), len(_HALVES) - 1)
            both = between(side, cuts - _HALVES[taken] * differs, cuts + _HALVES[taken] * differs)
            k = int(np.argmin(both))
            if best is None or both[k] < best[0]:
                best = both[k], direction, float(cuts[k]), float(_HALVES[taken[k]] * differs), float(_BEYOND[taken[k]] * density[k])
        return best if best and best[0] <= OVERLAP else None

    def compared(rows: int) -> float:
        """What a leaf with so many rows of the sample costs."""
        n = rows * scale
        return n * n + COPY * n * max(1.0, n / BLOCK_ROWS)

    def build(own: np.ndarray, allowance: float | None) -> tuple[int, float]:
        """A node over rows of the sample, and its leaves' cost; allowance: what its tree may lose yet, before the fork None."""
        todo: list = [(own, allowance, None)]
        name_of_all, cost = None, 0.0
        while todo:
            own, allowance, to = todo.pop()
            name = None
            if len(own) > most:
                found = safe(own) if allowance is None and len(own) >= 4 * LEAST else None
                if found is None and allowance is not None:
                    found = loose(own, allowance)
                if found:
                    _, direction, cut, half, gone = found
                    name = len(forest.nodes)
                    forest.nodes.append((direction, cut, half, [0, 0]))
                    side = x[own] @ direction - cut
                    todo += [(own[at], None if allowance is None else allowance - gone, (name, i)) for i, at in enumerate((side <= half, side >= -half))]
                elif allowance is None:
                    mark, count, whole, all_ = len(forest.nodes), forest.leaves, compared(len(own)), 0.0
                    forest.nodes.append(([],))
                    for k in range(trees):
                        child, own_cost = build(own, -np.log(1 - LOST))
                        forest.nodes[mark][0].append(child)
                        all_ += own_cost
                        if all_ / (k + 1) * trees >= whole:  # comparing all with all is no dearer, and loses nothing
                            break
                    else:
                        name, cost = mark, cost + all_
                    if name is None:
                        del forest.nodes[mark:]
                        forest.leaves = count
            if name is None:
                name = leaf()
                cost += compared(len(own))
            if to:
                forest.nodes[to[0]][3][to[1]] = name
            else:
                name_of_all = name
        return name_of_all, cost

    forest.root = build(np.arange(len(x)), None)[0]
    return forest


def unit(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of unit length in double precision, padded with zeros to the width."""
    size = vectors.value_lengths().to_numpy(zero_copy_only=False)
    x = np.zeros((len(vectors), width))
    x[np.arange(width) < size[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def links_in_leaf(least: float):
    """For applyInArrow: of one pair of blocks of a leaf, each linked row's links that no earlier leaf has, and a root."""

    def compare(key, table):
        leaf, i, j = (k.as_py() for k in key[:3])
        table = table.combine_chunks()
        vectors, lists = (table[c].chunk(0) for c in ("vector", "leaves"))
        x = unit(vectors, len(vectors[0]))
        ids, copies, block = (table[c].to_numpy() for c in ("id", "copies", "block"))
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        links, root = np.zeros(len(ids), np.int64), np.arange(len(ids))
        linked = np.zeros(len(ids), bool)
        for a in range(0, len(left), TILE):
            for b in range(a if i == j else 0, len(right), TILE):
                one, two = left[a : a + TILE], right[b : b + TILE]
                same = i == j and a == b
                near = x[one] @ x[two].T >= least
                if same:
                    np.fill_diagonal(near, False)
                n, m = near.any(axis=1), near.any(axis=0)
                if not n.any():
                    continue
                one, two, near = one[n], two[m], near[np.ix_(n, m)]
                earlier = membership(lists, leaf, np.concatenate([one, two]))
                new = near & ~(earlier[: len(one)] @ earlier[len(one) :].T > 0)
                links[one] += new @ copies[two]
                if not same:
                    links[two] += new.T @ copies[one]
                both = np.concatenate([one, two])
                linked[both] = True
                unite(root, both, both[spanning(near)])
        rows = np.flatnonzero(linked)
        return pa.table({"id": pa.array(ids[rows]), "links": pa.array(links[rows]), "root": pa.array(ids[[top(root, r) for r in rows.tolist()]] if len(rows) else ids[:0])})

    return compare


def top(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = int(root[i])
    return i


def unite(root: np.ndarray, rows: np.ndarray, others: np.ndarray) -> None:
    """Links each row with the other beside it."""
    for a, b in set(zip(rows.tolist(), others.tolist(), strict=True)):
        a, b = top(root, a), top(root, b)
        root[max(a, b)] = min(a, b)


def membership(lists: pa.Array, leaf: int, rows: np.ndarray) -> np.ndarray:
    """A row for each of rows, a column for each leaf before `leaf` that any of them is in."""
    own = lists.take(pa.array(rows))
    row = np.repeat(np.arange(len(rows)), own.value_lengths().to_numpy(zero_copy_only=False))
    value = own.flatten().to_numpy(zero_copy_only=False)
    row, value = row[value < leaf], value[value < leaf]
    names, column = np.unique(value, return_inverse=True)
    out = np.zeros((len(rows), max(1, len(names))), np.float32)
    out[row, column] = 1
    return out


def spanning(near: np.ndarray) -> np.ndarray:
    """For each left and then right row, a row of its component; sides are told apart, equal rows link elsewhere."""
    n, m = near.shape
    root = np.full(n + m, -1)
    for first in range(n):
        if root[first] >= 0:
            continue
        root[first], edge = first, np.array([first])
        while len(edge):  # from left rows to right rows and back
            right = np.flatnonzero(near[edge].any(axis=0) & (root[n:] < 0))
            root[n + right] = first
            edge = np.flatnonzero(near[:, right].any(axis=1) & (root[:n] < 0)) if len(right) else np.zeros(0, np.int64)
            root[edge] = first
    return root


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, trees: int = TREES, leaf_rows: int = LEAF_ROWS, sample_rows: int = SAMPLE_ROWS, seed: int = 7
) -> DataFrame:
    """For each row: id, n_links (other rows found with cosine >= least), component_id (smallest id that links reach), kept.

    A vector that is null, empty or zero, or holds a null or a value that isn't finite, links with nothing, and so do
    vectors of different lengths. Repeated rows are vectors of their own and link with each other. A null id gives a row
    and counts as a link of others; component_id is null only where no id is in reach, kept is then true. Other columns
    are no matter. Equal vectors are compared once.
    """
    spark = vectors.sparkSession
    rows = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].alias("vector"))
    finite = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("good", F.coalesce(finite, F.lit(False)))
    rows = rows.withColumn("vector", F.when(F.col("good"), F.col("vector")))
    classes = rows.where("good").groupBy("vector").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = saved(classes.select(F.monotonically_increasing_id().alias("key"), "*"), "vectors")
    total, width = classes.agg(F.count("*"), F.max(F.size("vector"))).first()
    most = min(sample_rows, SAMPLE_BYTES // (8 * max(1, width or 1)))
    part = min(1.0, most / max(1, total))
    sample = classes.where(F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < int(part * (1 << 20))).limit(2 * most).select("vector").toArrow()["vector"].combine_chunks()
    sample = sample.chunk(0) if isinstance(sample, pa.ChunkedArray) and sample.num_chunks else sample
    known = spark.sparkContext.broadcast(grow(unit(sample, width), total, least, trees, leaf_rows, np.random.default_rng(seed)) if total and len(sample) else Forest(leaves=1))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            row, leaf = known.value.find(unit(batch.column("vector"), width))
            order = np.lexsort((leaf, row))
            ends = np.searchsorted(row[order], np.arange(batch.num_rows + 1))
            leaves = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(leaf[order], pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("copies"), batch.column("vector"), leaves], names=["id", "copies", "vector", "leaves"])

    kind = classes.schema["vector"].dataType.simpleString()
    placed = saved(classes.select("key", "copies", "vector").mapInArrow(place, f"id long, copies long, vector {kind}, leaves array<long>"), "placed")
    leaf_of = placed.select("id", F.explode("leaves").alias("leaf"), F.size("vector").alias("width"))
    sizes = leaf_of.groupBy("leaf", "width").agg(F.count("*").alias("n")).where("n > 1")
    rows_of = F.least(F.lit(BLOCK_ROWS), F.greatest(F.lit(64), F.lit(BLOCK_BYTES) / (8 * F.col("width"))))
    sizes = sizes.select("leaf", "width", F.ceil(F.col("n") / rows_of).cast("long").alias("blocks"))
    spread = placed.select("*", F.size("vector").alias("width"), F.explode("leaves").alias("leaf")).join(sizes, ["leaf", "width"])
    spread = spread.withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    spread = spread.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "width", "block", "id", "copies", "vector", "leaves")
    found = spread.groupBy("leaf", "i", "j", "width").applyInArrow(links_in_leaf(least), "id long, links long, root long")
    found = saved(found, "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    grouped = classes.join(links, classes["key"] == links["id"], "left").join(parts, classes["key"] == parts["node"], "left")
    grouped = grouped.select("vector", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "key").alias("part"))
    smallest = grouped.groupBy("part").agg(F.min("first").alias("component_id"))
    grouped = grouped.join(smallest, "part").select("vector", "n_links", "component_id")
    out = rows.where("good").join(grouped, "vector").select("id", "n_links", "component_id")
    out = out.unionByName(rows.where("not good").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
