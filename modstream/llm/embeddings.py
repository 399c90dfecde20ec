"""Embedding near-dedup: a forest of random-projection trees with spill, exact comparison within leaves, union of the links."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modstream.llm.common import connected_components, forget, written

TREES = 10
#: Vectors that a leaf has on average, but for spill; and of a larger leaf, those that one task takes of each side.
LEAF, BLOCK = 256, 1500
#: A vector this close to a split (of unit vectors, in projections' standard deviations) goes to both sides.
SPILL = 0.12
#: Splits are put at medians of about this many vectors, and at 0 below the level FITTED; all vectors are indexed.
SAMPLE, FITTED = 20_000, 11


class Forest:
    """Splits: one random direction for each tree and level, a threshold for each node of the first levels."""

    def __init__(self, sample: np.ndarray, n: int, trees: int = TREES, leaf: int = LEAF, seed: int = 1):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.depth = max(0, math.ceil(math.log2(max(1, n) / leaf)))
        size = sample.shape[1]
        self.directions = rng.standard_normal((trees, self.depth, size))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.spill = SPILL / math.sqrt(size)
        fitted = min(self.depth, FITTED)
        self.thresholds = np.zeros((trees, max(0, 2**fitted - 1)))
        for t in range(trees):
            node = np.zeros(len(sample), dtype=np.int64)
            for level in range(fitted):
                at = sample @ self.directions[t, level]
                order = np.argsort(node, kind="stable")
                for part in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                    if len(part) >= 8:
                        self.thresholds[t, node[part[0]]] = np.median(at[part])
                node = 2 * node + 1 + (at > self.thresholds[t, node])

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) for all leaves of all unit vectors ``x``, ordered by tree; a leaf's number is unique in the forest."""
        rows_out, leaves_out = [], []
        for t in range(len(self.directions)):
            at = x @ self.directions[t].T
            rows, node = np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
            for level in range(self.depth):
                known = node < self.thresholds.shape[1]
                threshold = np.where(known, self.thresholds[t, np.where(known, node, 0)], 0.0) if self.thresholds.shape[1] else 0.0
                off = at[rows, level] - threshold
                left, right = off <= self.spill, off > -self.spill
                rows = np.concatenate([rows[left], rows[right]])
                node = np.concatenate([2 * node[left] + 1, 2 * node[right] + 2])
            rows_out.append(rows)
            leaves_out.append(node * len(self.directions) + t)
        return np.concatenate(rows_out), np.concatenate(leaves_out)


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of unit vectors of a column of vectors of one size."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(embedding: Column) -> Column:
    """Whether a vector has a direction: no null in it, all numbers finite, not all zero."""
    bad = F.exists(embedding, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf")))
    some = F.exists(embedding, lambda v: v != 0)
    return F.coalesce(~bad & some, F.lit(False))


def _links(forest, threshold: float):
    """Group function: (leaf, part, id, times, side, embedding) of a block or a pair of blocks -> (id, links, root)."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("side", "ascending"), ("id", "ascending")])
        x, ids, times = _units(group.column("embedding")), group.column("id").to_numpy(), group.column("times").to_numpy()
        leaf, (low, high) = group.column("leaf")[0].as_py(), group.column("part")[0].as_py().split("-")
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        if low != high:  # only pairs across the blocks; those within have their own group
            side = group.column("side").to_numpy()
            near &= side[:, None] != side[None, :]
        a, b = np.nonzero(near)
        if not len(a):
            return pa.table({"id": ids[:0], "links": times[:0], "root": ids[:0]})
        # A pair counts in the first leaf, by number, that has both.
        found = np.unique(a)
        place = np.full(len(ids), -1)
        place[found] = np.arange(len(found))
        rows, leaves = forest.value.leaves(x[found])
        order = np.lexsort((leaves, rows))
        rows, leaves = rows[order], leaves[order]
        earlier = leaves < leaf
        rows, leaves = rows[earlier], leaves[earlier]
        shared = np.zeros(len(a), dtype=bool)
        if len(rows):
            _, number = np.unique(leaves, return_inverse=True)
            member = np.zeros((len(found), number.max() + 1), dtype=np.float32)
            member[rows, number] = 1
            common = member @ member.T > 0
            shared = common[place[a], place[b]]
        links = np.bincount(a[~shared], times[b[~shared]], len(ids)).astype(np.int64)
        root = np.arange(len(ids))
        while True:  # smallest neighbour, then jump; ids ascend within a side only, so roots are places here
            new = root.copy()
            np.minimum.at(new, a, root[b])
            new = new[new]
            if (new == root).all():
                break
            root = new
        return pa.table({"id": ids[found], "links": links[found], "root": ids[root[found]]})

    return run


def _forest_links(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(id, links, root): parts of links of ``classes`` (id, times, embedding), vectors of one dimension.

    Leaves are laid out as (leaf, id); a vector itself is joined to its leaves once, on the way to the groups.
    """
    spark = classes.sparkSession
    share = min(1.0, SAMPLE / n)
    sample = classes.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("embedding").toArrow().column("embedding")
    forest = spark.sparkContext.broadcast(Forest(_units(sample) if len(sample) else np.zeros((0, 1)), n if len(sample) else 0))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 4000):
                part = batch.slice(low, 4000)
                rows, leaves = forest.value.leaves(_units(part.column(1)))
                yield pa.record_batch([pa.array(leaves), part.column(0).take(pa.array(rows))], ["leaf", "id"])

    placed = written(classes.select("id", "embedding").mapInArrow(place, "leaf long, id long"), "leaves")
    sizes = placed.groupBy("leaf").count().where("count > 1").select("leaf", F.ceil(F.col("count") / BLOCK).alias("blocks"))
    parts = placed.join(sizes, "leaf").withColumn("side", F.pmod(F.xxhash64("id", "leaf"), F.col("blocks")))
    others = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.concat_ws("-", F.least(o, "side"), F.greatest(o, "side")))
    keyed = parts.select("leaf", "id", "side", F.explode(others).alias("part")).join(classes, "id")
    out = written(keyed.groupBy("leaf", "part").applyInArrow(_links(forest, threshold), "id long, links long, root long"), "links")
    forget(placed)
    return out


def link_embeddings(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row of ``vectors`` (vec_id, embedding).

    Vectors are linked if their cosine, in double precision, is ``threshold`` or more and they meet in a leaf of the forest. Equal
    vectors are one class before that: a class of m has m - 1 links within. In a leaf all vectors are compared, large leaves by
    pairs of blocks; a task returns sums and one root for each vector, never pairs. component_id is the smallest vec_id reachable,
    kept says whether that is the vector's own.

    Vectors that are null, zero, or hold null or non-finite numbers, and rows with a null id, link with nothing; they are their own
    component. Vectors of another dimension are never linked. Repeated rows count as further vectors. No rows give no rows; other
    columns are not read.
    """
    rows = vectors.select("vec_id", "embedding")
    good = rows.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    classes = written(good.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("times")), "classes")
    links = None
    for size in [r[0] for r in classes.select(F.size("embedding").alias("d")).distinct().collect()]:
        some = classes.where(F.size("embedding") == size)
        found = _forest_links(some, some.count(), threshold)
        links = found if links is None else links.union(found)
    if links is None:
        links = vectors.sparkSession.createDataFrame([], "id long, links long, root long")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    named = connected_components(links.select(F.col("id").alias("a"), F.col("root").alias("b")))
    found = classes.join(counts, "id", "left").join(named, "id", "left")
    found = written(
        found.select(
            F.col("embedding").alias("vector"), (F.col("times") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
            F.coalesce("component_id", "id").alias("component"),
        ), "found",
    )
    joined = rows.join(found, (F.col("embedding") == F.col("vector")) & F.col("vec_id").isNotNull(), "left")
    component = F.coalesce("component", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept")
    )
