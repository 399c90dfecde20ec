"""Exact top-k search by inner product: a ball tree for each shard, best nodes first, with the k-th score passed on from shard to shard.

Vectors are dealt into shards of near ones. A query goes to its best shard first, then to more and more of the others, best first: with
it goes the score of its k-th candidate so far, so that a shard whose ball can't hold anything better isn't sent the query at all, and
in a shard whole branches are left out. No candidate is missed: what is left out lies below the k-th score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modstream.llm.common import forget, small_batches, written
from modstream.llm.integers import floored, products, rows_of

#: Vectors of a shard on average; those of a leaf of its tree.
SHARD, LEAF = 8_192, 64
#: A larger shard is dealt into parts of about this many vectors, each with a tree of its own; queries are sent in parts as large.
PART = 20_000
#: Shards are laid out by at most about this many vectors; all vectors are indexed.
SAMPLE = 20_000
NONE = np.iinfo(np.int64).min


class BallTree:
    """Nodes over rows of ``x``, put into the order of the leaves: each has a ball (center, radius) and its rows lo..hi."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(x))
        y = x.astype(np.float64)
        centers, radii, spans, children, splits = [], [], [], [], []
        waiting = [(0, len(x), -1, 0)] if len(x) else []
        while waiting:
            lo, hi, parent, side = waiting.pop()
            rows = self.order[lo:hi]
            center = y[rows].mean(axis=0)
            far = np.linalg.norm(y[rows] - center, axis=1)
            if parent >= 0:
                children[parent][side] = len(centers)
            node, split = len(centers), (np.zeros(x.shape[1]), 0.0)
            if hi - lo > leaf and far.max() > 0:
                one = y[rows[far.argmax()]]
                other = y[rows[np.linalg.norm(y[rows] - one, axis=1).argmax()]]
                at = y[rows] @ (other - one)
                middle = (hi - lo) // 2
                by = np.argsort(at, kind="stable")
                self.order[lo:hi] = rows[by]
                split = (other - one, float(at[by[middle]]))
                waiting += [(lo, lo + middle, node, 0), (lo + middle, hi, node, 1)]
            centers.append(center)
            radii.append(far.max())
            spans.append((lo, hi))
            children.append([-1, -1])
            splits.append(split)
        self.centers, self.radii = np.array(centers).reshape(len(centers), x.shape[1]), np.array(radii)
        self.spans, self.children = np.array(spans, dtype=np.int64).reshape(-1, 2), np.array(children, dtype=np.int64).reshape(-1, 2)
        self.directions, self.thresholds = np.array([s[0] for s in splits]).reshape(len(splits), x.shape[1]), np.array([s[1] for s in splits])

    def leaves(self) -> np.ndarray:
        return np.flatnonzero(self.children[:, 0] < 0)

    def place(self, x: np.ndarray) -> np.ndarray:
        """The leaf on whose sides of all splits each row of ``x`` is."""
        node = np.zeros(len(x), dtype=np.int64)
        while (inner := np.flatnonzero(self.children[node, 0] >= 0)).size:
            right = (x[inner] * self.directions[node[inner]]).sum(1) >= self.thresholds[node[inner]]
            node[inner] = self.children[node[inner], right.astype(np.int64)]
        return node


def upper_bounds(q: np.ndarray, centers: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """At least the inner product of each row of ``q`` with anything in each ball, beyond errors of rounding."""
    q = q.astype(np.float64)
    norm = np.linalg.norm(q, axis=1)[:, None]
    return q @ centers.T + norm * radii + 1e-9 * norm * (np.linalg.norm(centers, axis=1) + radii) + 1e-6


def _within(rank_by: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): rows by group and then ``rank_by``, and the place of each in its group, in that order."""
    order = np.lexsort((rank_by, group))
    g = group[order]
    start = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    return order, np.arange(len(g)) - np.repeat(start, np.diff(np.r_[start, len(g)]))


def best_first(tree: BallTree, x: np.ndarray, first: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of the ``k`` best rows of ``x`` for each of ``q`` that score ``floor`` or more, ties to the smaller ``first``.

    Each query opens its nodes with the largest upper bound first: one at a time until it has seen a leaf, then twice as many each time;
    nodes below its k-th score are dropped. The queries go on together, so a leaf is multiplied with all that open it.
    """
    kth = floor.copy()
    found = [np.zeros(0, np.int64)] * 3
    at, node = np.arange(len(q)), np.zeros(len(q), np.int64)
    bound = upper_bounds(q, tree.centers[:1], tree.radii[:1])[:, 0]
    width = np.ones(len(q), np.int64)
    while True:
        limit = kth[at].astype(np.float64)
        alive = bound >= limit - 1e-9 * np.abs(limit)
        at, node, bound = at[alive], node[alive], bound[alive]
        if not len(at):
            return found[0], found[1], found[2]
        order, rank = _within(-bound, at)
        now = rank < width[at[order]]
        opened, kept = order[now], order[~now]
        is_leaf = tree.children[node[opened], 0] < 0
        leaves, inner = opened[is_leaf], opened[~is_leaf]
        hits = [found]
        by_leaf = leaves[np.argsort(node[leaves], kind="stable")]
        for group in np.split(by_leaf, np.flatnonzero(np.diff(node[by_leaf])) + 1):
            if len(group):
                lo, hi = tree.spans[node[group[0]]]
                scores = products(q[at[group]], x[lo:hi])
                a, b = np.nonzero(scores >= kth[at[group]][:, None])
                hits.append([at[group][a], b + lo, scores[a, b]])
        if len(hits) > 1:
            query, row, score = (np.concatenate(c) for c in zip(*hits, strict=True))
            order = np.lexsort((first[row], -score, query))
            query, row, score = query[order], row[order], score[order]
            _, rank = _within(np.arange(len(query)), query)
            best = rank < k
            found = [query[best], row[best], score[best]]
            full = rank == k - 1
            kth[query[full]] = np.maximum(kth[query[full]], score[full])
            width[np.unique(at[leaves])] *= 2
        more = tree.children[node[inner]].ravel()
        owner = np.repeat(at[inner], 2)
        further = np.zeros(len(more))
        for low in range(0, len(more), 100_000):  # pairs of queries and nodes, a part at a time
            some, n = slice(low, low + 100_000), more[low : low + 100_000]
            y = q[owner[some]].astype(np.float64)
            norm = np.linalg.norm(y, axis=1)
            further[some] = (y * tree.centers[n]).sum(1) + norm * tree.radii[n] + 1e-9 * norm * (np.linalg.norm(tree.centers[n], axis=1) + tree.radii[n]) + 1e-6
        at, node, bound = np.r_[at[kept], owner], np.r_[node[kept], more], np.r_[bound[kept], further]


class Shards:
    """Trees of the sample for each dimension of vectors; their leaves are the shards, numbered over all dimensions."""

    def __init__(self, sample: dict[int, np.ndarray], leaf: int):
        self.trees, self.numbers, self.centers = {}, {}, {}
        n = 0
        for size, x in sorted(sample.items()):
            tree = BallTree(x, leaf)
            leaves = tree.leaves()
            self.trees[size], self.numbers[size], self.centers[size] = tree, np.zeros(len(tree.radii), np.int64), tree.centers[leaves]
            self.numbers[size][leaves] = n + np.arange(len(leaves))
            n += len(leaves)

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shard, distance from its center); vectors of a dimension that the sample lacks are a shard of their own, -1 - size."""
        y, tree = x.astype(np.float64), self.trees.get(x.shape[1])
        if tree is None:
            return np.full(len(x), -1 - x.shape[1]), np.linalg.norm(y, axis=1)
        leaf = tree.place(y)
        return self.numbers[x.shape[1]][leaf], np.linalg.norm(y - tree.centers[leaf], axis=1)


def _by_size(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, vectors) of each dimension in a column of vectors."""
    sizes = np.asarray(column.value_lengths())
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, rows_of(column.take(pa.array(rows)))


def _placed(shards):
    """Batches of classes (key, first, ids, v) with shard and distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, far = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for rows, x in _by_size(batch.column(3)) if batch.num_rows else ():
                shard[rows], far[rows] = shards.value.place(x)
            yield pa.record_batch([*batch.columns, pa.array(shard), pa.array(far)], [*batch.schema.names, "shard", "far"])

    return run


def _visits(balls, low: int, high: int):
    """Batches of queries (query, v, kth) to (shard, query, kth): their shards ``low``..``high`` by upper bound, unless below the k-th score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, kth = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for rows, x in _by_size(batch.column(1)) if batch.num_rows else ():
                numbers, centers, radii = balls.value.get(x.shape[1], (None, None, None))
                if numbers is None:
                    continue
                bound = upper_bounds(x, centers, radii)
                best = np.argsort(-bound, axis=1, kind="stable")[:, low:high]
                limit = kth[rows].astype(np.float64)
                a, b = np.nonzero(np.take_along_axis(bound, best, axis=1) >= (limit - 1e-9 * np.abs(limit))[:, None])
                yield pa.record_batch([pa.array(numbers[best[a, b]]), pa.array(ids[rows][a]), pa.array(kth[rows][a])], ["shard", "query", "kth"])

    return run


def _searched(k: int):
    """Group function of a part of a shard (first, ids, v) and of its queries (query, kth, v): (query, score, first, ids) of each query's best."""

    def run(own: pa.Table, asking: pa.Table) -> pa.Table:
        empty = pa.table({"query": pa.array([], pa.int64()), "score": pa.array([], pa.int64()), "first": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.int64()))})
        if not own.num_rows or not asking.num_rows:
            return empty
        x, first, tables = rows_of(own.column("v")), own.column("first").to_numpy(), [empty]
        tree = BallTree(x)
        x, first, ids = x[tree.order], first[tree.order], own.column("ids").combine_chunks().take(pa.array(tree.order))
        for low in range(0, asking.num_rows, 1_000):
            some = asking.slice(low, 1_000)
            query, row, score = best_first(tree, x, first, rows_of(some.column("v")), some.column("kth").to_numpy(), k)
            tables.append(pa.table({"query": pa.array(some.column("query").to_numpy()[query]), "score": pa.array(score), "first": pa.array(first[row]), "ids": ids.take(pa.array(row))}))
        return pa.concat_tables(tables)

    return run


def _best(found: DataFrame, by: str, k: int, *order: str) -> DataFrame:
    """The ``k`` first rows of each ``by``; Spark takes the k first of each task before it shuffles."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(F.col("score").desc(), *order))
    return found.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def top_k(vectors: DataFrame, asking: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id and score: for each row of ``vectors`` (vec_id, embedding) that is ``asking``, its ``k`` best among all others.

    A component x counts as floor(256 * x); the score is the inner product, exact; of equal scores the smaller vec_id is better. Fewer
    than ``k`` others are all returned. Equal vectors are searched and found once, with their k + 1 smallest ids, so any number of copies
    is one row. A search has a round for the best shard of each query, one for the next 3, the next 12 and so on; each is a table.

    Vectors that are null or hold null or non-finite components, and rows with a null id, take no part. Vectors of another dimension are
    no candidates. Repeated rows count once; different vectors with one id are never candidates of each other. Scores too large for a
    long are an error. No rows give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select("vec_id", floored(F.col("embedding")).alias("v"), F.coalesce(asking, F.lit(False)).alias("asks")).where("v is not null and vec_id is not null")
    order = Window.partitionBy("v").orderBy("vec_id")
    # Of repeated rows all have one rank, so k + 1 ids are left of those ranks.
    ranked = rows.withColumn("n", F.dense_rank().over(order)).where(F.col("n") <= k + 1)
    classes = ranked.groupBy("v").agg(F.min("vec_id").alias("first"), F.array_sort(F.collect_set("vec_id")).alias("ids"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("key"), "first", "ids", "v"), "classes")
    asked = written(rows.where("asks").select("vec_id", "v").distinct().join(classes.select("key", "v"), "v").select(F.col("vec_id").alias("query_id"), F.col("key").alias("query")), "asked")
    queries = written(classes.join(asked.select(F.col("query").alias("key")).distinct(), "key", "left_semi").select(F.col("key").alias("query"), "v"), "queries")
    n = classes.count()
    share = min(1.0, SAMPLE / max(1, n))
    sample = classes.where(F.pmod(F.xxhash64("key"), F.lit(1_000_000)) < int(share * 1_000_000) + 1).select("v").toArrow().column("v").combine_chunks()
    sizes = {x.shape[1]: x for _, x in _by_size(sample)} if len(sample) else {}
    shards = spark.sparkContext.broadcast(Shards(sizes, max(4, int(SHARD * share))))
    placed = written(classes.mapInArrow(_placed(shards), "key long, first long, ids array<long>, v array<long>, shard long, far double"), "placed")
    forget(classes)
    measures = placed.groupBy("shard").agg(F.max("far").alias("radius"), F.min(F.size("v")).alias("size"), F.ceil(F.count("*") / PART).alias("parts"))
    measures = sorted(measures.collect())  # a row for each shard: SAMPLE / 4 at most, and one for each dimension not in the sample
    balls: dict[int, list[tuple]] = {}
    for number, radius, size, _ in measures:
        center = shards.value.centers[size][number - shards.value.numbers[size][shards.value.trees[size].leaves()][0]] if number >= 0 else np.zeros(size)
        balls.setdefault(size, []).append((number, center, radius))
    packed = spark.sparkContext.broadcast({size: (np.array([b[0] for b in own]), np.array([b[1] for b in own]).reshape(len(own), size), np.array([b[2] for b in own])) for size, own in balls.items()})
    parts = F.broadcast(spark.createDataFrame([(m[0], m[3]) for m in measures], "shard long, parts long"))
    own = placed.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")))
    best = spark.createDataFrame([], "query long, score long, first long, ids array<long>")
    low, high, most = 0, 1, max((len(b) for b in balls.values()), default=0)
    while low < most:
        kth = best.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("s")).where(F.col("n") > k).select("query", "s")
        state = queries.join(kth, "query", "left").select("query", "v", F.coalesce("s", F.lit(int(NONE))).alias("kth"))
        visits = written(state.mapInArrow(_visits(packed, low, high), "shard long, query long, kth long"), "visits")
        chunks = visits.groupBy("shard").agg(F.ceil(F.count("*") / PART).alias("chunks"))
        deal = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        here = own.join(F.broadcast(chunks), "shard").select("shard", "part", deal("chunks").alias("chunk"), "first", "ids", "v")
        there = visits.join(F.broadcast(chunks), "shard").join(parts, "shard").withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("chunks")))
        there = there.join(queries, "query").select("shard", deal("parts").alias("part"), "chunk", "query", "kth", "v")
        keys = ("shard", "part", "chunk")
        found = here.groupBy(*keys).cogroup(there.groupBy(*keys)).applyInArrow(_searched(k + 1), "query long, score long, first long, ids array<long>")
        last, best = best, written(_best(best.union(found), "query", k + 1, "first"), "best")
        forget(visits)
        if low:
            forget(last)
        low, high = high, 4 * high
    each = _best(best.select("query", "score", F.explode("ids").alias("vec_id")), "query", k + 1, "vec_id")
    answers = each.groupBy("query").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "vec_id"))).alias("found"))
    others = F.slice(F.filter("found", lambda f: f.vec_id != F.col("query_id")), 1, k)
    out = asked.join(answers, "query").select("query_id", F.posexplode(others).alias("at", "f"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("f.vec_id").alias("vec_id"), (-F.col("f.low")).alias("score"))
