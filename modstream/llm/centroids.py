"""Centroid clustering by rounds of exact integer k-means with ns-bounds.

A row keeps its distances to all centroids as they were when it was last scanned, and the round of that scan. The centroids of all
rounds are kept too, so a bound is loosened by how far its centroid has got since then in a straight line, which is never more, and
mostly much less, than the sum of its steps. Rows whose bounds can't tell the nearest centroid any more are scanned again exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modstream.llm.common import forget, small_batches, written
from modstream.llm.integers import floored, rows_of, squares

STATE = "vec_id long, v array<long>, before int, cluster int, bounds array<float>, scanned int, upper double, measured int, rescanned boolean"
#: Distances are rounded down to single precision as lower bounds, up as upper ones.
DOWN, UP = 1 - 1e-6, 1 + 1e-12


def drift(history: Sequence[np.ndarray], since: int) -> np.ndarray:
    """How far each centroid is from where it was in round ``since``: the norm of its total displacement."""
    return np.linalg.norm((history[-1] - history[since]).astype(np.float64), axis=1) * UP


def settled(bounds: np.ndarray, scanned: np.ndarray, upper: np.ndarray, measured: np.ndarray, cluster: np.ndarray, history: Sequence[np.ndarray]) -> np.ndarray:
    """Which rows' bounds say that their centroid is nearer than any other, without a tie."""
    moved = np.stack([drift(history, t) for t in range(len(history))])
    rows = np.arange(len(cluster))
    lower = bounds.astype(np.float64) - moved[scanned]
    lower[rows, cluster] = np.inf
    return upper + moved[measured, cluster] < lower.min(axis=1)


def _assign(history: Sequence[np.ndarray]):
    """Batches of (vec_id, v), or of STATE after the round before, to those of STATE with the nearest of the last centroids."""
    now, c = len(history) - 1, history[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x = batch.num_rows, rows_of(batch.column(1))
            if not n:
                continue
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            rows = np.arange(n)
            if now:
                get = lambda name: column[name].to_numpy(zero_copy_only=False).copy()  # noqa: E731, B023
                before, scanned, upper, measured = get("cluster"), get("scanned"), get("upper"), get("measured")
                bounds = column["bounds"].flatten().to_numpy(zero_copy_only=False).reshape(n, len(c)).copy()
                open_rows = np.flatnonzero(~settled(bounds, scanned, upper, measured, before, history))
                # First the distance to the own centroid anew; where that isn't enough, all distances.
                own = np.sqrt(((x[open_rows] - c[before[open_rows]]).astype(np.float64) ** 2).sum(1)) * UP
                upper[open_rows], measured[open_rows] = own, now
                part = settled(bounds[open_rows], scanned[open_rows], own, measured[open_rows], before[open_rows], history)
                open_rows = open_rows[~part]
            else:
                before, scanned, upper, measured = np.full(n, -1, np.int32), np.zeros(n, np.int32), np.zeros(n), np.zeros(n, np.int32)
                bounds, open_rows = np.zeros((n, len(c)), np.float32), rows
            cluster = before.copy()
            if len(open_rows):
                d = squares(x[open_rows], c)
                nearest = d.argmin(axis=1)  # the first of equal ones
                root = np.sqrt(d.astype(np.float64))
                cluster[open_rows], bounds[open_rows] = nearest, root * DOWN
                upper[open_rows] = root[np.arange(len(d)), nearest] * UP
                scanned[open_rows] = measured[open_rows] = now
            again = np.zeros(n, bool)
            again[open_rows] = True
            kept = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * len(c), pa.int32()), pa.array(bounds.ravel(), pa.float32()))
            ints = lambda a: pa.array(a.astype(np.int32))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(before.astype(np.int32), mask=before < 0), ints(cluster), kept, ints(scanned), pa.array(upper), ints(measured), pa.array(again)],
                ["vec_id", "v", "before", "cluster", "bounds", "scanned", "upper", "measured", "rescanned"],
            )

    return run


def _measured(c: np.ndarray):
    """Batches of STATE to (vec_id, cluster, distance): squared, to the row's centroid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, cluster = rows_of(batch.column(1)), batch.column(2).to_numpy()
            if batch.num_rows:
                yield pa.record_batch([batch.column(0), batch.column(2), pa.array(((x - c[cluster]) ** 2).sum(1))], ["vec_id", "cluster", "distance"])

    return run


def _sums(state: DataFrame, size: int) -> dict[int, list[int]]:
    """What joins and leaves each cluster in a round, [rows, sums of components]: only rows that changed are read, a row for each cluster is returned."""
    changed = state.where("before is null or before != cluster")
    moves = changed.select("v", F.explode(F.array(F.struct(F.col("cluster").alias("k"), F.lit(1).alias("sign")), F.struct(F.col("before").alias("k"), F.lit(-1).alias("sign")))).alias("m"))
    moves = moves.where("m.k is not null").select("v", "m.k", "m.sign")
    sums = [F.sum(F.col("v")[i] * F.col("sign")).alias(f"s{i}") for i in range(size)]
    return {r[0]: list(r[1:]) for r in moves.groupBy("k").agg(F.sum("sign").cast("long").alias("n"), *sums).collect()}


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector of ``vectors`` (vec_id, embedding) that takes part.

    Those are vectors of exactly ``size`` components, none null or non-finite; a component x counts as floor(256 * x). Centroids start
    as the ``k`` vectors with the smallest SHA-256 of "seed:vec_id". In each round every vector goes to the nearest centroid, of equal
    ones the first, and each centroid becomes the floor of its vectors' mean; one without vectors stays. Then vectors go to the nearest
    once more. All sums are exact; numbers too large for that are an error.

    Fewer vectors than ``k`` make as many centroids. Rows with a null id take part but never start a centroid while others are there;
    repeated rows are further vectors. No vectors give no rows; other columns are not read. The driver gets k centroids and k sums a
    round, never rows. Each round is a table in the shared folder, rows are neither shuffled nor sorted.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    rows = vectors.select("vec_id", floored(F.col("embedding")).alias("v")).where(F.size("v") == size)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(digest.asc_nulls_last(), "v").limit(k).select("v").collect()
    if not first:
        return rows.select("vec_id", F.lit(0).alias("cluster"), *(F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")), F.lit("").alias("centroid_sha256"))
    history = [np.array([r.v for r in first], dtype=np.int64)]
    state, total = rows, {j: [0] * (size + 1) for j in range(len(first))}
    for now in range(rounds + 1):
        last, state = state, written(state.mapInArrow(_assign(history), STATE), "clusters")
        if now:
            forget(last)
        if now < rounds:
            for j, change in _sums(state, size).items():
                total[j] = [a + b for a, b in zip(total[j], change, strict=True)]
            means = [[s // total[j][0] for s in total[j][1:]] if total[j][0] else history[-1][j].tolist() for j in range(len(first))]
            history.append(np.array(means, dtype=np.int64))
    found = state.select("vec_id", "v", "cluster").mapInArrow(_measured(history[-1]), "vec_id long, cluster int, distance long")
    inertia = {r[0]: r[1] for r in found.groupBy("cluster").agg(F.sum("distance")).collect()}
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1].tolist()]
    named = spark.createDataFrame([(j, n, sum(inertia.values()), digests[j]) for j, n in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
