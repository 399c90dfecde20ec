"""Shared helpers: tables in the shared folder, word counts, connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modstream.sources import shared
from modstream.sources.io import spread
from modstream.sources.shared import forget as forget

#: A word of most operators: a run of characters other than space and \\t..\\r.
WORD = "[^\\x20\\x09-\\x0D]+"
BLANKS = "[\\x20\\x09-\\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


#: Rows that Spark sends to Python at once, where the session has Spark's own setting: texts may be long.
ARROW_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ARROW_ROWS unless somebody set it: it bounds the memory of Python workers."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """``shared.written`` in a session whose batches are small."""
    small_batches(df.sparkSession)
    return shared.written(df, name, *by)


def whole(text: Column) -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(text, F.lit(""))


def n_words(text: Column) -> Column:
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, UPPER, LOWER)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """``df``, a written table, marked for broadcast if it has at most ``rows`` rows; beyond that Spark joins by shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Smallest id reachable from each id: ``edges`` (a long, b long) -> (id long, component_id long), ids with an edge only.

    Alternating large-star and small-star steps; each step is two shuffles of the remaining edges, the number of steps
    grows with the logarithm of the longest chain. Every step is a table in the shared folder, so a lost executor costs
    one step at most. Loops, repeated and reversed edges and null ends are allowed; an empty input gives an empty result.
    """
    now = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "edges"
    )
    mark = _mark(now)
    for _ in range(rounds):
        large = written(_large_star(now), "edges")
        forget(now)
        now = written(_small_star(large), "edges")
        forget(large)
        before, mark = mark, _mark(now)
        if mark == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(
        now.select("b", "b").distinct()
    )


def _mark(edges: DataFrame) -> tuple:
    """Equal for equal edge sets."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("b", "a") % 1_000_003), F.bit_xor(F.xxhash64("a", "b"))).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """(a > b) edges; every neighbour above a node is linked to the node's smallest neighbour or itself."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """(a > b) edges; a node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
