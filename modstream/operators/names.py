"""Names that resemble each other: all pairs above a similarity and no others, without comparing all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modstream.functions.text import jaro_winkler_pct
from modstream.sources.shared import forget, written

#: Letters of a gram. Below HALF percent pairs need not share a pair of letters, and grams are single letters.
GRAM, HALF = 2, 50
#: Kinds of grams that are broadcast with their counts at most.
GRAMS = 500_000


def _edits(longer: Column, least: float) -> Column:
    """Edits that a pair may have whose longer name has so many letters."""
    return F.floor(longer * (100 - least) / 100 + 1e-9).cast("int")


def _grams(names: DataFrame, size: int) -> DataFrame:
    """(name, low, n, gram): all runs of ``size`` letters, with marks before and after; of equal ones in a name each has its number."""
    mark = F.lit("\u0001" * (size - 1))
    padded = F.concat(mark, "low", mark)
    starts = F.sequence(F.lit(1), F.length("low") + (size - 1))
    at = names.select("name", "low", F.length("low").alias("n"), F.posexplode(F.transform(starts, lambda i: F.substring(padded, i, F.lit(size)))).alias("at", "letters"))
    number = F.row_number().over(Window.partitionBy("name", "letters").orderBy("at"))
    return at.select("name", "low", "n", F.struct("letters", number.alias("number")).alias("gram"))


def similar_pairs(names: DataFrame, least: float = 80.0) -> DataFrame:
    """(a, b, similarity) of all pairs a < b of different ``names`` (name) whose similarity is at least ``least`` percent.

    The similarity is the share of the longer name's letters that no edit touches, without case; names whose lengths differ by over 40 %
    of the longer are no pair. A pair with few edits shares most of its grams, so it shares one among the rarest of each name: those are
    the keys of the join, of which a name has as many as its edits can destroy and one more. Pairs whose lengths don't fit go before the
    rest is compared by the edit distance, which stops at its limit. Null and empty names are in no pair.
    """
    if not 0 < least <= 100:
        raise ValueError("least must be above 0, up to 100")
    size = GRAM if least >= HALF else 1
    distinct = names.select("name").where("name != ''").distinct().withColumn("low", F.lower("name"))
    grams = written(_grams(distinct, size), "grams")
    counts = written(grams.groupBy("gram").agg(F.count("*").alias("count")), "counts")
    counts = F.broadcast(counts) if counts.limit(GRAMS + 1).count() <= GRAMS else counts
    order = Window.partitionBy("name").orderBy("count", "gram")
    keys = grams.join(counts, "gram").withColumn("place", F.row_number().over(order))
    # A partner may be longer: least / 100 of it is at most as long as this name.
    longest = F.floor(F.col("n") * 100 / least + 1e-9)
    keys = written(keys.where(F.col("place") <= size * _edits(longest, least) + 1).select("gram", "n", "name", "low"), "keys")
    side = lambda c: keys.select("gram", *(F.col(x).alias(f"{c}_{x}") for x in ("n", "name", "low")))
    longer, shorter = F.greatest("a_n", "b_n"), F.least("a_n", "b_n")
    edits = _edits(longer, least)
    fits = (longer - shorter <= edits) & (longer - shorter <= longer * 0.4)
    pairs = side("a").join(side("b"), "gram").where((F.col("a_name") < F.col("b_name")) & fits).select("a_name", "b_name", "a_low", "b_low", longer.alias("longer"), edits.alias("edits")).distinct()
    distance = F.call_function("levenshtein", F.col("a_low"), F.col("b_low"), F.col("edits"))
    found = pairs.withColumn("distance", distance).where("distance >= 0")
    out = written(found.select(F.col("a_name").alias("a"), F.col("b_name").alias("b"), ((F.col("longer") - F.col("distance")) / F.col("longer") * 100).alias("similarity")), "similar")
    for table in (grams, keys):
        forget(table)
    return out


def winkler_pairs(names: DataFrame, least: float = 80.0) -> DataFrame:
    """``similar_pairs`` with jaro_winkler of each pair: Python sees the pairs that are left only."""
    return similar_pairs(names, least).withColumn("jaro_winkler", jaro_winkler_pct("a", "b"))
