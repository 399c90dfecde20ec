"""Mixing sources to target weights: Efraimidis-Spirakis sampling to token budgets, DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modstream.llm.common import WORD, n_words, small_side, whole, written

#: A source's documents are cut into so many ranges of keys when its last budgeted word is looked for.
RANGES = 64
#: Rows of a source that one task may sort.
SORT_ROWS = 20_000
#: Up to so many sources are broadcast; beyond that Spark joins by shuffle.
BROADCAST_SOURCES = 50_000


def quality_weight(text: Column, size: Column) -> Column:
    """Weight of a document: 1 where its words have 3 to 12 characters on average, with the blank after each, else 0.25."""
    mean = F.length(whole(text)) / F.greatest(size, F.lit(1))
    return F.when(mean.between(3, 12), 1.0).otherwise(0.25)


def uniform(doc_id: Column, seed: str) -> Column:
    """The same number in (0, 1) for a document on every run: 52 bits of its id's MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, source_size) -> also target: shares of ``share`` times all words by weight, at most ``most`` times a source's size.

    Sources by code point, nulls last, take the weights in turn. What a full source leaves is shared by weight again among
    the others until none is above its limit: with sources in order of limit per weight, the full ones come first, and one
    level of words per weight holds for the rest. One row per source; a source without words gets 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(int(w)) for w in weights)), turn.cast("int") + 1)
    limited = sizes.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = (total * F.lit(float(share)) - before) / rest
    full = limited.select("*", level.alias("level")).withColumn("full", F.col("level") * F.col("weight") >= F.col("most"))
    # The level of the first source that isn't full holds for all that follow.
    first = F.first(F.when(~F.col("full"), F.col("level")), ignorenulls=True).over(
        Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    target = F.least(F.col("most"), F.coalesce(first * F.col("weight"), F.col("most")))
    return full.select("source", "source_size", "weight", target.alias("target"))


def _thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Keys up to which each source is taken: (source, low, high, before), rows below low are in, rows from high on are out.

    Each round cuts the rows still in question into ranges of keys, sums their words and keeps the range in which the
    budget ends, so that one task never sorts more than about SORT_ROWS rows of a source, however large the source is.
    """
    bounds = targets.select(
        "source", "part", F.lit(0.0).alias("low"), F.lit(float("inf")).alias("high"), F.lit(0).cast("long").alias("before")
    )
    last = None
    while True:
        bounds = written(bounds, "bounds")
        side = small_side(bounds.withColumnRenamed("source", "s"), BROADCAST_SOURCES)
        open_rows = rows.join(side, rows.source.eqNullSafe(F.col("s"))).where("key >= low and key < high and part > 0").drop("s")
        most = open_rows.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        if most <= SORT_ROWS or most == last:
            return bounds
        last = most
        cuts = open_rows.groupBy("source").agg(
            F.percentile_approx("key", [i / RANGES for i in range(1, RANGES)], 10_000).alias("cuts")
        )
        cuts = small_side(written(cuts.select(F.col("source").alias("s"), F.array_distinct("cuts").alias("cuts")), "cuts"), BROADCAST_SOURCES)
        at = F.size(F.filter("cuts", lambda c: c <= F.col("key")))
        ranges = (
            open_rows.join(cuts, open_rows.source.eqNullSafe(F.col("s"))).drop("s")
            .groupBy("source", at.alias("at"))
            .agg(*(F.first(c).alias(c) for c in ("part", "low", "high", "before")), F.sum("size").alias("words"), F.min("key").alias("from"))
        )
        order = Window.partitionBy("source").orderBy("at")
        start = F.col("before") + F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ranges = ranges.withColumn("start", start).withColumn("to", F.coalesce(F.lead("from").over(order), F.col("high")))
        cut = ranges.where("start < part and part <= start + words").select(
            F.col("source").alias("s"), F.col("from").alias("low2"), F.col("to").alias("high2"), F.col("start").alias("before2")
        )
        new = bounds.join(cut, bounds.source.eqNullSafe(F.col("s")), "left").select(
            "source", "part", F.coalesce("low2", "low").alias("low"), F.coalesce("high2", "high").alias("high"),
            F.coalesce("before2", "before").alias("before"),
        )
        bounds = new


def _keyed(docs: DataFrame, seed: str, quality: Column | None, *more: Column) -> DataFrame:
    text = F.col("text")
    size = n_words(text)
    weight = quality if quality is not None else quality_weight(text, F.col("size"))
    with_size = docs.select("doc_id", "source", "text", size.alias("size"), *more)
    names = [c for c in with_size.columns if c != "text"]
    return with_size.select(*names, (-F.ln(uniform(F.col("doc_id"), seed)) / weight).alias("key"))


def _plan(rows: DataFrame, weights: Sequence[int], share: float, most: float) -> DataFrame:
    """One row per source: its target, whole epochs, and the range of keys in which the words left end."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, share, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    part = F.floor(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    targets = written(targets.withColumn("epochs", epochs).withColumn("part", part), "targets")
    bounds = _thresholds(rows, targets).select(F.col("source").alias("s"), "low", "high", "before")
    return written(targets.join(bounds, targets.source.eqNullSafe(F.col("s"))).drop("source", "weight"), "plan")


def _take(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``plan`` and with extra, the words taken beside whole epochs. Only rows in the last range are sorted."""
    plan = small_side(plan, BROADCAST_SOURCES)
    planned = rows.join(plan, rows.source.eqNullSafe(F.col("s"))).drop("s")
    inside = (F.col("part") > 0) & (F.col("key") >= F.col("low")) & (F.col("key") < F.col("high"))
    sure = planned.where(~inside).withColumn(
        "extra", F.when((F.col("part") > 0) & (F.col("key") < F.col("low")), F.col("size")).otherwise(F.lit(0).cast("long"))
    )
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("part") - F.col("before") - F.coalesce(F.sum("size").over(order), F.lit(0))
    last = planned.where(inside).withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("long"))
    return sure.unionByName(last)


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix",
    quality: Column | None = None,
) -> DataFrame:
    """How many words the mix takes of each document.

    Returns doc_id, source, size, source_size, target, epochs, taken and key. A source's target gives whole epochs first:
    ``epochs`` times every document. The words left are filled in order of the Efraimidis-Spirakis key -ln(u)/weight (u from
    the id, weight from the document's quality); the document in which the budget ends gives just its first words, so that the
    source's sum is its target but for rounding down.

    Null texts and texts without words have size 0 and are taken as 0 words; a null source is a source of its own, last in
    order; a null doc_id draws like any other id. Repeated rows draw the same key and count each. No rows: no rows. Other
    columns are not read.
    """
    rows = written(_keyed(docs, seed, quality), "sizes")
    taken = F.col("epochs") * F.col("size") + F.col("extra")
    return _take(rows, _plan(rows, weights, share, most)).select(
        "doc_id", "source", "size", "source_size", "target", "epochs", taken.cast("long").alias("taken"), "key"
    )


def mixed_documents(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix",
    quality: Column | None = None,
) -> DataFrame:
    """The documents that the mix of ``mix_sources`` takes, in the columns of ``docs``: one row for each time one is taken.

    The document in which a source's budget ends comes with its first words only, joined by blanks, and n_chars (if there is
    such a column) to match. Texts are read twice and moved only for the few documents in a source's last range of keys.
    """
    plan = _plan(written(_keyed(docs, seed, quality), "sizes"), weights, share, most)
    rows = _take(_keyed(docs, seed, quality, F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")), plan)
    times = F.col("epochs").cast("int") + F.when(F.col("extra") > 0, 1).otherwise(0)
    copies = rows.where((F.col("size") > 0) & (times > 0)).select(
        "doc", "size", "extra", "epochs", F.explode(F.sequence(F.lit(1), times)).alias("copy")
    )
    text = F.col("doc.text")
    head = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("extra").cast("int")), " ")
    cut = (F.col("copy") > F.col("epochs")) & (F.col("extra") < F.col("size"))
    copies = copies.withColumn("text", F.when(cut, head).otherwise(text))
    values = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        values["n_chars"] = F.when(cut, F.length("text")).otherwise(F.col("doc.n_chars")).cast(docs.schema["n_chars"].dataType)
    return copies.select(*(values.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
