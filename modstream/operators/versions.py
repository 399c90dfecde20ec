"""Term lists that change while messages come in: each term holds for a time, and a message meets the terms of its own time.

A list is a table of (word, mode, valid_from, valid_to), times being instants, valid_to null for terms that hold still. Changes close and
open rows; nothing is overwritten, so a message that is looked at late, or again, gives what it gave.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modstream.functions.text import normalize_search
from modstream.operators.lexicon import BROADCAST_TERMS, filter_texts, match_terms
from modstream.operators.rules import RuleConfig

VERSIONS = "word string, mode string, valid_from timestamp, valid_to timestamp"


def first_version(lexicon: DataFrame, since: Column) -> DataFrame:
    """``lexicon`` (word, mode) as terms that hold from ``since`` on."""
    return lexicon.select("word", "mode", since.cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))


def changed(versions: DataFrame, changes: DataFrame) -> DataFrame:
    """``versions`` after ``changes`` (word, mode, at, added): a term comes with added true and goes with false, in its search form.

    Adding a term that holds, or taking away one that doesn't, changes nothing; of changes at one time taking away comes first. Changes
    may come in any order and more than once: each term's are put in order of time with those that made its rows, and its times made
    anew from them, so older changes may be added later.
    """
    old = versions.select("word", "mode", F.col("valid_from").alias("at"), F.lit(True).alias("added"))
    ends = versions.where("valid_to is not null").select("word", "mode", F.col("valid_to").alias("at"), F.lit(False).alias("added"))
    new = changes.select(normalize_search(F.col("word")).alias("word"), "mode", F.col("at").cast("timestamp").alias("at"), "added").where("word != '' and mode is not null and at is not null and added is not null")
    events = old.union(ends).union(new).distinct()
    order = Window.partitionBy("word", "mode").orderBy("at", "added")
    turns = events.withColumn("before", F.lag("added").over(order)).where("added != coalesce(before, false)")
    spans = turns.withColumn("valid_to", F.lead("at").over(order))
    return spans.where("added and (valid_to is null or valid_to > at)").select("word", "mode", F.col("at").alias("valid_from"), "valid_to")


def version_at(versions: DataFrame, at: Column) -> DataFrame:
    """(word, mode) of the terms that hold at one time."""
    return versions.where((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") > at))).select("word", "mode")


def _kept(spans) -> Callable:
    """Batches of rows with matches and _at to those with the matches that hold at _at; ``spans`` is a broadcast list of (word, mode, from, to) in microseconds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[tuple[str, str], list[tuple[int, int | None]]] = {}
        for word, mode, low, high in spans.value:
            by.setdefault((word, mode), []).append((low, high))
        for batch in batches:
            names = batch.schema.names
            at, found = batch.column(names.index("_at")).to_pylist(), batch.column(names.index("matches"))
            rows = [r and [m for m in r if t is not None and any(low <= t and (high is None or t < high) for low, high in by.get((m["word"], m["mode"]), ()))] for r, t in zip(found.to_pylist(), at, strict=True)]
            columns = [pa.array(rows, found.type) if n == "matches" else batch.column(i) for i, n in enumerate(names)]
            yield pa.record_batch([c for c, n in zip(columns, names, strict=True) if n != "_at"], [n for n in names if n != "_at"])

    return run


def match_terms_at(messages: DataFrame, versions: DataFrame, text: str = "text", key: str = "msg_id", ts: str = "ts") -> DataFrame:
    """``match_terms`` with the terms of each message's time ``ts``: none for one without a time.

    All terms that ever held are looked for at once; what they find is kept by their times, for rows with a find only. Times are
    broadcast for up to BROADCAST_TERMS rows of ``versions``, and joined by (word, mode) beyond.
    """
    found = match_terms(messages, versions.select("word", "mode").distinct(), text, key)
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    spans = versions.select("word", "mode", F.unix_micros("valid_from").alias("low"), F.unix_micros("valid_to").alias("high"))
    first = [tuple(r) for r in spans.limit(BROADCAST_TERMS + 1).collect()]
    if len(first) <= BROADCAST_TERMS:
        sent = messages.sparkSession.sparkContext.broadcast(first)
        return found.withColumn("_at", at).mapInArrow(_kept(sent), found.schema)
    held = found.select(key, at.alias("_at"), F.posexplode("matches").alias("_place", "_m")).join(spans, (F.col("_m.word") == F.col("word")) & (F.col("_m.mode") == F.col("mode")))
    held = held.where("_at >= low and (high is null or _at < high)").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_place", "_m"))).alias("_held"))
    kept = F.transform("_held", lambda h: h._m)
    return found.join(held, key, "left").withColumn("matches", F.coalesce(kept, F.slice("matches", 1, 0))).drop("_held")


def filter_texts_at(messages: DataFrame, versions: DataFrame, cfg: RuleConfig = RuleConfig(), **how) -> DataFrame:
    """``filter_texts`` with the terms of each message's time."""
    return filter_texts(messages, versions, cfg, match=match_terms_at, **how)


def versioned_sink(folder: str, read: Callable[[], DataFrame], cfg: RuleConfig = RuleConfig(), name: str = "filtered") -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: messages filtered with the terms of their time, once for each batch id.

    ``read`` gives the list anew for each micro-batch, so changes are seen without a restart; a batch that is repeated is written anew.
    """

    def write(messages: DataFrame, batch: int) -> None:
        filter_texts_at(messages, read(), cfg).write.mode("overwrite").parquet(f"{folder}/{name}/batch={batch}")

    return write
