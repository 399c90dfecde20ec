"""Substring dedup: suffix trees over the corpus, one for each shared prefix, expanded only where documents share it.

1. Prefixes. Of each window of WINDOW words the least hash of its PREFIX-word runs is the window's prefix, so equal windows have
   equal prefixes, and neighbouring windows mostly share one. Prefixes in one document only are leaves; they end here.
2. Variable-length runs. The windows of one prefix that follow each other make one run of WINDOW and more words. Equal runs are
   folded to their least document; every other document of the run is covered there, whatever their number. (Runs are equal if three
   64-bit hashes are.)
3. Subtrees. The different runs of a prefix, each of its least document, make a group; groups of up to GROUP runs go to tasks with
   their words. A task sorts all suffixes of its groups by doubling the sorted length; nodes of depth WINDOW with several documents
   are the repeats, and every document but the least is covered there. Words themselves are compared here.
4. A group of more runs, as at the ends of a very common passage, is split by longer prefixes: the whole windows. These are
   compared by MD5, and Spark folds the equal ones by partial sums.

Covered windows that touch or overlap are merged to maximal repeats in each document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modstream.llm.arrays import Texts, give_back, mix, pieces, sliding_min, span_hashes, window_hashes
from modstream.llm.common import forget, small_side, written

WINDOW, PREFIX = 50, 16
#: Runs of one prefix that are put into one subtree, and runs of different prefixes that a task works on at once.
GROUP, BATCH = 2_000, 10_000
#: So many documents' lists are broadcast to pick the texts that need more work; beyond that all texts are joined by shuffle.
BROADCAST_IDS = 1_000_000

RUN = "prefix long, span long, span2 long, doc_id long, digest long, start int, n int"


class Runs:
    """The windows of a batch of texts, in runs of one prefix: run i has the windows from ``starts[i]`` to ``ends[i]``, exclusive."""

    def __init__(self, texts: Texts, window: int, prefix: int):
        hashes, owner = texts.hashes(), texts.owner()
        n = len(hashes) - window + 1
        if n <= 0:
            self.prefix = self.span = self.span2 = np.zeros(0, np.uint64)
            self.starts = self.ends = self.owner = np.zeros(0, np.int64)
            return
        least = sliding_min(window_hashes(hashes, prefix), window - prefix + 1)
        inside = owner[:n] == owner[window - 1 :]
        first = inside.copy()
        first[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (owner[1:n] != owner[: n - 1])
        last = inside.copy()
        last[:-1] &= ~inside[1:] | first[1:]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.owner, self.prefix = owner[self.starts], least[self.starts]
        self.span, self.span2 = (span_hashes(h, self.starts, self.ends + window - 1) for h in (hashes, mix(hashes + np.uint64(1))))


def _runs(docs: DataFrame, window: int, prefix: int) -> DataFrame:
    """The runs of all documents; start is the run's first word, n its number of windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = Texts(batch.column(2))
            runs = Runs(texts, window, prefix)
            ids, digests = (batch.column(i).take(pa.array(runs.owner)) for i in (0, 1))
            hashes = [pa.array(h.view(np.int64)) for h in (runs.prefix, runs.span, runs.span2)]
            places = [pa.array(x.astype(np.int32)) for x in (runs.starts - texts.first[runs.owner], runs.ends - runs.starts)]
            yield pa.record_batch([*hashes, ids, digests, *places], ["prefix", "span", "span2", "doc_id", "digest", "start", "n"])
        give_back()

    return docs.where("doc_id is not null").select("doc_id", "digest", "text").mapInArrow(run, RUN)


def _passages(docs: DataFrame, window: int) -> DataFrame:
    """(prefix, large, doc_id, digest, start, words): the words of the runs listed in ``docs`` (doc_id, digest, text, runs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found: dict[str, list] = {c: [] for c in ("prefix", "large", "doc_id", "digest", "start", "words")}
            for doc_id, digest, text, runs in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = text.encode().split()
                for r in runs:
                    values = (r["prefix"], r["large"], doc_id, digest, r["start"], b" ".join(words[r["start"] : r["start"] + r["n"] + window - 1]))
                    for c, v in zip(found, values, strict=True):
                        found[c].append(v)
            kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.string())
            yield pa.record_batch([pa.array(v, t) for v, t in zip(found.values(), kinds, strict=True)], list(found))

    return docs.select("doc_id", "digest", "text", "runs").mapInArrow(run, "prefix long, large boolean, doc_id long, digest long, start int, words string")


def suffix_ranks(words: np.ndarray, depth: int) -> np.ndarray:
    """Equal numbers for equal ``depth`` words from a place on, for all places that have so many: ``words`` are numbers.

    The length by which suffixes are sorted is doubled until two overlapping parts make ``depth``: a number is a node of the suffix
    tree at that depth.
    """
    rank, size = words.astype(np.int64), 1
    step = lambda rank, by: np.unique(rank[: len(rank) - by] * (rank.max() + 1) + rank[by:], return_inverse=True)[1].astype(np.int64)
    while 2 * size <= depth:
        rank, size = step(rank, size), 2 * size
    return step(rank, depth - size) if size < depth else rank


def _covered_in(batch: pa.Table, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, end) of the passages of ``batch`` that also stand in a smaller document of it."""
    lists = pc.split_pattern(batch.column("words").combine_chunks(), " ")
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = pc.dictionary_encode(lists.flatten()).indices.to_numpy().astype(np.int64)
    offsets -= offsets[0]
    node = suffix_ranks(words, window)
    sizes = np.diff(offsets) - window + 1
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    node, doc = node[offsets[row] + at], batch.column("doc_id").to_numpy()[row]
    order = np.lexsort((doc, node))
    new = np.concatenate([[True], node[order][1:] != node[order][:-1]])
    least = doc[order][np.flatnonzero(new)[np.cumsum(new) - 1]]
    hit = np.sort(order[doc[order] > least])
    if not len(hit):
        return hit, hit, hit
    # Windows of a row that follow each other or overlap are one passage.
    fresh = np.concatenate([[True], (row[hit][1:] != row[hit][:-1]) | (at[hit][1:] > at[hit][:-1] + window)])
    low, high = np.flatnonzero(fresh), np.append(np.flatnonzero(fresh)[1:], len(hit)) - 1
    return row[hit[low]], at[hit[low]], at[hit[high]] + window


def _subtrees(passages: DataFrame, window: int, most: int) -> DataFrame:
    """(doc_id, digest, low, high): what is covered in the groups of ``passages``; rows of a prefix are worked on together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def covered(table: pa.Table) -> pa.RecordBatch:
            row, low, high = _covered_in(table, window)
            start = table.column("start").to_numpy()[row]
            ids = [table.column(c).combine_chunks().take(pa.array(row)) for c in ("doc_id", "digest")]
            return pa.record_batch([*ids, pa.array((start + low).astype(np.int32)), pa.array((start + high).astype(np.int32))], ["doc_id", "digest", "low", "high"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            if sum(map(len, held)) >= most:
                table = pa.concat_tables(held).combine_chunks()
                prefix = table.column("prefix").to_numpy()
                cut = int(np.searchsorted(prefix, prefix[-1]))  # the last prefix may go on
                if cut:
                    yield covered(table.slice(0, cut))
                held = [table.slice(cut)]
        table = pa.concat_tables(held).combine_chunks() if held else None
        if table is not None and len(table):
            yield covered(table)
        give_back()

    rows = passages.select("prefix", "doc_id", "digest", "start", "words").repartition("prefix").sortWithinPartitions("prefix")
    return rows.mapInArrow(run, "doc_id long, digest long, low int, high int")


def _whole_windows(passages: DataFrame, window: int) -> DataFrame:
    """(doc_id, digest, low, high): the covered windows of ``passages``, each compared with all others by its words' MD5."""
    words = passages.select("doc_id", "digest", "start", F.split("words", " ").alias("w"))
    windows = F.transform(F.sequence(F.lit(0), F.size("w") - window), lambda i: F.struct((F.col("start") + i).alias("low"), F.unhex(F.md5(F.array_join(F.slice("w", i + 1, F.lit(window)), " "))).alias("key")))
    windows = written(words.select("doc_id", "digest", F.explode(windows).alias("x")).select("doc_id", "digest", "x.low", "x.key"), "windows")
    least = windows.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least != most").select("key", "least")
    return windows.join(least, "key").where("doc_id > least").select("doc_id", "digest", "low", (F.col("low") + window).alias("high"))


def _with_lists(docs: DataFrame, lists: DataFrame, how: str) -> DataFrame:
    """``docs`` (doc_id, digest, text) joined to ``lists``, a written table; while its ids can be broadcast only the texts that have a list are moved."""
    keys = ["doc_id", "digest"]
    ids = lists.select(F.col("doc_id").alias("i"), F.col("digest").alias("g"))
    few = small_side(ids, BROADCAST_IDS)
    if few is ids:
        return docs.join(lists, keys, how)
    listed = (docs.doc_id == F.col("i")) & (docs.digest == F.col("g"))
    some = docs.join(few, listed, "left_semi").join(lists.hint("merge"), keys, how)
    if how == "inner":
        return some
    none = docs.join(few, listed, "left_anti")
    return some.unionByName(none, allowMissingColumns=True)


def covered_lists(docs: DataFrame, window: int, prefix: int, group: int = GROUP) -> DataFrame:
    """(doc_id, digest, gone): the passages of each document of ``docs`` (doc_id, digest, text) whose windows also start in one with a smaller id."""
    runs = written(_runs(docs, window, prefix), "runs")
    shared = runs.groupBy("prefix").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least != most")
    shared = written(shared.select("prefix"), "prefixes")
    mine = written(runs.join(small_side(shared, BROADCAST_IDS), "prefix"), "shared")
    forget(runs)
    node = ["prefix", "span", "span2"]
    first = F.min(F.struct("doc_id", "digest", "start", "n")).alias("first")
    nodes = written(mine.groupBy(*node).agg(first), "nodes")
    sizes = nodes.groupBy("prefix").agg(F.count("*").alias("size"), F.min("first.doc_id").alias("low"), F.max("first.doc_id").alias("high")).where("low != high")
    groups = written(sizes.select("prefix", (F.col("size") > group).alias("large")), "groups")
    opened = nodes.join(small_side(groups, BROADCAST_IDS), "prefix").select("first.doc_id", "first.digest", F.struct("prefix", "large", "first.start", "first.n").alias("run"))
    opened = written(opened.groupBy("doc_id", "digest").agg(F.collect_list("run").alias("runs")), "open")
    texts = _with_lists(docs, opened, "inner")
    if not mine.groupBy("doc_id", "digest", "start").count().where("count > 1").isEmpty():  # repeated rows
        texts = texts.dropDuplicates(["doc_id", "digest"])
    passages = written(_passages(texts, window), "passages")
    found = _subtrees(passages.where("not large"), window, BATCH).union(_whole_windows(passages.where("large"), window))
    others = mine.join(nodes, node).where(F.col("doc_id") > F.col("first.doc_id"))
    found = found.union(others.select("doc_id", "digest", F.col("start").alias("low"), (F.col("start") + F.col("n") + (window - 1)).alias("high")))
    out = written(found.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("low", "high")).alias("gone")), "covered")
    for table in (shared, mine, nodes, groups, opened, passages):
        forget(table)
    return out


def _kept(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The result of a piece of (doc_id, text, gone)."""
    counts, removed, digests, left = [], [], [], []
    for text, gone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
        words = (text or "").encode().split()
        counts.append(len(words))
        if gone:
            kept, at = [], 0
            for low, high in sorted((g["low"], g["high"]) for g in gone):
                kept += words[at:low]
                at = max(at, high)
            words = kept + words[at:]
        removed.append(counts[-1] - len(words))
        joined = b" ".join(words)
        digests.append(hashlib.sha256(joined).hexdigest())
        left.append(joined.decode())
    columns = [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(left, pa.string())]
    return pa.record_batch([batch.column(0), *columns], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def remove_repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, group: int = GROUP) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept_text of every row of ``docs`` (doc_id long, text).

    A word is removed if one of the windows of ``window`` words over it also starts in a document with a smaller id; windows are
    those of the input. kept_text are the words left, joined by one blank.

    Null texts have no words. A row with a null id neither loses words nor counts as another document. Rows of one id are one
    document for the comparison and come out each. Texts of under ``window`` words keep all; no rows give no rows; other columns
    are not read. Memory is that of a piece of 1 MB of text, of one longer text, or of BATCH runs.
    """
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    lists = covered_lists(rows, window, prefix, group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            yield _kept(batch)

    joined = _with_lists(rows, lists, "left").select("doc_id", "text", "gone")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
