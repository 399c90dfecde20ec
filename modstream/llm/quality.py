"""Quality rules: counts of words, symbols and repeats, and n-gram perplexity in language-specific bands."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modstream.llm.arrays import CharGrams, Texts, give_back, mix, pieces, strings_of, window_hashes
from modstream.llm.common import forget, small_side, written

#: Characters of the longest n-grams.
ORDER = 5
#: At most so many n-grams, the most frequent ones, are broadcast; the others are looked up by a join.
HOT_GRAMS = 2_000_000
#: A task hands on its counts when it holds so many n-grams.
HELD_GRAMS = 600_000
#: Bytes of text that a task works on at once (a longer text goes alone).
PIECE = 400_000
#: Shares of a language's plain documents that lie below and above its band.
BELOW, ABOVE = 0.002, 0.005
#: Losses are compared in so many steps a unit, so that no verdict hangs on the order in which a sum was made; RANGE steps are counted together first.
STEPS, RANGE = 1_000_000, 1_000
#: A language with fewer plain documents than this in either half has no band: its base decides.
LEAST_PLAIN = 10
#: A document is plain, so that models are counted and bands set by it, if it passes the base and has at most so many symbols, and
#: words in capitals, for each word.
PLAIN_SYMBOLS, PLAIN_CAPITALS = 0.1, 0.3

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_SMALL = np.zeros(256, dtype=bool)
_SMALL[0x61:0x7B] = True
_CAPITAL = np.zeros(256, dtype=bool)
_CAPITAL[0x41:0x5B] = True

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def n_dup_lines(text: str) -> int:
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            if line in seen:
                n += 1
            seen.add(line)
    return n


def repeated_words(texts: Texts, n: int = 5) -> np.ndarray:
    """Of each text, how many words stand in a window of ``n`` words that the text has twice or more."""
    owner = texts.owner()
    covered = np.zeros(len(owner) + 1, dtype=np.int64)
    windows = window_hashes(texts.hashes(), n)
    inside = np.flatnonzero(owner[: len(windows)] == owner[n - 1 :]) if len(windows) else np.zeros(0, int)
    keys = mix(windows[inside] + owner[inside].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    np.add.at(covered, inside[twice], 1)
    np.add.at(covered, inside[twice] + n, -1)
    marks = np.cumsum(covered)[:-1] > 0
    return np.bincount(owner, marks, texts.n).astype(np.int64)


def capital_words(texts: Texts) -> np.ndarray:
    """Of each text, how many words have two or more of A-Z and none of a-z."""
    sums = [np.concatenate([[0], np.cumsum(kind[texts.data], dtype=np.int64)]) for kind in (_CAPITAL, _SMALL)]
    capitals, small = (s[texts.ends] - s[texts.starts] for s in sums)
    return np.bincount(texts.owner(), (capitals >= 2) & (small == 0), texts.n).astype(np.int64)


class _Judged:
    """A piece of (doc_id, digest, model, text): n-grams, which texts fail the base, and which are plain."""

    def __init__(self, batch: pa.RecordBatch, order: int):
        self.texts = Texts(batch.column(3))
        self.models = batch.column(2).to_pylist()
        self.fold = np.asarray(batch.column(1)).astype(np.int64) & 1
        self.repeats = repeated_words(self.texts)
        self.symbols = self.texts.per_text(_SYMBOL[self.texts.data])
        n_words = self.texts.counts
        self.failed = (n_words < 10) | (100 * self.repeats > 20 * n_words)
        self.plain = ~self.failed & (self.symbols <= PLAIN_SYMBOLS * n_words) & (capital_words(self.texts) <= PLAIN_CAPITALS * n_words)
        salts = np.array([_salt(m) for m in self.models], dtype=np.uint64)
        self.grams = CharGrams([t or "" for t in batch.column(3).to_pylist()], salts, order)


@functools.lru_cache(maxsize=10_000)
def _salt(model: str) -> int:
    return xxhash.xxh64_intdigest(model.encode())


def _longs(*values: np.ndarray) -> list[pa.Array]:
    return [pa.array(np.asarray(v).astype(np.int64), pa.int64()) for v in values]


class _Counts:
    """N-grams with their counts, as arrays: key, model, code points, n, k0, k1."""

    def __init__(self, order: int):
        self.parts = [tuple(np.zeros((0, order) if i == 2 else 0, t) for i, t in enumerate((np.uint64, np.int32, np.uint32, np.int64, np.int64, np.int64)))]
        self.size = 0

    def add(self, keys: np.ndarray, model: np.ndarray, codes: np.ndarray, *counts: np.ndarray) -> None:
        self.parts.append((keys, model, codes, *(c.astype(np.int64) for c in counts)))
        self.size += len(keys)

    def merge(self) -> None:
        """Equal keys to one row."""
        columns = list(zip(*self.parts, strict=True))
        self.parts = []
        keys, first, inverse = np.unique(np.concatenate(columns[0]), return_index=True, return_inverse=True)
        picked = [np.concatenate(c)[first] for c in columns[1:3]]
        sums = [np.bincount(inverse, np.concatenate(c), len(keys)).astype(np.int64) for c in columns[3:]]
        self.parts, self.size = [(keys, *picked, *sums)], len(keys)

    def batches(self, names: list[str], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
        self.merge()
        keys, model, codes, *counts = self.parts[0]
        texts = pa.array(names, pa.string())
        for i in range(0, len(keys), rows):
            at = slice(i, i + rows)
            yield pa.record_batch(
                [texts.take(pa.array(model[at])), strings_of(codes[at]), *_longs(keys[at].view(np.int64), *(c[at] for c in counts))], ["model", "gram", "key", "n", "k0", "k1"]
            )


def count_grams(docs: DataFrame, order: int = ORDER, held: int = HELD_GRAMS) -> DataFrame:
    """(model, gram, key, n, k0, k1) over all texts of ``docs`` (doc_id, digest, model, text), summed by task, then by Spark.

    n counts an n-gram in all texts, k0 and k1 in the plain ones of either half. A text's half is the last bit of its digest, so
    copies of a text are in one half.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        counts = _Counts(order)
        for batch in pieces(batches, size=PIECE):
            found = _Judged(batch, order)
            keys, first, inverse = np.unique(found.grams.keys, return_index=True, return_inverse=True)
            owner = found.grams.owner
            halves = [np.bincount(inverse, (found.plain & (found.fold == f))[owner], len(keys)) for f in (0, 1)]
            model = np.array([names.setdefault(m, len(names)) for m in found.models], dtype=np.int32)
            counts.add(keys, model[owner[first]], found.grams.code_points(first), np.bincount(inverse, minlength=len(keys)), *halves)
            if counts.size > held:
                counts.merge()
                if counts.size > held * 3 // 4:
                    yield from counts.batches(list(names))
                    counts = _Counts(order)
        yield from counts.batches(list(names))
        del counts
        give_back()

    counted = docs.select("doc_id", "digest", "model", "text").mapInArrow(run, "model string, gram string, key long, n long, k0 long, k1 long")
    return written(counted.groupBy("model", "gram", "key").agg(*(F.sum(c).alias(c) for c in ("n", "k0", "k1"))), "grams")


def _discounts(f: int) -> list[Column]:
    """Discounts of modified Kneser-Ney for counts of 1, 2 and more of half ``f``, as aggregates."""
    n1, n2, n3, n4 = (F.sum(F.when(F.col(f"k{f}") == i, 1.0).otherwise(0.0)) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2)
    usual = (n1 > 0) & (n2 > 0)
    clipped = lambda d, most: F.when(usual, F.least(F.greatest(d, F.lit(0.05)), F.lit(most))).otherwise(0.5)
    last = F.when(n3 > 0, 3 - 4 * y * n4 / n3).otherwise(1.5)
    return [clipped(1 - 2 * y * n2 / n1, 0.95).alias(f"d{f}1"), clipped(2 - 3 * y * n3 / n2, 1.9).alias(f"d{f}2"), clipped(last, 2.9).alias(f"d{f}3")]


def gram_logs(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(key, n, log0, log1): log probabilities, as floats, of every n-gram of ``counts`` by the models of either half, modified Kneser-Ney.

    The longest n-grams have their counts; each shorter one counts the n-grams seen with another character in front. A level is
    grouped by contexts and joined to the level below by its last characters, so no task holds a model; the alphabet's share is
    the last resort.
    """
    levels = {order: counts}
    for size in range(order - 1, 0, -1):
        above = levels[size + 1].groupBy("model", F.substring("gram", 2, size).alias("gram"))
        levels[size] = written(above.agg(*(F.sum((F.col(f"k{f}") > 0).cast("long")).alias(f"k{f}") for f in (0, 1))), "grams")
    found = [levels[s].groupBy("model").agg(F.lit(s).alias("size"), (1.0 / (F.count("*") + 1)).alias("even"), *_discounts(0), *_discounts(1)) for s in levels]
    # A row for each model and size.
    discounts = small_side(written(functools.reduce(DataFrame.union, found), "discounts"), 200_000)
    below = None
    for size in range(1, order + 1):
        rows = levels[size].join(discounts.where(F.col("size") == size), "model")
        cut = {f: F.when(F.col(f"k{f}") == 0, 0.0).when(F.col(f"k{f}") == 1, F.col(f"d{f}1")).when(F.col(f"k{f}") == 2, F.col(f"d{f}2")).otherwise(F.col(f"d{f}3")) for f in (0, 1)}
        rows = rows.withColumns({f"cut{f}": cut[f] for f in cut} | {"context": F.substring("gram", 1, size - 1), "rest": F.substring("gram", 2, size - 1)})
        totals = rows.groupBy("model", "context").agg(
            *(F.sum(f"k{f}").alias(f"all{f}") for f in (0, 1)), *(F.sum(f"cut{f}").alias(f"freed{f}") for f in (0, 1))
        )
        joined = rows.join(totals, ["model", "context"])
        if below is None:
            joined = joined.withColumns({"low0": F.col("even"), "low1": F.col("even")})
        else:
            joined = joined.join(below, ["model", "rest"])
        p = [
            F.when(F.col(f"all{f}") == 0, F.col(f"low{f}")).otherwise((F.col(f"k{f}") - F.col(f"cut{f}") + F.col(f"freed{f}") * F.col(f"low{f}")) / F.col(f"all{f}")).alias(f"low{f}")
            for f in (0, 1)
        ]
        below = joined.select("model", F.col("gram").alias("rest"), *p) if size < order else joined.select("key", "n", *p)
    out = written(below.select("key", "n", *(F.log(f"low{f}").cast("float").alias(f"log{f}") for f in (0, 1))), "logs")
    for size in range(1, order):
        forget(levels[size])
    return out


def hot_grams(logs: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Keys, ascending, and logs of the most frequent n-grams of ``logs``, at most ``most``; and whether that is all of them."""
    size = F.floor(F.log2("n")).cast("int").alias("size")
    sizes = {r["size"]: r["count"] for r in logs.groupBy(size).count().collect()}  # a row for each power of 2
    room, least = most, 64
    for s in sorted(sizes, reverse=True):
        if sizes[s] > room:
            break
        room, least = room - sizes[s], s
    found = logs.where(F.floor(F.log2("n")) >= least).select("key", "log0", "log1").toArrow()
    keys = found.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    values = np.stack([found.column(c).to_numpy()[order] for c in ("log0", "log1")], axis=1)
    return keys[order], values, len(keys) == sum(sizes.values())


def measured(docs: DataFrame, order: int = ORDER, hot: int = HOT_GRAMS) -> DataFrame:
    """doc_id, digest, model, MEASURES, base_failed, plain, n_grams and log_loss (mean of -log p; null without words) of ``docs`` (doc_id, digest, model, text).

    A text is measured by the model of the other half, so it can't vouch for itself nor a copy for another.
    """
    counts = count_grams(docs, order)
    logs = gram_logs(counts, order)
    forget(counts)
    keys, values, complete = hot_grams(logs, hot)
    if complete:
        forget(logs)
    sent = docs.sparkSession.sparkContext.broadcast((keys, values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = sent.value
        for batch in pieces(batches, size=PIECE):
            found = _Judged(batch, order)
            texts, grams = found.texts, found.grams
            own, inverse = np.unique(grams.keys, return_inverse=True)
            at = np.minimum(np.searchsorted(keys, own), max(0, len(keys) - 1))
            known = keys[at] == own if len(keys) else np.zeros(len(own), dtype=bool)
            of_own = np.zeros((len(own), 2))
            if len(keys):
                of_own[known] = values[at[known]]
            loss = -np.bincount(grams.owner, of_own[inverse, 1 - found.fold[grams.owner]], texts.n)
            # What is not broadcast: each text's other n-grams, and how often it has them.
            away = np.flatnonzero(~known[inverse])
            pairs, times = np.unique(grams.owner[away] * len(own) + inverse[away], return_counts=True)
            ends = np.searchsorted(pairs, np.arange(texts.n + 1) * len(own))
            rest = pa.StructArray.from_arrays(_longs(own[pairs % max(1, len(own))].view(np.int64), times), ["key", "times"])
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rest)
            chars = texts.per_text(texts.solid & ((texts.data & 0xC0) != 0x80))
            dup_lines = np.array([n_dup_lines(t or "") for t in batch.column(3).to_pylist()], dtype=np.int64)
            yield pa.record_batch(
                [batch.column(i) for i in (0, 1, 2)] + _longs(texts.counts, chars, found.symbols, dup_lines, found.repeats, grams.sizes)
                + [pa.array(loss), pa.array(found.failed), pa.array(found.plain), rest],
                ["doc_id", "digest", "model", *MEASURES, "n_grams", "loss", "base_failed", "plain", "rest"],
            )
        del keys, values
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, digest long, model string, " + ", ".join(f"{m} long" for m in MEASURES)
        + ", n_grams long, loss double, base_failed boolean, plain boolean, rest array<struct<key:long,times:long>>"
    )
    found = written(docs.select("doc_id", "digest", "model", "text").mapInArrow(run, schema), "measures")
    loss = F.col("loss")
    if not complete:
        found, loss = _with_rest(found, logs), F.col("loss") + F.coalesce("more", F.lit(0.0))
    mean = F.when(F.col("n_grams") > 0, loss / F.col("n_grams"))
    return found.select("doc_id", "digest", "model", *MEASURES, "base_failed", "plain", "n_grams", mean.alias("log_loss"))


def _with_rest(found: DataFrame, logs: DataFrame) -> DataFrame:
    """``found`` with more, what the n-grams add that were not broadcast: equal rows share one sum, joined by the n-grams' keys."""
    row = F.xxhash64("doc_id", "digest", "model")
    rest = found.where(F.size("rest") > 0).select(row.alias("row"), F.pmod("digest", F.lit(2)).alias("half"), F.explode("rest").alias("r"))
    rest = rest.select("row", "half", "r.key", "r.times").distinct().join(logs, "key")
    log = F.when(F.col("half") == 0, F.col("log1")).otherwise(F.col("log0")).cast("double")
    sums = rest.groupBy("row").agg(F.sum(-F.col("times") * log).alias("more"))
    return found.withColumn("row", row).join(small_side(written(sums, "rest"), 1_000_000), "row", "left")


def _steps() -> Column:
    return F.floor(F.col("log_loss") * STEPS + 0.5)


def bands_of(found: DataFrame, below: float, above: float, least: int = LEAST_PLAIN) -> DataFrame:
    """(model, low, high) in STEPS of ``found`` (model, digest, plain, log_loss), for models with ``least`` plain documents in either half.

    low and high are the losses of rank ceil(below * n) and ceil((1 - above) * n), from 1, among the model's n plain documents. Ranges
    of steps are counted first; running sums say in which one a rank lies, and only there are single steps counted. So ranks are exact
    and a task holds counts of ranges, whose number the losses bound, never documents.
    """
    plain = found.where("plain and log_loss is not null").select("model", F.pmod("digest", F.lit(2)).alias("half"), _steps().alias("step"))
    plain = plain.withColumn("range", F.floor(F.col("step") / RANGE))
    ranges = written(plain.groupBy("model", "range").agg(F.count("*").alias("n"), F.sum("half").alias("n1")), "ranges")
    sizes = ranges.groupBy("model").agg(F.sum("n").alias("all"), F.sum("n1").alias("all1")).where((F.col("all1") >= least) & (F.col("all") - F.col("all1") >= least))
    rank = lambda share: F.greatest(F.lit(1), F.ceil(F.lit(share) * F.col("all")))
    wanted = sizes.select("model", F.posexplode(F.array(rank(below), rank(1 - above))).alias("side", "rank"))
    running = ranges.withColumn("upto", F.sum("n").over(Window.partitionBy("model").orderBy("range")))
    inside = lambda n: (F.col("rank") <= F.col("upto")) & (F.col("rank") > F.col("upto") - F.col(n))
    cut = running.join(wanted, "model").where(inside("n")).select("model", "range", "side", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    cut = written(cut, "cut")
    steps = plain.join(small_side(cut, 200_000), ["model", "range"]).groupBy("model", "side", "rank", "step").agg(F.count("*").alias("n"))
    steps = steps.withColumn("upto", F.sum("n").over(Window.partitionBy("model", "side").orderBy("step"))).where(inside("n"))
    ends = (F.max(F.when(F.col("side") == i, F.col("step"))).alias(name) for i, name in enumerate(("low", "high")))
    bands = written(steps.groupBy("model").agg(*ends), "bands")
    forget(ranges)
    forget(cut)
    return bands


def judge_quality(docs: DataFrame, below: float = BELOW, above: float = ABOVE, order: int = ORDER, hot: int = HOT_GRAMS) -> DataFrame:
    """doc_id, digest, MEASURES, perplexity, base_failed and kept of every row of ``docs`` (doc_id, text, lang).

    base_failed: fewer than 10 words, or over a fifth of the words in repeated five-word windows. The rest must lie in their
    language's band of perplexity by character: of its plain documents (those that pass the base, with few symbols and few words in
    capitals) the share ``below`` lies under the band and ``above`` over it. Junk mostly isn't plain and far above.

    Models are modified Kneser-Ney over characters, up to ``order`` of them, one for each lang and half of the plain documents, and
    a text is measured by the model of the other half. N-grams of all texts are counted, scored and kept by Spark tables that grow
    with the corpus; the ``hot`` most frequent ones are broadcast as sorted hash arrays, the others are joined.

    A null text counts as empty and fails; a null lang is a language of its own; in a language with fewer than LEAST_PLAIN plain documents
    in either half there is no band and the base decides; null ids and repeated rows are judged each; other columns are not read; no rows
    give no rows. Texts are read twice and not moved. Memory is that of a PIECE of text, or of one longer text.
    """
    model = F.coalesce(F.concat(F.lit("lang:"), "lang"), F.lit("none"))
    named = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), model.alias("model"), "text")
    found = measured(named, order, hot)
    joined = found.join(small_side(bands_of(found, below, above), 1_000_000), "model", "left")
    within = F.col("low").isNull() | _steps().between(F.col("low"), F.col("high"))
    kept = ~F.col("base_failed") & F.coalesce(within, F.lit(False))
    return joined.select("doc_id", "digest", *MEASURES, F.exp("log_loss").alias("perplexity"), "base_failed", kept.alias("kept"))


def good_documents(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that ``judge_quality`` keeps. The rejected ones' ids are broadcast while they are few, joined by shuffle beyond."""
    bad = judge_quality(docs, **how).where("not kept").select(F.col("doc_id").alias("bad_id"), F.col("digest").alias("bad_digest")).distinct()
    bad = small_side(written(bad, "rejected"), 200_000)
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    digest = F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("digest")
    rows = docs.select(doc, digest)
    good = rows.join(bad, F.col("doc.doc_id").eqNullSafe(F.col("bad_id")) & (F.col("digest") == F.col("bad_digest")), "left_anti")
    return good.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
