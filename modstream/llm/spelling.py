"""Spelling variants: words one edit apart, found level by level in a trie that is a table, and each word's most frequent form.

Two tries hold all words, forwards and backwards; their edges are rows (node, letter, what is below), a node being the text up to it.
A state is (word, position, node): so much of the word is spelt by the node, with one edit. A word enters level d, its own first d letters
being the node, only from its middle on, as an edit in its first half is one in the second half backwards; nodes there have few
edges. In each level states are joined with the edges of that level: those that edit take another letter or leave one out, all others
go on with their own letter; a state at the end of its word and of a branch is a pair of neighbours. Each pair is looked for
once: from the longer word, or from that with the smaller letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modstream.llm.common import forget, small_batches, written

#: Letters of a text that are looked through at once, and different words that a task holds before it hands on their counts.
PIECE, HELD = 1_000_000, 200_000
LAST = re.compile("[^A-Za-z\u00C0-\u00FF]")
#: Letters of a word in the trie; longer words go by the sums of their parts.
LONGEST = 32
#: Edges of a level that are broadcast at most; beyond that both sides are shuffled by node, of which no node has more edges than there are letters.
SMALL = 100_000
MODULI = (2_147_483_647, 2_147_483_629)
STATE = ("back", "word", "n", "at", "node")


def _counted(one_in: int, least: int):
    """Batches of (doc_id, text) to (word, n): counts of words of at least ``least`` letters, of a few thousand texts each time."""
    runs = re.compile(f"[A-Za-z\u00C0-\u00FF]{{{least},}}")

    def pieces(text: str) -> Iterator[list[str]]:
        """Runs of a part of the text at a time; a part ends between runs."""
        low = 0
        while low < len(text):
            high = low + PIECE
            if high < len(text):
                cut = LAST.search(text, high)
                high = cut.start() if cut else len(text)
            yield runs.findall(text, low, high)
            low = high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = pa.array(list(counts), pa.binary()).cast(pa.string())
            batch = pa.record_batch([words, pa.array(list(counts.values()), pa.int64())], ["word", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc = doc.as_py()
                start = zlib.crc32(("null:" if doc is None else f"{doc}:").encode())
                for found in pieces(text.as_py() or ""):
                    for letters, n in Counter(found).items():
                        word = letters.encode().lower()  # of bytes, only A-Z
                        h = zlib.crc32(word, start)
                        if h % one_in == 0:
                            if len(letters) == least:
                                continue
                            letters, at = word.decode(), h % len(letters)
                            word = (letters[:at] + letters[at + 1 :]).encode()
                        counts[word] += n
                if len(counts) > HELD:
                    yield out()
        if counts:
            yield out()

    return run


def vocabulary(docs: DataFrame, one_in: int = 97, least_letters: int = 5, least_count: int = 3) -> DataFrame:
    """(word, n) of the words of ``docs`` (doc_id, text) that have ``least_letters`` and occur ``least_count`` times.

    Words are runs of letters, A-Z in lower case, of which one in ``one_in`` lacks a letter. Which ones, and which letter, is given by the
    CRC-32 of "doc_id:run"; a null doc_id is the text "null". Each task counts what it can hold before the counts are shuffled.
    """
    parts = docs.select("doc_id", "text").mapInArrow(_counted(one_in, least_letters), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _letter(word: str, at: Column | str) -> Column:
    """The letter after ``at`` others; the empty text after the last."""
    return F.substring(F.col(word), F.col(at) + 1 if isinstance(at, str) else at + 1, F.lit(1))


def _bit(letter: Column) -> Column:
    return _one(F.ascii(letter) % 63)


def _one(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int"))


def trie_edges(words: DataFrame, least_depth: int) -> DataFrame:
    """(depth, back, node, letter, rests, nexts, n) of both tries over ``words`` (word, n) from ``least_depth`` letters on.

    An edge with the empty letter ends a word, and has its count. ``rests`` has a bit for each number of letters that follow the edge in
    some word, ``nexts`` one for the next letters.
    """
    both = words.select(F.lit(False).alias("back"), "word", "n").union(words.select(F.lit(True), F.reverse("word"), "n"))
    at = both.select("back", "word", "n", F.explode(F.sequence(F.lit(least_depth), F.length("word"))).alias("depth"))
    ends = F.col("depth") == F.length("word")
    edges = at.select(
        "depth", "back", F.substring("word", F.lit(1), F.col("depth")).alias("node"), _letter("word", "depth").alias("letter"),
        F.when(ends, F.lit(-1)).otherwise(_one(F.length("word") - F.col("depth") - 1)).cast("long").alias("rest"),
        F.when(ends, F.lit(-1)).otherwise(_bit(_letter("word", F.col("depth") + 1))).cast("long").alias("next"), F.when(ends, F.col("n")).alias("n"),
    )
    return edges.groupBy("depth", "back", "node", "letter").agg(F.bit_or("rest").alias("rests"), F.bit_or("next").alias("nexts"), F.max("n").alias("n"))


def _trie_neighbours(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): each pair of neighbours among ``words`` (word, n) of up to LONGEST letters, once or twice in either order."""
    shortest, longest, n = words.agg(F.min(F.length("word")), F.max(F.length("word")), F.count("*")).first()
    if not n:
        return words.select(F.col("word").alias("a"), F.col("n").alias("na"), F.col("word").alias("b"), F.col("n").alias("nb"))
    least, files = shortest // 2, 8 + n // 100_000
    edges = written(trie_edges(words, least).repartition("depth", F.pmod(F.hash("node"), F.lit(files))), "edges", "depth")
    counts = {r[0]: r[1] for r in edges.groupBy("depth").count().collect()}  # a row for each level
    both = words.select(F.lit(False).alias("back"), "word", "n").union(words.select(F.lit(True), F.reverse("word"), "n"))
    found, gone, states = [], [], None
    for depth in range(least, longest + 1):
        level = edges.where(F.col("depth") == depth).select(F.col("back").alias("_back"), F.col("node").alias("_node"), "letter", "rests", "nexts", F.col("n").alias("end_n"))
        level = F.broadcast(level) if counts.get(depth, 0) <= SMALL else level.hint("shuffle_hash")
        # Words enter where an edit may be: in their second half. An odd word's middle letter counts in both directions.
        entering = both.where((F.length("word") > depth) & (F.length("word") <= 2 * depth + 1))
        own = F.substring("word", F.lit(1), F.lit(depth)).alias("node")
        going = entering.select("back", "word", "n", F.explode(F.array(F.lit(depth), F.lit(depth + 1))).alias("at"), own)
        going = going.withColumn("swaps", F.col("at") == depth)
        going = going if states is None else going.union(states.withColumn("swaps", F.lit(False)))
        going = going.withColumns({"own": _letter("word", "at"), "rest": _one(F.length("word") - F.col("at") - 1), "next": _bit(_letter("word", F.col("at") + 1))})
        fits = F.when(F.col("swaps"), F.col("letter") > F.col("own")).otherwise(F.col("letter") == F.col("own"))
        fits &= (F.col("rests").bitwiseAND(F.col("rest")) != 0) & (F.col("nexts").bitwiseAND(F.col("next")) != 0)
        step = going.join(level, (F.col("back") == F.col("_back")) & (F.col("node") == F.col("_node")) & fits)
        ends = F.col("letter") == ""
        step = step.select(
            "back", "word", "n", F.when(~ends, F.col("at") + 1).otherwise(-1).alias("at"), F.when(~ends, F.concat("node", "letter")).alias("node"),
            F.when(ends, F.col("node")).alias("b"), F.when(ends, F.col("end_n")).alias("nb"),
        )
        step = written(step, "states")
        found.append(step.where("at < 0"))
        gone.append(step)
        states = step.where("at >= 0").select(*STATE)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    turn = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c))
    pairs = written(pairs.select(turn("word").alias("a"), F.col("n").alias("na"), turn("b").alias("b"), "nb"), "pairs")
    for table in [*gone, edges]:
        forget(table)
    return pairs


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (id, word) to (id, kind, length, at, before, after, place): sums of letters by their places, two in one number.

    Kind 0 has the sum of the whole word, 1 that without each letter, 2 those before and after each letter; place is the letter's.
    """
    for batch in batches:
        for id_, word in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            c = np.frombuffer(word.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
            n, packed = len(c), np.zeros((3, len(c) + 1), np.uint64)
            for m in MODULI:
                power, base, modulus = np.ones(n, np.uint64), 1_000_003, np.uint64(m)
                step, times = 1, base
                while step < n:  # base to the power of each place, by doubling
                    power[step : 2 * step] = power[: len(power[step : 2 * step])] * np.uint64(times) % modulus
                    step, times = 2 * step, times * times % m
                total = np.r_[np.uint64(0), np.cumsum(c * power % modulus)] % modulus
                after = (total[-1] + modulus - total[1:]) % modulus
                without = (total[:-1] + after * np.uint64(pow(base, -1, m))) % modulus
                for row, part in enumerate((total, without, after)):
                    packed[row, : len(part)] = packed[row, : len(part)] * np.uint64(2**31) + part
            total, without, after = packed.astype(np.int64)
            at = np.arange(n)
            for kind, length, place, x, y in ((0, n, at[:1] * 0, total[-1:], total[-1:]), (1, n - 1, at * 0, without[:n], without[:n]), (2, n, at, total[:n], after[:n])):
                for low in range(0, len(x), 50_000):
                    k = len(x[low : low + 50_000])
                    yield pa.record_batch(
                        [
                            pa.array([id_] * k, pa.int64()), pa.array([kind] * k, pa.int32()), pa.array([length] * k, pa.int32()), pa.array(place[low : low + k].astype(np.int32)), pa.array(x[low : low + k]), pa.array(y[low : low + k]),
                            pa.array(at[low : low + k].astype(np.int32)),
                        ],
                        ["id", "kind", "length", "at", "before", "after", "place"],
                    )


def _long_neighbours(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): pairs of neighbours among ``words`` of which one has more than LONGEST letters, by equal sums, compared afterwards.

    A word has as many rows as letters, so its length may be anything. No more words share a row than there are letters to put there.
    """
    some = written(words.where(F.length("word") >= LONGEST).select(F.xxhash64("word").alias("id"), "word", "n"), "long-words")
    sums = written(some.select("id", "word").mapInArrow(_sums, "id long, kind int, length int, at int, before long, after long, place int"), "sums")
    key, a, b = ["length", "at", "before", "after"], sums.withColumnRenamed("id", "a"), sums.select(F.col("id").alias("b"), "kind", "length", "at", "before", "after")
    left_out = a.where("kind = 1").drop("kind").join(b.where("kind = 0").drop("kind"), key)
    swapped = a.where("kind = 2").drop("kind").join(b.where("kind = 2").drop("kind"), key).where("a < b")
    pairs = left_out.union(swapped).groupBy("a", "b").agg(F.min("place").alias("place"))
    named = lambda c, n: some.select(F.col("id").alias(c), F.col("word").alias(f"{c}_word"), F.col("n").alias(n))
    pairs = pairs.join(named("a", "na"), "a").join(named("b", "nb"), "b")
    without = lambda c: F.concat(F.substring(F.col(c), F.lit(1), F.col("place")), F.substring(F.col(c), F.col("place") + 2, F.length(c)))
    # Where the letter is known, comparing takes one look at each word.
    same = F.when(F.length("a_word") == F.length("b_word"), without("a_word") == without("b_word")).otherwise(without("a_word") == F.col("b_word"))
    near = (F.greatest(F.length("a_word"), F.length("b_word")) > LONGEST) & (F.col("a_word") != F.col("b_word")) & same
    out = written(pairs.where(near).select(F.col("a_word").alias("a"), "na", F.col("b_word").alias("b"), "nb"), "long-pairs")
    for table in (some, sums):
        forget(table)
    return out


def neighbours(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): for each word of ``words`` (word, n; different words) all that one inserted, deleted or replaced letter makes of it."""
    pairs = _trie_neighbours(words.where(F.length("word") <= LONGEST))
    if words.where(F.length("word") > LONGEST).limit(1).count():
        pairs = pairs.union(_long_neighbours(words))
    return pairs.union(pairs.select("b", "nb", "a", "na")).distinct()


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) of ``forms`` (word, form): where following forms ends. Each round doubles the length of all ways; forms may not go in circles."""
    ways = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ways.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        last, ways = ways, written(ways.join(further, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("on")), "roots")
        forget(last)
        on = ways.where("on").limit(1).count()
        ways = _dropped(ways, "on")
        if not on:
            return ways


def _dropped(table: DataFrame, column: str) -> DataFrame:
    out = table.drop(column)
    out.written_path = table.written_path
    return out


def group_variants(docs: DataFrame, one_in: int = 97, least_letters: int = 5, least_count: int = 3, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near and form_n of each word of ``docs`` (doc_id, text) that is long and frequent enough.

    Words are those of ``vocabulary``. Two are near if one inserted, deleted or replaced letter makes one of the other. A word's form is
    its near word with the largest count, of equal ones the first by code points, if that count is ``times`` its own; root is where
    following forms ends.

    A null text has no words, a null doc_id reads "null"; repeated rows count again, no rows give no rows, other columns are not read.
    Texts and words may be of any length.
    """
    small_batches(docs.sparkSession)
    words = written(vocabulary(docs, one_in, least_letters, least_count), "words")
    near = neighbours(words)
    best = near.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("nb")).alias("low"), F.col("b").alias("form"))).alias("best"), F.max("na").alias("own"))
    good = -F.col("best.low") >= times * F.col("own")
    best = written(best.select("word", "n_near", F.when(good, F.col("best.form")).alias("form"), F.when(good, -F.col("best.low")).alias("form_n")), "forms")
    roots = roots_of(best.where("form is not null").select("word", "form"))
    out = words.join(best, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
