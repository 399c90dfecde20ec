"""Matching of texts with term lists: occurrences, whole words, evasion, masks; and upkeep of the lists."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modstream.functions.text import clean_mapping, normalize_search, search_forms, valid_charset
from modstream.operators.rules import RuleConfig
from modstream.sources.shared import numbered, written

MODES = ("STRONG", "NORMAL", "WRITE_COMMAND")
MATCH = "array<struct<word:string,mode:string,start:int,end:int,raw_start:int,raw_end:int>>"

_MATCH = [pa.field(n, t) for n, t in (("word", pa.string()), ("mode", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("raw_start", pa.int32()), ("raw_end", pa.int32()))]

#: Up to so many terms go to every executor; larger lists are joined by the terms' first letters.
BROADCAST_TERMS = 500_000
SEED = 4


#: Code points of texts that a task scans in one go, a longer text being alone.
SCANNED = 1 << 20
RANKS = {"STRONG": 0, "NORMAL": 1}


class Matcher:
    """An automaton of (word, mode) terms, sorted, that scans many texts at once."""

    def __init__(self, terms: Sequence[tuple[str, str]]):
        import ahocorasick

        terms = [t for t in terms if "\n" not in t[0]]  # no letters for search
        words = sorted({word for word, _ in terms})
        self.automaton = ahocorasick.Automaton()
        for i, word in enumerate(words):
            self.automaton.add_word(word, i)
        if words:
            self.automaton.make_automaton()
        self.sizes = np.array([len(word) for word in words], np.int64)
        # Of each word its terms, which follow each other.
        of = np.searchsorted(np.array(words, object), np.array([word for word, _ in terms], object)) if words else np.zeros(0, np.int64)
        self.first, self.modes = np.searchsorted(of, np.arange(len(words))), np.bincount(of, minlength=len(words))
        self.words, self.mode_names = pa.array([word for word, _ in terms], pa.string()), pa.array([mode for _, mode in terms], pa.string())
        self.rank = np.array([RANKS.get(mode, 2) for _, mode in terms], np.int64)
        self.whole = np.array([mode == "NORMAL" for _, mode in terms], bool)

    def scan(self, texts: Sequence[str]) -> tuple[np.ndarray, ...]:
        """(row, term, start, end, raw_start, raw_end) of all matches by row, in order within it; whole words only where the mode asks for them."""
        if not len(self.sizes):
            return (np.zeros(0, np.int64),) * 6
        letters, at, letter_ends, ends, wordy = search_forms(texts)
        hits = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(letters)), np.int64).reshape(-1, 2)
        n = self.modes[hits[:, 1]]
        end, word = np.repeat(hits[:, 0], n), np.repeat(hits[:, 1], n)
        term = self.first[word] + np.arange(len(word)) - np.repeat(np.cumsum(n) - n, n)
        start, row = end - self.sizes[word] + 1, np.searchsorted(letter_ends, end)
        raw_start, raw_end = at[start], at[end]
        # Behind each text is a place that is no letter or digit, so what is outside of one is never in the next.
        wordy[ends] = False
        kept = np.flatnonzero(~(self.whole[term] & (wordy[raw_start - 1] & (raw_start > 0) | wordy[raw_end + 1])))
        kept = kept[np.lexsort((term[kept], end[kept], self.rank[term[kept]], start[kept]))]
        row = row[kept]
        before, raw_before = np.where(row > 0, letter_ends[row - 1] + 1, 0), np.where(row > 0, ends[row - 1] + 1, 0)
        return row, term[kept], start[kept] - before, end[kept] - before, raw_start[kept] - raw_before, raw_end[kept] - raw_before


@functools.lru_cache(maxsize=4)
def matcher_of(sent: Broadcast) -> Matcher:
    """A worker keeps the last few."""
    return Matcher(sent.value)


def chunks(texts: pa.Array) -> Iterator[list[str]]:
    """``texts`` in order in lists of up to SCANNED code points, null as ""."""
    part, size = [], 0
    for text in texts.to_pylist():
        if part and size + len(text or "") > SCANNED:
            yield part
            part, size = [], 0
        part.append(text or "")
        size += len(text or "")
    if part:
        yield part


def finder(spark: SparkSession, terms: Iterable[tuple[str, str]]) -> Callable:
    """A function from texts to their matches with ``terms``, in order, by one broadcast automaton."""
    sent = spark.sparkContext.broadcast(tuple(sorted(set(terms))))

    @F.arrow_udf(MATCH)
    def matched(texts: pa.Array) -> pa.Array:
        matcher, parts = matcher_of(sent), []
        for part in chunks(texts):
            row, term, *places = matcher.scan(part)
            values = [matcher.words.take(pa.array(term)), matcher.mode_names.take(pa.array(term)), *(pa.array(p, pa.int32()) for p in places)]
            ends_of = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
            parts.append(pa.ListArray.from_arrays(pa.array(ends_of), pa.StructArray.from_arrays(values, fields=_MATCH)))
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.struct(_MATCH)))

    return matched


def _by_automaton(messages: DataFrame, terms: list[tuple[str, str]], text: str) -> DataFrame:
    # What isn't deterministic is computed once, where Spark would else compute it for a filter and again for what the filter leaves.
    return messages.withColumn("matches", finder(messages.sparkSession, terms).asNondeterministic()(text))


def _by_seeds(messages: DataFrame, lexicon: DataFrame, text: str, key: str) -> DataFrame:
    """Terms join on their first SEED letters, then on all of them, with every place in a text of as many letters as any term has.

    Per place only the key and a few letters are sent: those of SEED first; for the places that some term begins at, the letters up
    to the longest term with that beginning. Texts themselves aren't moved but for their letters' places.
    """
    rows = written(messages.select(key, clean_mapping(F.col(text)).alias("m")).select(key, "m.clean", "m.idx").where(F.length("clean") >= SEED), "letters")
    seeds = lexicon.groupBy(F.substring("word", 1, SEED).alias("seed")).agg(F.max(F.length("word")).alias("longest"))
    seeds = written(seeds, "seeds")
    cut = lambda at, n: F.substring(F.col("clean"), at + 1, n if isinstance(n, Column) else F.lit(n))
    starts = F.transform(F.sequence(F.lit(0), F.length("clean") - SEED), lambda i: F.struct(i.alias("start"), cut(i, SEED).alias("seed")))
    places = rows.select(key, F.explode(starts).alias("p")).select(key, "p.*").join(seeds, "seed")
    places = places.groupBy(key).agg(F.collect_list(F.struct("start", "longest")).alias("places")).join(rows, key)
    longer = F.transform("places", lambda p: F.struct(p.start.alias("start"), cut(p.start, p.longest).alias("letters")))
    tried = places.select(key, F.explode(longer).alias("p")).select(key, "p.*")
    lengths = lexicon.groupBy(F.substring("word", 1, SEED).alias("seed")).agg(F.collect_set(F.length("word")).alias("lengths"))
    tried = tried.join(lengths, F.substring("letters", 1, SEED) == F.col("seed")).select(key, "start", "letters", F.explode("lengths").alias("n")).where(F.length("letters") >= F.col("n"))
    found = tried.select(key, "start", F.substring(F.col("letters"), F.lit(1), F.col("n")).alias("word")).join(lexicon.select("word", "mode"), "word")
    found = found.groupBy(key).agg(F.collect_list(F.struct("word", "mode", "start")).alias("hits")).join(rows.select(key, "idx"), key)

    def match(h: Column) -> Column:
        end = h.start + F.length(h.word) - 1
        return F.struct(h.word.alias("word"), h.mode.alias("mode"), h.start.alias("start"), end.alias("end"), F.get("idx", h.start).alias("raw_start"), F.get("idx", end).alias("raw_end"))

    return found.select(key, F.transform("hits", match).alias("matches"))


def match_terms(messages: DataFrame, lexicon: DataFrame, text: str = "text", key: str = "msg_id", most: int = BROADCAST_TERMS) -> DataFrame:
    """``messages`` with matches, all occurrences of the terms of ``lexicon`` (word, mode) in the texts' search form.

    A list of up to ``most`` terms is broadcast and one automaton scans each text; the terms of a larger one are joined by their
    first letters, the short ones among them (too few to grow with the list) broadcast. raw_start and raw_end are code points of the
    text itself.
    """
    words = lexicon.select("word", "mode").where("word != ''").distinct()
    first = words.limit(most + 1).collect()
    if len(first) <= most:
        return _by_automaton(messages, [tuple(r) for r in first], text)
    short = [tuple(r) for r in words.where(F.length("word") < SEED).collect()]
    long = _by_seeds(messages, words.where(F.length("word") >= SEED), text, key).withColumnRenamed("matches", "more")
    found = _by_automaton(messages, short, text).join(long, key, "left")
    found = found.withColumn("matches", F.concat("matches", F.coalesce("more", F.array().cast(MATCH)))).drop("more")
    kept = F.filter("matches", lambda m: (m.mode != "NORMAL") | boundary_ok(F.col(text), m.raw_start, m.raw_end))
    rank = lambda m: F.when(m.mode == "STRONG", 0).when(m.mode == "NORMAL", 1).otherwise(2)
    ordered = F.array_sort(F.transform(kept, lambda m: F.struct(m.start.alias("start"), rank(m).alias("rank"), m.end.alias("end"), m.word.alias("word"), m.alias("m"))))
    return found.withColumn("matches", F.transform(ordered, lambda x: x.m))


def boundary_ok(text: Column, start: Column, end: Column) -> Column:
    """The characters just outside of the span are no letters or digits."""
    before = F.when(start > 0, F.substring(text, start, F.lit(1))).otherwise("")
    after = F.substring(text, end + 2, F.lit(1))
    return ~F.concat(before, after).rlike("[\\p{L}\\p{Nd}]")


def of_modes(matches: Column, *modes: str) -> Column:
    return F.filter(matches, lambda m: m.mode.isin(list(modes)))


def density(m: Column) -> Column:
    """Share of a match's span in the text that isn't the term."""
    span = m.raw_end - m.raw_start + 1
    return (span - F.length(m.word)) / span


def mask_matches(text: Column, matches: Column, mask: str = "****") -> Column:
    """Leftmost non-overlapping spans replaced by ``mask``, places being those of the text as it was."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, m: Column) -> Column:
        free = m.raw_start >= acc.at
        grown = F.concat(acc.out, F.substring(text, acc.at + 1, m.raw_start - acc.at), F.lit(mask))
        return F.struct(F.when(free, m.raw_end + 1).otherwise(acc.at).alias("at"), F.when(free, grown).otherwise(acc.out).alias("out"))

    return F.aggregate(matches, zero, step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))


def mask_literals(text: Column, words: Column, mask: str = "****") -> Column:
    """Every literal occurrence of the words, without case, replaced by ``mask``."""
    return F.aggregate(words, text, lambda s, w: F.regexp_replace(s, F.concat(F.lit("(?i)\\Q"), w, F.lit("\\E")), F.lit(mask.replace("\\", "\\\\").replace("$", "\\$"))))


def filter_texts(messages: DataFrame, lexicon: DataFrame, cfg: RuleConfig = RuleConfig(), text: str = "text", key: str = "msg_id", charset: Column | None = None, match: Callable[..., DataFrame] | None = None) -> DataFrame:
    """``messages`` with matches, filter_blocked, filter_reason, detected_word, detected_words, is_evasion, hidden, masked_text and literal_text.

    A command term blocks first. Then the first match gives word and reason; a match spread by over 5 % of other characters is an
    evasion and blocks. Otherwise all spans are masked; in literal_text, what chat shows, it is every place where a detected word stands
    literally, whatever is around it. hidden says that no detected word stands literally in the text. ``charset`` says
    which rows' characters are checked, all if it isn't given; ``match`` finds the terms, by default ``match_terms``.
    """
    t = F.col(text)
    found = (match or match_terms)(messages, lexicon, text, key)
    # Columns of their own, so that what the verdict needs again and again is computed once.
    found = found.withColumns({
        "_command": of_modes(F.col("matches"), "WRITE_COMMAND"), "_words": of_modes(F.col("matches"), "STRONG", "NORMAL"),
        "_invalid": F.coalesce(~valid_charset(t), F.lit(False)) & (F.lit(True) if charset is None else charset),
    })
    command, words, invalid = F.col("_command"), F.col("_words"), F.col("_invalid")
    found = found.withColumns({
        "_names": F.array_distinct(F.transform(words, lambda m: m.word)), "_evasion": F.exists(words, lambda m: density(m) > 0.05) & F.lit(cfg.evasion),
    })
    names, evasion = F.col("_names"), F.col("_evasion")
    by_command, any_word = F.size(command) > 0, F.size(words) > 0
    found = found.withColumn("literal_text", F.when(any_word, mask_literals(t, names, cfg.mask)).otherwise(t))
    reason = (
        F.when(by_command, "WriteCommand").when(invalid, "Zalgo/Unicode").when(any_word & evasion, "Evasion")
        .when(any_word & F.lit(not cfg.replacement), "Filter (Total Block)").when(any_word, F.concat(F.lit("Filter ("), F.get(names, 0), F.lit(")")))
    )
    blocked = by_command | invalid | (any_word & (evasion | F.lit(not cfg.replacement)))
    return found.select(
        *messages.columns, "matches", blocked.alias("filter_blocked"), reason.alias("filter_reason"),
        F.when(by_command, F.get(command, 0).word).when(invalid, "Unicode").otherwise(F.get(names, 0)).alias("detected_word"),
        F.when(by_command, F.array(F.get(command, 0).word)).otherwise(names).alias("detected_words"),
        (by_command | invalid | (any_word & evasion)).alias("is_evasion"),
        F.when(any_word, F.col("literal_text") == t).otherwise(False).alias("hidden"),
        F.when(any_word & ~by_command, mask_matches(t, words, cfg.mask)).otherwise(t).alias("masked_text"),
        F.when(~by_command, F.col("literal_text")).otherwise(t).alias("literal_text"),
    )


def is_clean(messages: DataFrame, lexicon: DataFrame, cfg: RuleConfig = RuleConfig(), **how) -> DataFrame:
    """``filter_texts`` reduced to clean: nothing detected and nothing blocked."""
    found = filter_texts(messages, lexicon, cfg, **how)
    return found.withColumn("clean", ~F.col("filter_blocked") & (F.size("detected_words") == 0))


def is_clean_for_command(messages: DataFrame, lexicon: DataFrame, **how) -> DataFrame:
    return is_clean(messages, lexicon.where("mode = 'WRITE_COMMAND'"), **how)


def filtered_text(messages: DataFrame, lexicon: DataFrame, cfg: RuleConfig = RuleConfig(), **how) -> DataFrame:
    """``filter_texts`` with safe_text: the masked text, or the mask alone where the text is blocked."""
    found = filter_texts(messages, lexicon, cfg, **how)
    return found.withColumn("safe_text", F.when(F.col("filter_blocked"), cfg.mask).otherwise(F.col("masked_text")))


def moderate_pages(pages: DataFrame, lexicon: DataFrame, cfg: RuleConfig = RuleConfig(), max_page: int = 256) -> DataFrame:
    """(container_id, cancelled, pages) of ``pages`` (container_id, page_no, text): any page of invalid characters cancels the book."""
    cut = pages.withColumn("msg_id", F.xxhash64("container_id", "page_no")).withColumn("ok", valid_charset(F.col("text")))
    found = filtered_text(cut.withColumn("text", F.substring("text", 1, max_page)), lexicon, cfg)
    book = found.groupBy("container_id").agg(
        F.bool_or(~F.col("ok")).alias("cancelled"), F.array_sort(F.collect_list(F.struct("page_no", "safe_text"))).alias("p")
    )
    return book.select("container_id", "cancelled", F.transform("p", lambda p: p.safe_text).alias("pages"))


def lexicon_of(texts: DataFrame, mode: str) -> DataFrame:
    """(word, mode) of lines (value): trimmed, without blank and "#" lines, in search form, each once."""
    lines = texts.select(F.trim("value").alias("value")).where("value != '' and not startswith(value, '#')")
    return lines.select(normalize_search(F.col("value")).alias("word")).where("word != ''").distinct().withColumn("mode", F.lit(mode))


def lexicon_add(lexicon: DataFrame, new: DataFrame) -> DataFrame:
    """``lexicon`` and those of ``new`` (word, mode) whose search form it doesn't have yet."""
    fresh = new.select(normalize_search(F.col("word")).alias("word"), "mode").where("word != ''").distinct()
    return lexicon.unionByName(fresh.join(lexicon, ["word", "mode"], "left_anti"))


def lexicon_remove(lexicon: DataFrame, gone: DataFrame) -> DataFrame:
    """``lexicon`` without the words of ``gone`` (word), in search form or as they are without case."""
    keys = gone.select(normalize_search(F.col("word")).alias("k")).union(gone.select(F.lower("word").alias("k"))).distinct()
    return lexicon.join(keys, F.lower(lexicon.word) == F.col("k"), "left_anti")


def lexicon_page(lexicon: DataFrame, mode: str, page: int, size: int = 20) -> DataFrame:
    """A page of a mode's words in order without case; a page beyond the last is the last."""
    rows = written(numbered(lexicon.where(F.col("mode") == mode).select("word", F.lower("word").alias("low")), "low", "word"), "page")
    last = rows.agg(F.greatest(F.lit(1), F.ceil(F.count("*") / size)).alias("last"))
    at = F.least(F.lit(max(1, page)), F.col("last"))
    paged = rows.join(F.broadcast(last)).withColumn("page", at)
    return paged.where((F.col("row") > (F.col("page") - 1) * size) & (F.col("row") <= F.col("page") * size)).select("row", "word", "page")


def words_lexicon(words: Iterable[str], mode: str, spark) -> DataFrame:
    return spark.createDataFrame([(w, mode) for w in words], "word string, mode string")


