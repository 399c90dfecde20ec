"""Language ID: scripts narrow the candidates, then Viterbi over words' scores labels spans of mixed-language text."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modstream.llm.arrays import CLASSES, PIECE, Texts, WordTypes, pieces
from modstream.llm.common import small_batches

#: About so many labelled documents of each language are learned from: of more, those whose id hashes lowest.
LEARN_DOCS = 5_000
#: With more languages than this, pieces of text get smaller, as words have a score for each language.
WIDE_PIECES = 200
#: A task hands on its counts when it has those of so many languages.
HELD_LANGUAGES = 32
#: Scores of trigrams, one for each language, that are held at once.
SLICE = 4_000_000
#: Cost of changing the language between two words, as a log probability.
SWITCH = 8.0
#: A language is a candidate for a script in which it has at least this share of its letters.
LEAST_SHARE = 0.01

LETTER = re.compile(r"[^\W\d_]")

#: Scripts by ranges of code points; what is in no range belongs to "other", what is no letter is not looked at.
SCRIPT_RANGES = (
    (0x0041, 0x005A, "latin"), (0x0061, 0x007A, "latin"), (0x00AA, 0x00AA, "latin"), (0x00BA, 0x00BA, "latin"), (0x00C0, 0x02AF, "latin"), (0x0370, 0x03FF, "greek"),
    (0x0400, 0x052F, "cyrillic"), (0x0531, 0x058A, "armenian"), (0x0591, 0x05F4, "hebrew"), (0x0610, 0x06FF, "arabic"), (0x0750, 0x077F, "arabic"), (0x08A0, 0x08FF, "arabic"),
    (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"), (0x0A01, 0x0A76, "gurmukhi"), (0x0A81, 0x0AFF, "gujarati"), (0x0B01, 0x0B77, "oriya"), (0x0B82, 0x0BFA, "tamil"),
    (0x0C00, 0x0C7F, "telugu"), (0x0C80, 0x0CF3, "kannada"), (0x0D00, 0x0D7F, "malayalam"), (0x0D81, 0x0DF4, "sinhala"), (0x0E01, 0x0E5B, "thai"), (0x0E81, 0x0EDF, "lao"),
    (0x0F00, 0x0FFF, "tibetan"), (0x1000, 0x109F, "myanmar"), (0x10A0, 0x10FF, "georgian"), (0x1100, 0x11FF, "hangul"), (0x1200, 0x139F, "ethiopic"), (0x1780, 0x17FF, "khmer"),
    (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x2C60, 0x2C7F, "latin"), (0x3041, 0x30FF, "kana"), (0x3131, 0x318E, "hangul"), (0x31F0, 0x31FF, "kana"), (0x3400, 0x4DBF, "han"),
    (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7A3, "hangul"), (0xF900, 0xFAFF, "han"), (0xFB50, 0xFDFF, "arabic"), (0xFE70, 0xFEFC, "arabic"), (0xFF66, 0xFF9F, "kana"), (0x20000, 0x323AF, "han"),
)
SCRIPTS = ("none", "other", *dict.fromkeys(name for *_, name in SCRIPT_RANGES))
#: Scripts that are written without blanks: their runs are cut into words of CUT characters.
UNSEGMENTED, CUT = ("han", "kana", "thai", "lao", "khmer", "myanmar", "tibetan"), 4
_LOW, _HIGH = (np.array([r[i] for r in SCRIPT_RANGES]) for i in (0, 1))
_NAME = np.array([SCRIPTS.index(r[2]) for r in SCRIPT_RANGES])
_UNSEGMENTED = np.isin(SCRIPTS, UNSEGMENTED)


def scripts_of(codes: np.ndarray) -> np.ndarray:
    """Number of the script of each code point: 0 for no letter as far as ASCII, Latin-1 and general signs go, 1 for other ones."""
    at = np.maximum(np.searchsorted(_LOW, codes, side="right") - 1, 0)
    found = np.where((codes >= _LOW[at]) & (codes <= _HIGH[at]), _NAME[at], 1)
    signs = (codes < 0x370) | (codes == 0xD7) | (codes == 0xF7) | ((codes >= 0x2000) & (codes < 0x2C00)) | ((codes >= 0x3000) & (codes < 0x3041)) | ((codes >= 0xFE00) & (codes < 0xFE70)) | (codes >= 0x1F000) & (codes < 0x20000)
    return np.where(signs & ((found == 1) | (codes == 0xD7) | (codes == 0xF7)), 0, found)


#: The script of each code point up to the last range, from the rule above.
_SCRIPT = scripts_of(np.arange(SCRIPT_RANGES[-1][1] + 2)).astype(np.int8)


class Words(Texts):
    """Words whose letters are of one kind of writing: runs of scripts without blanks are cut off the rest and into short words."""

    def __init__(self, column: pa.Array):
        super().__init__(column)
        self.leads = np.flatnonzero((self.data & 0xC0) != 0x80)
        first = self.data[self.leads]
        self.script = _SCRIPT[first]
        longer = np.flatnonzero(first >= 0x80)
        data = np.concatenate([self.data, np.zeros(3, np.uint8)])
        b, c, d, e = (data[self.leads[longer] + k].astype(np.int64) for k in range(4))
        codes = np.select([b < 0xE0, b < 0xF0], [(b & 31) << 6 | c & 63, (b & 15) << 12 | (c & 63) << 6 | d & 63], (b & 7) << 18 | (c & 63) << 12 | (d & 63) << 6 | e & 63)
        self.script[longer] = _SCRIPT[np.minimum(codes, len(_SCRIPT) - 1)]
        loose = _UNSEGMENTED[self.script]
        if loose.any():
            starts = np.zeros(len(self.data), dtype=bool)
            starts[self.starts] = True
            fresh = starts[self.leads]
            fresh[1:] |= (loose[1:] != loose[:-1]) & self.solid[self.leads[1:]] & self.solid[self.leads[:-1]]
            runs = np.flatnonzero(fresh)
            place = np.arange(len(self.leads)) - runs[np.maximum(np.searchsorted(runs, np.arange(len(self.leads)), side="right") - 1, 0)]
            fresh |= loose & (place % CUT == 0)
            new = self.leads[fresh & self.solid[self.leads]]
            self.ends = np.minimum(np.append(new[1:], len(self.data)), self.ends[np.searchsorted(self.ends, new, side="right")])
            self.starts = new
            self.first = np.searchsorted(self.starts, self.offsets)

    def places(self, at: np.ndarray) -> np.ndarray:
        """Code points before each byte, in the whole batch."""
        return np.searchsorted(self.leads, at)


def held_out(doc_id: Column) -> Column:
    """Documents that nothing is learned from: CRC32 of the id as text, modulo 4, is 2. A null id is not held out, nor learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Scorer:
    """Scores of words for each language: mean-free log odds of their byte trigrams, and languages' shares of scripts."""

    def __init__(self, languages: list[str], where: np.ndarray, grams: np.ndarray, n: np.ndarray, scripts: np.ndarray):
        """``n``: counts of the trigrams ``grams`` in the languages of the numbers ``where``; ``scripts``: letters, languages x scripts."""
        self.languages = languages
        # A row for each trigram seen; the last is that of all others.
        seen, at = np.unique(grams, return_inverse=True)
        self.row = np.full(CLASSES**3, len(seen), dtype=np.int32)
        self.row[seen] = np.arange(len(seen))
        self.table = np.zeros((len(seen) + 1, len(languages)), dtype=np.float32)
        self.table[at, where] = n
        sums = np.bincount(where, n, len(languages))
        for i in range(len(languages)):
            self.table[:, i] = np.log((self.table[:, i].astype(float) + 0.5) / (sums[i] + 0.5 * 4096))
        share = scripts / np.maximum(1, scripts.sum(axis=1, keepdims=True))
        self.candidate = share >= LEAST_SHARE
        # A script that no language was seen in leaves all of them.
        self.candidate[:, ~self.candidate.any(axis=0)] = True
        self.candidate[:, 0] = True

    def of_types(self, types: WordTypes) -> tuple[np.ndarray, np.ndarray]:
        """(types x languages) scores, and whether a type has letters. SLICE scores of trigrams are held at once."""
        grams, bounds = types.trigrams()
        texts, n = types.texts, len(types.index)
        scores = np.zeros((n, len(self.languages)), np.float32)
        step = max(1, SLICE // len(self.languages))
        i = 0
        while i < n:
            j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + step, side="right")) - 1)
            for low in range(bounds[i], bounds[j], step):  # a type of more than ``step`` trigrams comes alone, in parts
                high = min(low + step, bounds[j])
                part = self.table[self.row[grams[low:high]]]
                scores[i:j] += np.add.reduceat(part, bounds[i:j] - bounds[i], axis=0) if j > i + 1 else part.sum(axis=0)
            i = j
        # A word's script is that of most of its letters.
        low, high = texts.places(texts.starts[types.index]), texts.places(texts.ends[types.index])
        sizes = high - low
        at = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(low, sizes)
        votes = np.bincount(np.repeat(np.arange(n), sizes) * len(SCRIPTS) + texts.script[at], minlength=n * len(SCRIPTS)).reshape(n, len(SCRIPTS))
        script = np.where(votes[:, 1:].any(axis=1), votes[:, 1:].argmax(axis=1) + 1, 0) if n else np.zeros(0, np.int64)
        return np.where(self.candidate.T[script], scores, -1e4).astype(np.float32), script > 0


def viterbi(by_type: np.ndarray, types: np.ndarray, first: np.ndarray, switch: float) -> np.ndarray:
    """Best language of each word, of type ``types[i]`` with the scores ``by_type``; words of text d are ``first[d]`` to ``first[d + 1]``.

    All texts of a batch go in step. Of a word only which languages it was reached from is kept, as bits.
    """
    n_words, n_lang = len(types), by_type.shape[1]
    path = np.zeros(n_words, dtype=np.int32)
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")
    sizes, starts = sizes[order], first[:-1][order]
    if not n_words or n_lang < 2:
        return path
    live = np.searchsorted(-sizes, -np.arange(sizes[0] + 1), side="left")  # texts with more than t words
    moved = np.zeros((n_words, (n_lang + 7) // 8), dtype=np.uint8)
    source = np.zeros(n_words, dtype=np.int32)
    best = by_type[types[starts[: live[0]]]].copy()
    for t in range(1, sizes[0]):
        n = live[t]
        rows = starts[:n] + t
        best_now = best[:n]
        top = best_now.argmax(axis=1)
        change = best_now[np.arange(n), top] - switch
        moved[rows], source[rows] = np.packbits(best_now < change[:, None], axis=1), top
        best[:n] = np.maximum(best_now, change[:, None]) + by_type[types[rows]]
    state = best.argmax(axis=1).astype(np.int32)
    for t in range(sizes[0] - 1, -1, -1):
        n = live[t]
        rows = starts[:n] + t
        path[rows] = state[:n]
        if t:
            away = moved[rows, state[:n] >> 3] >> (7 - (state[:n] & 7)) & 1
            state[:n] = np.where(away, source[rows], state[:n])
    return path


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, kind, key, n): a task's trigrams and letters by script."""
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}

    def held() -> Iterator[pa.RecordBatch]:
        for kind, found in (("gram", grams), ("script", scripts)):
            for lang, sums in found.items():
                keys = np.flatnonzero(sums)
                yield pa.record_batch(
                    [pa.array([lang] * len(keys), pa.string()), pa.array([kind] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(sums[keys].astype(np.int64))],
                    ["lang", "kind", "key", "n"],
                )
            found.clear()

    for batch in pieces(batches):
        langs = np.asarray(batch.column(0).to_pylist(), dtype=object)
        for lang in set(langs):
            if lang not in grams and len(grams) >= HELD_LANGUAGES:
                yield from held()
            texts = Words(batch.column(1).filter(pa.array(langs == lang)))
            types = WordTypes(texts)
            packed, bounds = types.trigrams()
            times = np.repeat(np.bincount(types.inverse, minlength=len(types.index)), np.diff(bounds))
            grams.setdefault(lang, np.zeros(CLASSES**3))[:] += np.bincount(packed, times, CLASSES**3)
            scripts.setdefault(lang, np.zeros(len(SCRIPTS)))[:] += np.bincount(texts.script, minlength=len(SCRIPTS))
    yield from held()


def learn(docs: DataFrame, most: int = LEARN_DOCS) -> Scorer | None:
    """A scorer of the labelled rows of ``docs`` (doc_id, text, lang) that aren't held out; None without any.

    Of a language with more than ``most`` rows about that many are read: those whose id hashes below most / rows.
    """
    learned = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = learned.groupBy("lang").count().collect()
    if not rows:
        return None
    languages = sorted(r["lang"] for r in rows)
    fractions = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, most / r["count"])) for r in rows], "l string, fraction double")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit("learn:"), F.col("doc_id").cast("string"))), 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
    sample = learned.join(F.broadcast(fractions), F.col("lang") == F.col("l")).where(draw < F.col("fraction"))
    counted = sample.select("lang", "text").mapInArrow(_count, "lang string, kind string, key long, n long")
    number = F.broadcast(docs.sparkSession.createDataFrame([(x, i) for i, x in enumerate(languages)], "lang string, number int"))
    counts = counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")).join(number, "lang")
    # A row for each language's trigrams and scripts, three numbers each.
    found = counts.select("number", (F.col("kind") == "gram").alias("is_gram"), F.col("key").cast("int"), "n").toArrow()
    where, key, n = (found.column(c).to_numpy() for c in ("number", "key", "n"))
    is_gram = found.column("is_gram").to_numpy()
    scripts = np.zeros((len(languages), len(SCRIPTS)))
    scripts[where[~is_gram], key[~is_gram]] = n[~is_gram]
    return Scorer(languages, where[is_gram], key[is_gram], n[is_gram], scripts)


def label_languages(docs: DataFrame, scorer: Scorer | None, switch: float = SWITCH, spans: bool = True) -> DataFrame:
    """doc_id, lang_pred, score and, with ``spans``, array<struct<start, end, lang>> (code points, from the start of the
    span's first word to the end of its last) of every text.

    Only the text is looked at. Words' scores are sums of log rates of byte trigrams; languages that hardly use the word's script
    aren't candidates. The best path through all words pays ``switch`` for each change of language. lang_pred has most of the
    words with letters (of a tie the first by name), score is its share of them. A text that is null or has no letter, and any
    text where no language was learned, is "und" with score 0 and no spans. Runs of scripts without blanks are cut into words of CUT characters. Repeated rows and null ids are labelled each; other
    columns are not read; no rows give no rows. Memory is that of a piece of 1 MB of text (less with over
    WIDE_PIECES languages), or of one longer text, times the languages.
    """
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    kind = docs.schema["doc_id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value
        n_lang = len(scorer.languages) if scorer else 0
        for batch in pieces(batches, size=PIECE * WIDE_PIECES // max(WIDE_PIECES, n_lang)):
            column = batch.column(1)
            texts = Words(column)
            und = np.array([t is None or not LETTER.search(t) for t in column.to_pylist()], dtype=bool) | (n_lang == 0)
            preds, scores, found = ["und"] * texts.n, np.zeros(texts.n), [None] * texts.n
            if n_lang:
                types = WordTypes(texts)
                by_type, letters = scorer.of_types(types)
                path = viterbi(by_type, types.inverse, texts.first, switch)
                owner, counts = texts.owner(), letters[types.inverse]
                votes = np.bincount(owner * n_lang + path, counts, texts.n * n_lang).reshape(texts.n, n_lang)
                # Letters of no known script: every word counts.
                every = np.bincount(owner * n_lang + path, minlength=texts.n * n_lang).reshape(texts.n, n_lang)
                votes = np.where(votes.sum(axis=1, keepdims=True) > 0, votes, every)
                top = votes.argmax(axis=1)
                share = votes[np.arange(texts.n), top] / np.maximum(1, votes.sum(axis=1))
                preds = ["und" if u else scorer.languages[i] for u, i in zip(und, top, strict=True)]
                scores = np.where(und, 0.0, share)
                if spans:
                    cuts = np.flatnonzero(np.concatenate([[True], (path[1:] != path[:-1]) | (owner[1:] != owner[:-1])])) if len(path) else np.zeros(0, int)
                    ends = np.append(cuts[1:], len(path))
                    found = [[] for _ in range(texts.n)]
                    of = owner[cuts]
                    before = texts.places(texts.offsets[:-1])[of]
                    low, high = texts.places(texts.starts[cuts]) - before, texts.places(texts.ends[ends - 1]) - before
                    for a, b, d, lang in zip(low.tolist(), high.tolist(), of.tolist(), path[cuts].tolist(), strict=True):
                        if not und[d]:
                            found[d].append({"start": a, "end": b, "lang": scorer.languages[lang]})
            more = [pa.array(found, span_type)] if spans else []
            yield pa.record_batch([batch.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64()), *more], ["doc_id", "lang_pred", "score"] + ["spans"] * spans)

    schema = f"doc_id {kind}, lang_pred string, score double" + ", spans array<struct<start:long,end:long,lang:string>>" * spans
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def identify_languages(docs: DataFrame, switch: float = SWITCH, most: int = LEARN_DOCS) -> DataFrame:
    """``label_languages`` of all ``docs`` (doc_id, text, lang), learned from those that aren't held out, and held_out."""
    found = label_languages(docs, learn(docs, most), switch)
    return found.withColumn("held_out", held_out(F.col("doc_id")))
