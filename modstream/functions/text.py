"""Scalar text functions: columns in, columns out. Python runs only for values that no built-in function covers."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modstream.functions.fixed import DIGIT_LETTERS, INVISIBLE, LOOKALIKES, SAFE_TAGS

COLOR_CODE = "(?s)[§&](?:#.{6}|[0-9a-fA-Fk-orRxX])"
ASCII = "^[\\x00-\\x7F]*$"
MARKS = "[\\p{Mn}\\p{Mc}]"
FOREIGN_LETTER = "[\\p{L}&&[^\\p{InBasicLatin}\\p{InLatin-1Supplement}\\p{InLatinExtended-A}\\p{InLatinExtended-B}]]"
INVALID = f"[{INVISIBLE}\\p{{Mn}}\\p{{Mc}}]|{FOREIGN_LETTER}"


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for each row, although ``use`` needs it inside of lambdas."""
    return F.get(F.transform(F.array(value), use), 0)


def is_ascii(text: Column) -> Column:
    return text.rlike(ASCII)


def strip_color_codes(text: Column) -> Column:
    """Without color codes: a sign and one code letter, or a sign, "#" and six characters."""
    return F.regexp_replace(text, COLOR_CODE, "")


def _letters(char: str) -> str:
    """What a character of a text counts as for search: "" or a few letters."""
    if char in INVISIBLE or unicodedata.category(char) in ("Cf", "Cc"):
        return ""
    if char.isdecimal():
        return DIGIT_LETTERS[unicodedata.decimal(char)]
    if char in LOOKALIKES:
        return LOOKALIKES[char]
    if not char.isalpha():
        return ""
    kept = (c for c in unicodedata.normalize("NFKD", char) if unicodedata.category(c) != "Mn")
    return "".join(LOOKALIKES.get(c) or c.lower() for c in kept)


class _Letters(dict):
    """What each character counts as, looked up once: for ``str.translate``."""

    def __missing__(self, code: int) -> str:
        self[code] = found = _letters(chr(code))
        return found


_LETTERS = _Letters()
_CODES = re.compile(COLOR_CODE)


def search_text(text: str) -> str:
    """Letters of ``text`` for search."""
    if "&" in text or "§" in text:
        text = _CODES.sub("", text)
    return text.translate(_LETTERS)


def search_form(text: str) -> tuple[str, list[int]]:
    """Letters of ``text`` for search, and of each the place in ``text`` that it comes from."""
    gone = set()
    if "&" in text or "§" in text:
        gone = {i for m in _CODES.finditer(text) for i in range(*m.span())}
    letters = ["" if i in gone else _LETTERS[ord(c)] for i, c in enumerate(text)]
    return "".join(letters), [i for i, found in enumerate(letters) for _ in found]


class _Codes:
    """What ``_letters`` says, and whether a character is a letter or digit, as arrays by code point that fill as characters come."""

    def __init__(self):
        n = sys.maxunicode + 1
        self.known, self.wordy = np.zeros(n, bool), np.zeros(n, bool)
        self.size, self.letter = np.zeros(n, np.uint8), np.zeros(n, np.uint32)

    def learn(self, codes: np.ndarray) -> None:
        for code in np.unique(codes[~self.known[codes]]).tolist():
            found, kind = _LETTERS[code], unicodedata.category(chr(code))
            self.known[code], self.wordy[code], self.size[code] = True, kind[0] == "L" or kind == "Nd", len(found)
            self.letter[code] = ord(found[0]) if found else 0


_CODE_TABLE: list[_Codes] = []


def search_forms(texts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``search_form`` of many texts at once: (letters, at, letter_ends, ends, wordy).

    Letters of all texts follow each other with a line end after each text's, ``letter_ends`` being where those are. ``at`` has the place of
    each letter in the texts put together, with one place more after each text, at ``ends``; ``wordy`` says which places hold letters or digits.
    """
    if not _CODE_TABLE:
        _CODE_TABLE.append(_Codes())
    table = _CODE_TABLE[0]
    codes = np.frombuffer(("\n".join(texts) + "\n").encode("utf-32-le"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
    table.learn(codes)
    sizes, wordy = table.size[codes], table.wordy[codes]
    sizes[ends] = 1
    for row in np.unique(np.searchsorted(ends, np.flatnonzero((codes == ord("&")) | (codes == ord("§"))))).tolist():
        start = ends[row] + 1 - len(texts[row]) - 1
        for m in _CODES.finditer(texts[row]):
            sizes[start + m.start() : start + m.end()] = 0
    at = np.repeat(np.arange(len(codes)), sizes) if sizes.max() > 1 else np.flatnonzero(sizes)
    letters, first = table.letter[codes[at]], np.cumsum(sizes, dtype=np.int64) - sizes
    many = np.flatnonzero(sizes > 1)
    for code in np.unique(codes[many]).tolist():
        places = first[many[codes[many] == code]]
        for i, letter in enumerate(_LETTERS[code]):
            letters[places + i] = ord(letter)
    letters[first[ends]] = ord("\n")
    return letters.tobytes().decode("utf-32-le"), at, first[ends], ends, wordy


@F.pandas_udf(T.StringType())
def _normalized_unicode(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", search_text(t)))


@F.pandas_udf(T.StringType())
def _nfkc_unicode(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def normalize_search(text: Column) -> Column:
    """Letters only, in lower case, with digits and look-alikes read as letters, without accents, blanks and signs.

    Built-in functions do all ASCII values; the Arrow function gets null for those, so it does work for the others only.
    """
    plain = F.translate(strip_color_codes(text), "0123456789", DIGIT_LETTERS)
    plain = F.lower(F.regexp_replace(plain, "[^A-Za-z]", ""))
    return F.coalesce(F.when(is_ascii(text), plain), _normalized_unicode(F.when(~is_ascii(text), text)))


#: Characters that the compatibility form leaves as they are and that don't combine: ASCII and most Latin letters.
STABLE = "^[\\x00-\\x9F\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0180-\u01c3\u01cd-\u01f0\u01f4-\u02af]*$"


#: Texts of such characters that can be seen, blanks and line ends: no clean-up of characters changes them.
QUIET = "^[\\n\\x20-\\x7E\u00a1-\u00a7\u00a9\u00ab\u00ac\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u0131\u0134-\u013e\u0141-\u0148\u014a-\u017e\u0180-\u01c3\u01cd-\u01f0\u01f4-\u02af]*\\z"


def unless_quiet(text: Column, use: Callable[[Column], Column]) -> Column:
    """``use(text)``, which gets null for texts that it can't change: as Spark may compute it again and again, it costs next to nothing for those."""
    quiet = text.rlike(QUIET)
    return F.when(quiet, text).otherwise(use(F.when(~quiet, text)))


def nfkc(text: Column) -> Column:
    """Compatibility form; texts that it can't change don't go to Python."""
    plain = text.rlike(STABLE)
    # What isn't deterministic is computed once: Spark would else put all of it wherever its column is read.
    return F.coalesce(F.when(plain, text), _nfkc_unicode.asNondeterministic()(F.when(~plain, text)))


@F.pandas_udf(T.StructType([T.StructField("clean", T.StringType()), T.StructField("idx", T.ArrayType(T.IntegerType()))]))
def _mapped(texts: pd.Series) -> pd.DataFrame:
    found = [search_form(t or "") for t in texts]
    return pd.DataFrame({"clean": [c for c, _ in found], "idx": [i for _, i in found]})


def clean_mapping(text: Column) -> Column:
    """struct<clean, idx>: letters for search and their places (code points from 0) in the text."""
    return _mapped(text)


def valid_charset(text: Column) -> Column:
    """No invisible characters, no combining marks, no letters beyond Latin."""
    return ~text.rlike(INVALID)


def charset_gate(text: Column) -> Column:
    """struct<blocked, reason, detected, evasion, text>: invalid texts are blocked and cut to 50 characters."""
    cut = F.when(F.length(text) > 50, F.concat(F.substring(text, 1, 50), F.lit("..."))).otherwise(text)
    bad = ~valid_charset(text)
    return F.struct(
        bad.alias("blocked"), F.when(bad, "Zalgo/Unicode").alias("reason"), F.when(bad, "Unicode").alias("detected"), bad.alias("evasion"),
        F.when(bad, cut).otherwise(text).alias("text"),
    )


def sanitize_display(text: Column) -> Column:
    return F.regexp_replace(text, MARKS, "")


def sanitize_message(text: Column) -> Column:
    """Without invisible characters but line ends and joiners, in compatibility form."""
    return unless_quiet(text, lambda t: nfkc(F.regexp_replace(t, "[\\p{Cc}\\p{Cs}\\p{Co}\\p{Cf}&&[^\\n\\u200D\\u200C]]", "")))


def strip_tags(text: Column) -> Column:
    return F.regexp_replace(text, "<[!?#/]?[a-z0-9_-]*(?::[^<>]*)?>", "")


def sanitize_control(text: Column) -> Column:
    return unless_quiet(text, lambda t: F.regexp_replace(nfkc(t), "[\\p{C}&&[^\\n\\u00A7\\u200B]]", ""))


def filter_tags(text: Column, allowed: tuple[str, ...] = SAFE_TAGS) -> Column:
    """Tags go unless their name is allowed; hex colors stay."""
    names = "|".join(allowed)
    return F.regexp_replace(text, f"</?(?!/?(?:{names}|#[0-9a-fA-F]{{6}})(?:[:>]))[!?#]?[a-z0-9_-]+(?::[^<>]*)?>", "")


def escape_placeholders(text: Column) -> Column:
    return F.replace(text, F.lit("%"), F.lit("%\u00a0"))


def sanitized(text: Column, stages: tuple[Callable[[Column], Column], ...] = (sanitize_control, filter_tags, escape_placeholders)) -> Column:
    """Any stages in order; a stage is a function from column to column."""
    for stage in stages:
        text = stage(text)
    return text


def injection_rule(text: Column, replace: bool = True) -> Column:
    """struct<hit, blocked, text, reason>: a text that the stages change is rewritten, or blocked if ``replace`` is off."""
    safe = sanitized(text)
    hit = ~safe.eqNullSafe(text)
    return F.struct(
        hit.alias("hit"), (hit & F.lit(not replace)).alias("blocked"), F.when(hit & F.lit(replace), safe).otherwise(text).alias("text"),
        F.when(hit & F.lit(not replace), "spam.injection").alias("reason"),
    )


def too_long(text: Column, n: int = 1000) -> Column:
    return F.length(text) > n


def contains_ci(source: Column, what: Column | str) -> Column:
    what = F.lit(what) if isinstance(what, str) else what
    return F.lower(source).contains(F.lower(what))


def similarity_pct(a: Column, b: Column) -> Column:
    """100 if equal without case, 0 if lengths differ by over 40 % of the longer, else the share that no edit touches."""
    longer, shorter = F.greatest(F.length(a), F.length(b)), F.least(F.length(a), F.length(b))
    edits = F.levenshtein(F.lower(a), F.lower(b))
    return (
        F.when(F.lower(a) == F.lower(b), 100.0).when(a.isNull() | b.isNull(), 0.0)
        .when(longer - shorter > longer * 0.4, 0.0).otherwise((longer - edits) / longer * 100)
    )


def jaro_winkler(a: str | None, b: str | None) -> float:
    """Jaro-Winkler in percent with the whole common prefix, scaled by at most 0.1 or one part of the longer text, from 0.7 on."""
    if a is None or b is None:
        return 0.0
    if a == b:
        return 100.0
    long, short = (a, b) if len(a) > len(b) else (b, a)
    reach = max(len(long) // 2 - 1, 0)
    taken: set[int] = set()
    pairs = []
    for i, char in enumerate(short):
        for k in range(max(i - reach, 0), min(i + reach + 1, len(long))):
            if k not in taken and long[k] == char:
                taken.add(k)
                pairs.append(char)
                break
    if not pairs:
        return 0.0
    m = len(pairs)
    swaps = sum(x != long[k] for x, k in zip(pairs, sorted(taken), strict=True)) // 2
    j = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    if j < 0.7:
        return j * 100
    prefix = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(short))
    return (j + min(0.1, 1 / len(long)) * prefix * (1 - j)) * 100


@F.pandas_udf(T.DoubleType())
def jaro_winkler_pct(a: pd.Series, b: pd.Series) -> pd.Series:
    """For pairs that a join has narrowed down: no built-in function does this."""
    return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)])


def split_command(text: Column) -> Column:
    """struct<cmd, args> of "/cmd the rest"."""
    parts = F.split(text, " ", 2)
    head = F.get(parts, 0)
    return F.struct(F.lower(F.substring(head, 2, F.length(head))).alias("cmd"), F.coalesce(F.get(parts, 1), F.lit("")).alias("args"))


def command_too_long(text: Column, n: int = 256) -> Column:
    return F.length(text) > n


def parse_duration(text: Column) -> Column:
    """Seconds of 15m, 1h, 2d, 10, ...; -1 for anything else."""
    unit = F.regexp_extract(text, "^(\\d+)([dhms]?)$", 2)
    number = F.regexp_extract(text, "^(\\d+)([dhms]?)$", 1).try_cast("long")
    factor = F.when(unit == "d", 86400).when(unit == "h", 3600).when(unit == "m", 60).otherwise(1)
    return F.coalesce(F.try_multiply(number, factor.cast("long")), F.lit(-1).cast("long"))


def format_duration(seconds: Column) -> Column:
    """2d 3h 4m; seconds only below a minute; 0s for nothing."""
    d, h, m = F.floor(seconds / 86400), F.floor(seconds % 86400 / 3600), F.floor(seconds % 3600 / 60)
    part = lambda n, unit: F.when(n > 0, F.concat(n.cast("string"), F.lit(unit)))
    return F.when(seconds <= 0, "0s").when(seconds < 60, F.concat(seconds.cast("string"), F.lit("s"))).otherwise(F.concat_ws(" ", part(d, "d"), part(h, "h"), part(m, "m")))


def short_date(ts: Column) -> Column:
    return F.date_format(ts, "dd/MM HH:mm")


def detail_map(detail: Column) -> Column:
    """map of "key: value | key: value"; values may hold colons; of equal keys the last one stands."""
    parts = F.filter(F.split(detail, "\\|"), lambda p: F.trim(p) != "")
    pairs = F.transform(parts, lambda p: F.struct(F.trim(F.get(F.split(p, ":", 2), 0)).alias("k"), F.trim(F.coalesce(F.get(F.split(p, ":", 2), 1), F.lit(""))).alias("v")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q.k == p.k))
    return F.map_from_entries(last)


def kwic(text: Column, term: Column, n: int = 10) -> Column:
    """The first word that holds ``term``, without case, with ``n`` words before and after; the whole text if there is none."""
    words = F.split(text, " ")
    at = F.array_position(F.transform(words, lambda w: F.lower(w).contains(F.lower(term))), True).cast("int")
    start = F.greatest(at - n, F.lit(1))
    return F.when(at > 0, F.array_join(F.slice(words, start, at + n - start + 1), " ")).otherwise(text)


def split_parts(text: Column) -> Column:
    return F.split(text, " \\| ")


def join_parts(parts: Column) -> Column:
    return F.array_join(parts, " | ")


def truncate(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def expand_reason(df: DataFrame, presets: Mapping[str, str], column: str = "reason") -> DataFrame:
    """``column`` with a leading preset key replaced by its text; what follows the key stays. Presets are a few settings."""
    spark = df.sparkSession
    table = F.broadcast(spark.createDataFrame([(k.lower(), v) for k, v in presets.items()], "preset_key string, preset_text string"))
    parts = F.split(F.col(column), " ", 2)
    joined = df.join(table, F.lower(F.get(parts, 0)) == F.col("preset_key"), "left")
    full = F.concat_ws(" ", F.col("preset_text"), F.get(parts, 1))
    return joined.withColumn(column, F.when(F.col("preset_text").isNotNull(), full).otherwise(F.col(column))).drop("preset_key", "preset_text")


def sanitize_label(text: Column) -> Column:
    clean = F.trim(F.regexp_replace(text, "[^A-Za-z0-9_\\-: ]", ""))
    return F.when(F.length(clean).between(2, 20), clean).otherwise("Unknown")


def alert_class(category: Column) -> Column:
    low = F.lower(category)
    return (
        F.when(low.contains("flood"), "flood").when(low.contains("ip") | low.contains("domain"), "address")
        .when(low.contains("zalgo") | low.contains("unicode"), "unicode").when(low.contains("injection"), "injection").otherwise("filter")
    )


def should_notify(category: Column, off: tuple[str, ...] = ()) -> Column:
    """Whether a violation alerts: repeats, digits, lengths and capitals never do; classes in ``off`` are switched off."""
    low = F.lower(category)
    silent = low.contains("repeat") | low.contains("digits") | low.contains("chars") | low.contains("caps")
    return F.when(category.isNull(), True).otherwise(~silent & ~alert_class(category).isin(list(off)))
