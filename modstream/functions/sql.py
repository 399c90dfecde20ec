"""The public helpers as SQL functions of a session: search_text, jaro_winkler_pct, valid_charset, parse_duration, similarity_pct, strip_color_codes, find_domains; and the
matches of a term list as a table function."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modstream.functions.fixed import BLOCKED_ENDINGS
from modstream.functions.text import COLOR_CODE, INVALID, jaro_winkler_pct, search_text
from modstream.operators.lexicon import BROADCAST_TERMS, finder
from modstream.operators.rules import domain_pattern, dot_pattern

#: name: (parameters, result, expression); expressions are inlined by Spark.
EXPRESSIONS = {
    "valid_charset": ("text STRING", "BOOLEAN", f"NOT text RLIKE r'{INVALID}'"),
    "strip_color_codes": ("text STRING", "STRING", f"regexp_replace(text, r'{COLOR_CODE}', '')"),
    "parse_duration": (
        "text STRING", "BIGINT",
        r"coalesce(try_multiply(try_cast(regexp_extract(text, r'^(\d+)([dhms]?)$', 1) AS BIGINT), CASE regexp_extract(text, r'^(\d+)([dhms]?)$', 2) WHEN 'd' THEN 86400L WHEN 'h' THEN 3600L WHEN 'm' THEN 60L ELSE 1L END), -1L)",
    ),
    "similarity_pct": (
        "a STRING, b STRING", "DOUBLE",
        "CASE WHEN lower(a) = lower(b) THEN 100D WHEN a IS NULL OR b IS NULL THEN 0D WHEN abs(length(a) - length(b)) > greatest(length(a), length(b)) * 0.4D THEN 0D "
        "ELSE (greatest(length(a), length(b)) - levenshtein(lower(a), lower(b))) / greatest(length(a), length(b)) * 100D END",
    ),
    # Of the parts of a text between its dots: each label before a dot with the first ending that the letters behind it make.
    "domains_of_parts": (
        "parts ARRAY<STRING>", "ARRAY<STRING>",
        r"array_compact(transform(transform(sequence(0, greatest(size(parts) - 2, 0)), i -> struct(regexp_extract(rtrim(get(parts, i)), r'([A-Za-z0-9_-]+)$', 1) AS label, "
        r"filter(split(lower(regexp_extract(get(parts, i + 1), r'^([\s\p{L}]*)', 1)), r'\s+'), r -> r != '') AS runs)), p -> CASE WHEN p.label != '' THEN concat(lower(p.label), '.', "
        f"get(filter(transform(sequence(1, 10), k -> array_join(slice(p.runs, 1, k), '')), g -> array_contains(array({', '.join(map(repr, BLOCKED_ENDINGS))}), g)), 0)) END))",
    ),
    "find_domains": (
        "text STRING", "ARRAY<STRING>",
        f"CASE WHEN text RLIKE r'{domain_pattern()}' THEN domains_of_parts(split(regexp_replace(regexp_replace(text, r'{dot_pattern()}', '.'), r'[\\p{{P}}\\p{{S}}]+', '.'), r'\\.')) ELSE CAST(array() AS ARRAY<STRING>) END",
    ),
}

MATCH = "word string, mode string, start int, end int, raw_start int, raw_end int"


@F.pandas_udf(T.StringType())
def _search_text(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else search_text(t))


def register_functions(spark: SparkSession) -> None:
    """Make the helpers known to ``spark.sql``, as temporary functions."""
    spark.udf.register("search_text", _search_text)
    spark.udf.register("jaro_winkler_pct", jaro_winkler_pct)
    for name, (parameters, result, expression) in EXPRESSIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {expression}")


def register_matcher(spark: SparkSession, lexicon: DataFrame, name: str = "term_matches") -> None:
    """Make ``name`` a table function: ``SELECT ... FROM texts, LATERAL name(text)`` gives the rows of ``match_terms`` for each text, in its order.

    It is a SQL function over the scalar ``name``_of, which gives a text's matches as an array, so texts go to Python in batches. For
    lists of up to BROADCAST_TERMS terms, which are broadcast; more are a ValueError. The list is that of the time of this call.
    """
    words = [tuple(r) for r in lexicon.select("word", "mode").where("word != ''").distinct().limit(BROADCAST_TERMS + 1).collect()]
    if len(words) > BROADCAST_TERMS:
        raise ValueError(f"more than {BROADCAST_TERMS} terms")
    spark.udf.register(f"{name}_of", finder(spark, words))
    columns = ", ".join(f"m.`{c.split()[0]}`" for c in MATCH.split(", "))
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(text STRING) RETURNS TABLE({MATCH}) RETURN SELECT {columns} FROM explode({name}_of(text)) AS e(m)")
