"""Queries on texts, and their SQL. Lines of documents stand for messages, a document's source for the user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modstream.functions import text as X
from modstream.functions.fixed import SAFE_TAGS
from modstream.functions.sql import register_functions, register_matcher
from modstream.operators import lexicon as L
from modstream.operators import rules as R
from modstream.operators import versions as V
from modstream.operators.names import similar_pairs
from modstream.plans.moderation import moderate
from modstream.sources import io
from modstream.streaming import state as S

TERMS = ("ther", "tion", "ung", "eaux", "cion", "arm")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = io.spread(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    rows = docs.select("doc_id", F.col("source").alias("origin"), F.posexplode(F.split("text", "\n")).alias("line_no", "text"))
    return rows.select(
        (F.col("doc_id") * 2**24 + F.col("line_no")).alias("msg_id"), F.substring("origin", 4, 10).cast("long").alias("user_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id") * 60 + F.col("line_no")).alias("ts"), F.lit("chat").alias("source"), "text", "origin", "doc_id", "line_no",
    )


LINES = r"""WITH docs AS (SELECT doc_id, source AS origin, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT doc_id * 16777216 + i AS msg_id, doc_id, i AS line_no, origin, ls[i + 1] AS text FROM (SELECT *, unnest(range(len(ls))) AS i FROM docs))
"""

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
HAS_IP = rf"(?:^|[^0-9]){OCTET}(?:\.{OCTET}){{3}}(?:$|[^0-9])"


DOT_SQL = r"'(?i)\[\s*(?:dot|point|punto)\s*\]|\(\s*(?:dot|point|punto)\s*\)|\{\s*(?:dot|point|punto)\s*\}|<\s*(?:dot|point|punto)\s*>|\b(?:dot|point|punto)\b'"
ENDINGS_SQL = str(list(R.RuleConfig().endings))
# Parts between dots; of each pair the label before the dot, and the first ending that the letters behind it make.
DOMAINS_SQL = rf"""dotted AS (SELECT msg_id, string_split(regexp_replace(regexp_replace(text, {DOT_SQL}, '.', 'g'), '[\p{{P}}\p{{S}}]+', '.', 'g'), '.') AS parts FROM lines),
pairs AS (SELECT msg_id, i, lower(regexp_extract(rtrim(parts[i]), '([A-Za-z0-9_-]+)$', 1)) AS label,
  list_filter(regexp_split_to_array(lower(regexp_extract(parts[i + 1], '^([\s\p{{L}}]*)', 1)), '\s+'), lambda r: r != '') AS runs FROM (SELECT *, unnest(range(1, len(parts))) AS i FROM dotted)),
ended AS (SELECT msg_id, i, label, list_filter(list_transform(range(1, least(len(runs), 10) + 1), lambda k: array_to_string(runs[1:k], '')), lambda g: list_contains({ENDINGS_SQL}, g))[1] AS ending FROM pairs WHERE label != ''),
domain AS (SELECT msg_id, i, label || '.' || ending AS d FROM ended WHERE ending IS NOT NULL)"""
SPELLED_SQL = LINES.replace("lines AS (", "plain AS (") + r""", lines AS (SELECT 3 * msg_id AS msg_id, text FROM plain UNION ALL SELECT 3 * page_id + 1, url FROM pages
  UNION ALL SELECT 3 * msg_id + 2, regexp_replace(text, '([a-z]{4}) ([a-z]{3,5}) ', '\1 dot c o m \2 [ punto ]n et ', 'g') FROM plain), """ + DOMAINS_SQL + """
SELECT d AS domain, count(*) AS n FROM domain WHERE d NOT IN ('google.com', 'example.com') GROUP BY 1"""


def sql_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of lines and urls, found from SQL."""
    register_functions(spark)
    texts = lines(spark, sf_dir).select("text").union(read(spark, sf_dir, "pages").select("url"))
    return spark.sql("SELECT domain, count(*) AS n FROM (SELECT explode(ds) AS domain FROM (SELECT find_domains(text) AS ds FROM {texts})) GROUP BY domain", texts=texts)


SQL_DOMAINS_SQL = LINES.replace("lines AS (", "plain AS (") + ", lines AS (SELECT 2 * msg_id AS msg_id, text FROM plain UNION ALL SELECT 2 * page_id + 1, url FROM pages), " + DOMAINS_SQL + """
SELECT d AS domain, count(*) AS n FROM domain GROUP BY 1"""


def moderation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = R.spam_chain(lines(spark, sf_dir))
    return ruled.groupBy("origin", F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"), F.sum(F.col("modified").cast("long")).alias("n_modified"))


WORD_RUN_SQL = """len(list_filter(range(1, len(w) - 2), lambda i: w[i] = w[i + 1] AND w[i] = w[i + 2] AND w[i] = w[i + 3])) > 0"""
CHAR_RUN_SQL = """len(list_filter(range(1, len(text) - 4), lambda i: text[i:i + 5] = repeat(text[i], 6))) > 0"""
VERDICTS = LINES + ", " + DOMAINS_SQL + rf""", worded AS (SELECT *, list_filter(string_split(lower(text), ' '), lambda x: x != '') AS w FROM lines),
ruled AS (SELECT *, CASE WHEN length(text) > 1000 THEN 'spam.chars' WHEN regexp_matches(text, '{HAS_IP}') THEN 'spam.ip'
  WHEN msg_id IN (SELECT msg_id FROM domain) THEN 'spam.domain' WHEN len(regexp_extract_all(text, '\p{{Nd}}')) > 7 THEN 'spam.digits' WHEN {CHAR_RUN_SQL} OR {WORD_RUN_SQL} THEN 'spam.repeat' END AS reason FROM worded)
SELECT origin, coalesce(reason, 'none') AS reason, count(*) AS n,
  sum(CASE WHEN reason IS NULL AND len(regexp_extract_all(text, '\p{{Lu}}')) > 15 THEN 1 ELSE 0 END)::BIGINT AS n_modified FROM ruled GROUP BY ALL"""


def rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return lines(spark, sf_dir).select(
        "msg_id", X.too_long(t).alias("long"), R.find_ipv4(t).isNotNull().alias("ip"), R.digit_limit(t, 7).alias("digits"), R.char_run(t, 5).alias("char_run"),
        R.word_run(t, 3).alias("word_run"), (R.caps_limit(t, 15) != t).alias("caps"), R.find_blacklisted(t, ["spam-farm.example", "th.re"]).alias("listed"),
    )


FLAGS_SQL = LINES + rf""", worded AS (SELECT *, list_filter(string_split(lower(text), ' '), lambda x: x != '') AS w FROM lines)
SELECT msg_id, length(text) > 1000 AS long, regexp_matches(text, '{HAS_IP}') AS ip, len(regexp_extract_all(text, '\p{{Nd}}')) > 7 AS digits,
  {CHAR_RUN_SQL} AS char_run, {WORD_RUN_SQL} AS word_run, len(regexp_extract_all(text, '\p{{Lu}}')) > 15 AS caps,
  nullif(regexp_extract(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), '(spamfarmexample|thre)', 1), '') AS listed FROM worded"""


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains of lines, of urls, and of lines with the word for a dot and the letters of an ending apart behind each word."""
    lined = lines(spark, sf_dir).select("text")
    urls = read(spark, sf_dir, "pages").select(F.col("url").alias("text"))
    spelled = lined.select(F.regexp_replace(F.col("text"), "([a-z]{4}) ([a-z]{3,5}) ", "$1 dot c o m $2 [ punto ]n et ").alias("text"))
    # Not "explode", for which Spark would find all domains once more beforehand, to see which texts have any.
    found = lined.union(urls).union(spelled).select(F.explode_outer(R.find_domains(F.col("text"), allowed=("google.com", "example.com"))).alias("domain"))
    return found.where("domain is not null").groupBy("domain").agg(F.count("*").alias("n"))


def ip_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines(spark, sf_dir).select("origin", R.find_ipv4(F.col("text")).alias("ip")).where("ip is not null")
    return found.groupBy("ip").agg(F.count("*").alias("n"), F.min("origin").alias("first_origin"))


IP_SQL = LINES + rf"""SELECT regexp_extract(text, '(?:^|[^0-9])({OCTET}(?:\.{OCTET}){{3}})(?:$|[^0-9])', 1) AS ip, count(*) AS n, min(origin) AS first_origin
FROM lines WHERE regexp_matches(text, '{HAS_IP}') GROUP BY 1"""


def search_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = X.normalize_search(F.col("text"))
    return lines(spark, sf_dir).select("msg_id", F.md5(form).alias("form_md5"), F.length(form).cast("long").alias("n_letters"))


FORM_SQL = r"strip_accents(lower(regexp_replace(translate(regexp_replace(text, '(?s)[§&](?:#.{6}|[0-9a-fA-Fk-orRxX])', '', 'g'), '0123456789', 'oizeasgtbg'), '[^\p{L}]', '', 'g')))"
FORMS_SQL = LINES + f"SELECT msg_id, md5({FORM_SQL}) AS form_md5, length({FORM_SQL}) AS n_letters FROM lines"


def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    h = io.spread(read(spark, sf_dir, "pages")).select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    return h.select(
        "id", F.md5(X.strip_color_codes(t)).alias("colors"), F.md5(X.sanitize_display(t)).alias("display"), F.md5(X.strip_tags(t)).alias("tags"),
        F.md5(X.escape_placeholders(t)).alias("placeholders"), X.contains_ci(t, "UTM_Source").alias("has_utm"), F.md5(X.truncate(t, 300)).alias("cut"),
    )


CLEAN_SQL = r"""SELECT page_id AS id, md5(regexp_replace(html, '(?s)[§&](?:#.{6}|[0-9a-fA-Fk-orRxX])', '', 'g')) AS colors, md5(regexp_replace(html, '[\p{Mn}\p{Mc}]', '', 'g')) AS display,
  md5(regexp_replace(html, '<[!?#/]?[a-z0-9_-]*(?::[^<>]*)?>', '', 'g')) AS tags, md5(replace(html, '%', '%' || chr(160))) AS placeholders,
  contains(lower(html), 'utm_source') AS has_utm, md5(CASE WHEN length(html) > 300 THEN substr(html, 1, 300) || '...' ELSE html END) AS cut FROM pages"""


def charset_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = lines(spark, sf_dir).select("msg_id", X.charset_gate(F.col("text")).alias("g"))
    return gate.select("msg_id", "g.blocked", "g.reason", "g.detected", F.md5("g.text").alias("text_md5"))


GATE_SQL = LINES + r""", tested AS (SELECT *, regexp_matches(text, '[\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}\x{180E}\p{Mn}\p{Mc}]')
  OR regexp_matches(regexp_replace(text, '[\x{0000}-\x{024F}]', '', 'g'), '\p{L}') AS bad FROM lines)
SELECT msg_id, bad AS blocked, CASE WHEN bad THEN 'Zalgo/Unicode' END AS reason, CASE WHEN bad THEN 'Unicode' END AS detected,
  md5(CASE WHEN bad AND length(text) > 50 THEN substr(text, 1, 50) || '...' ELSE text END) AS text_md5 FROM tested"""


def injection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = io.spread(read(spark, sf_dir, "pages")).select("page_id", X.injection_rule(F.col("html")).alias("r"), X.injection_rule(F.col("html"), False).alias("b"))
    return found.select("page_id", "r.hit", F.length("r.text").alias("n_safe"), F.col("b.blocked").alias("blocked"), F.col("b.reason").alias("reason"))


def similar_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    other = parts.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("before"))
    return parts.join(other, "p_partkey").select("p_partkey", F.round(X.similarity_pct(F.col("p_name"), F.col("before")), 6).alias("similarity"))


SIMILAR_SQL = """SELECT b.p_partkey, round(CASE WHEN lower(b.p_name) = lower(a.p_name) THEN 100.0
  WHEN abs(length(b.p_name) - length(a.p_name)) > 0.4 * greatest(length(b.p_name), length(a.p_name)) THEN 0.0
  ELSE (greatest(length(b.p_name), length(a.p_name)) - levenshtein(lower(b.p_name), lower(a.p_name))) / greatest(length(b.p_name), length(a.p_name))::DOUBLE * 100 END, 6)::DOUBLE AS similarity
FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1"""


def winkler_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    other = parts.select((F.col("p_partkey") + 1).alias("p_partkey"), F.col("p_name").alias("before"))
    return parts.join(other, "p_partkey").select("p_partkey", F.round(X.jaro_winkler_pct("p_name", "before"), 6).alias("jw"))


def similar_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of terms and part names that resemble each other."""
    names = lexicon(spark, sf_dir).select(F.col("word").alias("name")).union(read(spark, sf_dir, "part").select("p_name"))
    return similar_pairs(names, 70).select("a", "b", F.round("similarity", 6).alias("similarity"))


# The distance there counts bytes, so letters of two bytes get one of their own.
SIMILAR_TERMS_SQL = """, names AS (SELECT DISTINCT name, translate(lower(name), 'ßàáâãäåæçèéêëìíîïðñòóôõö÷øùúûüýþÿœ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ!#$%&*+=') AS low FROM (SELECT word AS name FROM lexicon UNION ALL SELECT p_name FROM part) WHERE name != ''),
pairs AS (SELECT a.name AS a, b.name AS b, greatest(length(a.name), length(b.name)) AS n, abs(length(a.name) - length(b.name)) AS d, levenshtein(a.low, b.low) AS edits FROM names a JOIN names b ON a.name < b.name)
SELECT a, b, round((n - edits) / n::DOUBLE * 100, 6)::DOUBLE AS similarity FROM pairs WHERE d <= 0.4 * n AND (n - edits) / n::DOUBLE * 100 >= 70"""


def term_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When terms hold: events add and take away their type as a term, in any order."""
    rows = read(spark, sf_dir, "events")
    mode = F.when(F.col("user_id") % 2 == 0, "STRONG").otherwise("NORMAL")
    changes = rows.select(F.col("event_type").alias("word"), mode.alias("mode"), F.col("ts").cast("timestamp").alias("at"), (F.col("event_id") % 3 != 0).alias("added"))
    found = V.changed(spark.createDataFrame([], V.VERSIONS), changes)
    return found.select("word", "mode", F.unix_micros("valid_from").alias("since"), F.unix_micros("valid_to").alias("until"))


VERSIONS_SQL = """WITH change AS (SELECT DISTINCT event_type AS word, CASE WHEN user_id % 2 = 0 THEN 'STRONG' ELSE 'NORMAL' END AS mode, epoch_us(ts) AS t, event_id % 3 != 0 AS added FROM events),
turn AS (SELECT * FROM (SELECT *, lag(added) OVER (PARTITION BY word, mode ORDER BY t, added) AS before FROM change) WHERE added != coalesce(before, false)),
span AS (SELECT *, lead(t) OVER (PARTITION BY word, mode ORDER BY t, added) AS until FROM turn)
SELECT word, mode, t AS since, until FROM span WHERE added AND (until IS NULL OR until > t)"""


def commands(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir).select("msg_id", F.concat(F.lit("/"), "text").alias("text"))
    split = rows.withColumn("c", X.split_command(F.col("text")))
    return split.select("msg_id", "c.cmd", F.md5("c.args").alias("args_md5"), X.command_too_long(F.col("text")).alias("too_long"), R.blocked_command(F.col("c.cmd")).alias("talking"))


COMMANDS_SQL = LINES + """, cut AS (SELECT msg_id, text, CASE WHEN strpos(text, ' ') > 0 THEN substr(text, 1, strpos(text, ' ') - 1) ELSE text END AS head FROM lines)
SELECT msg_id, lower(head) AS cmd, md5(substr(text, length(head) + 2)) AS args_md5, length(text) + 1 > 256 AS too_long,
  lower(head) IN ('msg', 'tell', 'w', 'whisper', 'r', 'reply', 'mail', 'me', 'say', 'nick', 'nickname', 'tags', 'rename') AS talking FROM cut"""


def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat((F.col("event_id") % 40).cast("string"), F.element_at(F.array(*map(F.lit, ["d", "h", "m", "s", "", "x"])), (F.col("event_id") % 6 + 1).cast("int")))
    rows = read(spark, sf_dir, "events").select("event_id", X.parse_duration(text).alias("seconds"), X.short_date(F.col("ts")).alias("day"))
    return rows.select("event_id", "seconds", X.format_duration(F.col("seconds") + F.col("event_id") % 97).alias("shown"), "day")


DURATIONS_SQL = """WITH parsed AS (SELECT event_id, ts, CASE event_id % 6 WHEN 0 THEN event_id % 40 * 86400 WHEN 1 THEN event_id % 40 * 3600 WHEN 2 THEN event_id % 40 * 60
    WHEN 5 THEN -1 ELSE event_id % 40 END AS seconds FROM events), shown AS (SELECT *, seconds + event_id % 97 AS s FROM parsed)
SELECT event_id, seconds, strftime(ts, '%d/%m %H:%M') AS day, CASE WHEN s <= 0 THEN '0s' WHEN s < 60 THEN s || 's' ELSE concat_ws(' ',
  CASE WHEN s >= 86400 THEN (s // 86400) || 'd' END, CASE WHEN s % 86400 >= 3600 THEN (s % 86400 // 3600) || 'h' END, CASE WHEN s % 3600 >= 60 THEN (s % 3600 // 60) || 'm' END) END AS shown FROM shown"""


def kwic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = X.kwic(F.col("text"), F.lit("the"), 3)
    return lines(spark, sf_dir).where(X.contains_ci(F.col("text"), "THE")).select("msg_id", found.alias("found"), F.size(X.split_parts(F.col("text"))).cast("long").alias("n_parts"))


KWIC_SQL = LINES + """, cut AS (SELECT *, string_split(text, ' ') AS w FROM lines WHERE contains(lower(text), 'the')),
found AS (SELECT *, list_position(list_transform(w, lambda x: contains(lower(x), 'the')), true) AS i FROM cut)
SELECT msg_id, array_to_string(w[greatest(i - 3, 1):i + 3], ' ') AS found, len(string_split(text, ' | ')) AS n_parts FROM found"""


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms: the longer words of benchmark as whole words, and a few fixed ones that count anywhere."""
    words = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", "\\s+")).alias("value"))
    return L.lexicon_of(words, "NORMAL").where(F.length("word") >= 6).unionByName(L.words_lexicon(TERMS, "STRONG", spark))


def lexicon_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexicon(spark, sf_dir)


LEXICON_SQL = rf"""terms AS (SELECT {FORM_SQL} AS word FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS text FROM benchmark) WHERE text != '' AND text NOT LIKE '#%'),
lexicon AS (SELECT DISTINCT word, 'NORMAL' AS mode FROM terms WHERE length(word) >= 6 UNION ALL SELECT unnest(['ther', 'tion', 'ung', 'eaux', 'cion', 'arm']), 'STRONG')
"""


def term_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    strong = lexicon(spark, sf_dir).withColumn("mode", F.lit("STRONG"))
    found = L.match_terms(lines(spark, sf_dir).select("msg_id", "text"), strong).select("msg_id", F.explode("matches").alias("m"))
    return found.groupBy("m.word").agg(F.count("*").alias("n"), F.countDistinct("msg_id").alias("n_lines"))


TERMS_SQL = LINES + ", " + LEXICON_SQL + rf""", forms AS (SELECT msg_id, {FORM_SQL} AS f FROM lines),
hits AS (SELECT word, msg_id, len(list_filter(range(1, length(f) - length(word) + 2), lambda i: substr(f, i, length(word)) = word)) AS n
  FROM forms, (SELECT DISTINCT word FROM lexicon) WHERE contains(f, word))
SELECT word, sum(n)::BIGINT AS n, count(*) AS n_lines FROM hits GROUP BY word"""


def sql_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``term_counts`` by the table function, from SQL."""
    register_matcher(spark, lexicon(spark, sf_dir).withColumn("mode", F.lit("STRONG")))
    return spark.sql("SELECT m.word, count(*) AS n, count(DISTINCT l.msg_id) AS n_lines FROM {lines} l, LATERAL term_matches(l.text) m GROUP BY m.word", lines=lines(spark, sf_dir).select("msg_id", "text"))


def filtered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = L.filter_texts(lines(spark, sf_dir).select("msg_id", "text"), lexicon(spark, sf_dir).where("mode = 'NORMAL'"), R.RuleConfig(evasion=False))
    return found.where(F.size("detected_words") > 0).select("msg_id", "filter_blocked", "detected_word", F.size("detected_words").alias("n_words"), F.md5("masked_text").alias("masked_md5"))


# Characters, their letters for search, and the places of the letters; then all occurrences of terms, those of whole words between
# characters that are no letters or digits; the masked text, and whether a term's letters are spread.
MATCHED_SQL = rf"""spelled AS (SELECT msg_id, text, string_split(text, '') AS c FROM lines WHERE text != ''),
lettered AS (SELECT *, list_transform(c, lambda x: {FORM_SQL.replace("text", "x")}) AS l FROM spelled),
formed AS (SELECT *, array_to_string(l, '') AS f, list_filter(range(1, len(c) + 1), lambda i: l[i] != '') AS idx FROM lettered),
occurring AS (SELECT msg_id, word, mode, c, idx, text, unnest(list_filter(range(1, length(f) - length(word) + 2), lambda i: substr(f, i, length(word)) = word)) AS s FROM formed JOIN lexicon ON contains(f, word)),
matched AS (SELECT msg_id, text, word, CASE mode WHEN 'STRONG' THEN 0 ELSE 1 END AS rank, s, s + length(word) - 1 AS e, idx[s] AS a, idx[s + length(word) - 1] AS b FROM occurring
  WHERE mode = 'STRONG' OR NOT regexp_matches(coalesce(c[idx[s] - 1], '') || coalesce(c[idx[s + length(word) - 1] + 1], ''), '[\p{{L}}\p{{Nd}}]')),
listed AS (SELECT msg_id, any_value(text) AS text, list({{'a': a, 'b': b, 'at': 0::BIGINT, 'out': ''}} ORDER BY s, rank, e, word) AS ms, first(word ORDER BY s, rank, e, word) AS detected_word, list(DISTINCT word) AS names,
  bool_or((b - a + 1 - length(word)) / (b - a + 1)::DOUBLE > 0.05) AS spread FROM matched GROUP BY msg_id),
reduced AS (SELECT *, list_reduce(ms, lambda st, m: CASE WHEN m.a > st.at THEN {{'a': m.a, 'b': m.b, 'at': m.b, 'out': st.out || substr(text, st.at + 1, m.a - st.at - 1) || '****'}} ELSE st END, {{'a': 0::BIGINT, 'b': 0::BIGINT, 'at': 0::BIGINT, 'out': ''}}) AS r FROM listed),
masked AS (SELECT *, r.out || substr(text, r.at + 1) AS masked_text FROM reduced)"""
FILTERED_SQL = LINES + ", " + LEXICON_SQL.replace("lexicon AS (", "every AS (") + ", lexicon AS (SELECT * FROM every WHERE mode = 'NORMAL'), " + MATCHED_SQL + """
SELECT msg_id, false AS filter_blocked, detected_word, len(names)::INT AS n_words, md5(masked_text) AS masked_md5 FROM masked"""

# Control and format characters, then tags whose name isn't allowed (those that are stand behind a mark meanwhile), then placeholders.
CONTROL_SQL = r"regexp_replace({}, '[\x00-\x09\x0B-\x1F\x7F-\x9F\p{{Cf}}\p{{Co}}]', '', 'g')"
SAFE_SQL = "replace(replace(regexp_replace(regexp_replace({}, '<(/?/?(?:" + "|".join(SAFE_TAGS) + r"|#[0-9a-fA-F]{{6}})[:>])', chr(1) || '\1', 'g'), '</?[!?#]?[a-z0-9_-]+(?::[^<>]*)?>', '', 'g'), chr(1), '<'), '%', '%' || chr(160))"
INJECTION_SQL = f"""WITH safe AS (SELECT page_id, html, {SAFE_SQL.format(CONTROL_SQL.format("html"))} AS s FROM pages)
SELECT page_id, s != html AS hit, length(s)::INT AS n_safe, s != html AS blocked, CASE WHEN s != html THEN 'spam.injection' END AS reason FROM safe"""

WINKLER_SQL = """WITH p AS (SELECT b.p_partkey, b.p_name AS x, a.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
j AS (SELECT *, jaro_similarity(x, y) AS j, len(list_filter(range(1, least(length(x), length(y)) + 1), lambda i: x[1:i] = y[1:i])) AS prefix FROM p)
SELECT p_partkey, round(CASE WHEN x = y THEN 100.0 WHEN j < 0.7 THEN j * 100 ELSE (j + least(0.1::DOUBLE, 1.0::DOUBLE / greatest(length(x), length(y))) * prefix * (1 - j)) * 100 END, 6)::DOUBLE AS jw FROM j"""


def moderated(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = moderate(lines(spark, sf_dir), lexicon(spark, sf_dir))
    return found.groupBy("source", "category", "blocked").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("n_users"))


def moderated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moderation without the rules that have state, line by line."""
    found = moderate(lines(spark, sf_dir), lexicon(spark, sf_dir), stateful=False)
    return found.select("msg_id", "blocked", "reason", "category", "detected", F.md5("masked").alias("masked_md5"))


MODERATED_SQL = (
    LINES.replace("lines AS (", "plain AS (") + ", " + LEXICON_SQL + ", " + MATCHED_SQL.replace("FROM lines", "FROM plain") + f""",
literal AS (SELECT msg_id, list_reduce(list_prepend(text, list_filter(ws, lambda w, i: list_position(ws, w) = i)), lambda s, w: regexp_replace(s, '(?i)' || w, '****', 'g')) AS literal_text
  FROM (SELECT msg_id, any_value(text) AS text, list(word ORDER BY s, rank, e, word) AS ws FROM matched GROUP BY msg_id)),
termed AS (SELECT plain.*, detected_word, CASE WHEN spread THEN 'Evasion' WHEN names IS NOT NULL AND len(list_filter(names, lambda x: contains(lower(plain.text), x))) = 0 THEN 'Evasion/Hidden Characters' END AS by_terms,
  coalesce(literal_text, plain.text) AS checked FROM plain LEFT JOIN masked USING (msg_id) LEFT JOIN literal USING (msg_id)),
cleared AS (SELECT *, {CONTROL_SQL.format("checked")} AS message, {SAFE_SQL.format(CONTROL_SQL.format("checked"))} AS final FROM termed),
lines AS (SELECT *, regexp_replace(final, '<[!?#/]?[a-z0-9_-]*(?::[^<>]*)?>', '', 'g') AS text FROM (SELECT * EXCLUDE (text) FROM cleared)), """
    + DOMAINS_SQL + f""", first_domain AS (SELECT msg_id, first(d ORDER BY i) AS d FROM domain GROUP BY 1), worded AS (SELECT *, list_filter(string_split(lower(text), ' '), lambda x: x != '') AS w FROM lines),
judged AS (SELECT *, CASE WHEN by_terms IS NOT NULL THEN by_terms WHEN length(checked) > 1000 THEN 'spam.chars' WHEN regexp_matches(text, '{HAS_IP}') THEN 'spam.ip' WHEN d IS NOT NULL THEN 'spam.domain'
  WHEN len(regexp_extract_all(text, '\\p{{Nd}}')) > 7 THEN 'spam.digits' WHEN {CHAR_RUN_SQL} OR {WORD_RUN_SQL} THEN 'spam.repeat' END AS reason,
  CASE WHEN len(regexp_extract_all(final, '\\p{{Lu}}')) > 15 THEN lower(final) WHEN final != message THEN final ELSE checked END AS shown FROM worded LEFT JOIN first_domain USING (msg_id))
SELECT msg_id, reason IS NOT NULL AS blocked, reason, CASE WHEN reason LIKE 'Evasion%' THEN 'Evasion' WHEN reason = 'spam.ip' THEN 'Anti-Ip' WHEN reason = 'spam.domain' THEN 'Anti-Domain' WHEN reason = 'spam.digits' THEN 'Digits'
    WHEN reason = 'spam.repeat' THEN 'Repeat' WHEN reason = 'spam.chars' THEN 'Chars' END AS category,
  CASE WHEN by_terms IS NOT NULL THEN detected_word WHEN reason = 'spam.ip' THEN regexp_extract(text, '(?:^|[^0-9])({OCTET}(?:\\.{OCTET}){{3}})(?:$|[^0-9])', 1) WHEN reason = 'spam.domain' THEN d END AS detected,
  CASE WHEN reason IS NULL THEN md5(shown) END AS masked_md5 FROM judged"""
)


def user_rule_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.user_rules(lines(spark, sf_dir), R.RuleConfig(flood_messages=30, flood_seconds=60))


def disguised_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search forms of lines whose letters are partly look-alikes of other alphabets, with invisible characters and wide letters in between."""
    hidden = F.regexp_replace(F.translate("text", "aeopcyxAEOPCX", "\u0430\u0435\u043e\u0440\u0441\u0443\u0445\u0410\u0415\u041e\u0420\u0421\u0425"), "(t|n)", "$1\u200b\ufeff\u0301")
    wide = F.translate(hidden, "birs", "\uff42\uff49\uff52\uff53")
    form = X.normalize_search(wide)
    return lines(spark, sf_dir).where("not contains(text, '&')").select("msg_id", F.md5(form).alias("form_md5"), X.valid_charset(wide).alias("valid"))


def toxic_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ruled = R.spam_chain(lines(spark, sf_dir)).groupBy("doc_id").agg(F.bool_or("blocked").alias("blocked"))
    return ruled.join(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id").groupBy("toxic", "blocked").agg(F.count("*").alias("n"))


TOXIC_SQL = VERDICTS[: VERDICTS.index("\nSELECT origin")] + """, judged AS (SELECT doc_id, bool_or(reason IS NOT NULL) AS blocked FROM ruled GROUP BY 1)
SELECT toxic, blocked, count(*) AS n FROM judged JOIN labels USING (doc_id) GROUP BY ALL"""


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumnRenamed("event_id", "msg_id")
    return S.token_bucket(events, 4, 2 * 86400).select("msg_id", "user_id", "allowed")


def _fold_sql(init: str, step: str, shape: str) -> str:
    return f"""WITH seq AS (SELECT user_id, list(epoch_us(ts) / 1000000.0 ORDER BY ts, event_id) AS ts, list(event_id ORDER BY ts, event_id) AS ids FROM events GROUP BY user_id),
folded AS (SELECT user_id, ids, list_reduce(list_transform(ts, lambda t: {shape}), lambda s, x: {step}, {init}) AS s FROM seq)
SELECT unnest(ids) AS msg_id, user_id, unnest(s.ok) AS allowed FROM folded"""


BUCKET_SQL = _fold_sql(
    "{'v': 4.0::DOUBLE, 'at': 0.0::DOUBLE, 't': 0.0::DOUBLE, 'ok': []::BOOLEAN[]}",
    "{'v': CASE WHEN least(4.0, s.v + CASE WHEN len(s.ok) = 0 THEN 0 ELSE (x.t - s.at) * 4.0 / 172800.0 END) >= 1 THEN least(4.0, s.v + CASE WHEN len(s.ok) = 0 THEN 0 ELSE (x.t - s.at) * 4.0 / 172800.0 END) - 1 ELSE s.v END, "
    "'at': CASE WHEN least(4.0, s.v + CASE WHEN len(s.ok) = 0 THEN 0 ELSE (x.t - s.at) * 4.0 / 172800.0 END) >= 1 THEN x.t ELSE s.at END, 't': x.t, "
    "'ok': list_append(s.ok, least(4.0, s.v + CASE WHEN len(s.ok) = 0 THEN 0 ELSE (x.t - s.at) * 4.0 / 172800.0 END) >= 1)}",
    "{'v': 0.0::DOUBLE, 'at': 0.0::DOUBLE, 't': t::DOUBLE, 'ok': []::BOOLEAN[]}",
)


def throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumnRenamed("event_id", "msg_id")
    return S.throttle(events, 86400).select("msg_id", "user_id", "allowed")


THROTTLE_SQL = _fold_sql(
    "{'at': -1e18::DOUBLE, 't': 0.0::DOUBLE, 'ok': []::BOOLEAN[]}",
    "{'at': CASE WHEN x.t - s.at >= 86400 THEN x.t ELSE s.at END, 't': x.t, 'ok': list_append(s.ok, x.t - s.at >= 86400)}",
    "{'at': 0.0::DOUBLE, 't': t::DOUBLE, 'ok': []::BOOLEAN[]}",
)


def rate_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.rate_cap(read(spark, sf_dir, "events").withColumnRenamed("event_id", "msg_id"), 3600, 10)


RATE_SQL = "SELECT event_id AS msg_id, row_number() OVER (PARTITION BY epoch_us(ts) // 3600000000 ORDER BY ts, event_id) <= 10 AS allowed FROM events"


def flood_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("event_id").alias("msg_id"), "user_id", "ts", F.col("event_type").alias("text"), (F.col("value") > 150).alias("denied"))
    return S.flood_context(events)


CONTEXT_SQL = """WITH e AS (SELECT *, value > 150 AS denied, coalesce(sum(CASE WHEN value > 150 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch FROM events),
c AS (SELECT *, array_to_string(list(event_type) OVER (PARTITION BY user_id, epoch ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ' | ') AS context FROM e)
SELECT event_id AS msg_id, context FROM c WHERE denied"""


def split_ip_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("event_id").alias("msg_id"), "user_id", "ts", F.floor("value").cast("string").alias("text"))
    return S.split_windows(events)


SPLIT_SQL = rf"""WITH e AS (SELECT *, array_to_string(list(floor(value)::BIGINT::VARCHAR) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), ' ') AS j FROM events)
SELECT event_id AS msg_id, regexp_matches(j, '(?:^|[^0-9]){OCTET}(?: {OCTET}){{3}}(?:$|[^0-9])') AS split_ip FROM e"""


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document as a book of lines: limits, evidence, and whether a page cancels it."""
    pages = io.spread(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", F.split("text", "\n").alias("pages"))
    limits = pages.select("doc_id", R.book_limits(F.col("pages")).alias("b"), io.evidence(F.col("pages")).alias("e"))
    stops = R.book_security(R.spam_chain(lines(spark, sf_dir)).withColumnRenamed("doc_id", "container_id"))
    return limits.join(stops, F.col("doc_id") == F.col("container_id")).select(
        "doc_id", "b.too_many", "b.too_long", F.aggregate("b.pages", F.lit(0), lambda s, p: s + F.length(p)).cast("long").alias("n_chars"), F.size("e").cast("long").alias("n_evidence"), "cancelled"
    )


BOOKS_SQL = VERDICTS[: VERDICTS.index("\nSELECT origin")] + """, stops AS (SELECT doc_id, coalesce(bool_or(contains(reason, 'ip') OR contains(reason, 'domain')), false) AS cancelled FROM ruled GROUP BY 1)
SELECT doc_id, len(ls) > 30 AS too_many, list_sum(list_transform(ls, lambda p: length(p))) > 8000 AS too_long,
  list_sum(list_transform(ls, lambda p: least(length(p), 256)))::BIGINT AS n_chars, least(len(ls), 11) AS n_evidence, cancelled FROM docs JOIN stops USING (doc_id)"""


def moderated_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("container_id"), F.col("turn").alias("page_no"), "text")
    found = L.moderate_pages(pages, lexicon(spark, sf_dir))
    return found.select("container_id", "cancelled", F.size("pages").alias("n_pages"), F.md5(F.array_join("pages", "\n")).alias("pages_md5"))


BOOK_PAGES_SQL = "WITH " + LEXICON_SQL + ", lines AS (SELECT conv_id * 1000 + turn AS msg_id, conv_id, turn, substr(text, 1, 256) AS text FROM conversations), " + MATCHED_SQL + """,
safe AS (SELECT conv_id, turn, CASE WHEN spread THEN '****' ELSE coalesce(masked_text, lines.text) END AS t FROM lines LEFT JOIN masked USING (msg_id))
SELECT conv_id AS container_id, false AS cancelled, count(*)::INT AS n_pages, md5(string_agg(t, chr(10) ORDER BY turn, t)) AS pages_md5 FROM safe GROUP BY 1"""
FORM_OF_DISGUISED_SQL = LINES + f"""SELECT msg_id, md5({FORM_SQL}) AS form_md5, NOT regexp_matches(text, '[aeopcyxAEOPCXtnbirs]') AS valid FROM lines WHERE NOT contains(text, '&')"""


def alert_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = {"click": "Anti-Flood", "view": "IP Split", "signup": "Text usage (Zalgo/Unicode)", "error": "Injection", "purchase": "Filter"}
    category = F.lit("Repeat")
    for k, v in kinds.items():
        category = F.when(F.col("event_type") == k, v).otherwise(category)
    rows = read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 11 == 0, "Caps").otherwise(category).alias("category"))
    marked = rows.select("category", X.alert_class(F.col("category")).alias("class"), X.should_notify(F.col("category"), ("flood",)).alias("notify"), io.should_log(F.col("category")).alias("log"))
    return marked.groupBy("category", "class", "notify", "log").agg(F.count("*").alias("n"))


ALERTS_SQL = """WITH c AS (SELECT CASE WHEN event_id % 11 = 0 THEN 'Caps' ELSE CASE event_type WHEN 'click' THEN 'Anti-Flood' WHEN 'view' THEN 'IP Split' WHEN 'signup' THEN 'Text usage (Zalgo/Unicode)'
    WHEN 'error' THEN 'Injection' WHEN 'purchase' THEN 'Filter' ELSE 'Repeat' END END AS category FROM events)
SELECT category, CASE category WHEN 'Anti-Flood' THEN 'flood' WHEN 'IP Split' THEN 'address' WHEN 'Text usage (Zalgo/Unicode)' THEN 'unicode' WHEN 'Injection' THEN 'injection' ELSE 'filter' END AS class,
  category NOT IN ('Anti-Flood', 'Caps') AS notify, category NOT IN ('Caps', 'Filter') AS log, count(*) AS n FROM c GROUP BY ALL"""

QUERIES = {
    f.__name__: f
    for f in (
        moderation_verdicts, rule_flags, domains, ip_addresses, search_forms, clean_texts, charset_gate, injection, similar_names, winkler_names, commands, durations, kwic_lines,
        lexicon_words, term_counts, filtered_lines, moderated, moderated_texts, disguised_forms, user_rule_flags, toxic_verdicts, token_bucket, throttled, rate_capped, flood_contexts, split_ip_windows, books, moderated_books, alert_classes, similar_terms, term_versions, sql_domains, sql_terms,
    )
}

ORACLE_SQL = {
    "moderation_verdicts": VERDICTS, "rule_flags": FLAGS_SQL, "ip_addresses": IP_SQL, "search_forms": FORMS_SQL, "clean_texts": CLEAN_SQL, "charset_gate": GATE_SQL, "similar_names": SIMILAR_SQL,
    "commands": COMMANDS_SQL, "durations": DURATIONS_SQL, "kwic_lines": KWIC_SQL, "lexicon_words": "WITH " + LEXICON_SQL + "SELECT word, mode FROM lexicon", "term_counts": TERMS_SQL, "toxic_verdicts": TOXIC_SQL,
    "domains": SPELLED_SQL, "filtered_lines": FILTERED_SQL, "moderated_texts": MODERATED_SQL, "injection": INJECTION_SQL, "winkler_names": WINKLER_SQL, "moderated_books": BOOK_PAGES_SQL, "disguised_forms": FORM_OF_DISGUISED_SQL,
    "token_bucket": BUCKET_SQL, "throttled": THROTTLE_SQL, "rate_capped": RATE_SQL, "flood_contexts": CONTEXT_SQL, "split_ip_windows": SPLIT_SQL, "books": BOOKS_SQL, "alert_classes": ALERTS_SQL, "similar_terms": "WITH " + LEXICON_SQL + SIMILAR_TERMS_SQL, "term_versions": VERSIONS_SQL, "sql_domains": SQL_DOMAINS_SQL, "sql_terms": TERMS_SQL,
}
