"""The queries of this subpackage: each operator over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modstream.llm import centroids, embeddings, language, licenses, mixing, quality, secrets, sentencepieces, simhash, spelling, substrings, topk, url_filter
from modstream.llm.common import table

# Values of the queries that are to equal those of other implementations.
WORDS_SQL = r"[^\x20\x09-\x0D]+"


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
keyed AS (
  SELECT doc_id, source, size,
    -ln((('0x' || md5('mix:' || coalesce(doc_id::VARCHAR, 'null'))[1:13])::BIGINT::DOUBLE + 0.5) / 4503599627370496.0)
    / CASE WHEN length(t) / greatest(size, 1) BETWEEN 3 AND 12 THEN 1.0::DOUBLE ELSE 0.25::DOUBLE END AS key
  FROM sized),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
weighed AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w, source_size * 2.0::DOUBLE AS most FROM sizes),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(most) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY most / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
level1 AS (SELECT min_by(level, most / w) AS level FROM levels WHERE level * w < most),
targets AS (SELECT source, source_size, least(most, coalesce((SELECT level FROM level1) * w, most)) AS target FROM weighed),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
taken AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs, floor(p.target - p.epochs * p.source_size)::BIGINT AS part,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM keyed k JOIN parts p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (epochs * size + greatest(0, least(size, part - before)))::BIGINT AS taken FROM taken
"""


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode(table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify_languages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


OP5_SQL = r"""
WITH rests AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1), '') AS path FROM rests),
judged AS (
  SELECT *, CASE
    WHEN ends_with('.' || host, '.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN ends_with('.' || host, '.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN ends_with('.' || host, '.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN ends_with('.' || host, '.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.fingerprint_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link_embeddings(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(table(spark, sf_dir, "documents")).drop("digest")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda p: p.kind.isin("assign", "access", "hex"))
    count = lambda kind: F.size(F.filter("spans", lambda p: p.kind == kind)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.spans_text(base), 256).alias("base_sha256"), secrets.spans_text(F.col("spans")).alias("spans"),
    )


def op11_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(table(spark, sf_dir, "embeddings"))


_TOKEN_SQL = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
_TEMPLATES_SQL = ", ".join(f"({n}, {t[0]!r}, {len(licenses.tokens(t[1]))}, {sorted(set(licenses.tokens(t[1])))!r}, {licenses.tokens(t[2])!r}, {licenses.tokens(' '.join(t[3:]))!r}::VARCHAR[])" for n, t in enumerate(licenses.TEMPLATES))
OP3_SQL = rf"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc_id, regexp_extract_all(t, {_TOKEN_SQL}) AS w FROM d),
places AS (
  SELECT doc_id, w, list_filter(range(1, len(w)), lambda i: w[i] = 'mit' AND w[i + 1] = 'license') AS m,
    list_filter(range(1, len(w)), lambda i: w[i] = 'apache' AND w[i + 1] = 'license') AS a,
    list_filter(range(1, len(w) - 1), lambda i: w[i] = 'general' AND w[i + 1] = 'public' AND w[i + 2] = 'license') AS g FROM w),
templates(template, label, size, own, must, never) AS (VALUES {_TEMPLATES_SQL}),
parts AS (SELECT template, label, ceil(1.5 * size)::BIGINT AS length, len(own) AS n_own, ceil(0.8::DOUBLE * len(own) - 1e-9) AS need, len(must) AS n_must, unnest(list_concat(own, never)) AS x, list_contains(must, x) AS is_must, list_contains(never, x) AS is_never FROM templates),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w),
hit AS (SELECT doc_id, template, i, x, is_must, is_never, length, n_own, need, n_must, label FROM word JOIN parts USING (x)),
likely AS (SELECT doc_id, template FROM hit GROUP BY ALL HAVING count(DISTINCT CASE WHEN NOT is_never THEN x END) >= any_value(need) AND count(DISTINCT CASE WHEN is_must THEN x END) = any_value(n_must)),
wanted AS (SELECT hit.* FROM hit JOIN likely USING (doc_id, template)),
block AS (
  SELECT s.doc_id, s.template, s.i, any_value(s.label) AS label, count(DISTINCT e.x) / any_value(s.n_own)::DOUBLE AS share FROM wanted s JOIN wanted e
  ON s.doc_id = e.doc_id AND s.template = e.template AND e.i >= s.i AND e.i < s.i + s.length GROUP BY s.doc_id, s.template, s.i
  HAVING NOT bool_or(e.is_never) AND count(DISTINCT e.x) >= any_value(s.need) AND count(DISTINCT CASE WHEN e.is_must THEN e.x END) = any_value(s.n_must)),
found AS (SELECT doc_id, list(DISTINCT label) AS ls, max(share) AS best FROM block GROUP BY doc_id),
joined AS (
  SELECT p.*, list_concat(m, a, g) AS al, [x for x in [CASE WHEN len(m) > 0 THEN 'mit' END, CASE WHEN len(a) > 0 THEN 'apache' END, CASE WHEN len(g) > 0 THEN 'gpl' END] if x IS NOT NULL] AS base, ls, best
  FROM places p LEFT JOIN found USING (doc_id))
SELECT doc_id, len(w)::BIGINT AS n_words, len(al)::BIGINT AS n_base, list_min(al) - 1 AS first_word, list_max(al) - 1 AS last_word,
  array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(ls, [])))), ',') AS labels,
  CASE WHEN len(al) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score FROM joined
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 48, 1))) AS i FROM d)),
least_doc AS (SELECT k, min(doc_id) AS m FROM win GROUP BY k),
starts AS (SELECT doc_id, i FROM win JOIN least_doc USING (k) WHERE m < doc_id),
covered AS (SELECT DISTINCT doc_id, i + j AS p FROM starts, range(50) AS r(j)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS s, count(*) AS n FROM word ANTI JOIN covered USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id != b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_id AS (SELECT a, min(b) AS m FROM reach GROUP BY a), counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, least(vec_id, coalesce(m, vec_id)) AS component_id, vec_id <= coalesce(m, vec_id) AS kept
FROM embeddings LEFT JOIN least_id l ON l.a = vec_id LEFT JOIN counts c ON c.a = vec_id
"""

_ASSIGN_SQL = r"""'(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""
_HITS_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{kind}' AS found, regexp_extract_all(t, {pattern}) AS h, regexp_split_to_array(t, {pattern}) AS g FROM d"
    for kind, pattern in (
        ("assign", _ASSIGN_SQL), ("access", "'AKIA[A-Z0-9]+'"), ("hex", "'[0-9a-f]+'"), ("endpoint", "'[a-z]+://[A-Za-z0-9.-]+(?::[0-9]+)?'"),
        ("ident", r"""'(?i)(?:user_?name|user|login|account|client_?id)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9_.@-]{3,}'"""),
    )
)
# Strong parts stand alone; a weak one needs a part of the other roles that starts within 200 code points.
OP10_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), hits AS ({_HITS_SQL}),
placed AS (SELECT doc_id, found, h[i] AS m, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM hits WHERE len(h) > 0)),
sized AS (SELECT *, s + length(m) AS e, CASE found WHEN 'assign' THEN length(regexp_extract(m, {_ASSIGN_SQL}, 2)) ELSE length(m) END AS n FROM placed),
parts AS (SELECT doc_id, s, e, CASE WHEN found = 'assign' AND n BETWEEN 6 AND 11 THEN 'short' ELSE found END AS kind FROM sized
  WHERE CASE found WHEN 'assign' THEN n >= 6 WHEN 'access' THEN n >= 18 WHEN 'hex' THEN n >= 16 ELSE true END),
roled AS (SELECT *, CASE WHEN kind IN ('access', 'ident') THEN 'id' WHEN kind = 'endpoint' THEN kind ELSE 'secret' END AS role FROM parts),
linked AS (SELECT a.doc_id, a.s, a.e, a.kind, bool_or(b.role = 'id') AS by_id, bool_or(b.role = 'secret') AS by_secret FROM roled a JOIN roled b ON a.doc_id = b.doc_id AND abs(a.s - b.s) <= 200 AND a.role != b.role
  WHERE a.kind IN ('ident', 'short', 'endpoint') GROUP BY ALL),
spans AS (SELECT doc_id, s, e, kind FROM parts WHERE kind IN ('assign', 'access', 'hex')
  UNION ALL SELECT doc_id, s, e, kind FROM linked WHERE CASE kind WHEN 'ident' THEN by_secret WHEN 'short' THEN by_id ELSE by_id AND by_secret END),
ranked AS (SELECT *, list_position(['assign', 'access', 'hex', 'ident', 'short', 'endpoint'], kind) AS rank, kind || ':' || s || ':' || e AS x FROM spans),
joined AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(x, ',' ORDER BY s, rank, e) FILTER (rank <= 3) AS base, string_agg(x, ',' ORDER BY s, rank, e) AS spans FROM ranked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN joined USING (doc_id)
"""

# Vectors without nulls and non-finite numbers as whole ones.
_WHOLE_SQL = "SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)::BIGINT) AS e FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0"
OP11_SQL = f"""
WITH v AS ({_WHOLE_SQL}),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id != c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score FROM pairs QUALIFY rank <= 5
"""

# CRC-32 by a table of 256 values, made from its polynomial.
OP12_SQL = r"""
WITH RECURSIVE crc(tbl) AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))),
runs AS (SELECT coalesce(doc_id::VARCHAR, 'null') AS d, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT d, run, count(*) AS c, hex(d || ':' || run) AS x FROM runs GROUP BY d, run),
hashed AS (SELECT run, c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1]))) AS h FROM counted, crc),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, c FROM hashed),
words AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
places AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT *, unnest(range(length(word)))::INT AS i FROM words)),
one_way AS (
  SELECT x.word, x.n, y.word AS other, y.n AS m FROM places x JOIN places y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word != y.word
  UNION SELECT p.word, p.n, w.word, w.n FROM places p JOIN words w ON w.word = p.a || p.b),
near AS (SELECT * FROM one_way UNION SELECT other, m, word, n FROM one_way),
best AS MATERIALIZED (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, CASE WHEN m >= 2 * n THEN other END AS form, CASE WHEN m >= 2 * n THEN m END AS form_n FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
ways AS (SELECT word, form AS at FROM best WHERE form IS NOT NULL UNION ALL SELECT w.word, b.form FROM ways w JOIN best b ON w.at = b.word WHERE b.form IS NOT NULL),
roots AS (SELECT w.word, w.at AS root FROM ways w LEFT JOIN best b ON w.at = b.word WHERE b.form IS NULL)
SELECT w.word, form, coalesce(root, w.word) AS root, w.n, coalesce(n_near, 0)::BIGINT AS n_near, form_n FROM words w LEFT JOIN best USING (word) LEFT JOIN roots USING (word)
"""

_NEAREST_SQL = "SELECT vec_id, any_value(v.e) AS e, min({{'d': list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'j': c.j}}) AS m FROM v, c{0} c GROUP BY vec_id"
_ROUNDS_SQL = ",\n".join(
    f"a{r} AS MATERIALIZED ({_NEAREST_SQL.format(r)}),\n"
    f"c{r + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.e, c.e) AS e FROM c{r} c LEFT JOIN (SELECT j, list(f ORDER BY i) AS e FROM (SELECT m.j AS j, i, floor(sum(x)::DOUBLE / count(*)::DOUBLE)::BIGINT AS f FROM (SELECT m, unnest(e) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY m.j, i) GROUP BY j) m USING (j))"
    for r in range(5)
)
OP13_SQL = f"""
WITH v AS MATERIALIZED ({_WHOLE_SQL} AND len(embedding) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS j, e FROM v ORDER BY sha256('2:' || vec_id) LIMIT 40),
{_ROUNDS_SQL},
final AS MATERIALIZED ({_NEAREST_SQL.format(5)})
SELECT vec_id, m.j::INT AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.j))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c5.e, ',')) AS centroid_sha256 FROM final JOIN c5 ON c5.j = m.j
"""

QUERIES = {"op1_mixing": op1_mixing, "op2_sentencepiece": op2_sentencepiece, "op3_licenses": op3_licenses, "op4_language": op4_language, "op5_url_filter": op5_url_filter, "op6_substrings": op6_substrings, "op7_simhash": op7_simhash, "op8_embeddings": op8_embeddings, "op9_quality": op9_quality, "op10_secrets": op10_secrets, "op11_topk": op11_topk, "op12_spelling": op12_spelling, "op13_centroids": op13_centroids}

ORACLE_SQL = {"op1_mixing": OP1_SQL, "op3_licenses": OP3_SQL, "op5_url_filter": OP5_SQL, "op6_substrings": OP6_SQL, "op8_embeddings": OP8_SQL, "op10_secrets": OP10_SQL, "op11_topk": OP11_SQL, "op12_spelling": OP12_SQL, "op13_centroids": OP13_SQL}
