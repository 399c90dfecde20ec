"""Queries on moderation tables, and their SQL. Customers stand for users, their orders for sanctions, events for actions."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modstream.functions import text as X
from modstream.operators import lexicon as L
from modstream.operators import reports as P
from modstream.operators import tables as T
from modstream.plans.catalog_text import FORM_SQL, LEXICON_SQL, lexicon, read
from modstream.sources import io
from modstream.sources.days import append_days, day_of, purge_days, read_days
from modstream.sources.shared import shared_dir

NOW_SQL = "TIMESTAMP '1998-06-01 00:00:00'"
PURGED_AT = dt.datetime(2024, 1, 25, 10, 30, tzinfo=dt.UTC)


def now():
    return F.lit("1998-06-01 00:00:00").cast("timestamp")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "customer")
    return rows.select(F.col("c_custkey").alias("id"), F.concat(F.lit("u-"), F.col("c_custkey").cast("string")).alias("uuid"), F.col("c_name").alias("name"), now().alias("last_seen"))


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orders(spark, sf_dir).select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("player_id"), F.col("o_orderstatus").alias("reason"), F.col("o_orderpriority").alias("moderator"),
        (F.col("o_orderkey") % 40 * 86400).alias("duration"), F.col("o_orderdate").alias("created_at"), F.when(F.col("o_orderstatus") == "F", "GLOBAL").otherwise("CHAT").alias("scope"),
    )


HISTORY = """hist AS (SELECT o_orderkey AS id, o_custkey AS player_id, o_orderstatus AS reason, o_orderpriority AS moderator, o_orderkey % 40 * 86400 AS duration, o_orderdate AS created_at,
  CASE WHEN o_orderstatus = 'F' THEN 'GLOBAL' ELSE 'CHAT' END AS scope FROM orders)"""


def muted(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = history(spark, sf_dir).withColumnRenamed("duration", "seconds").drop("id")
    return T.apply_mutes(spark.createDataFrame([], "player_id long, reason string, muted_by string, expires_at timestamp, created_at timestamp, scope string"), T.latest(new, "player_id", "created_at", "seconds", "reason", "moderator"))


MUTED = HISTORY + """, muted AS (SELECT player_id, reason, moderator AS muted_by, CASE WHEN duration > 0 THEN created_at + to_seconds(duration) END AS expires_at, created_at, scope FROM hist
  QUALIFY row_number() OVER (PARTITION BY player_id ORDER BY created_at DESC, duration DESC, reason DESC, moderator DESC) = 1)"""


def suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.element_at(F.array(F.lit("pending"), F.lit("accepted"), F.lit("rejected")), (F.col("p_partkey") % 3 + 1).cast("int"))
    return read(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), (F.col("p_partkey") % 100).alias("player_id"), F.col("p_name").alias("suggestion"), F.col("p_type").alias("reason"), status.alias("status"),
        F.timestamp_seconds(F.lit(890_000_000) + F.col("p_partkey") * 3600).alias("created_at"),
    )


SUGGESTIONS = """sugg AS (SELECT p_partkey AS id, p_partkey % 100 AS player_id, p_name AS suggestion, p_type AS reason, ['pending', 'accepted', 'rejected'][(p_partkey % 3 + 1)::INT] AS status,
  make_timestamp((890000000 + p_partkey * 3600) * 1000000) AS created_at FROM part)"""


def pending_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.pending_words(suggestions(spark, sf_dir), players(spark, sf_dir)).groupBy("word", "uuid").agg(F.count("*").alias("n"))


def named_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = history(spark, sf_dir).withColumn("player_id", F.when(F.col("id") % 50 == 0, F.col("player_id") + 10_000_000).otherwise(F.col("player_id")))
    return T.with_names(rows, players(spark, sf_dir)).select("id", "name")


def ids_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = read(spark, sf_dir, "customer").select(F.upper("c_name").alias("name")).union(read(spark, sf_dir, "supplier").select("s_name"))
    return T.ids_of_names(names, players(spark, sf_dir)).select("name", F.coalesce("id", F.lit(-1)).alias("id"))


def mute_enforcement(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    source = F.when(F.col("o_orderkey") % 2 == 0, "chat").otherwise("sign")
    messages = rows.select(F.col("o_orderkey").alias("msg_id"), F.col("o_custkey").alias("user_id"), (F.col("o_orderdate") + F.expr("interval 15 days")).alias("ts"), source.alias("source"))
    found = T.enforce_mutes(messages, T.mute_intervals(history(spark, sf_dir)))
    return found.select("msg_id", "muted")


MUTES_SQL = "WITH " + HISTORY + """, iv AS (SELECT player_id, scope, created_at AS a, least(CASE WHEN duration > 0 THEN created_at + to_seconds(duration) END,
    lead(created_at) OVER (PARTITION BY player_id ORDER BY created_at, id)) AS b, id FROM hist),
msg AS (SELECT o_orderkey AS msg_id, o_custkey AS user_id, o_orderdate + INTERVAL 15 DAY AS ts, CASE WHEN o_orderkey % 2 = 0 THEN 'chat' ELSE 'sign' END AS source FROM orders)
SELECT msg_id, coalesce(bool_or(a IS NOT NULL AND (scope = 'GLOBAL' OR source = 'chat')), false) AS muted FROM msg LEFT JOIN iv ON player_id = user_id AND ts >= a AND (b IS NULL OR ts < b) GROUP BY msg_id"""


def permissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    grants = read(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("user_id"), F.col("n_name").alias("permission"))
    parents = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("permission"), F.col("r_name").alias("includes"))
    flat = T.flat_permissions(grants, parents)
    users = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return T.exempt(users, flat, "AMERICA").join(flat, "user_id").select("user_id", "exempt", F.array_join("permissions", ",").alias("held"))


def login(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.login_snapshot(players(spark, sf_dir), muted(spark, sf_dir), now()).select("id", "name", "scope", F.coalesce(F.unix_seconds("expires_at"), F.lit(-1)).alias("until"), "mute_reason")


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = players(spark, sf_dir).where("id % 2 = 0")
    new = players(spark, sf_dir).where("id % 3 = 0").drop("id")
    return T.register_users(known, new.union(new)).select("id", "uuid", "name")


def mute_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = players(spark, sf_dir).where("id % 7 = 0").select(F.col("id").alias("player_id"))
    now_muted = T.apply_unmutes(muted(spark, sf_dir), gone)
    return T.mute_status(players(spark, sf_dir).select(F.col("id").alias("player_id")), now_muted, now())


def expired_mutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    active, audit = T.expire_mutes(muted(spark, sf_dir), now())
    return active.groupBy("scope").agg(F.count("*").alias("n")).select(F.lit("active").alias("what"), "scope", "n").union(
        audit.groupBy("detail").agg(F.count("*").alias("n")).select(F.lit("audit"), "detail", "n")
    )


def sanctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.element_at(F.array(*map(F.lit, ["MUTE", "TEMPMUTE", "PERMUTE", "API_MUTE", "AUTO", "NONE"])), (F.col("event_id") % 6 + 1).cast("int"))
    rows = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("player_id"), kinds.alias("kind"), F.when(F.col("event_id") % 5 == 0, "bad").otherwise("15m").alias("duration"),
        F.concat_ws(" ", "event_type", F.lit("again")).alias("reason"), F.lit("staff").alias("moderator"), F.col("ts").cast("timestamp").alias("created_at"),
    )
    return T.sanction_rows(rows, {"Click": "Clicking too much,", "error": "Errors:"}).select("id", "player_id", "scope", "seconds", "reason")


SANCTIONS_SQL = """WITH k AS (SELECT *, ['MUTE', 'TEMPMUTE', 'PERMUTE', 'API_MUTE', 'AUTO', 'NONE'][(event_id % 6 + 1)::INT] AS kind FROM events),
s AS (SELECT *, CASE WHEN kind = 'NONE' THEN NULL WHEN kind = 'PERMUTE' THEN 'GLOBAL' ELSE 'CHAT' END AS scope, CASE WHEN kind IN ('MUTE', 'PERMUTE', 'API_MUTE') THEN 0 WHEN event_id % 5 = 0 THEN -1 ELSE 900 END AS seconds FROM k)
SELECT event_id AS id, user_id AS player_id, scope, seconds, CASE event_type WHEN 'click' THEN 'Clicking too much,' WHEN 'error' THEN 'Errors:' ELSE event_type END || ' again' AS reason FROM s WHERE seconds >= 0 AND scope IS NOT NULL"""


def purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {"suggestions": (suggestions(spark, sf_dir), "created_at"), "mute_history": (history(spark, sf_dir), "created_at")}
    kinds = [T.purge_counts(tables, k, 30 * 86400, now()).select(F.lit(k).alias("kind"), "purged") for k in ("sg", "hp", "all", "zz")]
    kept = T.retention(suggestions(spark, sf_dir), history(spark, sf_dir), now())
    rows = [k.agg(F.count("*").alias("purged")).select(F.lit(n).alias("kind"), "purged") for n, k in zip(("kept sg", "kept hp"), kept, strict=True)]
    out = kinds[0]
    for df in kinds[1:] + rows:
        out = out.union(df)
    return out


PURGE_SQL = "WITH " + HISTORY + ", " + SUGGESTIONS + f""", s AS (SELECT count(*) AS n FROM sugg WHERE created_at < {NOW_SQL} - INTERVAL 30 DAY), h AS (SELECT count(*) AS n FROM hist WHERE created_at < {NOW_SQL} - INTERVAL 30 DAY)
SELECT 'sg' AS kind, n AS purged FROM s UNION ALL SELECT 'hp', n FROM h UNION ALL SELECT 'all', s.n + h.n FROM s, h UNION ALL SELECT 'zz', 0
UNION ALL SELECT 'kept sg', count(*) FROM sugg WHERE created_at >= {NOW_SQL} - INTERVAL 72 HOUR UNION ALL SELECT 'kept hp', count(*) FROM hist WHERE created_at >= {NOW_SQL} - INTERVAL 7 DAY"""


def submitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = suggestions(spark, sf_dir).where("id % 2 = 0")
    new = suggestions(spark, sf_dir).where("id % 2 = 1").select("player_id", F.upper("suggestion").alias("suggestion"), "reason", "created_at")
    return T.submit_suggestions(old, new).select("id", "player_id", "suggestion", "status")


SUBMIT_SQL = "WITH " + SUGGESTIONS + """, old AS (SELECT * FROM sugg WHERE id % 2 = 0),
fresh AS (SELECT player_id, upper(suggestion) AS suggestion, created_at FROM sugg n WHERE id % 2 = 1 AND length(suggestion) <= 20 AND length(reason) <= 100
  AND NOT EXISTS (FROM old WHERE status = 'pending' AND lower(old.suggestion) = lower(n.suggestion)) QUALIFY row_number() OVER (PARTITION BY lower(suggestion) ORDER BY created_at, player_id, suggestion) = 1)
SELECT id, player_id, suggestion, status FROM old UNION ALL SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY created_at, suggestion), player_id, suggestion, 'pending' FROM fresh"""


def reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = suggestions(spark, sf_dir).where("id % 5 = 0").select("id", (F.col("id") % 2 == 0).alias("accepted"), F.lit("staff").alias("staff_name"), now().alias("timestamp"))
    after, words, audit = T.review_suggestions(suggestions(spark, sf_dir), decisions)
    states = after.groupBy("status").agg(F.count("*").alias("n")).select(F.lit("suggestion").alias("what"), "status", "n")
    return states.union(words.select(F.lit("word"), "word", F.lit(1).cast("long"))).union(audit.groupBy("action").agg(F.count("*").alias("n")).select(F.lit("audit"), "action", "n"))


REVIEW_SQL = "WITH " + SUGGESTIONS + f""", d AS (SELECT *, CASE WHEN id % 5 = 0 AND status = 'pending' THEN CASE WHEN id % 2 = 0 THEN 'accepted' ELSE 'rejected' END ELSE status END AS after, id % 5 = 0 AND status = 'pending' AS done FROM sugg)
SELECT 'suggestion' AS what, after AS status, count(*) AS n FROM d GROUP BY 2 UNION ALL SELECT DISTINCT 'word', {FORM_SQL.replace("text,", "suggestion,")}, 1 FROM d WHERE done AND after = 'accepted'
UNION ALL SELECT 'audit', CASE WHEN after = 'accepted' THEN 'ACCEPT' ELSE 'DENY' END, count(*) FROM d WHERE done GROUP BY 2"""


def lexicon_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = read(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("word")).withColumn("mode", F.lit("NORMAL"))
    added = L.lexicon_add(lexicon(spark, sf_dir), new)
    return L.lexicon_remove(added, spark.createDataFrame([("R3D",), ("TION",)], "word string"))


def lexicon_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = read(spark, sf_dir, "part").select(X.normalize_search(F.col("p_name")).alias("word"), F.lit("NORMAL").alias("mode")).distinct()
    return L.lexicon_page(new, "NORMAL", 2).union(L.lexicon_page(new, "NORMAL", 10_000))


PAGES_SQL = """WITH w AS (SELECT DISTINCT replace(lower(p_name), ' ', '') AS word FROM part), r AS (SELECT row_number() OVER (ORDER BY word) AS row, word, ceil(count(*) OVER () / 20)::BIGINT AS last FROM w)
SELECT row, word, least(2, last) AS page FROM r WHERE row > (least(2, last) - 1) * 20 AND row <= least(2, last) * 20 UNION ALL SELECT row, word, last FROM r WHERE row > (last - 1) * 20"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit("Staff"), (F.col("user_id") % 5).cast("string")).alias("staff_name"), F.upper("event_type").alias("action"), F.concat(F.lit("p"), F.col("user_id").cast("string")).alias("player"),
        F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("a:"), "event_type")).alias("reason"), F.when(F.col("event_id") % 3 == 0, "15m").alias("duration"), F.col("ts").cast("timestamp").alias("timestamp"),
    )
    return io.audit_rows(rows)


AUDIT = """aud AS (SELECT event_id AS id, 'Staff' || (user_id % 5) AS staff_name, upper(event_type) AS action, ts AS timestamp, user_id, event_type,
  'Player: p' || user_id || CASE WHEN event_id % 2 = 0 THEN ' | Reason: a:' || event_type ELSE '' END || CASE WHEN event_id % 3 = 0 THEN ' | Duration: 15m' ELSE '' END AS detail FROM events)"""


def audit_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = audit(spark, sf_dir).withColumn("m", X.detail_map(F.col("detail")))
    key = lambda k: F.try_element_at("m", F.lit(k))
    return m.select("id", "action", key("Player").alias("player"), key("Reason").alias("reason"), key("Duration").alias("duration"))


def audit_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.audit_top(audit(spark, sf_dir), "STAFF1%").select("id", "staff_name", "action", "detail")


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("player_name"), F.col("props").alias("content"), F.lit("Filter").alias("category"),
        F.when(F.col("event_id") % 4 == 0, None).otherwise(F.col("event_type")).alias("source"), F.lit("w").alias("detected_word"), F.col("ts").cast("timestamp").alias("timestamp"),
    )


def log_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = logs(spark, sf_dir)
    return P.log_page(found, "b", 3).unionByName(P.log_page(found, "zz", 1)).select("id", "player_name", "content", "source")


def violation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("msg_id"), F.col("user_id").cast("string").alias("user_name"), F.col("props").alias("text"), F.when(F.col("event_id") % 3 == 0, "Filter").otherwise("Anti-Ip").alias("category"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("source"), F.lit("x").alias("detected"), F.col("ts").cast("timestamp").alias("ts"), (F.col("value") > 20).alias("blocked"),
    )
    return io.violation_rows(verdicts, strict=True).select("id", "player_name", "content", "category", "source")


def alert_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = read(spark, sf_dir, "events").select(
        F.col("event_id").alias("msg_id"), F.when(F.col("event_id") % 3 == 0, "Caps").otherwise("Anti-Ip").alias("category"), F.when(F.col("event_id") % 4 == 0, "Book").otherwise("chat").alias("source"), F.col("props").alias("text"), (F.col("value") > 20).alias("blocked"),
    )
    staff = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("user_id"), F.when(F.col("r_regionkey") % 2 == 0, F.array(F.lit("notify"))).otherwise(F.array(F.lit("chat"))).alias("permissions"))
    found = io.alerts(verdicts, staff).withColumn("recipient_id", F.explode("recipients"))
    return found.groupBy("recipient_id", "category", "source").agg(F.count("*").alias("n"))


def pending_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.pending_page(suggestions(spark, sf_dir), 2).select("id", "suggestion")


def user_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = history(spark, sf_dir)
    warnings = h.where("reason != 'F'").select("id", "player_id", "moderator", "reason", "created_at")
    return P.user_reports(warnings, h.where("reason = 'F'"), muted(spark, sf_dir), now(), 1, 5)


SHOWN = """CASE WHEN {s} <= 0 THEN '0s' WHEN {s} < 60 THEN {s} || 's' ELSE concat_ws(' ', CASE WHEN {s} >= 86400 THEN ({s} // 86400) || 'd' END, CASE WHEN {s} % 86400 >= 3600 THEN ({s} % 86400 // 3600) || 'h' END, CASE WHEN {s} % 3600 >= 60 THEN ({s} % 3600 // 60) || 'm' END) END"""
REPORT_SQL = "WITH " + MUTED + f""", w AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY created_at DESC, id DESC) AS row FROM hist WHERE reason != 'F'),
h AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY created_at DESC, id DESC) AS row FROM hist WHERE reason = 'F'),
m AS (SELECT *, (epoch_us(expires_at) // 1000000 - epoch_us({NOW_SQL}) // 1000000) AS left_s FROM muted WHERE expires_at IS NULL OR expires_at > {NOW_SQL})
SELECT player_id, 1 AS section, row, moderator || ' | ' || reason AS text FROM w WHERE row <= 5
UNION ALL SELECT player_id, 2, row, moderator || ' | ' || reason || ' | ' || CASE WHEN duration = 0 THEN 'Perm' ELSE {SHOWN.format(s='duration')} END FROM h WHERE row <= 5
UNION ALL SELECT player_id, 0, 1, 'Muted: ' || reason || ' | ' || CASE WHEN expires_at IS NULL THEN 'Perm' ELSE {SHOWN.format(s='left_s')} END FROM m"""


def labels_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", X.sanitize_label(F.col("p_name")).alias("name"), X.sanitize_label(F.col("p_type")).alias("type"))


def purged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by day of events, kept as a table by days, after a purge in the middle of a day."""
    folder = f"{shared_dir(spark)}/days-{uuid.uuid4().hex}"
    append_days(read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")), folder, "audit", "ts")
    purge_days(spark, folder, "audit", "ts", 10 * 86_400, PURGED_AT)
    left = read_days(spark, folder, "audit")
    return left.groupBy(F.unix_date(day_of(F.col("ts"))).alias("day")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


PURGED_DAYS_SQL = "SELECT (epoch_us(ts) // 86400000000)::INT AS day, count(*) AS n, min(event_id) AS first_id FROM events WHERE ts >= TIMESTAMP '2024-01-25 10:30:00' - INTERVAL 10 DAY GROUP BY 1"

QUERIES = {
    f.__name__: f
    for f in (
        pending_words, named_history, ids_of_names, mute_enforcement, permissions, login, registered, mute_state, expired_mutes, sanctions, purged, submitted, reviewed, lexicon_changes, lexicon_pages,
        audit_details, audit_latest, log_pages, violation_log, alert_rows, pending_pages, user_reports, labels_clean, purged_days,
    )
}

ORACLE_SQL = {
    "pending_words": "WITH " + SUGGESTIONS + "SELECT suggestion AS word, 'u-' || c_custkey AS uuid, count(*) AS n FROM sugg JOIN customer ON player_id = c_custkey WHERE status = 'pending' GROUP BY ALL",
    "named_history": "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 50 = 0 THEN 'Unknown (ID: ' || (o_custkey + 10000000) || ')' ELSE coalesce(c_name, 'Unknown (ID: ' || o_custkey || ')') END AS name FROM orders LEFT JOIN customer ON c_custkey = o_custkey",
    "ids_of_names": "SELECT upper(c_name) AS name, c_custkey AS id FROM customer UNION ALL SELECT s_name, -1 FROM supplier",
    "mute_enforcement": MUTES_SQL,
    "permissions": "SELECT c_custkey AS user_id, r_name = 'AMERICA' AS exempt, array_to_string(list_sort([n_name, r_name]), ',') AS held FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "login": "WITH " + MUTED + f"SELECT c_custkey AS id, c_name AS name, scope, coalesce(epoch_us(expires_at) // 1000000, -1) AS until, reason AS mute_reason FROM customer LEFT JOIN (FROM muted WHERE expires_at IS NULL OR expires_at > {NOW_SQL}) ON player_id = c_custkey",
    "registered": """WITH k AS (SELECT * FROM customer WHERE c_custkey % 2 = 0) SELECT c_custkey AS id, 'u-' || c_custkey AS uuid, c_name AS name FROM k UNION ALL
SELECT (SELECT max(c_custkey) FROM k) + row_number() OVER (ORDER BY 'u-' || c_custkey), 'u-' || c_custkey, c_name FROM customer WHERE c_custkey % 3 = 0 AND c_custkey % 2 = 1""",
    "mute_state": "WITH " + MUTED + f"SELECT c_custkey AS player_id, coalesce(s, -1) AS status FROM customer LEFT JOIN (SELECT player_id, coalesce(epoch_us(expires_at) // 1000000, 0) AS s FROM muted WHERE player_id % 7 != 0 AND (expires_at IS NULL OR expires_at > {NOW_SQL})) ON player_id = c_custkey",
    "expired_mutes": "WITH " + MUTED + f"SELECT 'active' AS what, scope, count(*) AS n FROM muted WHERE expires_at IS NULL OR expires_at > {NOW_SQL} GROUP BY 2 UNION ALL SELECT 'audit', 'Expired/Manual', count(*) FROM muted WHERE expires_at <= {NOW_SQL}",
    "lexicon_changes": "WITH " + LEXICON_SQL + """, new AS (SELECT DISTINCT lower(w) AS word, 'NORMAL' AS mode FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part) WHERE w != ''),
added AS (SELECT word, mode FROM lexicon UNION ALL SELECT word, mode FROM new ANTI JOIN lexicon USING (word, mode))
SELECT word, mode FROM added WHERE word NOT IN ('red', 'r3d', 'tion')""",
    "sanctions": SANCTIONS_SQL, "purged": PURGE_SQL, "submitted": SUBMIT_SQL, "reviewed": REVIEW_SQL, "lexicon_pages": PAGES_SQL,
    "audit_details": "SELECT event_id AS id, upper(event_type) AS action, 'p' || user_id AS player, CASE WHEN event_id % 2 = 0 THEN 'a:' || event_type END AS reason, CASE WHEN event_id % 3 = 0 THEN '15m' END AS duration FROM events",
    "audit_latest": "WITH " + AUDIT + "SELECT id, staff_name, action, detail FROM aud WHERE staff_name ILIKE 'STAFF1%' ORDER BY timestamp DESC, id DESC LIMIT 10",
    "log_pages": "SELECT event_id AS id, user_id::VARCHAR AS player_name, props AS content, CASE WHEN event_id % 4 = 0 THEN 'Unknown' ELSE event_type END AS source FROM events ORDER BY ts DESC, event_id DESC LIMIT 10 OFFSET 20",
    "violation_log": "SELECT event_id AS id, user_id::VARCHAR AS player_name, props AS content, 'Anti-Ip' AS category, CASE WHEN event_id % 4 != 0 THEN event_type ELSE 'Unknown' END AS source FROM events WHERE value > 20 AND event_id % 3 != 0",
    "alert_rows": "SELECT r_regionkey AS recipient_id, 'Anti-Ip' AS category, 'chat' AS source, count(*) AS n FROM events, region WHERE value > 20 AND event_id % 3 != 0 AND event_id % 4 != 0 AND r_regionkey % 2 = 0 GROUP BY 1",
    "pending_pages": "WITH " + SUGGESTIONS + "SELECT id, suggestion FROM sugg WHERE status = 'pending' ORDER BY id LIMIT 10 OFFSET 10",
    "user_reports": REPORT_SQL, "purged_days": PURGED_DAYS_SQL,
    "labels_clean": r"""WITH l AS (SELECT p_partkey, trim(regexp_replace(p_name, '[^A-Za-z0-9_\-: ]', '', 'g')) AS n, trim(regexp_replace(p_type, '[^A-Za-z0-9_\-: ]', '', 'g')) AS t FROM part)
SELECT p_partkey, CASE WHEN length(n) BETWEEN 2 AND 20 THEN n ELSE 'Unknown' END AS name, CASE WHEN length(t) BETWEEN 2 AND 20 THEN t ELSE 'Unknown' END AS type FROM l""",
}
