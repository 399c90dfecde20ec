"""Joins and changes of the moderation tables. A change gives the table as it is afterwards; the caller writes it as a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modstream.functions.text import expand_reason, normalize_search, parse_duration
from modstream.sources.shared import forget, numbered, written


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each ``key`` by ``order``."""
    newest = Window.partitionBy(key).orderBy(*(F.col(c).desc_nulls_last() for c in order))
    return df.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")


# Joins.


def pending_words(suggestions: DataFrame, players: DataFrame) -> DataFrame:
    """(word, uuid) of pending suggestions."""
    pending = suggestions.where("status = 'pending'").select("player_id", F.col("suggestion").alias("word"))
    return pending.join(players.select(F.col("id").alias("player_id"), "uuid"), "player_id").select("word", "uuid")


def with_names(df: DataFrame, players: DataFrame, column: str = "player_id") -> DataFrame:
    """``df`` with name; an unknown id is named after itself."""
    names = players.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    unknown = F.concat(F.lit("Unknown (ID: "), F.col(column).cast("string"), F.lit(")"))
    return df.join(names, F.col(column) == F.col("_id"), "left").withColumn("name", F.coalesce("_name", unknown)).drop("_id", "_name")


def ids_of_names(names: DataFrame, players: DataFrame) -> DataFrame:
    """(name, id) of ``names`` (name) without case; of several players the one with the smallest id, null if there is none."""
    first = players.groupBy(F.lower("name").alias("_low")).agg(F.min("id").alias("id"))
    return names.join(first, F.lower("name") == F.col("_low"), "left").select("name", "id")


def mute_intervals(history: DataFrame, unmutes: DataFrame | None = None) -> DataFrame:
    """(player_id, scope, valid_from, valid_to): a mute holds until its end, the player's next one, or an unmute; 0 seconds is forever."""
    rows = history.select("player_id", "scope", F.col("created_at").cast("timestamp").alias("valid_from"), "duration", F.lit(False).alias("unmute"), "id")
    if unmutes is not None:
        stops = unmutes.select("player_id", F.lit(None).cast("string").alias("scope"), F.col("created_at").cast("timestamp").alias("valid_from"), F.lit(0).cast("long").alias("duration"), F.lit(True).alias("unmute"), F.lit(-1).cast("long").alias("id"))
        rows = rows.union(stops)
    following = F.lead("valid_from").over(Window.partitionBy("player_id").orderBy("valid_from", "id"))
    end = F.when(F.col("duration") > 0, F.timestamp_micros(F.unix_micros("valid_from") + F.col("duration") * 1_000_000))
    return rows.select("player_id", "scope", "valid_from", F.least(end, following).alias("valid_to"), "unmute").where("not unmute and (valid_to is null or valid_to > valid_from)").drop("unmute")


def enforce_mutes(messages: DataFrame, intervals: DataFrame) -> DataFrame:
    """``messages`` (msg_id, user_id, ts, source, ...) with muted: a mute covers the time, and is global or the message is chat.

    Intervals of a player don't overlap, so the last one that began before the message decides: both are put in one order by time
    and the last interval is carried on. No player's rows are joined with all the player's intervals.
    """
    at = F.col("ts").cast("timestamp")
    none = F.lit(None)
    marks = intervals.select(
        F.col("player_id").alias("_user"), F.col("valid_from").alias("_at"), F.lit(0).alias("_kind"),
        F.struct("scope", "valid_to").alias("_mute"), none.cast(messages.select(F.struct("*").alias("m")).schema["m"].dataType).alias("_message"),
    )
    texts = messages.select(F.col("user_id").alias("_user"), at.alias("_at"), F.lit(1).alias("_kind"), none.cast("struct<scope:string,valid_to:timestamp>").alias("_mute"), F.struct("*").alias("_message"))
    order = Window.partitionBy("_user").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    carried = marks.union(texts).withColumn("_last", F.last("_mute", ignorenulls=True).over(order)).where("_kind = 1")
    covers = F.col("_last").isNotNull() & (F.col("_last.valid_to").isNull() | (F.col("_at") < F.col("_last.valid_to")))
    applies = (F.col("_last.scope") == "GLOBAL") | (F.col("_message.source") == "chat")
    return carried.select("_message.*", F.coalesce(covers & applies, F.lit(False)).alias("muted"))


def flat_permissions(grants: DataFrame, parents: DataFrame) -> DataFrame:
    """(user_id, permissions): grants and all that they include, by (permission, includes) of ``parents``.

    The closure of ``parents`` is made first, as it is small beside the grants: paths are joined to themselves until no pair is new, so
    depth d takes log d rounds, and circles end.
    """
    closure = written(parents.select("permission", "includes").where("permission is not null and includes is not null").distinct(), "closure")
    n = closure.count()
    while n:
        a, b = closure.alias("a"), closure.alias("b")
        step = a.join(b, F.col("a.includes") == F.col("b.permission")).select("a.permission", "b.includes")
        last, closure = closure, written(closure.union(step).distinct(), "closure")
        before, n = n, closure.count()
        forget(last)
        if n == before:
            break
    own = grants.select("user_id", "permission")
    more = own.join(closure, "permission").select("user_id", F.col("includes").alias("permission"))
    return own.union(more).groupBy("user_id").agg(F.array_sort(F.collect_set("permission")).alias("permissions"))


def exempt(df: DataFrame, permissions: DataFrame, permission: str) -> DataFrame:
    """``df`` with exempt: the user holds ``permission``."""
    holders = permissions.where(F.array_contains("permissions", permission)).select(F.col("user_id").alias("_holder")).distinct()
    return df.join(holders, F.col("user_id") == F.col("_holder"), "left").withColumn("exempt", F.col("_holder").isNotNull()).drop("_holder")


def exemptions(df: DataFrame, permissions: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``df`` with exempt_from: those of ``names`` that the user holds in ``permissions`` (user_id, permissions)."""
    known = F.array(*map(F.lit, names))
    held = permissions.select(F.col("user_id").alias("_holder"), F.explode(F.array_intersect("permissions", known)).alias("p"))
    held = held.groupBy("_holder").agg(F.array_sort(F.collect_set("p")).alias("exempt_from"))
    out = df.join(held, F.col("user_id") == F.col("_holder"), "left").drop("_holder")
    return out.withColumn("exempt_from", F.coalesce("exempt_from", F.array().cast("array<string>")))


def login_snapshot(players: DataFrame, muted: DataFrame, now: Column) -> DataFrame:
    active = muted.where(F.col("expires_at").isNull() | (F.col("expires_at") > now)).select(F.col("player_id").alias("id"), "scope", "expires_at", F.col("reason").alias("mute_reason"))
    return players.join(active, "id", "left")


# Changes.


def register_users(players: DataFrame, new: DataFrame, refresh: bool = False) -> DataFrame:
    """``players`` with those of ``new`` (uuid, name, last_seen) whose uuid is unknown, numbered on; ``refresh`` also renews known ones."""
    once = latest(new, "uuid", "last_seen", "name")
    fresh = once.join(players.select("uuid"), "uuid", "left_anti")
    top = players.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new_rows = numbered(fresh, "uuid").join(F.broadcast(top)).withColumn("id", F.col("top") + F.col("row"))
    known = players
    if refresh:
        seen = once.select("uuid", F.col("name").alias("_name"), F.col("last_seen").alias("_seen"))
        known = players.join(seen, "uuid", "left").select("id", "uuid", F.coalesce("_name", "name").alias("name"), F.greatest("_seen", "last_seen").alias("last_seen"))
    return known.select("id", "uuid", "name", "last_seen").unionByName(new_rows.select("id", "uuid", "name", "last_seen"))


SANCTIONS = {"MUTE": "CHAT", "TEMPMUTE": "CHAT", "PERMUTE": "GLOBAL", "API_MUTE": "CHAT", "AUTO": "CHAT", "AUTO_PERMUTE": "GLOBAL"}


def sanction_rows(actions: DataFrame, presets: dict[str, str] | None = None) -> DataFrame:
    """``actions`` (player_id, kind, duration, reason, moderator, created_at) with scope and seconds, 0 for good; bad durations drop."""
    scope = F.lit(None).cast("string")
    for kind, s in SANCTIONS.items():
        scope = F.when(F.col("kind") == kind, s).otherwise(scope)
    seconds = F.when(F.col("kind").isin("MUTE", "PERMUTE", "API_MUTE"), 0).otherwise(parse_duration(F.col("duration")))
    rows = actions.withColumns({"scope": scope, "seconds": seconds.cast("long")}).where("seconds >= 0 and scope is not null")
    return expand_reason(rows, presets) if presets else rows


def apply_mutes(muted: DataFrame, new: DataFrame) -> DataFrame:
    """The current mute of each player after ``new`` (player_id, reason, moderator, seconds, created_at, scope)."""
    end = F.when(F.col("seconds") > 0, F.timestamp_micros(F.unix_micros("created_at") + F.col("seconds") * 1_000_000))
    rows = new.select("player_id", "reason", F.col("moderator").alias("muted_by"), end.alias("expires_at"), "created_at", "scope")
    return latest(muted.unionByName(rows), "player_id", "created_at")


def apply_unmutes(muted: DataFrame, players: DataFrame) -> DataFrame:
    return muted.join(players.select("player_id").distinct(), "player_id", "left_anti")


def mute_status(players: DataFrame, muted: DataFrame, now: Column) -> DataFrame:
    """(player_id, status): -1 not muted, 0 for good, else the end in seconds."""
    active = muted.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    status = active.select("player_id", F.coalesce(F.unix_seconds("expires_at"), F.lit(0)).alias("status"))
    return players.select("player_id").join(status, "player_id", "left").select("player_id", F.coalesce("status", F.lit(-1)).alias("status"))


def expire_mutes(muted: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(mutes still on, audit rows of those that ended)."""
    ended = F.col("expires_at").isNotNull() & (F.col("expires_at") <= now)
    audit = muted.where(ended).select("player_id", F.lit("UNMUTE").alias("action"), F.lit("Expired/Manual").alias("detail"), F.col("expires_at").alias("timestamp"))
    return muted.where(~ended), audit


PURGED = {"sg": "suggestions", "b": "monitor_logs", "l": "monitor_logs", "a": "audit", "hp": "mute_history", "w": "warnings"}


def purge(df: DataFrame, seconds: int, now: Column, ts: str) -> DataFrame:
    """Rows that are not older than ``seconds``."""
    return df.where(F.unix_micros(F.col(ts).cast("timestamp")) >= F.unix_micros(now) - seconds * 1_000_000)


def purge_counts(tables: dict[str, tuple[DataFrame, str]], kind: str, seconds: int, now: Column) -> DataFrame:
    """(purged): how many rows a purge of ``kind`` removes from ``tables`` (name: table, time column); an unknown kind removes none."""
    names = set(PURGED.values()) if kind == "all" else {PURGED.get(kind, "")}
    counts = None
    for name in sorted(names & tables.keys()):
        df, ts = tables[name]
        old = df.where(F.unix_micros(F.col(ts).cast("timestamp")) < F.unix_micros(now) - seconds * 1_000_000).agg(F.count("*").alias("n"))
        counts = old if counts is None else counts.union(old)
    if counts is None:
        return next(iter(tables.values()))[0].limit(0).agg(F.count("*").alias("purged"))
    return counts.agg(F.sum("n").alias("purged"))


def retention(suggestions: DataFrame, history: DataFrame, now: Column, suggestion_hours: int = 72, history_days: int = 7) -> tuple[DataFrame, DataFrame]:
    return purge(suggestions, suggestion_hours * 3600, now, "created_at"), purge(history, history_days * 86400, now, "created_at")


def submit_suggestions(suggestions: DataFrame, new: DataFrame) -> DataFrame:
    """``suggestions`` with those of ``new`` (player_id, suggestion, reason, created_at) that are short enough and not pending yet, each once."""
    ok = new.where((F.length("suggestion") <= 20) & (F.length("reason") <= 100))
    pending = suggestions.where("status = 'pending'").select(F.lower("suggestion").alias("_w")).distinct()
    fresh = ok.join(pending, F.lower("suggestion") == F.col("_w"), "left_anti").withColumn("_w", F.lower("suggestion"))
    first = Window.partitionBy("_w").orderBy("created_at", "player_id", "suggestion")
    once = fresh.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "_w")
    top = suggestions.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    new_rows = numbered(once, "created_at", "suggestion").join(F.broadcast(top)).withColumn("id", F.col("top") + F.col("row"))
    return suggestions.unionByName(new_rows.withColumn("status", F.lit("pending")).select(*suggestions.columns))


def review_suggestions(suggestions: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(suggestions, accepted words, audit rows) after ``decisions`` (id, accepted, staff_name, timestamp) on pending ones."""
    d = decisions.select(F.col("id").alias("_id"), "accepted", "staff_name", F.col("timestamp").alias("_at"))
    joined = suggestions.join(d, (F.col("id") == F.col("_id")) & (F.col("status") == "pending"), "left")
    status = F.when(F.col("accepted"), "accepted").when(~F.col("accepted"), "rejected").otherwise(F.col("status"))
    done = joined.where("_id is not null")
    audit = done.select("staff_name", F.when(F.col("accepted"), "ACCEPT").otherwise("DENY").alias("action"), F.concat(F.lit("Word: "), "suggestion").alias("detail"), F.col("_at").alias("timestamp"))
    words = done.where("accepted").select(normalize_search(F.col("suggestion")).alias("word")).distinct()
    return joined.withColumn("status", status).select(*suggestions.columns), words, audit
