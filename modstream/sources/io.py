"""Sources and sinks: term lists, messages, JDBC stores, logs, alerts and evidence."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modstream.functions.fixed import LOGGED, LOGGED_UNMASKED
from modstream.functions.text import should_notify
from modstream.operators.lexicon import MODES, lexicon_of
from modstream.operators.rules import RuleConfig
from modstream.sources.schemas import MESSAGES

#: Of each source: whether its texts are written things, and whether traffic rules apply.
SOURCES = {"chat": (False, True), "sign": (True, True), "book": (True, False), "anvil": (True, False), "command": (True, False)}
EVIDENCE_PAGES = 11


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt out evenly if it comes in fewer parts than there are cores, as a table in one file does; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_lexicon(spark: SparkSession, path: str, mode: str) -> DataFrame:
    """(word, mode) of a file of one term a line; blank lines and those with "#" in front don't count."""
    return lexicon_of(spark.read.text(path), mode)


def read_lexicons(spark: SparkSession, folder: str) -> DataFrame:
    """The lists of all modes, ``folder``/strong.txt and so on."""
    return functools.reduce(DataFrame.unionByName, (read_lexicon(spark, f"{folder}/{m.lower()}.txt", m) for m in MODES))


def read_messages(spark: SparkSession, path: str, source: str, stream: bool = False) -> DataFrame:
    """Messages of one source, with what the source says about rules."""
    reader = spark.readStream if stream else spark.read
    return with_source(reader.schema(MESSAGES).parquet(path), source)


def with_source(df: DataFrame, source: str) -> DataFrame:
    writable, traffic = SOURCES[source]
    return df.withColumns({"source": F.lit(source), "is_writable": F.lit(writable), "check_traffic": F.lit(traffic)})


def union_messages(*dfs: DataFrame) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def enabled_sources(df: DataFrame, cfg: RuleConfig) -> DataFrame:
    return df.where(F.col("source").isin(list(cfg.sources)))


def read_jdbc(spark: SparkSession, url: str, table: str, column: str | None = None, bounds: tuple[int, int] = (0, 1), parts: int = 1, **options: str) -> DataFrame:
    """A table of a SQL store, read in ``parts`` ranges of a number column; the store's driver must be on the class path."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
    if column:
        reader = reader.options(partitionColumn=column, lowerBound=str(bounds[0]), upperBound=str(bounds[1]), numPartitions=str(parts))
    return reader.load()


def write_jdbc(df: DataFrame, url: str, table: str, batch: int = 10_000, **options: str) -> None:
    df.write.format("jdbc").mode("append").options(url=url, dbtable=table, batchsize=str(batch), rewriteBatchedStatements="true", **options).save()


def should_log(category: Column, cfg: RuleConfig = RuleConfig()) -> Column:
    """Whether a violation is kept: the classes of abuse always, plain term hits only while masking is off."""
    kept = LOGGED if cfg.replacement else LOGGED + LOGGED_UNMASKED
    return F.coalesce(category.isin(list(kept)), F.lit(False))


def violation_rows(verdicts: DataFrame, strict: bool = False, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Log rows of the blocked ones of ``verdicts`` (msg_id, user_name, text, category, source, detected, ts); ``strict`` keeps only what ``should_log`` says."""
    rows = verdicts.where("blocked")
    rows = rows.where(should_log(F.col("category"), cfg)) if strict else rows
    return rows.select(
        F.col("msg_id").alias("id"), F.col("user_name").alias("player_name"), F.col("text").alias("content"), "category",
        F.coalesce("source", F.lit("Unknown")).alias("source"), F.col("detected").alias("detected_word"), F.col("ts").alias("timestamp"),
    )


def append(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("append").parquet(f"{folder}/{name}")


def append_stream(df: DataFrame, folder: str, name: str, checkpoint: str):
    """A streaming append to a table, once for each row."""
    return df.writeStream.format("parquet").option("path", f"{folder}/{name}").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audit_rows(actions: DataFrame) -> DataFrame:
    """Audit rows of ``actions`` (id, staff_name, action, player, reason, duration, timestamp): the detail names what is there."""
    part = lambda name, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{name}: "), F.col(c)))
    detail = F.concat_ws(" | ", part("Player", "player"), part("Reason", "reason"), part("Duration", "duration"))
    return actions.select("id", "staff_name", "action", detail.alias("detail"), "timestamp")


#: Alerts go to so many people at most: their ids are part of the plan.
MOST_STAFF = 10_000


def alerts(verdicts: DataFrame, recipients: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """Notifiable violations with recipients, the ids of all who hold "notify"; books alert by their own way and are left out.

    More than MOST_STAFF recipients are a ValueError.
    """
    rows = verdicts.where(F.col("blocked") & (F.lower("source") != "book") & should_notify(F.col("category"), cfg.silent_alerts))
    staff = recipients.where(F.array_contains("permissions", "notify")).select("user_id").distinct()
    ids = sorted(r.user_id for r in staff.limit(MOST_STAFF + 1).collect())
    if len(ids) > MOST_STAFF:
        raise ValueError(f"more than {MOST_STAFF} recipients")
    return rows.select("msg_id", "category", "source", "text", F.lit(ids).cast("array<bigint>").alias("recipients") if ids else F.array().cast("array<bigint>").alias("recipients"))


def append_alerts(found: DataFrame, folder: str) -> None:
    """A row for each alert and recipient appended to the table alerts."""
    append(found.select("msg_id", "category", "source", "text", F.explode("recipients").alias("recipient_id")), folder, "alerts")


def warning_rows(actions: DataFrame) -> DataFrame:
    """Rows of the table warnings for ``actions`` (id, player_id, moderator, reason, created_at); an empty reason is "none"."""
    reason = F.when(F.trim(F.coalesce("reason", F.lit(""))) == "", "none").otherwise(F.trim("reason"))
    return actions.select("id", "player_id", F.coalesce("moderator", F.lit("System")).alias("moderator"), reason.alias("reason"), F.col("created_at").cast("timestamp").alias("created_at"))


def mute_history_rows(sanctions: DataFrame) -> DataFrame:
    """Rows of the table mute_history for sanctions (id, player_id, reason, moderator, seconds, created_at, scope); 0 seconds are for good."""
    return sanctions.select("id", "player_id", "reason", F.coalesce("moderator", F.lit("System")).alias("moderator"), F.greatest(F.col("seconds"), F.lit(0)).alias("duration"), F.col("created_at").cast("timestamp").alias("created_at"), "scope")


def evidence(pages: Column, n: int = EVIDENCE_PAGES) -> Column:
    """The first pages of a blocked book."""
    return F.slice(pages, 1, n)
