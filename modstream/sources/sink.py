"""What a moderated stream leaves behind: one sink that writes all tables of a micro-batch, once for each batch id.

Each batch has a folder of its own in each table, ``batch=<id>``, which a repeated batch writes anew. So a batch that was written half,
or was written and then repeated because its commit was lost, adds no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modstream.operators.rules import RuleConfig
from modstream.operators.tables import apply_mutes, sanction_rows, with_names
from modstream.sources.io import alerts, audit_rows, mute_history_rows, violation_rows
from modstream.sources.schemas import TABLES
from modstream.sources.shared import delete, exists

REASON = "Anti-Flood Auto Mute"
#: Snapshots of current mutes that are kept.
SNAPSHOTS = 3


def _at(folder: str, name: str, batch: int) -> str:
    return f"{folder}/{name}/batch={batch}"


def read_batches(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """All rows of a table of the sink, with their batch; of ``muted`` those of the last batch only. A table that isn't there yet is an error."""
    found = spark.read.parquet(f"{folder}/{name}")
    return found.where(F.col("batch") == found.agg(F.max("batch")).first()[0]) if name == "muted" else found


def flood_sanctions(verdicts: DataFrame, duration: str, reason: str = REASON) -> DataFrame:
    """Sanctions (id, player_id, kind, duration, reason, moderator, created_at, scope, seconds) for the verdicts with ``sanction``; the id is that of the message."""
    rows = verdicts.where("sanction").select(
        F.col("msg_id").alias("id"), F.col("user_id").alias("player_id"), F.lit("AUTO").alias("kind"), F.lit(duration).alias("duration"), F.lit(reason).alias("reason"), F.lit("System").alias("moderator"),
        F.col("ts").alias("created_at"),
    )
    return sanction_rows(rows)


def _mutes_now(spark: SparkSession, folder: str, batch: int, sanctions: DataFrame, ended: DataFrame) -> DataFrame:
    """The mutes of the batch before with new ones, without those that have ended."""
    before = max((b for b in range(batch - SNAPSHOTS, batch) if exists(spark, _at(folder, "muted", b))), default=None)
    old = spark.createDataFrame([], TABLES["muted"]) if before is None else spark.read.schema(TABLES["muted"]).parquet(_at(folder, "muted", before))
    last = ended.groupBy(F.col("user_id").alias("player_id")).agg(F.max("ts").alias("_ended"))
    now = apply_mutes(old, sanctions).join(last, "player_id", "left")
    return now.where("_ended is null or expires_at is null or expires_at > _ended").drop("_ended")


def moderation_sink(folder: str, players: DataFrame | None = None, recipients: DataFrame | None = None, cfg: RuleConfig = RuleConfig(), strict: bool = False) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` of ``moderate_stream``: verdicts, monitor_logs, alerts, mute_history, audit and muted, in this order.

    Verdicts are written first, all else is made of the written ones, so a batch is computed once. ``players`` (id, name) has the names for
    logs and audit, ``recipients`` (user_id, permissions) who gets alerts. Ids of logs and sanctions are those of their messages. ``muted``
    is the table of current mutes after the batch; the last SNAPSHOTS are kept.
    """

    def write(found: DataFrame, batch: int) -> None:
        spark = found.sparkSession
        put = lambda df, name: df.write.mode("overwrite").parquet(_at(folder, name, batch))
        put(found, "verdicts")
        rows = spark.read.schema(found.schema).parquet(_at(folder, "verdicts", batch))
        names = players if players is not None else spark.createDataFrame([], "id long, name string")
        named = with_names(rows, names, "user_id").withColumnRenamed("name", "user_name")
        said = named.where("kind = 'message'")
        put(violation_rows(said, strict, cfg), "monitor_logs")
        if recipients is not None:
            put(alerts(said, recipients, cfg).select("msg_id", "category", "source", "text", F.explode("recipients").alias("recipient_id")), "alerts")
        sanctions = flood_sanctions(rows, f"{cfg.sanction_s}s")
        put(mute_history_rows(sanctions), "mute_history")
        ended = named.where("kind = 'unmuted'")
        no = F.lit(None).cast("string")
        given = with_names(sanctions, names).select("id", F.lit("System").alias("staff_name"), F.lit("MUTE").alias("action"), F.col("name").alias("player"), "reason", "duration", F.col("created_at").alias("timestamp"))
        taken = ended.select(F.lit(None).cast("long").alias("id"), F.lit("System").alias("staff_name"), F.lit("UNMUTE").alias("action"), F.col("user_name").alias("player"), F.lit("Expired/Manual").alias("reason"), no.alias("duration"), F.col("ts").alias("timestamp"))
        put(audit_rows(given.union(taken)), "audit")
        put(_mutes_now(spark, folder, batch, sanctions, ended), "muted")
        delete(spark, _at(folder, "muted", batch - SNAPSHOTS))

    return write
