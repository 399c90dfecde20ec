"""Reports: latest entries, pages, histories. Every order ends in a unique id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modstream.functions.text import format_duration


def audit_top(audit: DataFrame, staff: str | None = None, n: int = 10) -> DataFrame:
    rows = audit if staff is None else audit.where(F.lower("staff_name").like(staff.lower()))
    return rows.orderBy(F.desc("timestamp"), F.desc("id")).limit(n)


def log_page(logs: DataFrame, kind: str, page: int, size: int = 10) -> DataFrame:
    """A page of the violation log, newest first; kinds other than "b" and "all" are empty."""
    rows = logs.where(F.lit(kind in ("b", "all"))).withColumn("source", F.coalesce("source", F.lit("Unknown")))
    return rows.orderBy(F.desc("timestamp"), F.desc("id")).offset(size * (max(1, page) - 1)).limit(size)


def pending_page(suggestions: DataFrame, page: int, size: int = 10) -> DataFrame:
    return suggestions.where("status = 'pending'").orderBy("id").offset(size * (max(1, page) - 1)).limit(size)


def user_reports(warnings: DataFrame, history: DataFrame, muted: DataFrame, now: Column, page: int = 1, size: int = 10) -> DataFrame:
    """(player_id, section, row, text) of all users: the active mute on page 1, a page of warnings, a page of former mutes."""
    low, high = size * (page - 1), size * page

    def section(df: DataFrame, number: int, text: Column) -> DataFrame:
        newest = Window.partitionBy("player_id").orderBy(F.desc("created_at"), F.desc("id"))
        rows = df.withColumn("row", F.row_number().over(newest)).where((F.col("row") > low) & (F.col("row") <= high))
        return rows.select("player_id", F.lit(number).alias("section"), "row", text.alias("text"))

    left = F.unix_seconds("expires_at") - F.unix_seconds(now)
    active = muted.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))
    active = active.select("player_id", F.lit(0).alias("section"), F.lit(1).alias("row"), F.concat(F.lit("Muted: "), F.coalesce("reason", F.lit("")), F.lit(" | "), F.when(F.col("expires_at").isNull(), "Perm").otherwise(format_duration(left))).alias("text"))
    out = section(warnings, 1, F.concat_ws(" | ", "moderator", "reason")).unionByName(
        section(history, 2, F.concat_ws(" | ", "moderator", "reason", F.when(F.col("duration") == 0, "Perm").otherwise(format_duration(F.col("duration")))))
    )
    return out.unionByName(active) if page == 1 else out


def user_report(player_id: int, *tables: DataFrame, **how) -> DataFrame:
    warnings, history, muted, now = tables
    own = lambda df: df.where(F.col("player_id") == player_id)
    return user_reports(own(warnings), own(history), own(muted), now, **how).orderBy("section", "row")
