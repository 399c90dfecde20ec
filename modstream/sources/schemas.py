"""Schemas of the tables of a moderation store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

MESSAGES = (
    "msg_id long, user_id long, user_name string, ts timestamp, source string, text string, is_writable boolean, check_traffic boolean, "
    "line_no int, page_no int, container_id long"
)

TABLES = {
    "players": "id long, uuid string, name string, last_seen timestamp",
    "suggestions": "id long, player_id long, suggestion string, reason string, status string, created_at timestamp",
    "warnings": "id long, player_id long, moderator string, reason string, created_at timestamp",
    "muted": "player_id long, reason string, muted_by string, expires_at timestamp, created_at timestamp, scope string",
    "mute_history": "id long, player_id long, reason string, moderator string, duration long, created_at timestamp, scope string",
    "audit": "id long, staff_name string, action string, detail string, timestamp timestamp",
    "monitor_logs": "id long, player_name string, content string, category string, source string, detected_word string, timestamp timestamp",
}


def create_tables(spark: SparkSession, folder: str) -> None:
    """An empty table for each that isn't there yet."""
    for name, schema in TABLES.items():
        spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{folder}/{name}")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")
