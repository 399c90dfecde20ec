"""Tables in a folder for each day (UTC), so that old rows go without reading or writing the others."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from modstream.operators.tables import PURGED
from modstream.sources.shared import children, delete, forget, written

DAY = 86_400


def day_of(ts: Column) -> Column:
    """The day of an instant in UTC, whatever the session's time zone; null for a null time."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.unix_micros(ts.cast("timestamp")) / (DAY * 1_000_000)).cast("int"))


def append_days(df: DataFrame, folder: str, name: str, ts: str) -> None:
    """``df`` added to the table ``name``, each row in the folder of its day. A day's rows are brought together first, those of a large one in several parts."""
    df.withColumn("day", day_of(F.col(ts))).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(f"{folder}/{name}")


def read_days(spark: SparkSession, folder: str, name: str, since: dt.date | None = None) -> DataFrame:
    """The table, or what it has from a day on: of earlier ones no file is opened."""
    found = spark.read.parquet(f"{folder}/{name}")
    return (found.where(F.col("day") >= F.lit(since)) if since else found).drop("day")


def _days(spark: SparkSession, path: str) -> dict[dt.date, str]:
    """The folders of days there are; that of rows without a time isn't one."""
    found = {}
    for at in children(spark, path):
        kind, _, value = at.rpartition("/")[2].partition("=")
        if kind == "day" and not value.startswith("__"):
            found[dt.date.fromisoformat(value)] = at
    return found


def purge_days(spark: SparkSession, folder: str, name: str, ts: str, seconds: int, now: dt.datetime) -> int:
    """Remove the rows of the table that are older than ``seconds`` at ``now``; how many that were.

    Whole days before the limit are dropped as folders, after their rows have been counted from the files' footers. The day on the limit is
    written anew without them, through a table in the shared folder, and put in place by overwriting that one day; all others keep their
    files. Rows without a time stay. A purge that is lost on the way can be repeated.
    """
    limit = (now if now.tzinfo else now.replace(tzinfo=dt.UTC)).astimezone(dt.UTC) - dt.timedelta(seconds=seconds)
    path = f"{folder}/{name}"
    days = _days(spark, path)
    old = sorted(d for d in days if d < limit.date())
    purged = spark.read.parquet(path).where(F.col("day") <= F.lit(old[-1])).count() if old else 0
    for day in old:
        delete(spark, days[day])
    if limit.date() in days:
        rows = spark.read.parquet(path).where(F.col("day") == F.lit(limit.date()))
        micros = round(limit.timestamp() * 1_000_000)
        kept = written(rows.where(F.unix_micros(F.col(ts).cast("timestamp")) >= micros), "kept")
        gone, stay = rows.count(), kept.count()
        gone -= stay
        if gone and stay:
            kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
        elif gone:
            delete(spark, days[limit.date()])
        purged += gone
        forget(kept)
    return purged


def purge_kind(spark: SparkSession, folder: str, times: dict[str, str], kind: str, seconds: int, now: dt.datetime) -> dict[str, int]:
    """``purge_days`` of the tables that ``kind`` names ("all": all), of those in ``times`` (name: time column); rows removed by table."""
    names = set(PURGED.values()) if kind == "all" else {PURGED.get(kind, "")}
    return {name: purge_days(spark, folder, name, times[name], seconds, now) for name in sorted(names & times.keys())}
