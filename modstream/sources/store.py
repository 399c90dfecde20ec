"""A SQL store: parallel reads, and upserts that come whole or not at all.

Executors write the rows to a staging table, as many at once as there are partitions; then one statement on the driver merges that table
into the target, in one transaction, and empties it. A job that is lost before leaves the target as it was; one that is repeated merges the
same rows again, which changes nothing. What goes through the driver is the statement, never rows.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from modstream.operators.tables import latest
from modstream.sources.io import read_jdbc

#: How many a read's parts are, if nobody says so.
PARTS = 8


@contextlib.contextmanager
def _connection(spark: SparkSession, url: str) -> Iterator:
    """A connection with one transaction: committed at the end, rolled back where anything fails."""
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        yield connection
        connection.commit()
    except BaseException:
        connection.rollback()
        raise
    finally:
        connection.close()


def _run(connection, sql: str) -> int:
    statement = connection.createStatement()
    try:
        return statement.executeUpdate(sql)
    finally:
        statement.close()


def _staged(df: DataFrame, url: str, table: str, staging: str, batch: int, options: dict[str, str]) -> None:
    """Write ``df`` to a new table ``staging`` whose columns have the types of those of ``table``; one left by a lost job is dropped."""
    spark, none = df.sparkSession, "WITH NO DATA" if url.split(":")[1] == "derby" else "WHERE 1 = 0"
    with _connection(spark, url) as connection:
        found, there = connection.getMetaData().getTables(None, None, "%", None), False
        while found.next():
            there |= found.getString("TABLE_NAME").lower() == staging.lower()
        found.close()
        if there:
            _run(connection, f"DROP TABLE {staging}")
        _run(connection, f"CREATE TABLE {staging} AS SELECT {', '.join(df.columns)} FROM {table} {none}")
    df.write.format("jdbc").mode("append").options(url=url, dbtable=staging, batchsize=str(batch), **options).save()


def merge_sql(url: str, table: str, staging: str, columns: Sequence[str], keys: Sequence[str], keep: Sequence[str] = ()) -> str:
    """The statement that puts the rows of ``staging`` into ``table`` by ``keys``: new ones in, known ones renewed but for the columns ``keep``.

    SQLite and MySQL have their own forms, which need a unique index on the keys; others MERGE.
    """
    names, changed = ", ".join(columns), [c for c in columns if c not in keys and c not in keep]
    kind = url.split(":")[1]
    if kind == "sqlite":
        sets = "UPDATE SET " + ", ".join(f"{c} = excluded.{c}" for c in changed) if changed else "NOTHING"
        return f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging} WHERE true ON CONFLICT ({', '.join(keys)}) DO {sets}"
    if kind in ("mysql", "mariadb"):
        sets = ", ".join(f"{c} = VALUES({c})" for c in changed) or f"{keys[0]} = {table}.{keys[0]}"
        return f"INSERT INTO {table} ({names}) SELECT {names} FROM {staging} ON DUPLICATE KEY UPDATE {sets}"
    on = " AND ".join(f"t.{k} = s.{k}" for k in keys)
    update = f" WHEN MATCHED THEN UPDATE SET {', '.join(f'{c} = s.{c}' for c in changed)}" if changed else ""
    values = ", ".join(f"s.{c}" for c in columns)
    return f"MERGE INTO {table} t USING {staging} s ON {on}{update} WHEN NOT MATCHED THEN INSERT ({names}) VALUES ({values})"


def upsert(df: DataFrame, url: str, table: str, keys: Sequence[str], order: Sequence[str] = (), keep: Sequence[str] = (), staging: str | None = None, batch: int = 10_000, **options: str) -> int:
    """Put ``df`` into ``table`` of the store by ``keys``; how many rows that changed. Of rows with the same keys the last by ``order`` counts.

    Rows with a null key are left out. ``staging`` (by default the table's name with _staging) is made anew for each call and dropped at the
    end; calls that may run at the same time need one each.
    """
    spark, staging = df.sparkSession, staging or f"{table}_staging"
    rows = df.dropna(subset=list(keys))
    last = F.struct(*(F.col(c) for c in (*order, *(c for c in df.columns if c not in keys and c not in order))))
    rows = rows.groupBy(*keys).agg(F.max(last).alias("_last")).select(*keys, "_last.*").select(*df.columns) if len(df.columns) > len(keys) else rows.distinct()
    _staged(rows, url, table, staging, batch, options)
    with _connection(spark, url) as connection:
        changed = _run(connection, merge_sql(url, table, staging, df.columns, keys, keep))
        _run(connection, f"DROP TABLE {staging}")
    return changed


def delete_rows(keys: DataFrame, url: str, table: str, staging: str | None = None, **options: str) -> int:
    """Delete the rows of ``table`` whose key is in ``keys`` (one column, of the key's name), in one transaction; how many there were."""
    (key,), staging = keys.columns, staging or f"{table}_gone"
    _staged(keys.dropna().distinct(), url, table, staging, 10_000, options)
    with _connection(keys.sparkSession, url) as connection:
        changed = _run(connection, f"DELETE FROM {table} WHERE {key} IN (SELECT {key} FROM {staging})")
        _run(connection, f"DROP TABLE {staging}")
    return changed


def read_parallel(spark: SparkSession, url: str, table: str, column: str, parts: int = PARTS, **options: str) -> DataFrame:
    """A table of the store in ``parts`` ranges of a number column, from its least to its largest value, which the store is asked for."""
    bounds = read_jdbc(spark, url, f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}) b", **options).first()
    low, high = (0, 1) if bounds[0] is None else (int(bounds[0]), int(bounds[1]) + 1)
    return read_jdbc(spark, url, table, column, (low, high), parts, **options)


def save_users(new: DataFrame, url: str, refresh: bool = False, table: str = "players") -> int:
    """Users (uuid, name, last_seen) into the store: unknown ones are added, known ones renewed with ``refresh``. Ids are the store's."""
    return upsert(latest(new, "uuid", "last_seen", "name").select("uuid", "name", "last_seen"), url, table, ["uuid"], keep=() if refresh else ("name", "last_seen"))


def save_mutes(mutes: DataFrame, url: str, table: str = "muted") -> int:
    """Current mutes (player_id, reason, muted_by, expires_at, created_at, scope) into the store: a player's mute is replaced."""
    return upsert(mutes, url, table, ["player_id"], order=["created_at"])


def save_unmutes(players: DataFrame, url: str, table: str = "muted") -> int:
    return delete_rows(players.select("player_id"), url, table)
