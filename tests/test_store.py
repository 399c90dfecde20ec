"""Upserts and parallel reads against a store in memory."""

import datetime
import uuid

import pytest
from pyspark.sql import functions as F

from modstream.sources import store

T = [datetime.datetime(2024, 1, d) for d in range(1, 8)]


@pytest.fixture
def url(spark):
    at = f"jdbc:derby:memory:{uuid.uuid4().hex}"
    with store._connection(spark, at + ";create=true") as c:
        store._run(c, "CREATE TABLE players (id BIGINT GENERATED ALWAYS AS IDENTITY, uuid VARCHAR(36) PRIMARY KEY, name VARCHAR(40), last_seen TIMESTAMP)")
        store._run(c, "CREATE TABLE muted (player_id BIGINT PRIMARY KEY, reason VARCHAR(100), muted_by VARCHAR(40), expires_at TIMESTAMP, created_at TIMESTAMP, scope VARCHAR(10))")
    return at


def players(spark, rows):
    return spark.createDataFrame(rows, "uuid string, name string, last_seen timestamp")


def test_users(spark, url):
    assert store.save_users(players(spark, [("a", "Ann", T[0]), ("b", "Bob", T[0]), ("a", "Anna", T[1]), (None, "Nobody", T[0])]), url) == 2
    store.save_users(players(spark, [("a", "Other", T[3]), ("c", "Cyd", T[3])]), url)
    read = lambda: {(r.UUID, r.NAME, r.LAST_SEEN) for r in store.read_parallel(spark, url, "players", "id", 3).collect()}
    assert read() == {("a", "Anna", T[1]), ("b", "Bob", T[0]), ("c", "Cyd", T[3])}
    store.save_users(players(spark, [("a", "Other", T[3])]), url, refresh=True)
    assert ("a", "Other", T[3]) in read() and len(read()) == 3
    found = store.read_parallel(spark, url, "players", "id", 3)
    assert found.rdd.getNumPartitions() == 3 and found.select("id").distinct().count() == 3
    assert store.read_parallel(spark, url, "muted", "player_id").count() == 0


def mutes(spark, rows):
    return spark.createDataFrame(rows, "player_id long, reason string, muted_by string, expires_at timestamp, created_at timestamp, scope string")


def test_mutes(spark, url):
    """Replaced, repeated without effect, and deleted."""
    new = mutes(spark, [(1, "x", "s", None, T[0], "CHAT"), (2, "y", "s", T[4], T[0], "CHAT"), (2, "z", "s", T[5], T[1], "GLOBAL")]).repartition(3)
    read = lambda: {tuple(r) for r in store.read_parallel(spark, url, "muted", "player_id", 2).collect()}
    for _ in range(2):
        store.save_mutes(new, url)
        assert read() == {(1, "x", "s", None, T[0], "CHAT"), (2, "z", "s", T[5], T[1], "GLOBAL")}
    assert store.save_unmutes(mutes(spark, [(2, None, None, None, None, None), (9, None, None, None, None, None)]), url) == 1
    assert {r[0] for r in read()} == {1}


def test_all_or_nothing(spark, url):
    """A merge that fails halfway leaves the table as it was; rows that can't be staged don't reach it."""
    store.save_mutes(mutes(spark, [(1, "x", "s", None, T[0], "CHAT")]), url)
    bad = mutes(spark, [(1, "new", "s", None, T[1], "CHAT"), (3, "w", "s", None, T[1], "A SCOPE THAT IS TOO LONG")])
    with pytest.raises(Exception, match="(?i)trunc"):
        store.save_mutes(bad, url)
    assert [tuple(r) for r in store.read_parallel(spark, url, "muted", "player_id").collect()] == [(1, "x", "s", None, T[0], "CHAT")]
    lost = mutes(spark, [(1, "new", "s", None, T[1], "CHAT")]).withColumn("reason", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        store.save_mutes(lost, url)
    assert store.read_parallel(spark, url, "muted", "player_id").first().REASON == "x"


def test_statements():
    merge = lambda kind, keep=(): store.merge_sql(f"jdbc:{kind}:x", "t", "s", ["k", "a", "b"], ["k"], keep)
    assert merge("sqlite") == "INSERT INTO t (k, a, b) SELECT k, a, b FROM s WHERE true ON CONFLICT (k) DO UPDATE SET a = excluded.a, b = excluded.b"
    assert merge("sqlite", ("a", "b")).endswith("DO NOTHING")
    assert merge("mysql", ("b",)).endswith("ON DUPLICATE KEY UPDATE a = VALUES(a)") and merge("mariadb", ("a", "b")).endswith("UPDATE k = t.k")
    assert merge("derby", ("a", "b")) == "MERGE INTO t t USING s s ON t.k = s.k WHEN NOT MATCHED THEN INSERT (k, a, b) VALUES (s.k, s.a, s.b)"
    import sqlite3

    con = sqlite3.connect(":memory:")
    con.executescript("CREATE TABLE t (k INT PRIMARY KEY, a TEXT, b TEXT); CREATE TABLE s (k INT, a TEXT, b TEXT); INSERT INTO t VALUES (1, 'x', 'y'); INSERT INTO s VALUES (1, 'p', 'q'), (2, 'r', 's')")
    con.execute(merge("sqlite", ("b",)))
    assert con.execute("SELECT * FROM t ORDER BY k").fetchall() == [(1, "p", "y"), (2, "r", "s")]
