"""Tables by day and their purge; term lists with versions."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from modstream.operators import versions as V
from modstream.operators.lexicon import lexicon_add, lexicon_remove, match_terms
from modstream.operators.tables import purge_counts
from modstream.sources import days

BEGIN = dt.datetime(2024, 3, 1, tzinfo=dt.UTC)


def hours(n):
    return BEGIN + dt.timedelta(hours=n)


@pytest.fixture
def table(spark, tmp_path):
    df = spark.createDataFrame([(i, hours(i * 5)) for i in range(60)] + [(99, None)], "id long, timestamp timestamp")
    days.append_days(df.repartition(2), str(tmp_path), "audit", "timestamp")
    return df


def files(tmp_path):
    return {str(p) for p in (tmp_path / "audit").rglob("*.parquet")}


@pytest.mark.parametrize("seconds", [86_400 * 3, 86_400 * 3 + 1, 0, 86_400 * 100])
def test_purge(spark, tmp_path, table, seconds):
    """As many rows go as the plain count says, the rest stays, and days after the limit keep their files."""
    now = hours(200)
    before, limit = files(tmp_path), (now - dt.timedelta(seconds=seconds))
    want = purge_counts({"audit": (table, "timestamp")}, "a", seconds, F.lit(now)).first().purged
    assert days.purge_kind(spark, str(tmp_path), {"audit": "timestamp", "warnings": "x"}, "a", seconds, now) == {"audit": want}
    got = sorted((r.id for r in days.read_days(spark, str(tmp_path), "audit").collect()))
    assert got == sorted(r.id for r in table.collect() if r.timestamp is None or r.timestamp.replace(tzinfo=dt.UTC) >= limit)
    untouched = {f for f in before if (day := os.path.basename(os.path.dirname(f)))[4:] > str(limit.date())}
    assert untouched <= files(tmp_path) and untouched
    assert days.purge_kind(spark, str(tmp_path), {"audit": "timestamp"}, "all", seconds, now) == {"audit": 0}


def test_reads_only_days(spark, tmp_path, table):
    found = days.read_days(spark, str(tmp_path), "audit", dt.date(2024, 3, 10))
    assert len(found.inputFiles()) < len(files(tmp_path)) or "PartitionFilters: [isnotnull(day" in found._jdf.queryExecution().toString()
    assert found.count() == sum(1 for r in table.collect() if r.timestamp and r.timestamp.date() >= dt.date(2024, 3, 10))


# Versions of term lists.


def lists(spark, rows):
    return spark.createDataFrame(rows, "word string, mode string, at timestamp, added boolean")


def test_versions_follow_changes(spark):
    """At each time they hold what adding and removing one after the other gives."""
    first = spark.createDataFrame([("arm", "NORMAL"), ("gato", "STRONG")], "word string, mode string")
    changes = [("V4ca", "STRONG", hours(2), True), ("arm", "NORMAL", hours(3), False), ("arm", "NORMAL", hours(5), True), ("vaca", "STRONG", hours(6), True), ("none", "NORMAL", hours(6), False), ("gato", "STRONG", hours(7), False), ("gato", "STRONG", hours(7), True)]
    start = V.first_version(first, F.lit(hours(0)))
    at_once = V.changed(start, lists(spark, changes[::-1] + [("x", None, hours(1), True), (None, "NORMAL", hours(1), True)]))
    late = V.changed(V.changed(V.changed(start, lists(spark, changes[3:])), lists(spark, changes[:3])), lists(spark, changes[2:5]))
    assert sorted(map(str, at_once.collect())) == sorted(map(str, late.select(at_once.columns).collect()))
    now = first
    for h in range(9):
        for word, mode, at, added in changes:
            if at == hours(h):
                one = spark.createDataFrame([(word, mode)], "word string, mode string")
                now = lexicon_add(now, one) if added else lexicon_remove(now, one.select("word"))
        got = {tuple(r) for r in V.version_at(at_once, F.lit(hours(h))).collect()}
        assert got == {tuple(r) for r in now.collect()}, h


@pytest.fixture
def versions(spark):
    rows = [("arm", "NORMAL", hours(0), hours(3)), ("arm", "NORMAL", hours(5), None), ("vaca", "STRONG", hours(2), None), ("arm", "STRONG", hours(4), hours(6))]
    return spark.createDataFrame(rows, V.VERSIONS)


@pytest.mark.parametrize("most", [500_000, 0])
def test_terms_of_the_time(spark, versions, monkeypatch, most):
    """Each message has the matches that the list of its time gives."""
    monkeypatch.setattr(V, "BROADCAST_TERMS", most)
    texts = ["an arm here", "v4c4 and arm", "nothing", None]
    messages = spark.createDataFrame([(i, texts[i % 4], None if i == 30 else hours(i // 4)) for i in range(33)], "msg_id long, text string, ts timestamp")
    got = {r.msg_id: r.matches for r in V.match_terms_at(messages, versions).collect()}
    assert len(got) == 33 and got[30] == []
    for h in range(8):
        own = messages.where(F.col("ts") == F.lit(hours(h)))
        want = {r.msg_id: r.matches for r in match_terms(own, V.version_at(versions, F.lit(hours(h)))).collect()}
        assert {i: got[i] for i in want} == want and (h == 3 or any(want.values()))


def test_change_between_batches(spark, tmp_path):
    """A running stream sees a change of the list, and a message of before meets the list of before."""
    listed, source, out = str(tmp_path / "list"), str(tmp_path / "in"), str(tmp_path / "out")
    V.first_version(spark.createDataFrame([("arm", "NORMAL")], "word string, mode string"), F.lit(hours(0))).write.parquet(listed)
    schema = "msg_id long, text string, ts timestamp"
    send = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    send([(1, "arm and leg", hours(1))])
    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(V.versioned_sink(out, lambda: spark.read.schema(V.VERSIONS).parquet(listed))).option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        query.processAllAvailable()
        changes = lists(spark, [("leg", "NORMAL", hours(5), True), ("arm", "NORMAL", hours(5), False)])
        V.changed(spark.read.schema(V.VERSIONS).parquet(listed), changes).write.parquet(str(tmp_path / "new"))
        spark.read.schema(V.VERSIONS).parquet(str(tmp_path / "new")).coalesce(1).write.mode("overwrite").parquet(listed)
        send([(2, "arm and leg", hours(6)), (3, "arm and leg", hours(4))])
        query.processAllAvailable()
    finally:
        query.stop()
    got = {r.msg_id: r.masked_text for r in spark.read.parquet(f"{out}/filtered").collect()}
    assert got == {1: "**** and leg", 2: "arm and ****", 3: "**** and leg"}
