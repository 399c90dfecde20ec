"""Streams: whatever micro-batches rows come in, they give what the batch gives; sinks write each batch once."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from modstream.operators.rules import RuleConfig
from modstream.operators.tables import enforce_mutes, expire_mutes, mute_intervals
from modstream.plans.moderation import moderate, moderate_stream
from modstream.sources.sink import moderation_sink, read_batches
from modstream.streaming import live as L
from modstream.streaming import state as S

BEGIN = 1_700_000_000
FAR = BEGIN + 10_000_000
MESSAGES = "msg_id long, user_id long, s double, source string, text string"
MARKS = "id long, player_id long, s double, scope string, duration long"


def at(s="s"):
    return F.timestamp_micros(F.lit(BEGIN * 1_000_000) + (F.col(s) * 1e6).cast("long"))


def some_messages(n=240, users=4):
    rng = random.Random(1)
    texts = ["hello there", "hello therE", "192", "168", "1", "10", "good day", "x", None, "go to 1.2.3.4 now", "WHAT A LOUD AND LONG TEXT", "evil words", "see fake.com"]
    rows = [(i, rng.randrange(users), rng.random() * 100, rng.choice(["chat", "chat", "sign", "book"]), rng.choice(texts)) for i in range(n)]
    return rows + [(n + i, rng.choice([0, 3]), 60 + rng.random() * 3, "chat", f"word {chr(97 + i % 26) * 4}") for i in range(40)]


def some_marks():
    return [(1, 0, 10.0, "CHAT", 20), (2, 1, 15.5, "GLOBAL", 0), (3, 1, 40.0, None, 0), (4, 2, 30.0, "CHAT", 50), (5, 2, 50.0, "GLOBAL", 10), (6, 3, 1.0, "CHAT", 3)]


@pytest.fixture(scope="module")
def messages(spark):
    return spark.createDataFrame(some_messages(), MESSAGES).withColumn("ts", at()).drop("s").cache()


@pytest.fixture(scope="module")
def marks(spark):
    return spark.createDataFrame(some_marks(), MARKS).withColumn("created_at", at()).drop("s").cache()


def dealt(df, folder, parts, seed, ts="ts"):
    """``df`` as files of a stream, in ``parts`` micro-batches that overlap in time by at most 40 seconds, and a last row that moves the watermark."""
    spark, rng = df.sparkSession, random.Random(seed)
    rows = sorted(df.collect(), key=lambda r: r[ts].timestamp() + rng.random() * 40)
    size = -(-len(rows) // parts)
    for i in range(parts):
        some = rows[i * size : (i + 1) * size]
        rng.shuffle(some)
        spark.createDataFrame(some, df.schema).coalesce(1).write.mode("append").parquet(folder)
    last = {c: None for c in df.columns} | {ts: datetime.datetime.fromtimestamp(FAR, datetime.UTC).replace(tzinfo=None)}
    last |= {c: -1 for c in ("msg_id", "user_id", "id", "player_id") if c in df.columns} | ({"source": "chat"} if "source" in df.columns else {})
    spark.createDataFrame([tuple(last[c] for c in df.columns)], df.schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, tmp, sink=None, name="out"):
    writer = df.writeStream.option("checkpointLocation", str(tmp / f"cp-{name}")).trigger(availableNow=True)
    writer = writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", str(tmp / name))
    query = writer.start()
    query.awaitTermination(300)
    assert not query.isActive and query.exception() is None
    return None if sink else df.sparkSession.read.parquet(str(tmp / name))


@pytest.mark.parametrize("parts, seed", [(1, 1), (3, 2)])
def test_rules(messages, tmp_path, parts, seed):
    stream = dealt(messages, str(tmp_path / "in"), parts, seed)
    got = run(L.stream_user_rules(stream, watermark="60 seconds"), tmp_path)
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in S.user_rules(messages).collect()}


def test_mutes(spark, messages, marks, tmp_path):
    """Enforced as by intervals, and ended as by the table of current mutes."""
    texts = dealt(messages, str(tmp_path / "m"), 3, 3)
    given = dealt(marks, str(tmp_path / "k"), 2, 4, "created_at")
    found = run(L.stream_muted(texts, given, "60 seconds"), tmp_path).cache()
    stops = marks.where("scope is null").select("player_id", "created_at")
    intervals = mute_intervals(marks.where("scope is not null"), stops)
    want = {(r.msg_id, r.muted) for r in enforce_mutes(messages, intervals).collect()}
    assert {(r.msg_id, r.muted) for r in found.where("kind = 'message'").collect()} == want and len({m for _, m in want}) == 2
    # Each player's last mute that nobody took back, as the table has it.
    table = marks.where("id in (1, 5, 6)").selectExpr("player_id", "'x' reason", "'y' muted_by", "created_at + make_interval(0, 0, 0, 0, 0, 0, duration) expires_at", "created_at", "scope")
    _, audit = expire_mutes(table, F.timestamp_seconds(F.lit(FAR)))
    assert {tuple(r) for r in L.ended_mutes(found).collect()} == {tuple(r) for r in audit.select("player_id", "action", "detail", "timestamp").collect()}


def test_state_expires_by_part():
    """Buckets after 5 minutes, texts for the context after 15 seconds from the first, near repeats after an hour."""
    cfg = RuleConfig(flood_messages=2, flood_seconds=1e9, repeat_max=1, repeat_cooldown_s=10_000)
    user = S.UserState(cfg)
    assert [user.flood(t) for t in (0, 1, 2, 299)] == [False, False, True, True]
    assert user.flood(598) and not user.flood(898)  # a denial is a use
    assert [user.repeat("hello", t) for t in (0, 1)] == [False, True] and user.repeat("hello", 3_600) and not user.repeat("hello", 7_200)
    user = S.UserState(cfg)
    for t, text in enumerate("abc"):
        user.judge("chat", text, 7.0 * t)
    assert user.context == "a | b | c" and user.state["texts"] == []
    user.judge("chat", "d", 14.5)
    assert user.context == "d"
    user.judge("chat", "e", 30.0)
    assert user.context == "e" and user.ends() == [330.0, 45.0]
    user.expire(45.0)
    assert user.state["texts_from"] is None and user.state["used"] == 30.0


def test_state_of_a_stream_expires(spark, tmp_path):
    """What the store holds after the last part's time is over is nothing, and flags are those of the batch that drops the same."""
    cfg = RuleConfig(flood_messages=2, flood_seconds=1e9)
    rows = [(i, 1, float(s), "chat", "some text" if i % 2 else "other words") for i, s in enumerate([0, 1, 2, 301, 302, 303, 900, 4_600, 4_601])]
    messages = spark.createDataFrame(rows, MESSAGES).withColumn("ts", at()).drop("s")
    stream = dealt(messages, str(tmp_path / "in"), 2, 5)
    got = {tuple(r) for r in run(L.stream_user_rules(stream, cfg, "60 seconds"), tmp_path).collect()}
    assert got == {tuple(r) for r in S.user_rules(messages, cfg).collect()}
    assert [f for _, f in sorted((m, f) for _, m, f, _, _ in got)] == [False, False, True, True, True, True, False, False, False]
    for name in ("bucket", "texts", "repeats", "waiting"):
        left = spark.read.format("statestore").option("stateVarName", name).load(str(tmp_path / "cp-out"))
        assert left.where("key.user_id = 1").count() == 0


def terms(spark):
    return spark.createDataFrame([("evil", "NORMAL"), ("vaca", "STRONG")], "word string, mode string")


def test_moderate_stream(spark, messages, marks, tmp_path):
    """Verdicts with lists, rules, state, mutes and exemptions equal those of the batch, and the sink's tables follow from them."""
    grants = spark.createDataFrame([(2, ["ip", "caps"])], "user_id long, permissions array<string>")
    intervals = mute_intervals(marks.where("scope is not null"), marks.where("scope is null").select("player_id", "created_at"))
    want = moderate(messages, terms(spark), mutes=intervals, permissions=grants)
    texts, given = dealt(messages, str(tmp_path / "m"), 3, 6), dealt(marks, str(tmp_path / "k"), 2, 7, "created_at")
    folder = str(tmp_path / "tables")
    staff = spark.createDataFrame([(7, ["notify"]), (8, [])], "user_id long, permissions array<string>")
    players = spark.createDataFrame([(0, "zero"), (1, "one"), (2, "two")], "id long, name string")
    sink = moderation_sink(folder, players, staff)

    failed = []

    def twice(df, batch):
        """The second batch with rows fails after it has been written."""
        sink(df, batch)
        if not failed and batch > 1 and not df.isEmpty():
            failed.append(batch)
            raise RuntimeError("lost")

    stream = moderate_stream(texts, terms(spark), marks=given, permissions=grants, watermark="60 seconds")
    with pytest.raises(Exception, match="lost"):
        run(stream, tmp_path, twice)
    run(stream, tmp_path, twice)
    assert len(failed) == 1
    got = read_batches(spark, folder, "verdicts").cache()
    said = got.where("kind = 'message'")
    assert sorted(map(str, said.select(want.columns).collect())) == sorted(map(str, want.collect()))
    denied = said.where("reason = 'spam.flood'").selectExpr("msg_id", "user_id", "ts")
    sanctions = {(r.player_id, r.created_at) for r in S.auto_sanctions(denied).collect()}
    history = read_batches(spark, folder, "mute_history").collect()
    assert {(r.player_id, r.created_at) for r in history} == sanctions and len(history) == len(sanctions) > 0
    logs = read_batches(spark, folder, "monitor_logs").collect()
    assert sorted(r.id for r in logs) == sorted(r.msg_id for r in want.where("blocked").collect())
    assert {r.player_name for r in logs} == {"zero", "one", "two", "Unknown (ID: 3)"}
    alerts = read_batches(spark, folder, "alerts").collect()
    assert alerts and {r.recipient_id for r in alerts} == {7} and len({r.msg_id for r in alerts}) == len(alerts)
    audit = read_batches(spark, folder, "audit").collect()
    assert sum(r.action == "MUTE" for r in audit) == len(history) and sum(r.action == "UNMUTE" for r in audit) == got.where("kind = 'unmuted'").count() == 3
    assert any(r.detail == "Player: zero | Reason: Expired/Manual" for r in audit)
    now = read_batches(spark, folder, "muted").collect()
    assert len({r.player_id for r in now}) == len(now) and {r.player_id for r in now} <= {r.player_id for r in history}


def test_sanctions_mute(spark, tmp_path):
    """With feedback, a denied user is muted until the sanction ends, and its end is told."""
    cfg = RuleConfig(sanction_s=30)
    rows = [(i, 1, float(s), "chat", t) for i, (s, t) in enumerate(zip([0, 0.1, 0.2, 0.3, 0.4, 5, 20, 30.3, 30.5], "apple bridge cloud diving elfin forty gunship hymn ivory".split(), strict=True))]
    messages = spark.createDataFrame(rows, MESSAGES).withColumn("ts", at()).drop("s")
    stream = dealt(messages, str(tmp_path / "in"), 2, 8)
    found = run(moderate_stream(stream, terms(spark), cfg, watermark="60 seconds", feedback=True), tmp_path).cache()
    by = {r.msg_id: r for r in found.where("kind = 'message'").collect()}
    assert [by[i].reason for i in range(9)] == [None] * 4 + ["spam.flood", "muted", "muted", "muted", None]
    assert by[4].sanction and by[4].context == " | ".join(r[4] for r in rows[:5]) and not by[5].sanction
    assert [(r.user_id, r.ts.timestamp() - BEGIN) for r in found.where("kind = 'unmuted'").collect()] == [(1, pytest.approx(30.4))]
