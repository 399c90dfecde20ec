"""Rules with state: golden sequences, and batch equal to stream."""

import random

import pytest
from pyspark.sql import functions as F

from modstream.operators.rules import RuleConfig
from modstream.streaming import state as S

CFG = RuleConfig()


def test_token_bucket():
    state = S.UserState(CFG)
    assert [state.flood(t) for t in (0, 0, 0, 0, 0, 0.5)] == [False] * 4 + [True, False]


def test_repeat():
    state = S.UserState(CFG)
    assert [state.repeat("hello", t) for t in (0, 1, 2, 3, 6)] == [False, False, True, True, False]
    assert not state.repeat("x", 7) and state.state == S.UserState(CFG, state.state).state


def test_split_address():
    run = lambda *parts: [S.UserState.split_address(state, p) for p in parts]
    state = S.UserState(CFG)
    assert run("192", "168", "1", "10") == [False, False, False, True]
    state = S.UserState(CFG)
    assert run("1", "2", "3", "4") == [False] * 4
    state = S.UserState(CFG)
    assert run("no digits", "1" * 60, "5", "5") == [False] * 4


def rows(n=300):
    rng = random.Random(1)
    texts = ["hello there", "hello therE", "192", "168", "1", "10", "good day", "x", None]
    return [(i, rng.randrange(5), rng.random() * 100, rng.choice(["chat", "chat", "sign"]), rng.choice(texts)) for i in range(n)]


@pytest.fixture(scope="module")
def messages(spark):
    df = spark.createDataFrame(rows(), "msg_id long, user_id long, s double, source string, text string")
    return df.withColumn("ts", F.timestamp_micros(F.lit(1_700_000_000_000_000) + (F.col("s") * 1e6).cast("long"))).drop("s").cache()


def test_batch(messages):
    got = {r.msg_id: (r.flood, r.split_ip, r.repeat) for r in S.user_rules(messages).collect()}
    states, want = {}, {}
    for r in sorted(messages.collect(), key=lambda r: (r.ts, r.msg_id)):
        v = states.setdefault(r.user_id, S.UserState(CFG)).verdict({"source": r.source, "text": r.text, "at": r.ts.timestamp()})
        want[r.msg_id] = (v["flood"], v["split_ip"], v["repeat"])
    assert got == want and sum(map(any, want.values())) > 20


def test_throttle(spark):
    df = spark.createDataFrame([(i, 1, t) for i, t in enumerate((0, 1000, 1600, 2900, 3100))], "msg_id long, user_id long, ms long").withColumn("ts", F.timestamp_millis("ms"))
    assert [r.allowed for r in S.throttle(df, 1.5).orderBy("msg_id").collect()] == [True, False, True, False, True]
    assert [r.allowed for r in S.rate_cap(df, 1, 1).orderBy("msg_id").collect()] == [True, True, False, True, True]


@pytest.mark.parametrize("gap", [0.5, 3.0])
def test_sessions(spark, monkeypatch, gap):
    """A hot user's rows are in many ranges; sessions begin where the gap is long enough, and folds by session give what those by user give."""
    rng, at, rows = random.Random(4), 0.0, []
    for i in range(3000):
        at += rng.choice([0.0, 0.1, 0.4, 0.5, 2.0, 3.0])
        rows.append((i, 7 if i % 3 else rng.randrange(6) if i % 5 else None, at))
    df = spark.createDataFrame(rows, "msg_id long, user_id long, at double").repartition(5)
    with_ranges = S.with_sessions(df, gap).collect()
    last, want = {}, {}
    for i, user, t in rows:
        begun = last[user][1] if user in last and t - last[user][0] < gap else t
        last[user] = (t, begun)
        want[i] = begun
    assert {r.msg_id: r.session for r in with_ranges} == want and len(with_ranges) == len(rows)
    events = df.withColumn("ts", F.timestamp_micros((F.col("at") * 1e6).cast("long"))).drop("at")
    plain = [S.throttle(events, gap).collect(), S.token_bucket(events, 3, gap).collect()]
    monkeypatch.setattr(S, "HOT_ROWS", 10)
    assert [sorted(S.throttle(events, gap).collect(), key=str), sorted(S.token_bucket(events, 3, gap).collect(), key=str)] == [sorted(p, key=str) for p in plain]


def test_bucket_bound(messages):
    allowed = S.token_bucket(messages, 4, 2).where("allowed").drop("user_id").join(messages, "msg_id").groupBy("user_id").agg(F.count("*").alias("n"), (F.max("ts").cast("double") - F.min("ts").cast("double")).alias("t"))
    assert all(r.n <= 4 + 2 * r.t + 1 for r in allowed.collect())


def test_session_end():
    state = S.UserState(CFG)
    for t in range(3):
        state.verdict({"source": "chat", "text": "hello", "at": 0.0})
    state.verdict({"source": "end_session", "text": "", "at": 0.0})
    assert state.state["tokens"] is None and state.state["repeats"] == []


def test_similarity_of_pruned_pairs():
    """What is skipped is below the limit, whatever the limit."""
    rng = random.Random(2)
    texts = ["".join(rng.choices("abc ", k=rng.randint(1, 30))) for _ in range(60)]
    texts += [t[:-1] + "x" for t in texts] + [t[1:] for t in texts]
    for a in texts:
        b = rng.choice(texts)
        full = S.similarity(a, b)
        for least in (1, 50, 80, 99):
            assert (S.similarity(a, b, least) >= least) == (full >= least)
            assert full < least or S.similarity(a, b, least) == full
