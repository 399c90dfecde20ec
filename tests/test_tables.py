"""Changes and joins of tables, sinks, the moderation plan."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from modstream.operators import tables as T
from modstream.operators.rules import RuleConfig
from modstream.plans.moderation import moderate
from modstream.sources import io, schemas


def at(s):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=s)


def test_mutes(spark):
    history = spark.createDataFrame([(1, 7, "CHAT", 10, at(10)), (2, 8, "GLOBAL", 0, at(0)), (3, 9, "CHAT", 0, at(0))], "id long, player_id long, scope string, duration long, created_at timestamp")
    unmutes = spark.createDataFrame([(9, at(5))], "player_id long, created_at timestamp")
    rows = [(1, 7, 9, "chat"), (2, 7, 10, "chat"), (3, 7, 19, "chat"), (4, 7, 20, "chat"), (5, 7, 15, "sign"), (6, 8, 99, "sign"), (7, 9, 4, "chat"), (8, 9, 5, "chat"), (9, 1, 5, "chat")]
    messages = spark.createDataFrame([(i, u, at(t), s) for i, u, t, s in rows], "msg_id long, user_id long, ts timestamp, source string")
    got = {r.msg_id: r.muted for r in T.enforce_mutes(messages, T.mute_intervals(history, unmutes)).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: False, 6: True, 7: True, 8: False, 9: False}


def test_purge(spark):
    df = spark.createDataFrame([(1, at(-6 * 86400)), (2, at(-8 * 86400))], "id long, created_at timestamp")
    assert [r.id for r in T.purge(df, 7 * 86400, F.lit(at(0)), "created_at").collect()] == [1]


def test_register_refreshes(spark):
    players = spark.createDataFrame([(5, "a", "old", at(0))], schemas.TABLES["players"])
    new = spark.createDataFrame([("a", "new", at(9)), ("b", "bob", at(1)), ("b", "bob2", at(2))], "uuid string, name string, last_seen timestamp")
    got = {(r.id, r.uuid, r.name) for r in T.register_users(players, new, refresh=True).collect()}
    assert got == {(5, "a", "new"), (6, "b", "bob2")}
    assert {(r.id, r.name) for r in T.register_users(players, new).collect()} == {(5, "old"), (6, "bob2")}


def test_create_and_append(spark, tmp_path):
    schemas.create_tables(spark, str(tmp_path))
    schemas.create_tables(spark, str(tmp_path))
    verdicts = spark.createDataFrame([(1, "bob", "1.2.3.4", "Anti-Ip", None, "1.2.3.4", at(0), True), (2, "al", "x", "Filter", "chat", None, at(0), True), (3, "al", "x", None, "chat", None, at(0), False)], "msg_id long, user_name string, text string, category string, source string, detected string, ts timestamp, blocked boolean")
    io.append(io.violation_rows(verdicts), str(tmp_path), "monitor_logs")
    assert {(r.id, r.source) for r in schemas.read_table(spark, str(tmp_path), "monitor_logs").collect()} == {(1, "Unknown"), (2, "chat")}
    assert [r.id for r in io.violation_rows(verdicts, strict=True).collect()] == [1]
    assert schemas.read_table(spark, str(tmp_path), "audit").count() == 0


def test_messages(spark, tmp_path):
    spark.createDataFrame([(1, 2, "hi")], "msg_id long, user_id long, text string").write.parquet(str(tmp_path / "m"))
    signs, chat = (io.read_messages(spark, str(tmp_path / "m"), s) for s in ("sign", "chat"))
    both = io.union_messages(signs, chat)
    assert {(r.source, r.is_writable, r.check_traffic) for r in both.collect()} == {("sign", True, True), ("chat", False, True)}


@pytest.mark.parametrize("stateful", [True, False])
def test_moderate(spark, stateful):
    rows = [(1, 1, "chat", "hola v4c4"), (2, 1, "chat", "1.2.3.4"), (3, 2, "book", "vaca foo.com"), (4, 2, "command", "/say vaca"), (5, 3, "chat", "fine"), (6, 4, "chat", "1.2.3.4"), (7, 5, "chat", "1.2.3.4"), (8, 1, "chat", None)]
    messages = spark.createDataFrame([(i, u, at(i * 10), s, t) for i, u, s, t in rows], "msg_id long, user_id long, ts timestamp, source string, text string")
    lexicon = spark.createDataFrame([("vaca", "NORMAL")], "word string, mode string")
    mutes = spark.createDataFrame([(4, "CHAT", at(0), None)], "player_id long, scope string, valid_from timestamp, valid_to timestamp")
    permissions = spark.createDataFrame([(5, ["chat"])], "user_id long, permissions array<string>")
    got = {r.msg_id: (r.blocked, r.reason, r.masked) for r in moderate(messages, lexicon, mutes=mutes, permissions=permissions, stateful=stateful).collect()}
    assert got[1] == (True, "Evasion/Hidden Characters", None) and got[2][:2] == (True, "spam.ip") and got[3][:2] == (True, "spam.domain")
    assert got[4][0] is False and got[5] == (False, None, "fine") and got[6] == (True, "muted", None) and got[7] == (False, None, "1.2.3.4")
    assert len(got) == 8


def moderated(spark, rows, words=("vaca", "arm"), **how):
    messages = spark.createDataFrame([(i, u, at(s), source, t) for i, (u, s, source, t) in enumerate(rows)], "msg_id long, user_id long, ts timestamp, source string, text string")
    lexicon = spark.createDataFrame([(w, "NORMAL") for w in words], "word string, mode string")
    return {r.msg_id: r for r in moderate(messages, lexicon, **how).collect()}


def test_order_of_rules(spark):
    """Injection comes before all rules but the length of the text as sent; rules see what was rewritten and masked."""
    long = "<click:x>" * 150  # 1350 characters as sent, none without tags
    rows = [(1, 0, "chat", "<click:run>1.2.3.4"), (1, 10, "chat", long), (2, 20, "chat", "<click:run>hi arm 100%"), (3, 30, "chat", "an ARM 1.2.3.4"), (3, 40, "sign", "arm " + "!" * 6), (4, 50, "book", "arm 1.2.3.4"), (4, 60, "book", "arm")]
    got = moderated(spark, rows)
    assert [(got[i].reason, got[i].masked) for i in (0, 1)] == [("spam.ip", None), ("spam.chars", None)]
    assert (got[2].reason, got[2].masked) == (None, "hi **** 100%\u00a0")
    assert (got[3].reason, got[3].detected) == ("spam.ip", "1.2.3.4") and got[4].reason == "spam.repeat"
    assert (got[5].reason, got[6].reason, got[6].masked) == ("spam.ip", None, "****")
    got = moderated(spark, rows, cfg=RuleConfig(replacement=False))
    assert [got[i].reason for i in (0, 1, 2)] == ["spam.injection", "spam.chars", "Filter (Total Block)"]


def test_stopped_messages_leave_no_state(spark):
    """Addresses, domains, digits and runs stop a message before near repeats; addresses before split ones; flood before all."""
    repeat = [(1, i * 5, "chat", t) for i, t in enumerate(["buy this thing at foo.com"] * 4 + ["hello my friends"] * 2)]
    got = moderated(spark, repeat)
    assert [got[i].reason for i in range(6)] == ["spam.domain"] * 4 + [None, None]
    # The whole address doesn't join the fragments: three fragments are not enough.
    parts = [(2, i * 5, "chat", t) for i, t in enumerate(["192.168.7.10", "192", "168", "7"])]
    assert [r.reason for _, r in sorted(moderated(spark, parts).items())] == ["spam.ip", None, None, None]
    parts = [(2, i * 5, "chat", t) for i, t in enumerate(["192", "168", "7", "10"])]
    assert [r.reason for _, r in sorted(moderated(spark, parts).items())] == [None, None, None, "spam.ip-split"]
    flood = [(3, 0.1 * i, "chat", t) for i, t in enumerate(["good day", "how is everybody", "nothing to say", "what a long evening", "quiet here"])]
    assert [r.reason for _, r in sorted(moderated(spark, flood).items())] == [None] * 4 + ["spam.flood"]


def test_exemptions(spark):
    held = {1: ["ip"], 2: ["spam"], 3: ["digits"], 4: ["caps"], 5: ["injection"], 6: ["symbol.all"], 7: ["command"], 8: ["sign"]}
    permissions = spark.createDataFrame([(u, p) for u, p in held.items()], "user_id long, permissions array<string>")
    texts = ["1.2.3.4", "1.2.3.4 foo.com", "12345678 9", "ABCDEFGHIJKLMNOPQR", "<click:run>x", "vаr", "/say arm", "arm"]
    sources = ["chat"] * 6 + ["command", "sign"]
    rows = [(u, 10 * u, s, t) for u, (s, t) in enumerate(zip(sources, texts, strict=True), 1)]
    free = moderated(spark, rows, permissions=permissions)
    assert all(not r.blocked for r in free.values()) and [free[i].masked for i in (3, 4, 7)] == [texts[i] for i in (3, 4, 7)]
    bound = moderated(spark, [(u + 100, s, source, t) for u, s, source, t in rows], permissions=permissions)
    assert [bound[i].reason for i in (0, 1, 2, 5)] == ["spam.ip", "spam.ip", "spam.digits", "Zalgo/Unicode"] and bound[3].masked == texts[3].lower() and bound[4].masked == "x"
    twice = [(u, 50 + i, "chat", "the same again") for u in (9, 10) for i in range(3)]
    free = moderated(spark, twice, permissions=spark.createDataFrame([(9, ["repeat"])], "user_id long, permissions array<string>"))
    assert [free[i].reason for i in range(6)] == [None] * 5 + ["spam.repeat"]


def test_registered_rule(spark, monkeypatch):
    from modstream.operators import rules as R

    monkeypatch.setattr(R, "RULES", dict(R.RULES))
    monkeypatch.setattr(R, "REASONS", R.REASONS)
    R.register_rule("spam.shout", lambda t, cfg: F.when(t.endswith("!!!"), "!!!"), before="spam.ip")
    df = spark.createDataFrame([("1.2.3.4 now!!!",), ("1.2.3.4",), ("calm",)], "text string")
    assert [r.reason for r in R.spam_chain(df).collect()] == ["spam.shout", "spam.ip", None]


def test_auto_sanctions(spark):
    from modstream.streaming.state import auto_sanctions

    denied = spark.createDataFrame([(i, u, at(s)) for i, (u, s) in enumerate([(1, 0), (1, 4), (1, 9.9), (1, 10), (1, 12), (2, 11)])], "msg_id long, user_id long, ts timestamp")
    got = sorted((r.player_id, r.s) for r in auto_sanctions(denied).select("player_id", F.unix_seconds("created_at").alias("s")).collect())
    assert got == [(1, at(0).timestamp()), (1, at(10).timestamp()), (2, at(11).timestamp())]
    rows = T.sanction_rows(auto_sanctions(denied)).collect()
    assert {(r.scope, r.seconds) for r in rows} == {("CHAT", 900)}


def test_permission_closure(spark):
    """Deep chains, diamonds and circles of permissions."""
    parents = [(f"p{i}", f"p{i + 1}") for i in range(40)] + [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), (None, "x")]
    grants = [(1, "p0"), (2, "b"), (3, "none"), (2, "b")]
    got = {r.user_id: r.permissions for r in T.flat_permissions(spark.createDataFrame(grants, "user_id long, permission string"), spark.createDataFrame(parents, "permission string, includes string")).collect()}
    assert got == {1: sorted(f"p{i}" for i in range(41)), 2: list("abcd"), 3: ["none"]}
    assert T.flat_permissions(spark.createDataFrame(grants, "user_id long, permission string"), spark.createDataFrame([], "permission string, includes string")).count() == 3


def test_alerts(spark, tmp_path):
    verdicts = spark.createDataFrame([(1, "Anti-Ip", "chat", "x", True), (2, "Caps", "chat", "x", True), (3, "Anti-Ip", "Book", "x", True), (4, "Anti-Ip", "sign", "y", True), (5, "Anti-Ip", "sign", "y", False)], "msg_id long, category string, source string, text string, blocked boolean")
    staff = spark.createDataFrame([(7, ["notify"]), (8, ["chat"]), (6, ["notify", "x"]), (7, ["notify"])], "user_id long, permissions array<string>")
    found = io.alerts(verdicts, staff)
    assert {(r.msg_id, tuple(r.recipients)) for r in found.collect()} == {(1, (6, 7)), (4, (6, 7))}
    io.append_alerts(found, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "alerts")).count() == 4
    assert {tuple(r.recipients) for r in io.alerts(verdicts, staff.limit(0)).collect()} == {()}


def test_rows_of_warnings_and_mutes(spark):
    actions = spark.createDataFrame([(1, 5, "mod", " rude ", at(0)), (2, 5, None, None, at(1))], "id long, player_id long, moderator string, reason string, created_at timestamp")
    assert [(r.moderator, r.reason) for r in io.warning_rows(actions).sort("id").collect()] == [("mod", "rude"), ("System", "none")]
    done = spark.createDataFrame([(1, 5, "r", None, -1, at(0), "CHAT"), (2, 5, "r", "m", 60, at(0), "GLOBAL")], "id long, player_id long, reason string, moderator string, seconds long, created_at timestamp, scope string")
    rows = io.mute_history_rows(done)
    assert [(r.moderator, r.duration) for r in rows.sort("id").collect()] == [("System", 0), ("m", 60)] and set(rows.columns) == {c.split()[0] for c in schemas.TABLES["mute_history"].split(", ")}


def test_numbered(spark):
    from modstream.sources.shared import numbered

    df = spark.createDataFrame([(i * 7 % 1000, "x") for i in range(1000)] + [(None, "n"), (5, "again")], "k long, row_ string")
    got = numbered(df, "k", "row_").sort("row").collect()
    assert [r.row for r in got] == list(range(1, 1003)) and got[0].k is None
    keys = [(r.k, r.row_) for r in got[1:]]
    assert keys == sorted(keys)
    assert numbered(df.limit(0), "k").count() == 0


def test_similar_pairs(spark):
    """All pairs above the limit and no others, for limits on both sides of where grams get shorter."""
    import random

    from modstream.functions.text import jaro_winkler
    from modstream.operators.names import similar_pairs, winkler_pairs
    from modstream.streaming.state import edit_distance

    rng = random.Random(5)
    names = ["".join(rng.choices("abAB1", k=rng.randint(1, 14))) for _ in range(150)] + ["", None, "abcabcabc", "ABCabcabd", "abcabcab", "aaaaaaaa", "aaaaaaa", "Éa", "éa"]
    names += [n[:3] + "x" + n[4:] for n in names if n]
    table = spark.createDataFrame([(n, 1) for n in names + names[:5]], "name string, at int").repartition(3)

    def similar(a, b):
        x, y = a.lower(), b.lower()
        longer = max(len(x), len(y))
        return 0.0 if abs(len(x) - len(y)) > longer * 0.4 else (longer - edit_distance(x, y)) / longer * 100

    distinct = sorted({n for n in names if n})
    for least in (100, 80, 60, 35):
        got = {(r.a, r.b): r.similarity for r in similar_pairs(table, least).collect()}
        assert got == {(a, b): pytest.approx(similar(a, b)) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if similar(a, b) >= least}
    assert all(r.jaro_winkler == pytest.approx(jaro_winkler(r.a, r.b)) for r in winkler_pairs(table, 80).collect())
    assert similar_pairs(table.limit(0)).count() == 0
