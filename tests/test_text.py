"""Text functions and rules on small golden rows."""

import pytest
from pyspark.sql import functions as F

from modstream.functions import text as X
from modstream.operators import rules as R


def one(spark, value, *columns):
    schema = "t string" if isinstance(value, str) or value is None else "t long"
    return tuple(spark.createDataFrame([(value,)], schema).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first())


T = F.col("t")


@pytest.mark.parametrize(
    "text,form",
    [("v4c4", "vaca"), ("vácá", "vaca"), ("H3LL0", "hello"), ("M1erda", "mierda"), ("&cvaca", "vaca"), ("", ""), ("a b-c", "abc"), ("vаcа", "vaca"), ("§#12345678x", "tbx"), ("§#12ab", "izab"), ("ﬁn​e", "fine"), ("٣x", "ex")],
)
def test_search_form(spark, text, form):
    assert one(spark, text, X.normalize_search(T)) == (form,)
    clean, at = X.search_form(text)
    assert len(clean) == len(at) and all(0 <= i < len(text) for i in at)
    if text.isascii():
        assert clean == form


def test_null_texts(spark):
    assert one(spark, None, X.normalize_search(T), X.strip_tags(T), X.nfkc(T), R.find_ipv4(T)) == (None, None, None, None)


@pytest.mark.parametrize("text,ok", [("h̀ól̂a", False), ("vаcа", False), ("Hello! How are you?", True), ("naïve ß ơ", True), ("a​b", False)])
def test_charset(spark, text, ok):
    assert one(spark, text, X.valid_charset(T)) == (ok,)


def test_charset_gate(spark):
    gate = one(spark, "а" * 60, X.charset_gate(T))[0]
    assert gate.blocked and gate.evasion and gate.reason == "Zalgo/Unicode" and gate.text == "а" * 50 + "..."


@pytest.mark.parametrize("text,safe", [("<red>hi</red>", "<red>hi</red>"), ("<click:run>hi</click>", "hi"), ("50%", "50% "), ("a\u0001b", "ab"), ("<#ff00ff>x", "<#ff00ff>x"), ("plain", "plain")])
def test_injection(spark, text, safe):
    rule, strict = one(spark, text, X.injection_rule(T), X.injection_rule(T, False))
    assert rule.text == safe and rule.hit == (safe != text) == strict.blocked and not rule.blocked


def test_small_functions(spark):
    assert one(spark, "Hola <b>x</b>", X.strip_tags(T), X.contains_ci(T, "HOLA"), X.truncate(T, 4)) == ("Hola x", True, "Hola...")
    assert one(spark, "/Msg bob hi there", X.split_command(T)["cmd"], X.split_command(T)["args"]) == ("msg", "bob hi there")
    assert one(spark, "Player: bob | Reason: x:y", X.detail_map(T)) == ({"Player": "bob", "Reason": "x:y"},)
    assert one(spark, "a b c Bad! d e f", X.kwic(T, F.lit("bad"), 1), X.kwic(T, F.lit("zz"), 1)) == ("c Bad! d", "a b c Bad! d e f")
    assert one(spark, " va<nil>la: 1 ", X.sanitize_label(T)) == ("vanilla: 1",) and one(spark, "!", X.sanitize_label(T)) == ("Unknown",)
    assert one(spark, "é́x", X.sanitize_display(T)) == ("éx",)


@pytest.mark.parametrize("text,seconds", [("15m", 900), ("1h", 3600), ("2d", 172800), ("10", 10), ("5x", -1), ("", -1), ("99999999999999999999", -1)])
def test_parse_duration(spark, text, seconds):
    assert one(spark, text, X.parse_duration(T)) == (seconds,)


@pytest.mark.parametrize("seconds,text", [(0, "0s"), (-5, "0s"), (59, "59s"), (60, "1m"), (3661, "1h 1m"), (90061, "1d 1h 1m")])
def test_format_duration(spark, seconds, text):
    assert one(spark, seconds, X.format_duration(T)) == (text,)


@pytest.mark.parametrize("a,b,pct", [("hello world", "hello worle", 90.909091), ("hi", "hello", 0), ("Hi", "hI", 100)])
def test_similarity(spark, a, b, pct):
    assert one(spark, a, F.round(X.similarity_pct(T, F.lit(b)), 6)) == (pct,)


def test_jaro_winkler():
    assert X.jaro_winkler("a", "a") == 100 and X.jaro_winkler("abc", "xyz") == 0 and X.jaro_winkler(None, "a") == 0
    assert X.jaro_winkler("martha", "marhta") == pytest.approx(96.11, abs=0.01)


def test_reasons(spark):
    df = spark.createDataFrame([("SPAM much",), ("other",), (None,)], "reason string")
    assert [r.reason for r in X.expand_reason(df, {"spam": "Flooding the chat"}).collect()] == ["Flooding the chat much", "other", None]


@pytest.mark.parametrize("category,kind,notify", [("Anti-Flood", "flood", True), ("IP Split", "address", True), ("Repeat", "filter", False), ("Injection", "injection", True), ("Caps", "filter", False)])
def test_alerts(spark, category, kind, notify):
    assert one(spark, category, X.alert_class(T), X.should_notify(T)) == (kind, notify)


@pytest.mark.parametrize("text,ip", [("192.168.1.55 join now", "192.168.1.55"), ("999.1.1.1", None), ("1.2.3.4.5", "1.2.3.4"), ("x256.1.1.1 8.8.8.80", "8.8.8.80")])
def test_ipv4(spark, text, ip):
    assert one(spark, text, R.find_ipv4(T)) == (ip,)


@pytest.mark.parametrize(
    "text,endings,found",
    [("visit www dot fake dot com", ("com",), ["fake.com"]), ("my site . c o m", ("com",), ["site.com"]), ("my site . c o m", ("co", "com"), ["site.co"]), ("hello, info here", ("info",), ["hello.info"]), ("a (dot) com", ("com",), ["a.com"]), ("no such", ("com",), []), ("x.com", (), [])],
)
def test_domains(spark, text, endings, found):
    assert one(spark, text, R.find_domains(T, endings)) == (found,)


def test_domain_lists(spark):
    assert one(spark, "see google.com", R.find_domains(T, ("com",), ("google.com",))) == ([],)
    assert one(spark, "join s e r v e r . u s", R.find_blacklisted(T, ["server.us"]), R.find_blacklisted(T, [])) == ("serverus", None)


@pytest.mark.parametrize("rule,text,hit", [
    (lambda: R.digit_limit(T, 7), "a12345678", True), (lambda: R.digit_limit(T, 7), "1234567", False), (lambda: R.digit_limit(T, 0), "1" * 20, False),
    (lambda: R.char_run(T, 5), "heeeeeey", True), (lambda: R.char_run(T, 5), "heeeeey", False), (lambda: R.word_run(T, 3), "spam SPAM spam spam", True),
    (lambda: R.word_run(T, 3), "spam spam spam spammer", False), (lambda: R.word_run(T, 3), "a spam  spam spam spam b", True),
    (lambda: R.caps_limit(T, 15) != T, "A" * 16, True), (lambda: R.caps_limit(T, 15) != T, "A" * 15, False), (lambda: R.blocked_command(T), "tell", True),
])
def test_limits(spark, rule, text, hit):
    assert one(spark, text, rule()) == (hit,)


def test_chain(spark):
    rows = [(1, "9.9.9.9 12345678"), (2, "HELLO EVERYBODY OUT THERE"), (3, "x" * 1001), (4, "ok"), (5, "visit foo.com"), (6, None)]
    found = {r.msg_id: r for r in R.spam_chain(spark.createDataFrame(rows, "msg_id long, text string")).collect()}
    assert [found[i].reason for i in range(1, 7)] == ["spam.ip", None, "spam.chars", None, "spam.domain", None]
    assert found[2].modified and found[2].final_text == "hello everybody out there" and found[5].detected == "foo.com" and found[1].detected == "9.9.9.9"


def test_books(spark):
    df = spark.createDataFrame([(["a" * 300] * 31,)], "p array<string>")
    got = df.select(R.book_limits(F.col("p")).alias("b")).first().b
    assert got.too_many and got.too_long and {len(p) for p in got.pages} == {256}
    rows = spark.createDataFrame([(1, "spam.ip"), (1, None), (2, "spam.digits"), (3, None)], "container_id long, reason string")
    assert {tuple(r) for r in R.book_security(rows).collect()} == {(1, True), (2, False), (3, False)}


def test_sql_functions(spark):
    """The helpers in SQL give what they give on columns."""
    from modstream.functions import sql

    sql.register_functions(spark)
    rows = [("h3ll0", "hello"), ("&cvaca", "vaca"), ("vаcа", "x"), ("15m", "1h"), ("2d", "99999999999999999999d"), (None, "a"), ("hello world", "hello worle"), ("5x", "")]
    df = spark.createDataFrame(rows, "a string, b string")
    df.createOrReplaceTempView("pairs")
    got = spark.sql("SELECT search_text(a) f, valid_charset(a) v, parse_duration(a) d, parse_duration(b) e, round(similarity_pct(a, b), 6) s, round(jaro_winkler_pct(a, b), 6) j, strip_color_codes(a) c FROM pairs").collect()
    a, b = F.col("a"), F.col("b")
    want = df.select(
        X.normalize_search(a).alias("f"), X.valid_charset(a).alias("v"), X.parse_duration(a).alias("d"), X.parse_duration(b).alias("e"), F.round(X.similarity_pct(a, b), 6).alias("s"),
        F.round(X.jaro_winkler_pct(a, b), 6).alias("j"), X.strip_color_codes(a).alias("c"),
    ).collect()
    assert got == want


def test_domains_in_sql(spark):
    """``find_domains`` in SQL gives what it gives on columns."""
    from modstream.functions import sql

    sql.register_functions(spark)
    texts = ["visit www dot fake dot com", "my site . c o m", "hello, info here", "see google.com and foo.net", "a ( punto ) n e t", "no domain", "", None, "x-y_z.io! UP.COM", "end."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert df.selectExpr("find_domains(t) d").collect() == df.select(R.find_domains(F.col("t")).alias("d")).collect()


def test_matches_in_sql(spark):
    """The table function gives the rows of ``match_terms``, in order; words within others count by mode."""
    from modstream.functions import sql
    from modstream.operators import lexicon as L

    terms = spark.createDataFrame([("arm", "NORMAL"), ("arm", "STRONG"), ("vaca", "STRONG"), ("war", "WRITE_COMMAND"), ("", "NORMAL")], "word string, mode string")
    texts = spark.createDataFrame(list(enumerate(["an arm here", "warm v4c4", "farm 7arm arm7 arm", "&cvaca a.r.m", "none", "", None])), "msg_id long, text string")
    sql.register_matcher(spark, terms)
    got = {}
    for r in spark.sql("SELECT t.msg_id, m.* FROM {texts} t, LATERAL term_matches(t.text) m", texts=texts).collect():
        got.setdefault(r.msg_id, []).append(tuple(r)[1:])
    want = {r.msg_id: [tuple(m) for m in r.matches] for r in L.match_terms(texts, terms).collect() if r.matches}
    assert got == want and len(want) == 4


def test_domains_are_found_once_at_dots_before_endings(spark, sf_dir):
    """Odd blanks, letters and line ends; no list of all parts of a text, and no second search for a filter."""
    from modstream.plans.catalog import QUERIES

    texts = ["abc\r .com", "abc \r.com", "ab\u2028.org x", "x.com\u00e9", "x.com \u00e9", "x.lin\u212a", "x.\u017fite", "a.com.net.x", ".com", "a.\nshop\n", "x.c\u00a0om"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r.d for r in df.select("i", R.find_domains(F.col("t")).alias("d")).orderBy("i").collect()]
    assert got == [["abc.com"], [], ["ab.org"], [], ["x.com"], ["x.link"], [], ["a.com", "com.net"], [], ["a.shop"], []]
    plan = QUERIES["domains"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan


def test_quiet_texts_are_left_alone(spark):
    """No clean-up changes a character that counts as quiet, and texts with others are cleaned as before."""
    import re
    import unicodedata

    quiet = re.compile(X.QUIET.replace("\\z", "\\Z"))
    chars = [c for c in map(chr, range(0x400)) if quiet.match(c)]
    assert len(chars) > 500 and all(unicodedata.normalize("NFKC", c) == c and (c == "\n" or unicodedata.category(c)[0] != "C") for c in chars)
    for text, message, control in (("a\u00e9\n", "a\u00e9\n", "a\u00e9\n"), ("a\u00ad\u200db\r", "a\u200db", "ab"), ("\ufb01\x07", "fi", "fi"), ("a\r", "a", "a"), (None, None, None)):
        df = spark.createDataFrame([(text,)], "t string")
        assert tuple(df.select(X.sanitize_message(F.col("t")), X.sanitize_control(F.col("t"))).first()) == (message, control)
