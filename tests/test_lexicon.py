"""Term lists: the three ways to match agree, whole words, evasion, masks."""

import pytest
from pyspark.sql import functions as F

from modstream.operators import lexicon as L
from modstream.operators.rules import RuleConfig

TERMS = [("arm", "NORMAL"), ("gato", "STRONG"), ("vaca", "NORMAL"), ("mod", "WRITE_COMMAND"), ("ga", "STRONG"), ("atoll", "STRONG")]


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(TERMS, "word string, mode string")


def messages(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "msg_id long, text string")


def filtered(spark, lexicon, *texts, **how):
    return [r for r in L.filter_texts(messages(spark, *texts), lexicon, **how).orderBy("msg_id").collect()]


def test_ways_agree(spark, lexicon):
    texts = messages(spark, "g4t0 ll arm", "farm gatoll", "nothing", "", None, "xx v.a.c.a yy", "gatogato")
    spans = lambda df: sorted((r.msg_id, sorted(map(str, r.matches))) for r in df.collect())
    assert spans(L.match_terms(texts, lexicon)) == spans(L.match_terms(texts, lexicon, most=0))


def test_whole_words_and_masks(spark, lexicon):
    a, b, c, d = filtered(spark, lexicon, "an arm here", "farm", "arm or arm", "Hola v4c4")
    assert (a.masked_text, a.filter_reason, a.detected_words) == ("an **** here", "Filter (arm)", ["arm"])
    assert b.detected_words == [] and b.masked_text == "farm"
    assert c.masked_text == "**** or ****" and not c.hidden
    assert d.masked_text == "Hola ****" and d.hidden


def test_evasion_and_commands(spark, lexicon):
    a, b, c = filtered(spark, lexicon, "g.a.t.o", "run mod", "gаto")
    assert a.filter_blocked and a.filter_reason == "Evasion" and a.is_evasion
    assert b.filter_blocked and b.filter_reason == "WriteCommand" and b.detected_word == "mod"
    assert c.filter_blocked and c.filter_reason == "Zalgo/Unicode"


def test_total_block_and_api(spark, lexicon):
    assert filtered(spark, lexicon, "an arm", cfg=RuleConfig(replacement=False))[0].filter_reason == "Filter (Total Block)"
    rows = messages(spark, "an arm", "fine", "g.a.t.o")
    assert [r.clean for r in L.is_clean(rows, lexicon).orderBy("msg_id").collect()] == [False, True, False]
    assert [r.clean for r in L.is_clean_for_command(rows, lexicon).orderBy("msg_id").collect()] == [True, True, True]
    assert [r.safe_text for r in L.filtered_text(rows, lexicon).orderBy("msg_id").collect()] == ["an ****", "fine", "****"]


@pytest.mark.parametrize("text", ["vaca", "VACA", "v4c4", "vácá", "v a c a", "v-a-c-a", "&c vaca", "v​aca", "vａca"])
def test_spellings(spark, lexicon, text):
    row = filtered(spark, lexicon, text)[0]
    assert row.filter_blocked or row.detected_words


def test_mask_literals(spark):
    df = spark.createDataFrame([("Bad bAd good.", ["bad", "."])], "t string, w array<string>")
    assert df.select(L.mask_literals(F.col("t"), F.col("w"))).first()[0] == "**** **** good****"


def test_pages(spark, lexicon):
    pages = spark.createDataFrame([(1, 0, "an arm"), (1, 1, "ok"), (2, 0, "а")], "container_id long, page_no int, text string")
    got = {r.container_id: (r.cancelled, r.pages) for r in L.moderate_pages(pages, lexicon).collect()}
    assert got == {1: (False, ["an ****", "ok"]), 2: (True, ["****"])}


def test_upkeep(spark, lexicon):
    new = spark.createDataFrame([("G4to", "STRONG"), ("new1", "STRONG"), ("...", "STRONG")], "word string, mode string")
    added = L.lexicon_add(lexicon, new)
    assert {r.word for r in added.collect()} - {w for w, _ in TERMS} == {"newi"}
    gone = L.lexicon_remove(added, spark.createDataFrame([("N3W1",), ("VACA",)], "word string"))
    assert "vaca" not in {r.word for r in gone.collect()}
    assert [r.word for r in L.lexicon_page(lexicon, "STRONG", 99, 2).collect()] == ["gato"]


def test_lexicon_source(spark, tmp_path):
    from modstream.sources import io

    for mode in L.MODES:
        (tmp_path / f"{mode.lower()}.txt").write_text("# note\n\n  V4ca \nvaca\n...\n")
    assert [tuple(r) for r in io.read_lexicon(spark, str(tmp_path / "strong.txt"), "STRONG").collect()] == [("vaca", "STRONG")]
    assert io.read_lexicons(spark, str(tmp_path)).count() == 3


def test_scan_of_many_texts():
    """Letters and places of texts put together are those of each text alone; no match goes from one text into the next."""
    from modstream.functions.text import search_form, search_forms

    texts = ["ﬁsh ﷺ", "", "&cred §#12345", "a&", "c\nv4cá", "\U0001d400rm ½ ß", "g&", "ato", "§#1\n3456gato", "ＡＲＭ"]
    letters, at, letter_ends, ends, _ = search_forms(texts)
    first = [0, *(int(e) + 1 for e in letter_ends)]
    for i, text in enumerate(texts):
        clean, places = search_form(text)
        assert (letters[first[i] : letter_ends[i]], [p - (ends[i] - len(text)) for p in at[first[i] : letter_ends[i]].tolist()]) == (clean, places)
    found = L.Matcher(sorted([("gato", "STRONG"), ("arm", "NORMAL"), ("arm", "STRONG"), ("m\n", "STRONG")])).scan([*texts, "x1arm arm", "arm", "m"])
    assert list(zip(*(f.tolist() for f in found), strict=True)) == [
        (5, 1, 0, 2, 0, 2), (5, 0, 0, 2, 0, 2), (8, 2, 0, 3, 8, 11), (9, 1, 0, 2, 0, 2), (9, 0, 0, 2, 0, 2), (10, 1, 2, 4, 2, 4), (10, 1, 5, 7, 6, 8), (10, 0, 5, 7, 6, 8), (11, 1, 0, 2, 0, 2), (11, 0, 0, 2, 0, 2),
    ]


@pytest.mark.parametrize("name", ["term_counts", "sql_terms", "filtered_lines"])
def test_texts_are_scanned_once(spark, sf_dir, name):
    """In batches, and not again for a filter on what was found."""
    from modstream.plans.catalog import QUERIES

    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("EvalPython") == 1 and "EvalPythonUDTF" not in plan
