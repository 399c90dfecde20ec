"""The pipeline on the smallest tables: each stage against what its own input says."""

import itertools
import re

import pytest

import corpus_pipeline
from modstream.llm import mixing
from modstream.llm.common import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = [docs]
    for _, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf_dir), "stage"))
    return out


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    assert {"doc_id", "ids", "n_tokens"} <= set(stages[-1].columns)


def test_quality(stages):
    kept = {r.doc_id for r in stages[1].collect()}
    good = 0
    for r in stages[0].collect():
        w = WORD.findall(r.text)
        windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        twice = {x for x in windows if windows.count(x) > 1}
        marked = {i + k for i, x in enumerate(windows) if x in twice for k in range(5)}
        passed = len(w) >= 10 and 100 * len(marked) <= 20 * len(w)
        assert passed or r.doc_id not in kept
        if passed and sum(r.text.count(c) for c in "#*$%&|<>") > len(w) / 2:  # tables and decorated words are far above the band
            assert r.doc_id not in kept
        elif passed:
            good += 1
    assert len(kept) >= 0.95 * good


def test_near_dedup(stages):
    rows = {r.doc_id: shingles(r.text) for r in stages[1].collect()}
    kept = {r.doc_id for r in stages[2].collect()}
    parent = {i: i for i in rows}
    for a, b in itertools.combinations(sorted(rows), 2):
        if len(rows[a] & rows[b]) >= 0.8 * len(rows[a] | rows[b]):
            x, y = a, b
            while parent[x] != x:
                x = parent[x]
            while parent[y] != y:
                y = parent[y]
            parent[max(x, y)] = min(x, y)
    assert kept == {i for i in rows if parent[i] == i}


def test_secrets_are_gone(stages):
    before, after = ({r.doc_id: r.text for r in s.collect()} for s in stages[2:4])
    assert before.keys() == after.keys()
    changed = {i for i in before if before[i] != after[i]}
    assert not any(re.search("AKIA[A-Z0-9]{14}|[0-9a-f]{16}", t) for t in after.values())
    assert all(re.search("AKIA|[0-9a-f]{16}|://|(?i:password|passwd|secret|token|api_?key)", before[i]) for i in changed)


def test_mixing(stages):
    want = {r.source: r.n for r in mixing.mix_sources(stages[3]).groupBy("source").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "n").collect()}
    got = dict.fromkeys(want, 0)
    for r in stages[4].collect():
        got[r.source] += len(WORD.findall(r.text))
    assert got == want


def test_tokens(stages):
    import sentencepiece

    from modstream.llm.sentencepieces import MODEL

    other = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = sorted((r.doc_id, other.encode(r.text)) for r in stages[4].collect())
    assert rows == sorted((r.doc_id, r.ids) for r in stages[5].collect())


def test_run(spark, sf_dir, stages):
    found = corpus_pipeline.run(spark, sf_dir)
    assert sorted((r.doc_id, r.n_tokens) for r in found.collect()) == sorted((r.doc_id, r.n_tokens) for r in stages[5].collect())
