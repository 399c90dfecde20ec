"""Top-k search, spelling variants and centroid clustering against plain brute-force versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from modstream.llm import centroids, spelling, topk
from modstream.llm.integers import floored, products, squares

VECTORS = "vec_id long, embedding array<float>, v int, score string, cluster string, ids int"


def table_of(spark, vectors):
    """Rows of (vec_id, embedding), with more columns whose names clash with those of operators."""
    return spark.createDataFrame([(i, v, 1, "x", "y", 2) for i, v in vectors], VECTORS)


def some_vectors(size=8, seed=3):
    """Groups of near ones, many copies of one, ties, and all that takes no part."""
    rng = random.Random(seed)
    out = []
    for _ in range(30):
        center = [rng.gauss(0, 1) for _ in range(size)]
        out += [[c + rng.gauss(0, 0.3) for c in center] for _ in range(12)]
    out += [out[7]] * 150 + [[0.0] * size, [-0.0] * size, [1e-9] * size, None, [math.nan] * size, [math.inf] + [1.0] * (size - 1), [None] + [1.0] * (size - 1), [1.0, 2.0], [3.0, 1.0], []]
    rows = list(enumerate(out))
    rng.shuffle(rows)
    return rows + [rows[5], rows[6], (None, out[0])]


def whole(v):
    if v is None or any(x is None or not math.isfinite(x) for x in v):
        return None
    return tuple(math.floor(256 * float(np.float32(x))) for x in v)


def best_of(rows, asks, k):
    """query -> [(score, vec_id)] by brute force."""
    good = sorted({(i, whole(v)) for i, v in rows if i is not None and whole(v) is not None})
    out = {}
    for q, x in good:
        if asks(q):
            found = [(sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in good if i != q and len(y) == len(x)]
            out[q] = sorted(found, key=lambda f: (-f[0], f[1]))[:k]
    return out


@pytest.mark.parametrize("shard, leaf, part, k", [(16, 4, 25, 5), (8_192, 64, 20_000, 3), (16, 4, 25, 100)])
def test_top_k(spark, monkeypatch, shard, leaf, part, k):
    """With many small shards, parts and chunks of queries, or one: what all pairs give."""
    for name, value in (("SHARD", shard), ("LEAF", leaf), ("PART", part)):
        monkeypatch.setattr(topk, name, value)
    rows = some_vectors()
    got = collections.defaultdict(list)
    for r in sorted(topk.top_k(table_of(spark, rows), F.col("vec_id") % 3 == 0, k).collect()):
        assert r.rank == len(got[r.query_id]) + 1
        got[r.query_id].append((r.score, r.vec_id))
    want = best_of(rows, lambda q: q % 3 == 0, k)
    assert dict(got) == {q: found for q, found in want.items() if found}


def test_top_k_of_nothing(spark):
    rows = some_vectors()
    none = topk.top_k(table_of(spark, rows).limit(0), F.col("vec_id") % 2 == 0)
    assert none.columns == ["query_id", "rank", "vec_id", "score"] and none.count() == 0
    assert topk.top_k(table_of(spark, rows), F.lit(None).cast("boolean")).count() == 0
    assert topk.top_k(table_of(spark, [(2, [1.0, 2.0])]), F.lit(True)).count() == 0


def test_one_id_with_two_vectors(spark):
    """They ask each for itself, and are no candidates of each other."""
    got = topk.top_k(table_of(spark, [(0, [1.0]), (0, [2.0]), (1, [4.0])]), F.col("vec_id") == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, 256 * 1024), (0, 1, 1, 512 * 1024)]


def test_dimension_that_the_sample_lacks(spark, monkeypatch):
    """Vectors of a dimension that is in no tree are searched all the same."""
    monkeypatch.setattr(topk, "SAMPLE", 40)
    rows = [(i, [float(i % 7), 1.0, float(i)]) for i in range(200)] + [(1000, [2.0, 1.0]), (1001, [1.0, 5.0])]
    got = topk.top_k(table_of(spark, rows), F.col("vec_id") == 1000).collect()
    assert [(r.vec_id, r.score) for r in got] == [(1001, 7 * 65536)]


def test_best_first_opens_few_leaves():
    """Of far groups the tree leaves most out, and still finds the best."""
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(c, 3, (100, 4)).round().astype(np.int64) for c in rng.normal(0, 400, (40, 4))])
    tree = topk.BallTree(x, 16)
    y = x[tree.order]
    assert sorted(tree.order) == list(range(len(x))) and len(tree.leaves()) > 100
    for node, (lo, hi) in enumerate(tree.spans):
        assert np.linalg.norm(y[lo:hi] - tree.centers[node], axis=1).max() <= tree.radii[node] + 1e-9
    read = []
    counted, topk.products = topk.products, lambda a, b: read.append(len(a) * len(b)) or products(a, b)
    try:
        query, row, score = topk.best_first(tree, y, tree.order, y[::50], np.full(80, topk.NONE), 3)
    finally:
        topk.products = counted
    assert sum(read) < 0.2 * 80 * len(x)
    every = y[::50] @ y.T
    for q in range(80):
        assert sorted(score[query == q], reverse=True) == sorted(every[q], reverse=True)[:3]


def test_scores_beyond_a_long(spark):
    with pytest.raises(ValueError, match="too large"):
        products(np.array([[2**31]]), np.array([[2**31]]))
    with pytest.raises(ValueError, match="too large"):
        squares(np.array([[2**31]]), np.array([[-(2**31)]]))
    a = np.array([[2**27 + 1, 3]])
    assert products(a, a)[0, 0] == (2**27 + 1) ** 2 + 9
    got = spark.createDataFrame([([0.5, -0.001],), (None,), ([None],)], "e array<float>").select(floored(F.col("e")).alias("v")).collect()
    assert [r.v for r in got] == [[128, -1], None, None]


# Spelling.


def variants_of(docs, one_in=97, least=5, count=3):
    n = collections.Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % one_in == 0 else run] += 1
    v = {w: c for w, c in n.items() if len(w) >= least and c >= count}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    close = {w: [x for x in v if near(w, x)] for w in v}
    form = {}
    for w in v:
        if close[w]:
            f = min(close[w], key=lambda x: (-v[x], x))
            form[w] = f if v[f] >= 2 * v[w] else None

    def root(w):
        while form.get(w):
            w = form[w]
        return w

    return {(w, form.get(w), root(w), v[w], len(close[w]), v[form[w]] if form.get(w) else None) for w in v}


def some_words(seed=4):
    rng = random.Random(seed)
    out = []
    for _ in range(60):
        w = "".join(rng.choices("abcdéÿ", k=rng.randint(5, 9)))
        for times in (40, 15, 6, 3):
            out += [w] * rng.randint(2, times)
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcdé") + w[i + 1 :], w[:i] + rng.choice("abcdé") + w[i:]])
    for long in (10, 11, 12, 13, 14, 80, 5000):  # lengths on both sides of what the trie holds in the tests
        w = "".join(rng.choices("xyzß", k=long))
        out += [w] * 9 + [w[:-1]] * 3 + ["y" + w[1:]] * 3 + [w[: long // 2] + "q" + w[long // 2 :]] * 4 + [w[: long // 2] + w[long // 2 + 1 :]] * 5
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("small", [100_000, 0])
def test_variants(spark, monkeypatch, small):
    monkeypatch.setattr(spelling, "LONGEST", 12)
    monkeypatch.setattr(spelling, "SMALL", small)
    monkeypatch.setattr(spelling, "PIECE", 700)
    monkeypatch.setattr(spelling, "HELD", 50)
    words = some_words()
    docs = [(i, " ".join(words[i::20])) for i in range(20)] + [(3, " ".join(words[3::20])), (None, "Abcde-ABCDE abcdE abcde"), (50, None), (51, ""), (52, "a bc . 12 Ābcdef Ā"), (53, "Éabcd Éabcd éabcd Éabcd×")]
    table = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in docs], "doc_id long, text string, word string, n int, at int")
    got = spelling.group_variants(table).collect()
    assert {tuple(r) for r in got} == variants_of(docs) and len(got) == len({r.word for r in got})
    assert got[0].asDict().keys() == {"word", "form", "root", "n", "n_near", "form_n"}
    assert spelling.group_variants(table.limit(0)).count() == 0


def test_runs_that_lack_a_letter(spark):
    """Of one in two runs, those that get too short are left out."""
    docs = [(i, "abcde fghij fghijk aaaaab") for i in range(60)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    assert {tuple(r) for r in spelling.group_variants(table, one_in=2).collect()} == variants_of(docs, 2)


def test_very_long_word(spark):
    """A word of 300,000 letters has a row for each, not a text for each."""
    w = "".join(random.Random(5).choices("abc", k=300_000))
    got = spelling.neighbours(spark.createDataFrame([(w, 9), (w[:150_000] + "x" + w[150_001:], 4), (w + "c", 3), ("abcde", 5)], "word string, n long")).collect()
    assert sorted((r.na, r.nb) for r in got) == [(3, 9), (4, 9), (9, 3), (9, 4)]


def test_roots(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(20)] + [("a", "w5")], "word string, form string")
    assert {r.word: r.root for r in spelling.roots_of(forms).collect()} == {f"w{i}": "w20" for i in range(20)} | {"a": "w20"}


# Centroids.


def clusters_of(rows, k, rounds, size, seed=2):
    good = [(i, np.array(whole(v))) for i, v in rows if whole(v) is not None and len(v) == size]
    digest = lambda i: "~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()
    c = [v for _, v in sorted(good, key=lambda r: (digest(r[0]), r[1].tolist()))[:k]]
    for r in range(rounds + 1):
        d = [[int(((v - x) ** 2).sum()) for x in c] for _, v in good]
        at = [x.index(min(x)) for x in d]
        if r < rounds:
            for j in range(len(c)):
                own = [v for (_, v), a in zip(good, at, strict=True) if a == j]
                if own:
                    c[j] = np.array([int(s) // len(own) for s in sum(own)])
    inertia = collections.Counter()
    for x, a in zip(d, at, strict=True):
        inertia[a] += x[a]
    sha = lambda j: hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()
    return sorted(((i, a, x[a], inertia[a], sum(inertia.values()), sha(a)) for (i, _), x, a in zip(good, d, at, strict=True)), key=str)


@pytest.mark.parametrize("k, rounds", [(12, 5), (40, 9), (1, 2), (1000, 3)])
def test_clusters(spark, k, rounds):
    rows = some_vectors()
    got = centroids.cluster_vectors(table_of(spark, rows), k, rounds, 8)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == clusters_of(rows, k, rounds, 8)


def test_clusters_of_nothing(spark):
    none = centroids.cluster_vectors(table_of(spark, some_vectors()))
    assert none.count() == 0 and dict(none.dtypes) == {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"}


def test_bounds_hold_and_save_scans():
    """Rows that the bounds call settled keep their nearest centroid, and most rows are not scanned again; a centroid that goes and comes back has not drifted."""
    rng = np.random.default_rng(6)
    centers = rng.integers(-300, 300, (6, 5))
    x = np.concatenate([c + rng.integers(-20, 20, (200, 5)) for c in centers])
    there, back = centers + 5, centers
    history = [centers, there, back]
    d = squares(x, centers)
    bounds, nearest = np.sqrt(d).astype(np.float32) * np.float32(centroids.DOWN), d.argmin(1)
    zero, upper = np.zeros(len(x), int), np.sqrt(d.min(1)) * centroids.UP
    for upto in (2, 3):
        done = centroids.settled(bounds, zero, upper, zero, nearest, history[:upto])
        assert (squares(x, history[upto - 1]).argmin(1)[done] == nearest[done]).all() and done.mean() > 0.8
    assert centroids.drift(history, 0).max() == 0 and centroids.drift(history[:2], 0).min() > 10
