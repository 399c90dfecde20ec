"""Bands of perplexity against sorted lists, and languages with few documents."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from modstream.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, low long"


def wanted_bands(found, below, above, least):
    """{model: (low, high)} of (model, digest, plain, log_loss)."""
    plain = defaultdict(list)
    for model, digest, ok, loss in found:
        if ok and loss is not None:
            plain[model].append((math.floor(loss * quality.STEPS + 0.5), digest % 2))
    out = {}
    for model, of in plain.items():
        if min(sum(h == 0 for _, h in of), sum(h == 1 for _, h in of)) >= least:
            steps = sorted(s for s, _ in of)
            out[model] = (steps[max(1, math.ceil(below * len(of))) - 1], steps[max(1, math.ceil((1 - above) * len(of))) - 1])
    return out


def test_ranks(spark):
    """Ends of bands are of exact rank: many ties, all equal, values in one range of steps, spread over many, too few in a half, no rows."""
    rng = random.Random(3)
    losses = {
        "spread": [rng.uniform(0, 30) for _ in range(1500)], "near": [2 + rng.random() / 2000 for _ in range(700)], "ties": [rng.choice((1.5, 1.5, 2.25, 9.0)) for _ in range(400)],
        "equal": [3.125] * 90, "few": [1.0, 2.0], "zero": [0.0] * 30 + [1e-9] * 30,
    }
    rows = [(m, rng.getrandbits(40) - 2**39, rng.random() < 0.8, x) for m, found in losses.items() for x in found]
    rows += [("half", 2 * i, True, float(i)) for i in range(50)] + [("spread", 7, True, None)]
    table = spark.createDataFrame(rows, "model string, digest long, plain boolean, log_loss double").repartition(7)
    for below, above in ((0.002, 0.005), (0.1, 0.25), (0.0, 0.0), (0.5, 0.5)):
        got = {r.model: (r.low, r.high) for r in quality.bands_of(table, below, above).collect()}
        assert got == wanted_bands(rows, below, above, quality.LEAST_PLAIN)
    assert quality.bands_of(table.limit(0), 0.1, 0.1).count() == 0


def test_verdicts_by_bands(spark):
    """kept is that of bands computed from the losses, whether n-grams are broadcast or joined; languages of one or two documents, or of copies of one, go by the base."""
    rng = random.Random(8)
    words = ["".join(rng.choices("aeinrst", k=rng.randint(2, 7))) for _ in range(200)]
    text = lambda: " ".join(rng.choices(words, k=60))
    texts = [(text(), "en") for _ in range(110)] + [(" | ".join(rng.choices(words, k=50)), "en") for _ in range(4)]
    copy = text()
    texts += [(text(), "one"), (text(), "two"), ("§ ¶ % " + text(), "two"), ("short text", "two"), (text(), None), ("", "one"), (None, None)] + [(copy, "copies")] * 40
    docs = spark.createDataFrame([(i, t, lang, None, len(t or ""), "k", 0) for i, (t, lang) in enumerate(texts)], SCHEMA)
    named = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), F.coalesce("lang", F.lit("none")).alias("model"), "text")
    found = quality.measured(named).collect()
    bands = wanted_bands([(r.model, r.digest, r.plain, r.log_loss) for r in found], 0.05, 0.1, quality.LEAST_PLAIN)
    assert set(bands) == {"en"}
    low, high = bands["en"]
    want = {r.doc_id: not r.base_failed and (r.model not in bands or low <= math.floor(r.log_loss * quality.STEPS + 0.5) <= high) for r in found}
    got = {r.doc_id: r.kept for r in quality.judge_quality(docs, below=0.05, above=0.1).collect()}
    assert got == want
    assert [got[i] for i in range(114, 121)] == [True, True, True, False, True, False, False] and all(got[i] for i in range(121, 161))
    assert not any(got[i] for i in range(110, 114)) and 0 < sum(not got[i] for i in range(110)) < 20
    joined = {r.doc_id: r.kept for r in quality.judge_quality(docs, below=0.05, above=0.1, hot=50).collect()}
    assert joined == want
