"""License scans: fixed phrases, and an exact set-similarity join of text blocks with templates. DataFrame functions only."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modstream.functions.text import bind
from modstream.llm.common import ascii_lower, small_side, whole, written

#: A word here: ASCII digits, lower-case letters and everything beyond ASCII.
TOKEN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The same before A-Z are lower-cased, and what stands between words.
RAW_TOKEN = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))

#: (label, text, words that must be there, words that must not): notices as they stand in files and on pages. The words are those by
#: which notices of one form differ, mostly names; without them a notice isn't reported, however much of the rest is there.
TEMPLATES = (
    ("mit", "Released under the MIT License", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", "sublicense"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "fee"),
    ("apache", "Licensed under the Apache License, Version 2.0", "apache"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at", "compliance"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied", "writing"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3", "gnu"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gnu general"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution"),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "attribution"),
    ("cc-by", "Licensed under CC BY 4.0", "cc by", "nc sa nd"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc nc"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc sa"),
    ("proprietary", "All rights reserved. No part of this work may be reproduced without permission", "reserved reproduced"),
)

#: Share of a template's words that a block must hold, and a block's length in the template's words.
CONTAINMENT, LENGTH = 0.8, 1.5
#: More templates or words in them than this are refused: templates go to every executor.
MOST_TEMPLATES, MOST_TOKENS = 10_000, 200_000


def tokens(text: str) -> list[str]:
    """Words of a template or phrase."""
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+", lowered)


def _need(template: Sequence[str], threshold: float) -> int:
    """How many of a template's different words make ``threshold`` of them."""
    return max(1, math.ceil(threshold * len(set(template)) - 1e-9))


def places(words: Column, phrase: Sequence[str]) -> Column:
    """Indexes at which the words of ``phrase`` stand one after the other."""
    last = len(phrase) - 1
    ends = F.filter(F.transform(words, lambda w, i: F.when(w == phrase[last], i - last)), lambda i: i >= 0)

    def stands(i: Column) -> Column:
        out = F.lit(True)
        for k, word in enumerate(phrase[:-1]):
            out = out & (F.get(words, i + k) == word)
        return out

    return F.filter(ends, stands)


def _long_places(phrase: Sequence[str], words: Column) -> Column:
    return F.transform(places(words, phrase), lambda i: i.cast("long"))


class Template:
    """A notice: its different words, how many a block must hold, which it must and mustn't, and a block's length."""

    def __init__(self, label: str, text: str, must: str = "", never: str = "", threshold: float = CONTAINMENT):
        self.label, words = label, tokens(text)
        self.words, self.must, self.never = sorted(set(words)), sorted(set(tokens(must))), sorted(set(tokens(never)))
        if not words or not set(self.must) <= set(words) or set(self.never) & set(words):
            raise ValueError(f"a template needs words, those that must be there among them, those that mustn't not: {text!r}")
        self.need = _need(words, threshold)
        self.length = math.ceil(LENGTH * len(words))


def lowered(text: Column) -> Column:
    """``ascii_lower``, by the quicker function where the text has nothing else."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(ascii_lower(text))


def _words(text: Column) -> Column:
    return F.split(F.regexp_replace(lowered(text), "^" + BETWEEN, ""), BETWEEN)


def _scanned(docs: DataFrame, phrases, vocabulary: Sequence[str]) -> DataFrame:
    """One row per document: the phrases' places, and the words of templates that it has anywhere."""
    text = whole(F.col("text"))
    low = F.lower(text)
    found = []
    for k, (_, phrase) in enumerate(phrases):
        parts = tokens(phrase)
        likely = low.contains(parts[-1])
        for part in parts[:-1]:
            likely = likely & low.contains(part)
        at = bind(_words(text), functools.partial(_long_places, parts))
        found.append(F.when(likely, at).otherwise(F.array().cast("array<bigint>")).alias(f"at{k}"))
    known = F.array_intersect(_words(text), F.array(*map(F.lit, vocabulary)))
    return docs.select("doc_id", F.xxhash64(text).alias("digest"), F.regexp_count(text, F.lit(RAW_TOKEN)).cast("long").alias("n_words"), *found, known.alias("known"))


def containment_candidates(scanned: DataFrame, templates: Sequence[Template]) -> tuple[DataFrame, list[list[str]]]:
    """(doc_id, digest, template) of documents that hold enough of a template's words anywhere; and each template's rarest words.

    Exact: with words ordered from rare to frequent, two sets that share ``need`` words share one among the first size - need + 1
    of each, so joining on those words finds all; documents with too few words, and pairs whose first shared word comes too late in
    either for ``need`` words to follow, are dropped before the words are compared.
    """
    spark = scanned.sparkSession
    sets = scanned.where(F.size("known") > 0).select("doc_id", "digest", "known").distinct()
    counted = sets.select(F.explode("known").alias("token")).groupBy("token").count()
    frequency = {r["token"]: r["count"] for r in counted.collect()}  # words of templates only
    order = sorted({t for x in templates for t in x.words}, key=lambda t: (frequency.get(t, 0), t))
    rank = {t: i for i, t in enumerate(order)}
    prefixes, rarest = [], []
    for n, x in enumerate(templates):
        ordered = sorted(x.words, key=rank.__getitem__)
        rarest.append(ordered[: len(ordered) - x.need + 1])
        prefixes += [(t, n, i, len(ordered), x.need, ordered, x.must) for i, t in enumerate(rarest[-1])]
    schema = "token string, template int, template_at int, template_size int, need int, template_tokens array<string>, must array<string>"
    prefix = F.broadcast(spark.createDataFrame(prefixes, schema))
    least = min(x.need for x in templates)
    ranked = F.array_intersect(F.array(*map(F.lit, order)), F.col("known"))
    sized = sets.where(F.size("known") >= least).select("doc_id", "digest", ranked.alias("known"))
    # No template needs fewer than ``least`` words, so no document's prefix is longer than this.
    starts = sized.select(
        "doc_id", "digest", "known", F.size("known").alias("size"),
        F.posexplode(F.slice("known", F.lit(1), F.size("known") - least + 1)).alias("at", "token"),
    )
    follow = F.least(F.col("template_size") - F.col("template_at"), F.col("size") - F.col("at"))
    pairs = starts.join(prefix, "token").where(
        (F.col("size") >= F.col("need")) & (F.col("at") <= F.col("size") - F.col("need")) & (follow >= F.col("need"))
    )
    pairs = pairs.where((F.size(F.array_intersect("known", "template_tokens")) >= F.col("need")) & (F.size(F.array_except("must", "known")) == 0))
    return pairs.select("doc_id", "digest", "template").distinct(), rarest


def block_matches(docs: DataFrame, candidates: DataFrame, templates: Sequence[Template], rarest: Sequence[Sequence[str]]) -> DataFrame:
    """(doc_id, digest, label, score): documents of ``candidates`` with a block that holds enough of the template's words.

    A block that does has one of the template's rarest words, so only the words around those are looked at; and it can be moved on
    to begin with a word of the template.
    """
    spark = docs.sparkSession
    rows = [(n, x.label, x.words, x.must, x.never, x.need, x.length, list(r)) for n, (x, r) in enumerate(zip(templates, rarest, strict=True))]
    schema = "template int, label string, own array<string>, must array<string>, never array<string>, need int, length int, rare array<string>"
    wanted = candidates.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "template")
    side = small_side(written(wanted, "candidates"), 200_000)
    text = whole(F.col("text"))
    texts = docs.select("doc_id", F.xxhash64(text).alias("digest"), text.alias("text"))
    pairs = texts.join(side, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g"))).join(F.broadcast(spark.createDataFrame(rows, schema)), "template")

    def around(words: Column) -> Column:
        spots = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains("rare", w), i)), lambda i: i.isNotNull())
        return F.transform(spots, lambda i: F.slice(words, F.greatest(i - F.col("length") + 2, F.lit(1)), 2 * F.col("length") - 1))

    near = pairs.select("doc_id", "digest", "label", "own", "must", "never", "need", "length", F.explode(bind(_words(F.col("text")), around)).alias("near"))
    hits = F.filter(F.transform("near", lambda w, i: F.when(F.array_contains("own", w) | F.array_contains("never", w), F.struct(i.alias("i"), w.alias("w")))), lambda h: h.isNotNull())
    near = near.select("doc_id", "digest", "label", "own", "must", "never", "need", "length", hits.alias("hits")).where(F.size(F.array_distinct("hits.w")) >= F.col("need"))

    def held(start: Column) -> Column:
        block = F.filter("hits", lambda h: (h.i >= start.i) & (h.i < start.i + F.col("length")))
        return bind(F.array_distinct(F.transform(block, lambda h: h.w)), lambda ws: F.when((F.size(F.array_except("must", ws)) == 0) & ~F.arrays_overlap("never", ws), F.size(ws)).otherwise(0))

    best = near.select("doc_id", "digest", "label", "need", F.size("own").alias("size"), F.array_max(F.transform("hits", held)).alias("best"))
    return best.where(F.col("best") >= F.col("need")).select("doc_id", "digest", "label", (F.col("best") / F.col("size")).alias("score"))


def scan_licenses(docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = CONTAINMENT) -> DataFrame:
    """License phrases and notices of every row of ``docs``.

    Returns doc_id, n_words, n_base (all places of phrases), first_word, last_word (least and greatest place, else null),
    base_labels, labels (also those of templates), both distinct and sorted, and score: 1 with a phrase, else the greatest share of
    a template's different words in a block that has enough of them, else 0.

    A block is any stretch of words LENGTH times as long as the template, over line ends and comment signs, as notices are often
    wrapped. It must hold the share ``threshold`` of the template's words and all those that tell the template from similar ones.

    A null text counts as empty; null ids, repeated rows and extra columns are allowed, each row gets its own result; no rows
    give no rows. Texts are read twice; those without candidates aren't moved. More than MOST_TEMPLATES templates or MOST_TOKENS
    different words are a ValueError.
    """
    parsed = [Template(*t, threshold=threshold) for t in templates]
    vocabulary = sorted({w for x in parsed for w in x.words})
    if not 0 < len(parsed) <= MOST_TEMPLATES or len(vocabulary) > MOST_TOKENS:
        raise ValueError(f"1 to {MOST_TEMPLATES} templates with at most {MOST_TOKENS} different words are needed")
    scanned = written(_scanned(docs, phrases, vocabulary), "scanned")
    candidates, rarest = containment_candidates(scanned, parsed)
    found = block_matches(docs, candidates, parsed, rarest).groupBy("doc_id", "digest").agg(F.collect_set("label").alias("found"), F.max("score").alias("best"))
    found = small_side(written(found.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "found", "best"), "found"), 200_000)
    joined = scanned.join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left")
    at = F.concat(*(F.col(f"at{k}") for k in range(len(phrases))))
    named = [F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, (label, _) in enumerate(phrases)]
    base = F.array_compact(F.array(*named))
    labels = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return joined.select(
        "doc_id", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        labels(base).alias("base_labels"), labels(F.concat(base, F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size(at) > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )
