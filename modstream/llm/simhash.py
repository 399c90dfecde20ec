"""SimHash near-dedup: pivot distance tables discard pairs of fingerprints, survivors are verified."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from modstream.llm.arrays import Texts, give_back, mix, pieces, span_hashes, window_hashes
from modstream.llm.common import connected_components, forget, small_side, written

BITS = 64
SEED = 42
#: Reference fingerprints to which distances are kept.
PIVOTS = tuple(int(x) for x in mix(np.arange(1, 17, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64))

#: References that cells are made of; the others only discard.
CELL_PIVOTS = 8

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def bit_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(sets x 64) how many of the values of each set have each bit; set i is ``values[bounds[i]:bounds[i + 1]]``.

    Eight bits at a time are added as the bytes of a 64-bit number, over at most 255 values.
    """
    sizes = np.diff(bounds)
    parts = (sizes + 254) // 255
    out = np.zeros((len(sizes), BITS), dtype=np.int64)
    if not parts.sum():
        return out
    first = np.concatenate([[0], np.cumsum(parts)])
    owner = np.repeat(np.arange(len(sizes)), parts)
    cuts = bounds[:-1][owner] + 255 * (np.arange(first[-1]) - first[:-1][owner])
    ones = np.zeros((len(cuts), BITS), dtype=np.int64)
    for k in range(8):
        sums = np.add.reduceat((values >> np.uint64(k)) & np.uint64(0x0101010101010101), cuts)
        ones[:, k::8] = sums.view(np.uint8).reshape(-1, 8)
    full = np.flatnonzero(parts)
    out[full] = np.add.reduceat(ones, first[:-1][full], axis=0)
    return out


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of 64 bits, lowest first, as signed 64-bit numbers."""
    return np.packbits(bits, axis=1, bitorder="little").view("<i8")[:, 0]


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    """XXH64 (seed 42) of all ``n``-word shingles of a text, repeats included; fewer words are one shingle."""
    words = (text or "").encode().translate(LOWER).split()
    digest, join = xxhash.xxh64_digest, b" ".join
    found = [digest(join(words[i : i + n]), SEED) for i in range(max(1, len(words) - n + 1))] if words else []
    return np.frombuffer(b"".join(found), dtype=">u8").astype(np.uint64)


def fingerprint_batch(texts: list[str | None], n: int = 3) -> np.ndarray:
    """64-bit SimHash of each text: a bit is 1 if over half of the shingles' hashes have it; 0 without words."""
    found = [shingle_hashes(t, n) for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(h) for h in found])]).astype(np.int64)
    values = np.concatenate(found) if found else np.zeros(0, np.uint64)
    return packed(2 * bit_sums(values, bounds) > np.diff(bounds)[:, None])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, fp) of each row of ``docs``; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = fingerprint_batch(batch.column(1).to_pylist(), n)
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def pivot_distances(fp: Column, masks: Sequence[int | Column] = (-1,), pivots: Sequence[int] = PIVOTS) -> Column:
    """Hamming distances to the reference fingerprints, counted in the bits of each of ``masks``."""
    near = lambda m, p: F.bit_count(fp.bitwiseXOR(F.lit(p)).bitwiseAND(m if isinstance(m, Column) else F.lit(m))).cast("tinyint")
    return F.array(*(near(m, p) for m in masks for p in pivots))


def may_be_near(a: Column, b: Column, distance: int) -> Column:
    """False if any coordinate of the pivot distances differs by more than ``distance``: then the fingerprints do too."""
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y)), lambda d: d <= distance)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _cut(bits: Sequence[int], parts: int) -> list[list[int]]:
    """``bits`` in ``parts`` runs of about equal length."""
    bounds = [round(i * len(bits) / parts) for i in range(parts + 1)]
    return [list(bits[a:b]) for a, b in itertools.pairwise(bounds)]


def _mask(bits: Sequence[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - 2**64 if m >= 2**63 else m


def _cells(distance: int, more: int, levels: int) -> list[list[tuple[int, int]]]:
    """Of each level the cells' kinds: (kind of the level above, mask of the bits whose pivot distances must be equal).

    First level: ``more`` of distance + more parts. Further ones: one of distance + 1 parts of the bits that are still free. Two
    fingerprints within ``distance`` agree in the mask of at least one kind, and in one of the kinds below it.
    """
    parts = _cut(range(BITS), distance + more)
    first = [(0, sum((parts[j] for j in chosen), [])) for chosen in itertools.combinations(range(len(parts)), more)]
    out, free = [first], [[b for b in range(BITS) if b not in used] for _, used in first]
    for _ in range(levels - 1):
        out.append([(k, part) for k, bits in enumerate(free) for part in _cut(bits, distance + 1)])
        free = [[b for b in free[k] if b not in part] for k, part in out[-1]]
    return [[(k, _mask(bits)) for k, bits in level] for level in out]


#: A cell of more fingerprints than this is cut by further pivot distances, LEVELS times at most: then nearly all bits are equal.
CELL, LEVELS = 64, 3


def near_fingerprints(fps: DataFrame, distance: int = 2, more: int = 3) -> DataFrame:
    """(a, b), a > b: all pairs of the different fingerprints ``fps`` (fp) within ``distance`` bits.

    The table of a fingerprint has its distances to CELL_PIVOTS references in each part of the bits. Fingerprints within
    ``distance`` differ in at most so many parts, so in ``more`` parts all coordinates are equal: those coordinates are the cell in
    which a pair meets, without a cross join. A large cell is cut in the same way by the coordinates of the bits that are left.
    Pairs of a cell with any coordinate over all bits too far apart are discarded, and the rest compared bit by bit. Copies must have been
    folded before.
    """
    kinds = _cells(distance, more, LEVELS)
    coordinates = lambda mask: F.xxhash64(pivot_distances(F.col("fp"), [mask], PIVOTS[:CELL_PIVOTS]))
    first = F.array(*(F.struct(F.lit(k).alias("kind"), F.xxhash64(F.lit(k), coordinates(m)).alias("key")) for k, (_, m) in enumerate(kinds[0])))
    rows = fps.select("fp", F.explode(first).alias("cell")).select("fp", "cell.*")
    found = None
    for level in range(LEVELS):
        rows = written(rows, "cells")
        sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        sized = written(rows.join(sizes, "key"), "cells")
        forget(rows)
        small = sized if level == LEVELS - 1 else sized.where(F.col("n") <= CELL)
        a, b = small.alias("a"), small.alias("b")
        pairs = a.join(b, F.col("a.key") == F.col("b.key")).where(F.col("a.fp") > F.col("b.fp")).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
        pairs = pairs.where(may_be_near(pivot_distances(F.col("a")), pivot_distances(F.col("b")), distance))
        pairs = pairs.where(hamming(F.col("a"), F.col("b")) <= distance)
        found = pairs if found is None else found.union(pairs)
        large = sized.where(F.col("n") > CELL)
        if level == LEVELS - 1 or large.isEmpty():
            break
        below = F.array(*(F.array(*(F.struct(F.lit(i).alias("kind"), F.lit(m).alias("mask")) for i, (k, m) in enumerate(kinds[level + 1]) if k == up)) for up in range(len(kinds[level]))))
        cut = large.select("fp", "key", F.explode(F.get(below, F.col("kind"))).alias("c"))
        rows = cut.select("fp", "c.kind", F.xxhash64("key", "c.kind", coordinates(F.col("c.mask"))).alias("key"))
    return found.distinct()


def fingerprint_components(docs: DataFrame, n: int = 3, distance: int = 2) -> DataFrame:
    """doc_id, fp and component_id of every row of ``docs`` (doc_id, text): documents are linked if fingerprints differ in at most ``distance`` bits.

    Documents of one fingerprint are a class; links are sought between classes, so copies make no pairs. component_id is the
    smallest doc_id reachable. Texts without words, null ones too, have fingerprint 0 and are linked like any other; fewer than
    ``n`` words are one shingle. Repeated rows and ids come out as often as they are there; null ids get the component's smallest
    id (null if it has none); no rows give no rows; other columns are not read.
    """
    found = written(fingerprints(docs, n), "fingerprints")
    classes = written(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    linked = connected_components(near_fingerprints(classes.select("fp"), distance))
    groups = classes.join(linked.withColumnRenamed("id", "fp"), "fp", "left").withColumn("group", F.coalesce("component_id", "fp"))
    least = written(groups.groupBy("group").agg(F.min("least").alias("component")), "components")
    named = written(groups.select("fp", "group").join(least, "group").select("fp", F.col("component").alias("component_id")), "components")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


# Near duplicates by similarity: fingerprints of WIDTH words of 64 bits over sets of shingles.
WIDTH = 24
#: Tables of candidates; each is keyed by the most decided bits of some words of the fingerprint.
TABLES = 72
#: Buckets up to this size are compared by a join, larger ones in Python tasks by pairs of blocks of about BLOCK members; the rules are the same.
FULL, BLOCK = 16, 2048
#: Shingles that a task verifies at once; groups with more are cut into pairs of blocks again.
SHINGLES = 1 << 22


def _choices(words: int = 3) -> list[tuple[int, ...]]:
    """TABLES sets of ``words`` words of a fingerprint, spread evenly by a fixed hash; the same for any input."""
    order = lambda t: int(mix(np.array([sum(x << 5 * i for i, x in enumerate(t)) + 1], np.uint64))[0])
    return sorted(itertools.combinations(range(WIDTH), words), key=order)[:TABLES]


def expected_distance(similarity: float, bits: int = BITS * WIDTH) -> float:
    """Bits that differ, on average, between sets of equal size with this Jaccard similarity."""
    cosine = 2 * similarity / (1 + similarity)
    return bits * math.acos(min(1.0, cosine)) / math.pi


def shingle_sets(texts: Texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different ``n``-word shingles of each text, and where each text's begin; fewer words are one shingle."""
    hashes, owner = texts.hashes(), texts.owner()
    windows = window_hashes(hashes, n)
    inside = np.flatnonzero(owner[: len(windows)] == owner[n - 1 :]) if len(windows) else np.zeros(0, int)
    short = np.flatnonzero((texts.counts > 0) & (texts.counts < n))
    of = np.concatenate([owner[inside], short])
    values = np.concatenate([windows[inside], span_hashes(hashes, texts.first[short], texts.first[short + 1])])
    order = np.lexsort((values, of))
    of, values = of[order], values[order]
    new = np.ones(len(of), dtype=bool)
    new[1:] = (of[1:] != of[:-1]) | (values[1:] != values[:-1])
    of, values = of[new], values[new]
    return values, np.searchsorted(of, np.arange(texts.n + 1))


def _wide(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (texts x WIDTH words), and of each word the most decided bit with its side."""
    n, size = len(bounds) - 1, np.diff(bounds)
    prints, decided = np.zeros((n, WIDTH), dtype=np.int64), np.zeros((n, WIDTH), dtype=np.int64)
    for w in range(WIDTH):
        margin = 2 * bit_sums(mix(values + np.uint64((w + 1) * 0x9E3779B97F4A7C15 % 2**64)), bounds) - size[:, None]
        prints[:, w] = packed(margin > 0)
        best = np.abs(margin).argmax(axis=1)
        decided[:, w] = 2 * best + (margin[np.arange(n), best] > 0)
    return prints, decided


def wide_fingerprints(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, digest, content, n_shingles, prints, decided) of ``docs`` (doc_id, digest, text); content is a hash of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = Texts(batch.column(2), lower=True)
            values, bounds = shingle_sets(texts, n)
            prints, decided = _wide(values, bounds)
            content = span_hashes(texts.hashes(), texts.first[:-1], texts.first[1:]).astype(np.int64)
            longs = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * WIDTH, pa.int32()), pa.array(x.ravel()))
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(content), pa.array(np.diff(bounds), pa.int64()), longs(prints), longs(decided)],
                ["doc_id", "digest", "content", "n_shingles", "prints", "decided"],
            )
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, digest long, content long, n_shingles long, prints array<long>, decided array<long>"
    return docs.select("doc_id", "digest", "text").mapInArrow(run, schema)


def _bounds(similarity: float) -> tuple[int, float, float]:
    """Bits that differ in pairs of at least this similarity: most in the first word; below the second number a pair is sure, above the third it isn't one."""
    p = expected_distance(similarity, 1)
    near = math.ceil(BITS * p + 4.5 * math.sqrt(BITS * p * (1 - p)))
    middle, width = expected_distance(similarity), 3.5 * math.sqrt(BITS * WIDTH * p * (1 - p))
    return near, middle - width, middle + width


def _apart(prints: np.ndarray, i: int, others: np.ndarray, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Those of ``others`` whose first word differs from row i's in at most ``near`` bits, and in how many all words do."""
    others = others[np.bitwise_count(prints[others, 0] ^ prints[i, 0]) <= near]
    return others, np.bitwise_count(prints[others] ^ prints[i]).sum(axis=1, dtype=np.int64)


def _sure_links(prints: np.ndarray, near: int, sure: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that differ in less than ``sure`` bits: as many as connect all that such pairs connect."""
    group = np.arange(len(prints))
    first, second = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(prints) - 1):
        rest, apart = _apart(prints, i, i + 1 + np.flatnonzero(group[i + 1 :] != group[i]), near)
        rest = rest[apart < sure]
        joined, at = np.unique(group[rest], return_index=True)
        if len(at):
            first.append(np.full(len(at), i))
            second.append(rest[at])
            group[np.isin(group, joined)] = group[i]
    return np.concatenate(first), np.concatenate(second)


def _open_pairs(prints: np.ndarray, decided: np.ndarray, group: np.ndarray, table: int, near: int, most: float) -> Iterator[tuple[int, np.ndarray]]:
    """Rows with those after them, nearest first, of other groups, within ``most`` bits and met in no table before this one. ``group`` may change on the way."""
    words = np.array(_choices())
    for i in range(len(prints) - 1):
        rest, apart = _apart(prints, i, i + 1 + np.flatnonzero(group[i + 1 :] != group[i]), near)
        rest, apart = rest[apart <= most], apart[apart <= most]
        if len(rest):
            here = (decided[rest] == decided[i])[:, words].all(axis=2).argmax(axis=1) == table
            if here.any():
                yield i, rest[here][np.argsort(apart[here], kind="stable")]


def _open_links(prints: np.ndarray, decided: np.ndarray, component: np.ndarray, table: int, near: int, most: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the open pairs of rows of different components, as many that each row with one is named: at most two for a row."""
    first, second, named = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], np.zeros(len(prints), dtype=bool)
    for i, rest in _open_pairs(prints, decided, component, table, near, most):
        new = rest[~named[rest]]
        new = new if len(new) or named[i] else rest[:1]
        named[i] = named[new] = True
        first.append(np.full(len(new), i))
        second.append(new)
    return np.concatenate(first), np.concatenate(second)


def _similar_links(prints: np.ndarray, decided: np.ndarray, component: np.ndarray, table: int, near: int, most: float, sets: Sequence[np.ndarray], similarity: float) -> tuple[list[int], list[int]]:
    """Open pairs whose ``sets`` have this Jaccard similarity: as many as connect all components that such pairs connect."""
    group, first, second = component.copy(), [], []
    for i, rest in _open_pairs(prints, decided, group, table, near, most):
        for j in rest.tolist():
            if group[i] != group[j]:
                same = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if same / (len(sets[i]) + len(sets[j]) - same) >= similarity:
                    first.append(i)
                    second.append(j)
                    group[group == group[j]] = group[i]
    return first, second


def _buckets(classes: DataFrame) -> DataFrame:
    """(content, fp, at, key, n) of classes (content, fp, prints, decided): the buckets of all tables that have several members, with their sizes."""
    keys = F.array(*(F.xxhash64(F.lit(k), *(F.get("decided", w) for w in t)) for k, t in enumerate(_choices())))
    rows = classes.select("content", "fp", F.posexplode(keys).alias("at", "key"))
    return written(rows.withColumn("n", F.count("*").over(Window.partitionBy("key"))).where("n > 1"), "buckets")


def _small_buckets(rows: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """(a, b, apart) of ``rows`` in buckets of up to FULL members, compared by a join: pairs that are near in the first word and not too far in all."""
    near, _, most = _bounds(similarity)
    close = may_be_near(pivot_distances(F.col("x.fp")), pivot_distances(F.col("y.fp")), near) & (hamming(F.col("x.fp"), F.col("y.fp")) <= near)
    small = rows.where(F.col("n") <= FULL)
    x, y = small.alias("x"), small.alias("y")
    pairs = x.join(y, F.col("x.key") == F.col("y.key")).where("x.content > y.content").where(close)
    pairs = pairs.select(F.col("x.content").alias("a"), F.col("y.content").alias("b")).distinct()
    prints = classes.select("content", "prints")
    pairs = pairs.join(prints.toDF("a", "prints_a"), "a").join(prints.toDF("b", "prints_b"), "b")
    apart = F.aggregate(F.zip_with("prints_a", "prints_b", hamming), F.lit(0), lambda s, d: s + d)
    return pairs.select("a", "b", apart.alias("apart")).where(F.col("apart") <= most)


def _in_blocks(rows: DataFrame, blocks: Column, i: str, j: str, salt: int = 0) -> DataFrame:
    """``rows`` (content, ...) dealt into ``blocks`` blocks of their group; every two blocks meet in a group ``i``, ``j`` of their own."""
    block = F.pmod(F.xxhash64("content", *[F.lit(salt)] * bool(salt)), blocks).cast("int")
    others = F.when(blocks > 1, F.array_remove(F.sequence(F.lit(0), blocks - 1), block)).otherwise(F.array(F.lit(0)))
    dealt = rows.select("*", block.alias("block"), F.explode(others).alias("other"))
    return dealt.withColumns({i: F.least("block", "other"), j: F.greatest("block", "other")}).drop("block", "other")


def _large_buckets(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(content, at, key, i, j, prints, decided) of ``rows`` in buckets of more members: every two blocks of about BLOCK members meet in a group of their own."""
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    dealt = _in_blocks(rows.where(F.col("n") > FULL), blocks, "i", "j").select("content", "at", "key", "i", "j")
    return written(dealt.join(classes.select("content", "prints", "decided"), "content"), "dealt")


def _longs(found: pa.Table, name: str) -> np.ndarray:
    return found.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)


def _named(found: pa.Table, i: Sequence[int], j: Sequence[int]) -> pa.Table:
    """(a, b) of pairs of rows by number."""
    content = found.column("content").to_numpy()
    i, j = np.asarray(i, dtype=np.int64), np.asarray(j, dtype=np.int64)
    if len(content) > BLOCK // 8:
        give_back()
    return pa.table({"a": np.maximum(content[i], content[j]), "b": np.minimum(content[i], content[j])})


def _with_components(dealt: DataFrame, linked: DataFrame) -> DataFrame:
    return dealt.join(linked, "content", "left").withColumn("component", F.coalesce("component", "content"))


def _compared(dealt: DataFrame, similarity: float, linked: DataFrame | None = None) -> DataFrame:
    """(a, b) of the groups of ``dealt``: links that connect all sure pairs of a bucket, or with components ``linked`` (content, component) open pairs
    across them that name each member which has one."""
    near, sure, most = _bounds(similarity)
    across = linked is not None
    rows = _with_components(dealt, linked) if across else dealt.drop("decided")

    def run(found: pa.Table) -> pa.Table:
        prints = _longs(found, "prints").view(np.uint64)
        if not across:
            return _named(found, *_sure_links(prints, near, sure))
        return _named(found, *_open_links(prints, _longs(found, "decided"), found.column("component").to_numpy(), found.column("at")[0].as_py(), near, most))

    return rows.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _verified(dealt: DataFrame, sets: DataFrame, similarity: float, linked: DataFrame) -> DataFrame:
    """(a, b) of the groups of ``dealt``: links that connect all that open pairs of this Jaccard similarity across ``linked`` connect. ``sets``
    (content, shingles) has the members of open pairs."""
    near, _, most = _bounds(similarity)
    rows = _with_components(dealt.join(sets, "content"), linked)
    total = F.sum(F.size("shingles")).over(Window.partitionBy("key", "i", "j"))
    rows = rows.withColumn("blocks", F.ceil(total / F.lit(SHINGLES)).cast("int"))
    rows = _in_blocks(rows, F.col("blocks"), "p", "q", salt=1).drop("blocks")

    def run(found: pa.Table) -> pa.Table:
        shingles = found.column("shingles").combine_chunks()
        values, ends = shingles.flatten().to_numpy(), np.cumsum(shingles.value_lengths().to_numpy())
        component, at = found.column("component").to_numpy(), found.column("at")[0].as_py()
        sets = np.split(values, ends[:-1])
        return _named(found, *_similar_links(_longs(found, "prints").view(np.uint64), _longs(found, "decided"), component, at, near, most, sets, similarity))

    return rows.groupBy("key", "i", "j", "p", "q").applyInArrow(run, "a long, b long").distinct()


def _shingles(docs: DataFrame, n: int) -> DataFrame:
    """(content, shingles) of ``docs`` (content, text)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            values, bounds = shingle_sets(Texts(batch.column(1), lower=True), n)
            arrays = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.astype(np.int64)))
            yield pa.record_batch([batch.column(0), arrays], ["content", "shingles"])
        give_back()

    return written(docs.select("content", "text").mapInArrow(sets, "content long, shingles array<long>"), "shingles")


def _jaccard(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the Jaccard similarity of their ``sets`` (content, shingles)."""
    half = pairs.join(sets.toDF("a", "shingles_a"), "a")
    both = half.join(sets.toDF("b", "shingles_b"), "b")
    same = F.size(F.array_intersect("shingles_a", "shingles_b"))
    return both.select("a", "b", (same / (F.size("shingles_a") + F.size("shingles_b") - same)).alias("similarity"))


def near_duplicates(docs: DataFrame, n: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, digest, component, first_id): groups of texts whose sets of ``n``-word shingles have Jaccard ``similarity`` or more.

    Texts with the same words (A-Z without case) are a class. SimHash fingerprints of 24 x 64 bits give candidates: each of 72
    tables is keyed by the most decided bits of three words, whatever the size of the input. In buckets of all sizes the first word's Hamming
    distance (in small ones also its pivot table) discards pairs, and the distance of all words decides those well above or below. Those well
    above are linked at once; of the rest only pairs across the components that these make are left. Their members get their shingles, and each
    bucket's task compares them, nearest first, as long as they lie across what it has linked; so tasks return links, not pairs. A pair is
    compared in the first bucket it shares only. first_id is the smallest doc_id of the group.
    Texts without words form a class. digest tells rows of one id apart. Null ids are allowed; no rows give no rows.
    """
    digest = F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest")
    rows = docs.select("doc_id", digest, "text")
    found = written(wide_fingerprints(rows, n), "prints")
    classes = found.where("n_shingles > 0").groupBy("content").agg(*(F.first(c).alias(c) for c in ("digest", "prints", "decided")))
    classes = written(classes.withColumn("fp", F.get("prints", 0)), "classes")
    buckets = _buckets(classes)
    small, dealt = written(_small_buckets(buckets, classes, similarity), "pairs"), _large_buckets(buckets, classes)
    low = _bounds(similarity)[1]
    links = written(small.where(F.col("apart") < low).select("a", "b").union(_compared(dealt, similarity)), "links")
    linked = written(connected_components(links).toDF("content", "component"), "linked")
    of = lambda c: linked.select(F.col("content").alias(c), F.col("component").alias(f"of_{c}"))
    across = small.where(F.col("apart") >= low).join(of("a"), "a", "left").join(of("b"), "b", "left").where("of_a is null or of_b is null or of_a != of_b")
    across, opened = written(across.select("a", "b"), "across"), written(_compared(dealt, similarity, linked), "open")
    named = across.union(opened)
    ids = named.select(F.col("a").alias("content")).union(named.select("b")).distinct()
    wanted = written(ids.join(classes.select("content", F.col("digest").alias("d")), "content"), "wanted")
    texts = rows.join(small_side(wanted, 500_000), F.col("digest") == F.col("d")).dropDuplicates(["content"])
    sets = _shingles(texts, n)
    similar = _jaccard(sets, across).where(F.col("similarity") >= similarity).select("a", "b")
    before = (links, linked, across, opened, wanted, sets)
    # What is linked already goes on as one link for each member.
    links = written(linked.toDF("a", "b").union(similar).union(_verified(dealt, sets, similarity, linked)), "links")
    linked = written(connected_components(links).toDF("content", "component"), "linked")
    for table in before:
        forget(table)
    grouped = found.select("doc_id", "digest", "content").join(linked, "content", "left")
    grouped = grouped.select("doc_id", "digest", F.coalesce("component", "content").alias("component"))
    least = written(grouped.groupBy("component").agg(F.min("doc_id").alias("first_id")), "least")
    out = written(grouped.join(least, "component").select("doc_id", "digest", "component", "first_id"), "groups")
    for table in (found, classes, buckets, small, dealt, links, linked, least):
        forget(table)
    return out


def one_of_each(docs: DataFrame, n: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the row with the smallest doc_id stays, of repeated rows one.

    Groups without any id keep all rows. The ids to drop are broadcast while they are few, joined by shuffle beyond.
    """
    found = near_duplicates(docs, n, similarity)
    drop = found.where("doc_id != first_id or (doc_id is null and first_id is not null)").select(F.col("doc_id").alias("drop_id"), F.col("digest").alias("drop_digest"))
    drop = small_side(written(drop.distinct(), "drop"), 1_000_000)
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    rows = docs.select(doc, F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"))
    kept = rows.join(drop, F.col("doc.doc_id").eqNullSafe(F.col("drop_id")) & (F.col("digest") == F.col("drop_digest")), "left_anti")
    out = kept.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns))
    again = found.where("doc_id = first_id").groupBy("doc_id").count().where("count > 1").limit(1).count()
    return out.dropDuplicates(["doc_id"]) if again else out
