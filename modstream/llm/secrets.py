"""Secret scans: spans of single-part secrets, and weak parts linked by an interval join. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modstream.functions.text import bind
from modstream.llm.common import whole, written

QUOTE, ASSIGN = "[\"']?", "[\"']?\\x20*[:=]\\x20*[\"']?"

#: kind: (pattern, least length of the match or of its group, that group, cheap condition, role). Kinds in order of report.
KINDS = ("assign", "access", "hex", "ident", "short", "endpoint")

SECRET_WORDS = "(password|passwd|secret|token|api_?key)"
ID_WORDS = "(?:user_?name|user|login|account|client_?id)"

#: Code points within which parts of a credential belong together.
SCOPE = 200
#: Matches of a text that are laid out at once, see ``_laid_out``.
CHUNK = 512


def _laid_out(text: Column, pattern: str, hits: Column) -> Column:
    """array<struct<start, end, hit>> of all matches: positions are the running lengths of the gaps and the matches.

    Sums are taken over chunks of CHUNK matches first, so that the work for m matches is about m * CHUNK + (m / CHUNK)^2.
    """
    gaps = F.split(text, pattern, -1)
    zipped = F.zip_with(
        F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(F.length(g).cast("long").alias("g"), F.length(h).cast("long").alias("n"), h.alias("h"))
    )
    return bind(zipped, _places)


def _places(zipped: Column) -> Column:
    chunks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / CHUNK).cast("int")), lambda c: F.slice(zipped, c * CHUNK + 1, F.lit(CHUNK))
    )
    return bind(chunks, _chunk_places)


def _chunk_places(chunks: Column) -> Column:
    ends = F.aggregate(
        chunks, F.array(F.lit(0).cast("long")),
        lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x.g + x.n))),
    )
    empty = F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")

    def spans(chunk: Column, at: Column) -> Column:
        return F.aggregate(
            chunk, F.struct(at.alias("at"), empty.alias("out")),
            lambda acc, x: F.struct(
                (acc.at + x.g + x.n).alias("at"),
                F.concat(acc.out, F.array(F.struct((acc.at + x.g).alias("start"), (acc.at + x.g + x.n).alias("end"), x.h.alias("hit")))).alias("out"),
            ),
            lambda acc: acc.out,
        )

    return F.flatten(F.zip_with(chunks, F.slice(ends, F.lit(1), F.size(chunks)), spans))


def matches(text: Column, pattern: str, likely: Column) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` with their places in code points; none where not ``likely``."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,hit:string>>")
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.when(likely, F.when(F.size(hits) > 0, _laid_out(text, pattern, hits)).otherwise(none)).otherwise(none)


def _parts(text: Column) -> Column:
    """array<struct<start, end, kind>> of strong and weak parts of a text."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    equals = text.contains("=") | text.contains(":")
    assign = "(?i)" + SECRET_WORDS + ASSIGN + "([A-Za-z0-9+/_.=-]+)"
    assigned = matches(text, assign, equals & text.rlike("(?i)" + SECRET_WORDS + ASSIGN + "[A-Za-z0-9+/_.=-]"))
    value = lambda m: F.length(F.regexp_extract(m.hit, assign, 2))
    access = matches(text, "AKIA[A-Z0-9]{14,}", text.contains("AKIA"))
    hexes = matches(text, "[0-9a-f]{16,}", text.rlike("[0-9a-f]{16}"))
    ident = matches(text, "(?i)" + ID_WORDS + ASSIGN + "[A-Za-z0-9_.@-]{3,}", equals & text.rlike("(?i)" + ID_WORDS + ASSIGN + "[A-Za-z0-9_.@-]{3}"))
    # A run of letters is tried from its first one only, so that long runs aren't scanned again and again.
    endpoint = matches(text, "(?<![a-z])[a-z]++://[A-Za-z0-9.-]++(?::[0-9]++)?", text.contains("://"))

    def of(found: Column, kind: str, keep=None) -> Column:
        kept = found if keep is None else F.filter(found, keep)
        return F.transform(kept, lambda m: F.struct(m.start.alias("start"), m.end.alias("end"), F.lit(kind).alias("kind")))

    return F.concat(
        none, of(assigned, "assign", lambda m: value(m) >= 12), of(access, "access"), of(hexes, "hex"), of(ident, "ident"),
        of(assigned, "short", lambda m: (value(m) >= 6) & (value(m) < 12)), of(endpoint, "endpoint"),
    )


def _linked(found: DataFrame, scope: int) -> DataFrame:
    """(doc_id, digest, weak): the weak parts that stand within ``scope`` code points of the parts they need.

    An id needs a secret, a short secret an id, an endpoint both. The interval join goes by buckets of ``scope`` code points:
    of each role just the first and last start in a bucket are needed, so a text full of parts makes no pairs.
    """
    parts = found.select("doc_id", "digest", F.explode("parts").alias("part")).distinct().select("doc_id", "digest", "part.*")
    role = F.when(F.col("kind").isin("access", "ident"), "id").when(F.col("kind") == "endpoint", "endpoint").otherwise("secret")
    parts = parts.withColumn("role", role).withColumn("bucket", F.floor(F.col("start") / scope))
    ends = parts.where("role != 'endpoint'").groupBy("doc_id", "digest", "bucket", "role").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    ends = ends.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), F.col("bucket").alias("b"), F.col("role").alias("r"), "first", "last")
    weak = parts.where(F.col("kind").isin("ident", "short", "endpoint")).withColumn("near", F.explode(F.array(*(F.col("bucket") + i for i in (-1, 0, 1)))))
    joined = weak.join(ends, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")) & (F.col("near") == F.col("b")))
    close = (F.abs(F.col("start") - F.col("first")) <= scope) | (F.abs(F.col("start") - F.col("last")) <= scope)
    # In its own bucket a part is never further off than the scope.
    close = close | (F.col("near") == F.col("bucket"))
    near = joined.where(close & (F.col("role") != F.col("r"))).groupBy("doc_id", "digest", "start", "end", "kind").agg(
        F.bool_or(F.col("r") == "id").alias("by_id"), F.bool_or(F.col("r") == "secret").alias("by_secret")
    )
    needs = F.when(F.col("kind") == "ident", F.col("by_secret")).when(F.col("kind") == "short", F.col("by_id")).otherwise(F.col("by_id") & F.col("by_secret"))
    return near.where(needs).groupBy("doc_id", "digest").agg(F.collect_list(F.struct("start", "end", "kind")).alias("weak"))


def find_secrets(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, digest (of the text) and spans, array<struct<start, rank, end, kind>> by start and kind, for every row of ``docs``.

    Strong kinds stand alone: assign (a secret's name, a sign and 12 or more characters), access (AKIA...), hex (16 or more).
    Weak ones (ident, short: 6 to 11 characters, endpoint) come only with their complement near. Matches are leftmost and don't
    overlap within a kind; places are code points, ends exclusive. A null text counts as empty; null ids, repeated rows and
    extra columns are allowed, each row gets its own spans; no rows give no rows. Texts are read once and not moved.
    """
    text = whole(F.col("text"))
    found = written(docs.select("doc_id", F.xxhash64(text).alias("digest"), _parts(text).alias("parts")), "parts")
    weak = _linked(found.where(F.exists("parts", lambda p: p.kind.isin("ident", "short", "endpoint"))), scope)
    weak = weak.select(F.col("doc_id").alias("d"), F.col("digest").alias("g"), "weak")
    joined = found.join(weak, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left")
    strong = F.filter("parts", lambda p: p.kind.isin("assign", "access", "hex"))
    none = F.array().cast("array<struct<start:bigint,end:bigint,kind:string>>")
    rank = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind)
    spans = F.array_sort(
        F.transform(
            F.concat(strong, F.coalesce("weak", none)),
            lambda p: F.struct(p.start.alias("start"), rank(p.kind).alias("rank"), p.end.alias("end"), p.kind.alias("kind")),
        )
    )
    return joined.select("doc_id", "digest", spans.alias("spans"))


def spans_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(":", p.kind, p.start, p.end)), ",")


def redacted(docs: DataFrame, scope: int = SCOPE, mask: str = "[redacted]") -> DataFrame:
    """``docs`` with every span of ``find_secrets`` replaced by ``mask``; overlapping spans are replaced together.

    Only rows with a span are rewritten. n_chars, if there is such a column, follows the text.
    """
    spans = find_secrets(docs, scope).where(F.size("spans") > 0).distinct()
    spans = spans.select(F.col("doc_id").alias("span_id"), F.col("digest").alias("span_digest"), "spans")
    doc = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc")
    joined = docs.select(doc, F.xxhash64(whole(F.col("text"))).alias("digest")).join(
        spans, F.col("doc.doc_id").eqNullSafe(F.col("span_id")) & (F.col("digest") == F.col("span_digest")), "left"
    )
    text = F.col("doc.text")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        fresh = F.concat(acc.out, F.array(F.substring(text, acc.at.cast("int") + 1, (p.start - acc.at).cast("int")), F.lit(mask)))
        return F.struct(F.greatest(acc.at, p.end).alias("at"), F.when(p.start >= acc.at, fresh).otherwise(acc.out).alias("out"))

    tail = lambda acc: F.concat(F.array_join(acc.out, ""), F.substring(text, acc.at.cast("int") + 1, F.length(text)))
    hidden = F.when(F.col("spans").isNotNull(), F.aggregate("spans", zero, step, tail)).otherwise(text)
    out = joined.withColumn("hidden", hidden)
    values = {"text": F.col("hidden")}
    if "n_chars" in docs.columns:
        changed = F.when(F.col("spans").isNotNull(), F.length("hidden")).otherwise(F.col("doc.n_chars"))
        values["n_chars"] = changed.cast(docs.schema["n_chars"].dataType)
    return out.select(*(values.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
