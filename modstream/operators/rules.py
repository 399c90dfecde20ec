"""Stateless rules over a text column, and the ordered chain in which the first block wins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modstream.functions.fixed import BLOCKED_ENDINGS, DOT_WORDS, TALKING_COMMANDS
from modstream.functions.text import bind

OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = f"(?<![0-9])({OCTET}(?:\\.{OCTET}){{3}})(?![0-9])"


@dataclass(frozen=True)
class RuleConfig:
    """Parameters of all rules; a limit of 0 or less turns its rule off."""

    max_chars: int = 1000
    digits: int = 7
    #: The limit on digits in written things (signs, books, items), where ``digits`` is that of chat and commands.
    digits_written: int = 7
    caps: int = 15
    char_run: int = 5
    word_run: int = 3
    mask: str = "****"
    replacement: bool = True
    evasion: bool = True
    sources: tuple[str, ...] = ("chat", "sign", "book", "anvil", "command")
    endings: tuple[str, ...] = BLOCKED_ENDINGS
    allowed_domains: tuple[str, ...] = ()
    blacklist: tuple[str, ...] = ()
    dot_words: tuple[str, ...] = DOT_WORDS
    repeat_similarity: float = 80.0
    repeat_max: int = 2
    repeat_cooldown_s: int = 3
    flood_messages: float = 4.0
    flood_seconds: float = 2.0
    #: Seconds after which a user's state is dropped: the bucket and near repeats since their last use, texts kept for a flood's context since the first.
    bucket_ttl_s: float = 300.0
    texts_ttl_s: float = 15.0
    repeat_ttl_s: float = 3600.0
    #: An automatic sanction for flooding: for how long, and how long no other follows.
    sanction_s: int = 900
    suppress_s: float = 10.0
    silent_alerts: tuple[str, ...] = field(default=())


def find_ipv4(text: Column) -> Column:
    """The first address with octets of 0 to 255 that no digit touches; null if there is none."""
    found = F.regexp_extract(text, IPV4, 1)
    return F.when(found != "", found)


def find_blacklisted(text: Column, blacklist: Sequence[str]) -> Column:
    """The first entry of ``blacklist`` in what is left of the text when only letters and digits stay; null if there is none."""
    collapsed = F.regexp_replace(F.lower(text), "[^a-z0-9]", "")
    entries = [e for e in ("".join(c for c in b.lower() if c.isascii() and c.isalnum()) for b in blacklist) if e]
    if not entries:
        return F.lit(None).cast("string")
    found = F.regexp_extract(collapsed, "(" + "|".join(entries) + ")", 1)
    return F.when(found != "", found)


def dot_pattern(words: Sequence[str] = DOT_WORDS) -> str:
    """Words for a dot, alone or in brackets."""
    union = "|".join(words)
    # At most places the first character says that there is none.
    first = f"(?=[\\[({{<{''.join(sorted({w[0] for w in words}))}])" if all(w[:1].isalnum() for w in words) else ""
    return f"(?i){first}(?:\\[\\s*(?:{union})\\s*\\]|\\(\\s*(?:{union})\\s*\\)|\\{{\\s*(?:{union})\\s*\\}}|<\\s*(?:{union})\\s*>|\\b(?:{union})\\b)"


def dedot(text: Column, words: Sequence[str] = DOT_WORDS) -> Column:
    """Signs, and words for a dot (alone or in brackets), as dots; dots next to each other as one."""
    return F.regexp_replace(F.regexp_replace(text, dot_pattern(words), "."), "[\\p{P}\\p{S}]+", ".")


def domain_pattern(endings: Sequence[str] = BLOCKED_ENDINGS, words: Sequence[str] = DOT_WORDS) -> str:
    """What every text with a domain has: a dot, a sign or a word for one, then any ending, with blanks among its letters."""
    spread = "|".join("\\s*".join(e) for e in endings)
    return f"(?iU)(?:[\\p{{P}}\\p{{S}}]|{'|'.join(words)})\\s*(?:{spread})"


def may_have_domain(text: Column, endings: Sequence[str], words: Sequence[str]) -> Column:
    """A quick test that every text with a domain passes."""
    return text.rlike(domain_pattern(endings, words))


def find_domains(text: Column, endings: Sequence[str] = BLOCKED_ENDINGS, allowed: Sequence[str] = (), words: Sequence[str] = DOT_WORDS) -> Column:
    """array<string> of domains: a label, a dot, and an ending whose letters may be spread by blanks; the shortest ending wins."""
    none = F.array().cast("array<string>")
    # What is behind a dot counts as letters only, 10 of them at most.
    usable = sorted((e for e in set(endings) if e.isalpha() and len(e) <= 10), key=lambda e: (len(e), e))
    if not usable:
        return none
    spread = "|".join("\\s*".join(e) for e in usable)
    # A dot with an ending behind it that no further letter follows; before it the label, up to blanks or a line end, read backwards.
    dot = f"\\.(?=\\s*+((?iu:{spread}))(?!\\p{{L}}))"
    label = "^ *(?:\\n\\r|[\\n\\r\u0085\u2028\u2029])?([A-Za-z0-9_-]+)"
    known = F.array(*map(F.lit, usable))

    def domain(part: Column, ending: Column) -> Column:
        return F.when(F.array_contains(known, ending), F.concat(F.lower(F.reverse(F.regexp_extract(F.reverse(part), label, 1))), F.lit("."), ending))

    def all_of(dotted: Column) -> Column:
        # Endings hold no dots, so those of a text are put in lower case and freed of blanks together.
        ends = F.regexp_replace(F.array_join(F.regexp_extract_all(dotted, F.lit(dot), F.lit(1)), "."), "\\s+", "")
        return F.filter(F.zip_with(F.split(dotted, dot), F.split(F.lower(ends), "\\."), domain), lambda d: ~d.startswith("."))

    found = bind(dedot(text, words), all_of)
    found = F.filter(found, lambda d: ~d.isin(list(allowed))) if allowed else found
    return F.when(may_have_domain(text, endings, words), found).otherwise(none)


def first_domain(text: Column, endings: Sequence[str] = BLOCKED_ENDINGS, allowed: Sequence[str] = (), words: Sequence[str] = DOT_WORDS) -> Column:
    return F.get(find_domains(text, endings, allowed, words), 0)


def digit_limit(text: Column, limit: int | Column) -> Column:
    """More than ``limit`` digits, the limit being a number or that of each row; none for a limit of 0 or less."""
    found = F.regexp_count(text, F.lit("\\p{Nd}"))
    if isinstance(limit, Column):
        return (limit > 0) & (found > limit)
    return F.lit(False) if limit <= 0 else found > limit


#: Sources whose texts are written things.
WRITTEN = ("sign", "book", "anvil")


def _of_source(df: DataFrame, cfg: RuleConfig) -> RuleConfig:
    """``cfg`` with the limits of each row's source."""
    if cfg.digits == cfg.digits_written or "source" not in df.columns:
        return cfg
    written = F.coalesce(F.col("source").isin(list(WRITTEN)), F.lit(False))
    return replace(cfg, digits=F.when(written, cfg.digits_written).otherwise(cfg.digits))


def char_run(text: Column, limit: int) -> Column:
    """A character more than ``limit`` (at least 3) times in a row."""
    return text.rlike(f"(?s)(.)\\1{{{max(3, limit)},}}")


def word_run(text: Column, limit: int) -> Column:
    """A word, without case, more than ``limit`` (at least 2) times in a row."""
    return text.rlike(f"(?iu)(?:^| )([^ ]++)(?: +\\1(?= |\\z)){{{max(2, limit)},}}")


def caps_limit(text: Column, limit: int) -> Column:
    """The text, in lower case if it has more than ``limit`` capitals."""
    return text if limit <= 0 else F.when(F.regexp_count(text, F.lit("\\p{IsUppercase}")) > limit, F.lower(text)).otherwise(text)


def blocked_command(cmd: Column) -> Column:
    return cmd.isin(list(TALKING_COMMANDS))


def book_limits(pages: Column, max_pages: int = 30, max_total: int = 8000, max_page: int = 256) -> Column:
    """struct<too_many, too_long, pages>: limits on a list of pages, pages cut to their limit."""
    total = F.aggregate(pages, F.lit(0), lambda s, p: s + F.length(p))
    return F.struct(
        (F.size(pages) > max_pages).alias("too_many"), (total > max_total).alias("too_long"),
        F.transform(pages, lambda p: F.substring(p, 1, max_page)).alias("pages"),
    )


#: Reasons in order of rules; the first that holds is the verdict's.
REASONS = ("spam.chars", "spam.injection", "spam.flood", "spam.ip", "spam.ip-split", "spam.domain", "spam.digits", "spam.repeat")
#: Rules that a user may be exempt from, each by the permission of this name.
EXEMPTIONS = ("spam", "injection", "ip", "ip.split", "digits", "repeat", "caps", "symbol.all", "chat", "sign", "book", "anvil", "command")

#: A rule is a function (text column, config) -> column of what it found, null for nothing.
Rule = Callable[[Column, RuleConfig], Column]


def _marked(test: Column, what: str) -> Column:
    return F.when(test, F.lit(what))


#: Rules on the text alone, by reason, in order. ``register_rule`` adds one.
RULES: dict[str, Rule] = {
    "spam.ip": lambda t, cfg: find_ipv4(t),
    "spam.domain": lambda t, cfg: F.coalesce(find_blacklisted(t, cfg.blacklist), first_domain(t, cfg.endings, cfg.allowed_domains, cfg.dot_words)),
    "spam.digits": lambda t, cfg: _marked(digit_limit(t, cfg.digits), "digits"),
    "spam.repeat": lambda t, cfg: _marked(char_run(t, cfg.char_run) | word_run(t, cfg.word_run), "run"),
}
#: The permission that a rule's exemption goes by.
EXEMPT_BY = {"spam.ip": "ip", "spam.ip-split": "ip.split", "spam.digits": "digits", "spam.injection": "injection"}


def register_rule(reason: str, rule: Rule, exempt_by: str | None = None, before: str | None = None) -> None:
    """Add a rule to all chains that are built from now on, before another reason or at the end; the same reason again replaces it."""
    global REASONS
    RULES[reason] = rule
    if exempt_by:
        EXEMPT_BY[reason] = exempt_by
    rest = tuple(r for r in REASONS if r != reason)
    at = rest.index(before) if before else len(rest)
    REASONS = (*rest[:at], reason, *rest[at:])


def is_exempt(exempt: Column | None, name: str) -> Column:
    return F.lit(False) if exempt is None else F.coalesce(F.array_contains(exempt, name), F.lit(False))


def rule_hits(df: DataFrame, cfg: RuleConfig, text: str, exempt: Column | None = None) -> DataFrame:
    """``df`` with hits, a struct of what each of RULES found in ``text``, by its reason; limits are those of the row's source, where it has one."""
    t, cfg = F.col(text), _of_source(df, cfg)
    free = lambda r: is_exempt(exempt, EXEMPT_BY[r]) if exempt is not None and r in EXEMPT_BY else F.lit(False)
    return df.withColumn("hits", F.struct(*(F.when(~free(r), rule(t, cfg)).alias(r) for r, rule in RULES.items())))


def first_reason(tests: dict[str, Column]) -> Column:
    """The first of REASONS whose test holds."""
    verdict = F.when(F.lit(False), "")
    for reason in REASONS:
        if reason in tests:
            verdict = verdict.when(tests[reason], reason)
    return verdict


def detected_by(reason: Column) -> Column:
    """What the rule of ``reason`` found, for addresses and domains."""
    return F.when(reason == "spam.ip", F.col("hits.`spam.ip`")).when(reason == "spam.domain", F.col("hits.`spam.domain`"))


def spam_chain(df: DataFrame, cfg: RuleConfig = RuleConfig(), text: str = "text", stateful: dict[str, str] | None = None) -> DataFrame:
    """``df`` with blocked, reason, detected, modified and final_text.

    All rules are one projection; the first in order that holds gives the reason. ``stateful`` names boolean columns of rules with
    state, by reason, that take their places in the order. Capitals are lowered in chat texts that nothing blocks.
    """
    t = F.col(text)
    flagged = rule_hits(df, cfg, text)
    tests = {"spam.chars": F.length(t) > cfg.max_chars} | {r: F.col(f"hits.`{r}`").isNotNull() for r in RULES}
    for reason, c in (stateful or {}).items():
        own = F.coalesce(F.col(c), F.lit(False))
        tests[reason] = tests[reason] | own if reason in tests else own
    out = flagged.withColumn("reason", first_reason(tests))
    blocked = F.col("reason").isNotNull()
    chat = (F.col("source") == "chat") if "source" in df.columns else F.lit(True)
    lowered = F.when(~blocked & chat, caps_limit(t, cfg.caps)).otherwise(t)
    return (
        out.withColumn("blocked", blocked).withColumn("detected", detected_by(F.col("reason"))).withColumn("final_text", lowered)
        .withColumn("modified", F.col("final_text") != t).drop("hits")
    )


def book_security(df: DataFrame, book: str = "container_id") -> DataFrame:
    """(book, cancelled): a book is cancelled if any page is blocked for an address or a domain."""
    stop = F.col("reason").contains("ip") | F.col("reason").contains("domain")
    return df.groupBy(book).agg(F.coalesce(F.bool_or(stop), F.lit(False)).alias("cancelled"))
