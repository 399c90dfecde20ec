"""Moderation of a table of messages from end to end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from modstream.functions.text import sanitize_message, sanitized, strip_tags
from modstream.operators.lexicon import filter_texts
from modstream.operators.rules import EXEMPTIONS, RULES, RuleConfig, caps_limit, detected_by, first_reason, is_exempt, rule_hits
from modstream.operators.tables import enforce_mutes, exemptions
from modstream.sources.io import enabled_sources
from modstream.streaming.live import live, waiting_marks, waiting_messages
from modstream.streaming.state import FLAGS, UserState, folded

#: Which check comes first: books and renamed items are checked for spam before the term lists, the others after.
SPAM_FIRST = ("book", "anvil")

CATEGORIES = {
    "spam.flood": "Anti-Flood", "spam.ip": "Anti-Ip", "spam.ip-split": "IP Split", "spam.domain": "Anti-Domain", "spam.digits": "Digits",
    "spam.repeat": "Repeat", "spam.chars": "Chars", "spam.injection": "Injection", "Evasion": "Evasion", "Evasion/Hidden Characters": "Evasion", "Zalgo/Unicode": "Text usage (Zalgo/Unicode)",
}


def category(reason):
    """Log category of a reason; term hits are "Filter"."""
    out = F.when(reason.startswith("Filter"), "Filter").when(reason == "WriteCommand", "(WordBlock)")
    for r, c in CATEGORIES.items():
        out = out.when(reason == r, c)
    return out


#: Rules with state, by reason: their flag.
STATEFUL = {"spam.flood": "flood", "spam.ip-split": "split_ip", "spam.repeat": "repeat"}


def _user_flags(rows: DataFrame, cfg: RuleConfig) -> DataFrame:
    """``rows`` with the flags of the rules with state, folded in the order of (ts, msg_id) of each user."""

    def make():
        judge = UserState(cfg).judge

        def step(reaches: bool, source: str, text: str, at: float, ip: bool, other: bool, split_off: bool, repeat_off: bool) -> tuple[bool, bool, bool]:
            return judge(source, text, at, ip, other, split_off, repeat_off) if reaches else (False, False, False)

        return step

    return folded(rows, "user_id", make, ("reaches", "source", "clean", "at", "ip", "other", "split_off", "repeat_off"), FLAGS)


def _free(name: str) -> Column:
    """Whether the user is exempt from what the permission ``name`` switches off."""
    return is_exempt(F.col("exempt_from"), name)


def _prepared(rows: DataFrame, lexicon: DataFrame, cfg: RuleConfig, permissions: DataFrame | None) -> DataFrame:
    """``rows`` (msg_id, user_id, ts, source, text, muted) with all that no state is needed for: what term lists and rules find, and the texts."""
    rows = rows.withColumn("exempt_from", F.array().cast("array<string>")) if permissions is None else exemptions(rows, permissions, EXEMPTIONS)
    source, chat, command, spam_first = F.col("source"), F.col("source") == "chat", F.col("source") == "command", F.col("source").isin(list(SPAM_FIRST))
    own = F.coalesce(F.array_contains("exempt_from", source), F.lit(False))
    passes = F.col("muted") | (own & ~command)
    raw = F.coalesce("text", F.lit(""))
    rows = rows.withColumns({"passes": passes, "no_terms": own & command, "sent": raw, "text": F.when(passes, "").otherwise(raw), "shown": F.col("text")})

    found = filter_texts(rows, lexicon, cfg, charset=~_free("symbol.all"))
    hidden = chat & F.col("hidden") & F.lit(cfg.replacement) & ~F.col("filter_blocked")
    stops = (F.col("filter_blocked") & (~command | (F.col("filter_reason") == "WriteCommand")) | hidden) & ~F.col("no_terms")
    reason = F.when(hidden, "Evasion/Hidden Characters").otherwise(F.col("filter_reason"))
    checked = F.when(chat, F.col("literal_text")).when(~command, F.col("masked_text")).otherwise(F.col("text"))
    found = found.select(
        "msg_id", "user_id", "ts", "source", "muted", "passes", "exempt_from", "shown", F.when(spam_first, F.col("text")).otherwise(checked).alias("checked"), checked.alias("masked_text"),
        F.when(stops, reason).alias("by_terms"), F.when(stops, F.col("detected_word")).alias("term"),
    )
    found = found.withColumn("reaches", ~F.col("passes") & (F.col("by_terms").isNull() | spam_first) & ~_free("spam"))
    found = found.withColumn("message", sanitize_message(F.col("checked"))).withColumn("safe", F.when(_free("injection"), F.col("message")).otherwise(sanitized(F.col("message"))))
    unsafe = F.col("safe") != F.col("message")
    found = found.withColumns({
        "too_long": F.length("checked") > cfg.max_chars, "injected": unsafe & F.lit(not cfg.replacement), "rewritten": unsafe & F.lit(cfg.replacement),
        "final": F.when(unsafe & F.lit(cfg.replacement), F.col("safe")).otherwise(F.col("message")),
    })
    found = found.withColumn("clean", strip_tags(F.col("final")))
    found = found.withColumn("reaches", F.col("reaches") & ~F.col("too_long") & ~F.col("injected")).withColumn("spam_off", F.col("passes") | _free("spam"))
    return rule_hits(found, cfg, "clean", F.col("exempt_from") if permissions is not None else None)


def _hit(reason: str) -> Column:
    return F.col(f"hits.`{reason}`").isNotNull()


#: What verdicts need beside the flags.
CARRIED = ("msg_id", "user_id", "source", "muted", "passes", "exempt_from", "shown", "masked_text", "by_terms", "term", "spam_off", "too_long", "injected", "rewritten", "final", "hits")


def _for_fold(ruled: DataFrame, *more: str) -> list[Column | str]:
    """What the rules with state read."""
    other = F.lit(False)
    for r in RULES:
        other = other | _hit(r) if r != "spam.ip" else other
    return [*more, "clean", "reaches", _hit("spam.ip").alias("ip"), other.alias("other"), _free("ip.split").alias("split_off"), _free("repeat").alias("repeat_off")]


def _verdicts(ruled: DataFrame, cfg: RuleConfig, stateful: bool, *more: str) -> DataFrame:
    """The verdict of each of ``ruled``: CARRIED, and the flags of the rules with state where ``stateful``."""
    chat, spam_first = F.col("source") == "chat", F.col("source").isin(list(SPAM_FIRST))
    tests = {"spam.chars": F.col("too_long"), "spam.injection": F.col("injected")} | {r: _hit(r) for r in RULES}
    if stateful:
        tests |= {r: tests[r] | F.col(flag) if r in tests else F.col(flag) for r, flag in STATEFUL.items()}
    ruled = ruled.withColumn("by_spam", F.when(~F.col("spam_off") & (F.col("by_terms").isNull() | spam_first), first_reason(tests)))
    first = F.when(F.col("muted"), "muted").when(spam_first, F.coalesce("by_spam", "by_terms")).otherwise(F.coalesce("by_terms", "by_spam"))
    ruled = ruled.withColumn("reason", first)
    lowered = F.when(chat & ~_free("caps"), caps_limit(F.col("final"), cfg.caps)).otherwise(F.col("final"))
    modified = ~F.col("spam_off") & (F.col("rewritten") | (lowered != F.col("final")))
    # What the terms mask in books and on items comes after the spam rules, which leave such texts as they are or block them.
    shown = F.when(F.col("passes"), F.col("shown")).when(modified & ~spam_first, lowered).otherwise(F.col("masked_text"))
    by = F.col("reason")
    return ruled.select(
        "msg_id", "user_id", "source", by.isNotNull().alias("blocked"), by.alias("reason"), category(by).alias("category"),
        F.when(by == F.col("by_terms"), F.col("term")).otherwise(detected_by(F.col("by_spam"))).alias("detected"), F.col("shown").alias("text"), F.when(by.isNull(), shown).alias("masked"), *more,
    )


def moderate(messages: DataFrame, lexicon: DataFrame, cfg: RuleConfig = RuleConfig(), mutes: DataFrame | None = None, permissions: DataFrame | None = None, stateful: bool = True) -> DataFrame:
    """(msg_id, user_id, source, blocked, reason, category, detected, text, masked) of ``messages``; one pass, one shuffle by user.

    A muted user's message is blocked; one who holds the permission of the source passes (with that of commands only the term lists);
    neither reaches a rule. The term lists come first, but last in books and on items. What they block goes no further, in chat
    also what hides its words from the mask; what they mask goes on masked: in chat every literal place of the
    words found, elsewhere the places found. Commands meet only command terms. The spam rules take the
    text as it is sent for its length, then without invisible characters; markup and placeholders that aren't safe block it, or are
    rewritten for all that follows; then come flood, address, split address, domain, digits, runs and near repeats, on the text without
    tags. A message that a rule stops doesn't reach the state of the next ones. In chat many capitals are lowered. A user's
    ``permissions`` (see EXEMPTIONS) switch single rules off. masked is the text to be shown, null if blocked.
    """
    rows = enabled_sources(messages.select("msg_id", "user_id", "ts", "source", "text"), cfg)
    rows = rows.withColumn("muted", F.lit(False)) if mutes is None else enforce_mutes(rows, mutes)
    ruled = _prepared(rows, lexicon, cfg, permissions)
    if stateful:
        at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).alias("at")
        ruled = _user_flags(ruled.select(*_for_fold(ruled, *CARRIED), at), cfg)
    return _verdicts(ruled, cfg, stateful)


def moderate_stream(
    messages: DataFrame, lexicon: DataFrame, cfg: RuleConfig = RuleConfig(), marks: DataFrame | None = None, permissions: DataFrame | None = None,
    watermark: str = "10 minutes", feedback: bool = False,
) -> DataFrame:
    """``moderate`` of a streaming ``messages`` with a stream of ``marks`` (mutes and their ends, see ``waiting_marks``), in the order of event time.

    Besides the columns of ``moderate`` each row has kind, ts, sanction (its denial leads to an automatic sanction) and context (the texts
    before a denial for flooding). Rows of kind "unmuted", with just user_id and ts, say that a mute has ended. With ``feedback`` such a
    sanction mutes the user from then on. Term lists and permissions are tables; rows later than the watermark are dropped.
    """
    rows = enabled_sources(messages.select("msg_id", "user_id", "ts", "source", "text"), cfg).withColumn("muted", F.lit(False))
    ruled = _prepared(rows, lexicon, cfg, permissions)
    packed = F.struct(*(F.col(c) for c in CARRIED))
    kind = ruled.select(packed.alias("p")).schema["p"].dataType
    waiting = waiting_messages(ruled.select(*_for_fold(ruled, "msg_id", "user_id", "ts", "source"), F.to_json(packed).alias("payload")).withColumnRenamed("clean", "text"))
    waiting = waiting if marks is None else waiting.union(waiting_marks(marks))
    found = live(waiting, cfg, watermark, feedback).withColumn("p", F.from_json("payload", kind))
    on = F.col("muted")
    off = {"muted": on, "passes": on | F.col("p.passes"), "spam_off": on | F.col("p.spam_off"), "by_terms": F.when(~on, F.col("p.by_terms")), "term": F.when(~on, F.col("p.term"))}
    carried = [F.col(f"p.{c}").alias(c) for c in CARRIED if c not in ("muted", "passes", "spam_off", "by_terms", "term", "msg_id", "user_id")]
    ruled = found.select("msg_id", "user_id", *carried, *(c.alias(name) for name, c in off.items()), *FLAGS, "kind", F.timestamp_micros("at_us").alias("ts"), "sanction", "context")
    return _verdicts(ruled, cfg, True, "kind", "ts", "sanction", "context")
