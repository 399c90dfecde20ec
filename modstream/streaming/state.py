"""Rules with state for each user, the same fold in batch and in Structured Streaming.

Rows are shuffled by user once, sorted within partitions by time, and folded in one pass over the partition, so a user with any number
of rows needs just one state in memory. ``streaming.live`` does the same on a stream.
"""

from __future__ import annotations

import copy
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from modstream.operators.rules import OCTET, RuleConfig
from modstream.sources.shared import written

#: Rows kept of a user's near repeats and fragments.
HISTORY = 5
FRAGMENT, JOINED = 50, 300
#: Rows of one user that a task folds in one go where sessions can be told apart.
HOT_ROWS = 1_000_000
SPLIT_IP = re.compile(rf"(?<![0-9])({OCTET}(?:[^0-9]+{OCTET}){{3}})(?![0-9])")


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance, a whole column of the table at a time as bits of a number (Myers); if it is above ``most``, anything above."""
    if not a:
        return len(b)
    at: dict[str, int] = {}
    for i, char in enumerate(a):
        at[char] = at.get(char, 0) | 1 << i
    every, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = every, 0, len(a)
    # A column more lowers the distance by one at most.
    least = len(a) + len(b) if most is None else most + len(b)
    for j, char in enumerate(b):
        if distance > least - j:
            return distance
        same = at.get(char, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | ~(diagonal | up), up & diagonal
        distance += bool(right & top) - bool(left & top)
        right, left = right << 1 | 1, left << 1
        up, down = (left | ~(diagonal | right)) & every, right & diagonal & every
    return distance


def similarity(a: str, b: str, least: float = 0.0) -> float:
    """Percent of the longer text that no edit touches; if it is below ``least``, anything below."""
    a, b = a.lower(), b.lower()
    if a == b:
        return 100.0
    longer = max(len(a), len(b))
    most = int(longer * (100 - least) / 100) + 1
    if abs(len(a) - len(b)) > min(0.4 * longer, most):
        return 0.0
    if most < longer:  # each edit takes away or adds at most one of a's letters that b hasn't, and the other way round
        x, y = Counter(a), Counter(b)
        if max((x - y).total(), (y - x).total()) > most:
            return 0.0
    return (longer - edit_distance(a, b, most)) / longer * 100


#: State of a user that has no messages yet.
FRESH = {"tokens": None, "at": 0.0, "used": None, "texts": [], "texts_from": None, "repeats": [], "repeats_used": None, "fragments": [], "sanctioned": None}


class UserState:
    """State of one user; times are seconds of event time. Each part is dropped by its own time limit, as if the user were new to it."""

    def __init__(self, cfg: RuleConfig, saved: dict | None = None):
        self.cfg = cfg
        self.state = copy.deepcopy(FRESH) | (saved or {})
        self.context: str | None = None

    def expire(self, now: float) -> None:
        """Drop the parts whose time is over."""
        s, cfg = self.state, self.cfg
        if s["used"] is not None and 0 < cfg.bucket_ttl_s <= now - s["used"]:
            s.update(tokens=None, at=0.0, used=None)
        if s["texts_from"] is not None and 0 < cfg.texts_ttl_s <= now - s["texts_from"]:
            s.update(texts=[], texts_from=None)
        if s["repeats_used"] is not None and 0 < cfg.repeat_ttl_s <= now - s["repeats_used"]:
            s.update(repeats=[], repeats_used=None)
        if s["sanctioned"] is not None and cfg.suppress_s <= now - s["sanctioned"]:
            s["sanctioned"] = None

    def ends(self) -> list[float]:
        """When each part that there is will be dropped."""
        s, cfg = self.state, self.cfg
        limits = ((s["used"], cfg.bucket_ttl_s), (s["texts_from"], cfg.texts_ttl_s), (s["repeats_used"], cfg.repeat_ttl_s), (s["sanctioned"], cfg.suppress_s))
        return [since + ttl for since, ttl in limits if since is not None and ttl > 0]

    def flood(self, now: float) -> bool:
        """Token bucket: full at first, refilled evenly; a denial leaves it as it is. True if denied."""
        self.expire(now)
        s, full = self.state, self.cfg.flood_messages
        s["used"] = now
        tokens = full if s["tokens"] is None else min(full, s["tokens"] + (now - s["at"]) * full / self.cfg.flood_seconds)
        if tokens < 1:
            return True
        s["tokens"], s["at"] = tokens - 1, now
        return False

    def remember(self, text: str, now: float) -> None:
        """Keep a text for the context of a denial."""
        self.expire(now)
        s = self.state
        if s["texts_from"] is None:
            s["texts_from"] = now
        s["texts"].append(text)
        del s["texts"][:-HISTORY]

    def sanction(self, now: float) -> bool:
        """Whether a denial leads to a sanction: not so soon after the last one."""
        self.expire(now)
        if self.state["sanctioned"] is not None:
            return False
        self.state["sanctioned"] = now
        return True

    def repeat(self, text: str, now: float) -> bool:
        """Near repeats of the last texts, most recent first; beyond the limit a text is blocked for the cooldown."""
        self.expire(now)
        text, cfg, kept = text.strip(), self.cfg, self.state["repeats"]
        if len(text) < 2:
            return False
        self.state["repeats_used"] = now
        at = next((i for i, r in enumerate(kept) if similarity(text, r["text"], cfg.repeat_similarity) >= cfg.repeat_similarity), None)
        if at is None:
            kept.insert(0, {"text": text, "n": 1, "until": 0.0, "seen": now})
            del kept[HISTORY:]
            return False
        hit = kept.pop(at)
        kept.insert(0, hit)
        if hit["until"] > now:
            return True
        if hit["until"] or now - hit["seen"] > cfg.repeat_cooldown_s + 30:
            hit["n"], hit["until"] = 0, 0.0
        hit.update(n=hit["n"] + 1, text=text, seen=now)
        if hit["n"] > cfg.repeat_max:
            hit.update(n=0, until=now + cfg.repeat_cooldown_s)
            return True
        return False

    def split_address(self, text: str) -> bool:
        """An address spread over the last fragments, unless its numbers just count."""
        text, kept = text.strip(), self.state["fragments"]
        if not text or len(text) > FRAGMENT or not any(c.isdecimal() or c == "." for c in text) or (kept and kept[-1] == text):
            return False
        kept.append(text)
        del kept[:-HISTORY]
        numbers: list[str] = []
        for number in re.findall("[0-9]+", " ".join(kept)):
            if numbers[-2:] != [number, number]:
                numbers.append(number)
        joined = " ".join(numbers)
        if sum(map(len, numbers)) < 4:
            return False
        found = SPLIT_IP.search(joined[:JOINED])
        if not found:
            return False
        octets = [int(x) for x in found[1].split()]
        steps = {b - a for a, b in zip(octets, octets[1:], strict=False)}
        if len(steps) == 1 and 1 <= abs(steps.copy().pop()) <= 10:
            return False
        kept.clear()
        return True

    def judge(self, source: str, text: str | None, now: float, ip: bool = False, other: bool = False, split_off: bool = False, repeat_off: bool = False) -> tuple[bool, bool, bool]:
        """Flood, split address and near repeat of one message, in order: a message that a rule stops doesn't reach the next ones.

        ``ip`` says that the rule on addresses stops it after the flood rule, ``other`` that one of domains, digits or runs does before
        near repeats. Texts beyond the length limit are stopped before any rule. A control row ends the session.
        """
        self.context = None
        if source == "end_session":
            self.state = UserState(self.cfg).state
            return False, False, False
        traffic, text = source == "chat", text or ""
        if len(text) > self.cfg.max_chars:
            return False, False, False
        if traffic:
            self.remember(text, now)
            if self.flood(now):
                self.context, self.state["texts"] = " | ".join(self.state["texts"]), []
                return True, False, False
        if ip:
            return False, False, False
        if not split_off and self.split_address(text):
            return False, True, False
        return False, False, traffic and not other and not repeat_off and self.repeat(text, now)

    def verdict(self, row: dict) -> dict:
        """``judge`` of a row (source, text, at)."""
        return dict(zip(FLAGS, self.judge(row["source"], row["text"], row["at"]), strict=True))


FLAGS = ("flood", "split_ip", "repeat")


def _seconds(ts: str = "ts"):
    return (F.unix_micros(F.col(ts).cast("timestamp")) / 1_000_000).alias("at")


def folded(rows: DataFrame, key: str | Sequence[str], make: Callable[[], Callable], inputs: Sequence[str], flags: Sequence[str], keep: Sequence[str] | None = None) -> DataFrame:
    """``rows`` with ``flags``: a fold in order of (at, msg_id) for each ``key``, in one shuffle by it.

    ``make()`` gives a function of the ``inputs`` for each new key, that returns the flags of a row or, where there is one, the flag.
    """
    keep, keys = list(keep or rows.columns), [key] if isinstance(key, str) else list(key)
    one = len(flags) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step = object(), None
        for batch in batches:
            column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: E731, B023
            found, at = [], list(zip(*(column(k).to_pylist() for k in keys), strict=True))
            for k, *values in zip(at, *(column(c).to_pylist() for c in inputs), strict=True):
                if k != current:
                    current, step = k, make()
                found.append(step(*values))
            more = [found] if one else zip(*found, strict=True) if found else [[] for _ in flags]
            yield pa.record_batch([column(c) for c in keep] + [pa.array(x, pa.bool_()) for x in more], [*keep, *flags])

    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField(f, T.BooleanType()) for f in flags])
    return rows.repartition(*keys).sortWithinPartitions(*keys, "at", "msg_id").mapInArrow(run, schema)


def with_sessions(rows: DataFrame, gap: float) -> DataFrame:
    """``rows`` (user_id, msg_id, at) with session, the time of the last row of the user up to this one that comes ``gap`` seconds or more after the one before.

    Rows are dealt into ranges of (user, time), so a user with any share of them is in many tasks. Within a range windows see the row before;
    what goes on from range to range is a row for each range that a user enters while in another, joined back to that user's rows of the range.
    """
    ranged = written(rows.repartitionByRange("user_id", "at", "msg_id").withColumn("_range", F.spark_partition_id()), "ranges")
    order = Window.partitionBy("_range", "user_id").orderBy("at", "msg_id")
    before = F.lag("at").over(order)
    own = ranged.withColumn("_first", before.isNull()).withColumn("_begins", F.when(F.col("at") - before >= gap, F.col("at")))
    own = own.withColumn("_since", F.last("_begins", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    # Of each range and user: first and last time, and where its last session begins; where a user has one range only, that is all.
    ends = own.groupBy("_range", "user_id").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.max("_begins").alias("last"))
    parts = Window.partitionBy("user_id").orderBy("_range")
    ends = ends.withColumn("_begins_here", F.coalesce(F.col("low") - F.lag("high").over(parts) >= gap, F.lit(True)))
    begun = F.coalesce("last", F.when(F.col("_begins_here"), F.col("low")))
    carried = F.last(begun, ignorenulls=True).over(parts.rowsBetween(Window.unboundedPreceding, -1))
    ends = ends.select("_range", F.col("user_id").alias("_user"), F.when(F.col("_begins_here"), F.col("low")).otherwise(carried).alias("_open"))
    joined = own.join(ends.withColumnRenamed("_range", "_r"), (F.col("_range") == F.col("_r")) & F.col("user_id").eqNullSafe(F.col("_user")))
    return joined.withColumn("session", F.coalesce("_since", "_open")).select(*rows.columns, "session")


def _by_session(events: DataFrame, gap: float) -> tuple[DataFrame, list[str]]:
    """(rows, keys) of a fold that begins anew after ``gap`` seconds: by user, or where a user has more than HOT_ROWS rows, by session; flags are the same."""
    rows = events.select("user_id", "msg_id", _seconds())
    most = rows.groupBy("user_id").count().agg(F.max("count")).first()[0] or 0
    return (with_sessions(rows, gap * (1 + 1e-9)), ["user_id", "session"]) if most > HOT_ROWS else (rows, ["user_id"])


def user_rules(messages: DataFrame, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """(user_id, msg_id, flood, split_ip, repeat) of ``messages`` (msg_id, user_id, ts, source, text), in order of (ts, msg_id)."""
    rows = messages.select("user_id", "msg_id", _seconds(), "source", "text")
    return folded(rows, "user_id", lambda: UserState(cfg).judge, ("source", "text", "at"), FLAGS, ("user_id", "msg_id"))


def token_bucket(events: DataFrame, capacity: float, seconds: float) -> DataFrame:
    """(user_id, msg_id, allowed) of ``events`` (msg_id, user_id, ts): a bucket of ``capacity`` that fills in ``seconds``.

    After ``seconds`` without an event the bucket is full as at first, so a hot user's events are folded by session.
    """

    def make():
        state = UserState(RuleConfig(flood_messages=capacity, flood_seconds=seconds, bucket_ttl_s=0))
        return lambda at: not state.flood(at)

    return folded(*_by_session(events, seconds), make, ("at",), ("allowed",), ("user_id", "msg_id"))


def throttle(events: DataFrame, seconds: float) -> DataFrame:
    """(user_id, msg_id, allowed): accepted if at least ``seconds`` after the last accepted one of the user; a hot user's are folded by session, as a longer gap lets any through."""

    def make():
        last = None

        def step(at: float) -> bool:
            nonlocal last
            if last is None or at - last >= seconds:
                last = at
                return True
            return False

        return step

    return folded(*_by_session(events, seconds), make, ("at",), ("allowed",), ("user_id", "msg_id"))


def auto_sanctions(denied: DataFrame, duration: str = "15m", reason: str = "Anti-Flood Auto Mute", kind: str = "AUTO", suppress: float = 10.0) -> DataFrame:
    """Sanctions (player_id, kind, duration, reason, moderator, created_at) for ``denied`` (msg_id, user_id, ts): a user gets one at most in ``suppress`` seconds."""
    allowed = throttle(denied, suppress).where("allowed").select("msg_id")
    rows = denied.join(allowed, "msg_id", "left_semi")
    return rows.select(
        F.col("user_id").alias("player_id"), F.lit(kind).alias("kind"), F.lit(duration).alias("duration"), F.lit(reason).alias("reason"), F.lit("System").alias("moderator"),
        F.col("ts").cast("timestamp").alias("created_at"),
    )


def rate_cap(events: DataFrame, seconds: int, n: int) -> DataFrame:
    """(msg_id, allowed): the first ``n`` of all events in each window of ``seconds`` are allowed.

    Only the n earliest of each part of a window can be among its n earliest, so parts are ranked first and no task gets a window whole.
    """
    rows = events.select("msg_id", F.col("ts").cast("timestamp").alias("ts")).withColumn("bucket", F.floor(F.unix_micros("ts") / (seconds * 1_000_000)))
    part = Window.partitionBy("bucket", F.pmod(F.xxhash64("msg_id"), F.lit(64))).orderBy("ts", "msg_id")
    ranked = rows.withColumn("place", F.row_number().over(part))
    first = ranked.where(F.col("place") <= n).withColumn("place", F.row_number().over(Window.partitionBy("bucket").orderBy("ts", "msg_id")))
    return first.select("msg_id", (F.col("place") <= n).alias("allowed")).union(ranked.where(F.col("place") > n).select("msg_id", F.lit(False)))


def flood_context(events: DataFrame, last: int = HISTORY) -> DataFrame:
    """(msg_id, context) of denied rows of ``events`` (msg_id, user_id, ts, text, denied): the user's last texts since the denial before."""
    by_user = Window.partitionBy("user_id").orderBy("ts", "msg_id")
    epoch = F.coalesce(F.sum(F.col("denied").cast("int")).over(by_user.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    recent = Window.partitionBy("user_id", "epoch").orderBy("ts", "msg_id").rowsBetween(1 - last, 0)
    found = events.withColumn("epoch", epoch).withColumn("context", F.array_join(F.collect_list("text").over(recent), " | "))
    return found.where("denied").select("msg_id", "context")


def split_windows(messages: DataFrame) -> DataFrame:
    """(msg_id, split_ip) by plain windows: no reset after a hit, no leaving out of counting; a quick first look."""
    rows = messages.where((F.length("text") <= FRAGMENT) & F.col("text").rlike("[0-9.]"))
    recent = Window.partitionBy("user_id").orderBy("ts", "msg_id").rowsBetween(1 - HISTORY, 0)
    joined = F.array_join(F.regexp_extract_all(F.array_join(F.collect_list("text").over(recent), " "), F.lit("[0-9]+"), F.lit(0)), " ")
    return rows.select("msg_id", joined.rlike(f"(?<![0-9]){OCTET}(?: {OCTET}){{3}}(?![0-9])").alias("split_ip"))
