"""Rules with state, mutes and automatic sanctions on a stream, in the order of event time.

Rows wait in their user's state until the watermark has passed them; then they are folded in the order of time, whatever micro-batches
they came in. So a stream gives what the batch gives, for all rows that come before the watermark. Timers of event time release rows,
end mutes, and drop each part of the state when its time is over. The state store has to be RocksDB.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from modstream.operators.rules import RuleConfig
from modstream.streaming.state import FLAGS, UserState

#: Rows that wait: marks (mutes and their ends) come before messages of the same time. Times are microseconds.
WAITING = (
    "at_us long, kind int, msg_id long, source string, text string, reaches boolean, ip boolean, other boolean, split_off boolean, repeat_off boolean, "
    "scope string, duration long, payload string"
)
COLUMNS = tuple(c.split()[0] for c in WAITING.split(", "))
#: A verdict on each message; besides, a row of kind "unmuted" for each mute that has ended.
OUTPUT = "user_id long, kind string, msg_id long, at_us long, muted boolean, flood boolean, split_ip boolean, repeat boolean, sanction boolean, context string, payload string"
NEVER = -1


class LiveUser(StatefulProcessor):
    """The state of one user. ``feedback``: an automatic sanction mutes the user from then on."""

    def __init__(self, cfg: RuleConfig, feedback: bool):
        self.cfg, self.feedback = cfg, feedback

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.bucket = handle.getValueState("bucket", "tokens double, at double, used double")
        self.texts = handle.getListState("texts", "text string, since double")
        self.repeats = handle.getListState("repeats", "text string, n int, until double, seen double, used double")
        self.fragments = handle.getListState("fragments", "text string")
        self.sanctioned = handle.getValueState("sanctioned", "at double")
        self.mute = handle.getValueState("mute", "scope string, until_us long")
        self.armed = handle.getValueState("armed", "ms long")

    def load(self) -> UserState:
        saved: dict = {}
        if self.bucket.exists():
            saved["tokens"], saved["at"], saved["used"] = self.bucket.get()
        texts, repeats = list(self.texts.get()), list(self.repeats.get())
        if texts:
            # The first row only says since when.
            saved["texts"], saved["texts_from"] = [t[0] for t in texts[1:]], texts[0][1]
        if repeats:
            saved["repeats"], saved["repeats_used"] = [dict(zip(("text", "n", "until", "seen"), r[:4], strict=True)) for r in repeats], repeats[0][4]
        saved["fragments"] = [f[0] for f in self.fragments.get()]
        if self.sanctioned.exists():
            saved["sanctioned"] = self.sanctioned.get()[0]
        return UserState(self.cfg, saved)

    def save(self, user: UserState) -> None:
        s = user.state
        put = lambda state, rows: state.put(rows) if rows else state.clear()
        update = lambda state, row: state.clear() if row is None else state.update(row)
        update(self.bucket, None if s["used"] is None else (s["tokens"], s["at"], s["used"]))
        put(self.texts, [] if s["texts_from"] is None else [(None, s["texts_from"]), *((t, s["texts_from"]) for t in s["texts"])])
        put(self.repeats, [(r["text"], r["n"], r["until"], r["seen"], s["repeats_used"]) for r in s["repeats"]])
        put(self.fragments, [(f,) for f in s["fragments"]])
        update(self.sanctioned, None if s["sanctioned"] is None else (s["sanctioned"],))

    def arm(self, times_us: list[int]) -> None:
        """One timer, for the first of ``times_us``."""
        at = min(times_us, default=None)
        ms = None if at is None else -(-at // 1000)
        last = self.armed.get()[0] if self.armed.exists() else None
        if ms != last:
            if last is not None:
                self.handle.deleteTimer(last)
            if ms is None:
                self.armed.clear()
            else:
                self.handle.registerTimer(ms)
                self.armed.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        first = [self.armed.get()[0] * 1000] if self.armed.exists() else []
        for frame in rows:
            self.waiting.appendList(list(zip(*(frame[c].tolist() for c in COLUMNS), strict=True)))
            first.append(int(frame["at_us"].min()))
        self.arm(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.armed.clear()
        until = timerValues.getCurrentWatermarkInMs() * 1000
        rows = [tuple(r) for r in self.waiting.get()]
        ready = sorted((r for r in rows if r[0] <= until), key=lambda r: r[:3])
        rest = [r for r in rows if r[0] > until]
        user, mute, out = self.load(), tuple(self.mute.get()) if self.mute.exists() else None, []

        def ended(now: int) -> None:
            nonlocal mute
            if mute and mute[1] != NEVER and mute[1] <= now:
                out.append((key[0], "unmuted", None, mute[1], None, None, None, None, None, None, None))
                mute = None

        for row in ready:
            r = dict(zip(COLUMNS, row, strict=True))
            now, at = r["at_us"], r["at_us"] / 1_000_000
            ended(now)
            if r["kind"] == 0:
                mute = (r["scope"], now + r["duration"] * 1_000_000 if r["duration"] > 0 else NEVER) if r["scope"] else None
                continue
            muted = bool(mute) and (mute[0] == "GLOBAL" or r["source"] == "chat")
            flags, sanction, user.context = (False, False, False), False, None
            if r["reaches"] and not muted:
                flags = user.judge(r["source"], r["text"], at, r["ip"], r["other"], r["split_off"], r["repeat_off"])
                sanction = flags[0] and user.sanction(at)
                if sanction and self.feedback:
                    mute = ("CHAT", now + self.cfg.sanction_s * 1_000_000 if self.cfg.sanction_s > 0 else NEVER)
            out.append((key[0], "message", r["msg_id"], now, muted, *flags, sanction, user.context, r["payload"]))
        ended(until)
        user.expire(until / 1_000_000)
        self.save(user)
        self.mute.update(mute) if mute else self.mute.clear()
        self.waiting.put(rest) if rest else self.waiting.clear()
        ends = [int(t * 1_000_000) for t in user.ends()]
        self.arm([t for t in (*(r[0] for r in rest), *ends, *([mute[1]] if mute and mute[1] != NEVER else ())) if t > until])
        if out:
            names = [c.split()[0] for c in OUTPUT.split(", ")]
            yield pd.DataFrame(out, columns=names).astype(object)

    def close(self) -> None:
        pass


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def waiting_messages(messages: DataFrame) -> DataFrame:
    """Messages (msg_id, user_id, ts, source, text; more as in WAITING where they are) as rows that wait."""
    has = lambda c, otherwise: F.coalesce(F.col(c), F.lit(otherwise)) if c in messages.columns else F.lit(otherwise)
    return messages.select(
        "user_id", F.col("ts").cast("timestamp").alias("ts"), _micros("ts").alias("at_us"), F.lit(1).alias("kind"), "msg_id", "source", "text", has("reaches", True).alias("reaches"),
        *(has(c, False).alias(c) for c in ("ip", "other", "split_off", "repeat_off")), F.lit(None).cast("string").alias("scope"), F.lit(0).cast("long").alias("duration"),
        (F.col("payload") if "payload" in messages.columns else F.lit(None)).cast("string").alias("payload"),
    )


def waiting_marks(marks: DataFrame) -> DataFrame:
    """Mutes and their ends as rows that wait: (id, player_id, created_at, scope, duration), scope null for an end, duration 0 for good."""
    none = F.lit(None).cast("string")
    return marks.select(
        F.col("player_id").alias("user_id"), F.col("created_at").cast("timestamp").alias("ts"), _micros("created_at").alias("at_us"), F.lit(0).alias("kind"), F.coalesce("id", F.lit(-1)).cast("long").alias("msg_id"),
        none.alias("source"), none.alias("text"), *(F.lit(False).alias(c) for c in ("reaches", "ip", "other", "split_off", "repeat_off")), "scope", F.coalesce("duration", F.lit(0)).cast("long").alias("duration"), none.alias("payload"),
    )


def live(waiting: DataFrame, cfg: RuleConfig = RuleConfig(), watermark: str = "10 minutes", feedback: bool = False) -> DataFrame:
    """OUTPUT of the rows of a stream made by ``waiting_messages`` and ``waiting_marks`` (their union).

    Rows later than ``watermark`` behind the latest row of all are dropped. Rows without a time are dropped too.
    """
    rows = waiting.where("ts is not null").withWatermark("ts", watermark)
    return rows.groupBy("user_id").transformWithStateInPandas(LiveUser(cfg, feedback), OUTPUT, "Append", "EventTime")


def stream_user_rules(messages: DataFrame, cfg: RuleConfig = RuleConfig(), watermark: str = "10 minutes") -> DataFrame:
    """``user_rules`` of a streaming ``messages``, in the order of (ts, msg_id) whatever micro-batches rows come in."""
    return live(waiting_messages(messages), cfg, watermark).select("user_id", "msg_id", *FLAGS)


def stream_muted(messages: DataFrame, marks: DataFrame, watermark: str = "10 minutes") -> DataFrame:
    """(msg_id, user_id, muted) of a streaming ``messages`` by a stream of mutes and their ends; user_id and the time at_us of each mute that has ended, with a null msg_id."""
    found = live(waiting_messages(messages.withColumn("reaches", F.lit(False))).union(waiting_marks(marks)), watermark=watermark)
    return found.select("msg_id", "user_id", "muted", "at_us", "kind")


def ended_mutes(found: DataFrame) -> DataFrame:
    """Audit rows (player_id, action, detail, timestamp) of the mutes that ``live`` found to have ended."""
    return found.where("kind = 'unmuted'").select(F.col("user_id").alias("player_id"), F.lit("UNMUTE").alias("action"), F.lit("Expired/Manual").alias("detail"), F.timestamp_micros("at_us").alias("timestamp"))
