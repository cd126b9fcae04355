"""The filing queue: one filing at a time for each bot, messages that meet a busy bot left for later, in order.

A bot is a (jurisdiction, service). A ``file`` message starts an idle bot; one that meets a busy bot, or others that wait, fails alone and is
delivered again, first come first, when the bot is idle. ``done`` makes the bot idle, as does a timer when it has
been busy for more than ``overtime`` seconds. Filings of ``BYPASS`` go straight through. The fold is by event time: a
batch takes all messages in order, a stream holds them until the watermark has passed them, so that both tell the
same, however the stream is cut into batches. Messages later than the watermark are dropped and counted by the stream's progress.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestrata.operators.business import OVERTIME_SECONDS

# Fixed value: the filings that don't go through the queue.
BYPASS = ("DELAWARE", "COGS")
OUTCOMES = "jurisdiction string, service string, at long, id string, outcome string"
_COLUMNS = ["jurisdiction", "service", "at", "id", "outcome"]
_KEY = ["jurisdiction", "service"]


@dataclass
class Bot:
    """One bot's state: what it does since when, and what waits."""

    overtime: int
    busy: str | None = None
    since: int = 0
    waiting: list[str] = field(default_factory=list)

    def _idle(self, at: int) -> Iterator[tuple[int, str, str]]:
        self.busy = None
        if self.waiting:
            self.busy, self.since = self.waiting.pop(0), at
            yield at, self.busy, "started"

    def until(self, now: int) -> Iterator[tuple[int, str, str]]:
        """What timers do before and at ``now``."""
        while self.busy is not None and self.since + self.overtime + 1 <= now:
            at = self.since + self.overtime + 1
            yield at, self.busy, "reset"
            yield from self._idle(at)

    def take(self, at: int, kind: str, id: str, bypass: bool) -> Iterator[tuple[int, str, str]]:
        yield from self.until(at)
        if kind == "done":
            if self.busy is not None:
                yield at, self.busy, "finished"
                yield from self._idle(at)
        elif bypass:
            yield at, id, "bypassed"
        elif self.busy is None:
            self.busy, self.since = id, at
            yield at, id, "started"
        else:
            self.waiting.append(id)
            yield at, id, "left"


def filing_outcomes(messages: DataFrame, until: int, overtime: int = OVERTIME_SECONDS) -> DataFrame:
    """OUTCOMES of messages (jurisdiction, service, ts seconds, seq, kind, id) up to the time ``until``; a bot's are in order of (ts, seq).

    Bots are streams through their tasks, of which only what waits is held.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, bot = None, Bot(overtime)
        for batch in batches:
            out = []
            for jurisdiction, service, ts, kind, id in batch.itertuples(index=False):
                if (jurisdiction, service) != now:
                    if now is not None:
                        out += [(*now, *o) for o in bot.until(until)]
                    now, bot = (jurisdiction, service), Bot(overtime)
                out += [(*now, *o) for o in bot.take(ts, kind, id, now == BYPASS)]
            yield pd.DataFrame(out, columns=_COLUMNS)
        if now is not None:
            yield pd.DataFrame([(*now, *o) for o in bot.until(until)], columns=_COLUMNS)

    own = messages.where(F.col("ts") <= until).repartition(*_KEY).sortWithinPartitions(*_KEY, "ts", "seq")
    return own.select(*_KEY, "ts", "kind", "id").mapInPandas(fold, OUTCOMES)


class FilingProcessor(StatefulProcessor):
    """The same fold with state: messages that the watermark hasn't passed, what the bot does, and what waits."""

    def __init__(self, overtime: int = OVERTIME_SECONDS):
        self.overtime = overtime

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bot = handle.getValueState("bot", "id string, since long")
        self.waiting = handle.getListState("waiting", "id string")
        self.early = handle.getListState("early", "ts long, seq long, kind string, id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(t), int(s), k, i) for batch in rows for t, s, k, i in batch[["ts", "seq", "kind", "id"]].itertuples(index=False)]
        self.early.appendList(new)
        self.handle.registerTimer(min(new)[0] * 1000)
        yield pd.DataFrame([], columns=_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        # all that the watermark has passed, not only what this timer stood for: timers set below may lie behind it already
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) // 1000
        early = sorted(self.early.get())
        due = [m for m in early if m[0] <= now]
        bot = Bot(self.overtime)
        if self.bot.exists():
            bot.busy, bot.since = self.bot.get()
        bot.waiting = [w[0] for w in self.waiting.get()]
        out = [o for m in due for o in bot.take(m[0], m[2], m[3], tuple(key) == BYPASS)]
        out += bot.until(now)
        if due:
            self.early.clear()
            if len(due) < len(early):
                self.early.put(early[len(due) :])
                self.handle.registerTimer(early[len(due)][0] * 1000)
        if bot.busy is None:
            self.bot.clear()
        else:
            self.bot.update((bot.busy, bot.since))
            self.handle.registerTimer((bot.since + self.overtime + 1) * 1000)
        self.waiting.clear()
        if bot.waiting:
            self.waiting.put([(w,) for w in bot.waiting])
        yield pd.DataFrame([(*key, *o) for o in out], columns=_COLUMNS)

    def close(self) -> None:
        pass


def filing_stream(messages: DataFrame, late: str = "10 minutes", overtime: int = OVERTIME_SECONDS) -> DataFrame:
    """OUTCOMES of a stream of messages (jurisdiction, service, ts seconds, seq, kind, id); its state needs the RocksDB provider, which is set for the session."""
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = messages.withColumn("event_time", F.timestamp_seconds("ts")).withWatermark("event_time", late)
    return own.groupBy(*_KEY).transformWithStateInPandas(FilingProcessor(overtime), OUTCOMES, "Append", "EventTime")
