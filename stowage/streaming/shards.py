"""State of a running listing as streams: each shard's answers, what siblings teach, and pages that come again.

The processors keep a few numbers for each key.  They need the RocksDB state store (see :func:`with_rocksdb`).
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import paths
from ..sources import listing

#: Failed tries in a row after which a shard fails, and after which a full listing without a cursor is split.
ATTEMPTS, SPLIT_AT = 3, 2
#: Seconds before a try is repeated: BACKOFF to the number of failures, PATIENCE at most.
BACKOFF, PATIENCE = 2.0, 60.0
LOG = "shard string, seq long, event string, mode string, generation int, attempts int, wait double"
#: State in RocksDB, whose commits write what has changed only.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


@contextlib.contextmanager
def with_rocksdb(spark: SparkSession) -> Iterator[None]:
    """Streams started in here keep their state in RocksDB."""
    before = {k: spark.conf.get(k, None) for k in STATE_STORE}
    for k, v in STATE_STORE.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@dataclass
class Shard:
    """Where a shard's listing stands.  A new generation begins when the pages held so far no longer count."""

    mode: str = "recursive"
    cursor: bool = False
    attempts: int = 0
    generation: int = 0
    state: str = "open"

    def anew(self) -> None:
        self.cursor, self.attempts, self.generation = False, 0, self.generation + 1

    def take(self, status: int, body: str, retry_after: str | None, has_more: bool) -> tuple[str, float] | None:
        """(event, seconds to wait) of an answer; None if the shard is done already.  A failed shard starts over."""
        if self.state == "done":
            return None
        if self.state == "error":
            self.anew()
            self.state = "open"
        told = listing.classify_answer(status, body, retry_after)
        if told is None:
            self.attempts, self.cursor = 0, has_more
            self.state = "open" if has_more else "done"
            return "page" if has_more else "last page", 0.0
        if isinstance(told, listing.Reset):
            # the failures in a row go on being counted
            failed = self.attempts
            self.anew()
            self.attempts = failed
            return "cursor_reset", 0.0
        if isinstance(told, listing.Gone):
            self.state = "done"
            return "path_gone", 0.0
        if isinstance(told, listing.Retry) and status == 429:
            return "rate_limited", told.seconds
        if not isinstance(told, listing.Retry | listing.Refused):
            self.state = "error"
            return "failed", 0.0
        self.attempts += 1
        if isinstance(told, listing.Retry) and self.mode == "recursive" and self.attempts >= (ATTEMPTS if self.cursor else SPLIT_AT):
            self.anew()
            self.mode = "split"
            return "split_after_failure", 0.0
        if self.attempts >= ATTEMPTS:
            self.state = "error"
            return "failed", 0.0
        return ("auth_expired", 0.0) if isinstance(told, listing.Refused) else ("transient", min(BACKOFF**self.attempts, PATIENCE))


class ShardMachine(StatefulProcessor):
    """Follows each shard; with ``timers``, a shard that was to be tried again and has no answer by then is reported as due."""

    def __init__(self, timers: bool):
        self.timers = timers

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.shard = handle.getValueState("shard", "mode string, cursor boolean, attempts int, generation int, state string")
        self.held = handle.getListState("held", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # answers are told without their entries, so a batch's answers of a shard are small
        frame = pd.concat([*rows]).sort_values("seq")
        shard = Shard(*self.shard.get()) if self.shard.exists() else Shard()
        out, held, begun, due = [], [], shard.generation, None
        for r in frame.itertuples():
            found = shard.take(int(r.status), r.body or "", r.retry_after, bool(r.has_more))
            if found is None:
                continue
            event, wait = found
            if shard.generation != begun:
                held, begun = [], shard.generation
                self.held.clear()
            if event in ("page", "last page"):
                held.append((int(r.seq),))
            due = r.ts.timestamp() + wait if wait else None
            out.append((key[0], int(r.seq), event, shard.mode, shard.generation, shard.attempts, wait))
        self.shard.update(astuple(shard))
        if held:
            self.held.appendList(held)
        if self.timers and out:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if due is not None:
                self.handle.registerTimer(int(due * 1000))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in LOG.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        shard = Shard(*self.shard.get())
        held = [n for (n,) in self.held.get()]
        yield pd.DataFrame([(key[0], held[-1] if held else -1, "due", shard.mode, shard.generation, shard.attempts, 0.0)], columns=[c.split()[0] for c in LOG.split(", ")])

    def close(self) -> None:
        pass


def follow(answers: DataFrame, late: str | None = None) -> DataFrame:
    """(shard, seq, event, mode, generation, attempts, wait) for a stream of stored answers of a paged listing.

    answers: (shard, seq, status, body, retry_after, has_more, ts timestamp); body is only looked at where the status is no success, and
    may be null else.  seq orders a shard's answers.  Rate limits and failures are tried again; an invalid cursor restates the shard (a new generation);
    a full listing that fails twice in a row before its first page, or ATTEMPTS times after it, is split: listed anew, one level; ATTEMPTS failures in a row
    fail the shard, whose next answer starts it over.  What comes after the last page is ignored.  ``late``: watermark, which also turns on the
    reports of shards that are due for another try.
    """
    rows = answers.withWatermark("ts", late) if late else answers
    return rows.groupBy("shard").transformWithStateInPandas(ShardMachine(bool(late)), LOG, "append", "EventTime" if late else "None")


def standing_pages(log: DataFrame) -> DataFrame:
    """(shard, seq) of the pages that count: those of each shard's last generation.  ``log`` is what :func:`follow` wrote."""
    last = log.groupBy("shard").agg(F.max("generation").alias("generation"))
    return log.filter(F.col("event").isin("page", "last page")).join(last, ["shard", "generation"], "left_semi").select("shard", "seq")


class Siblings(StatefulProcessor):
    """Counts a parent's listed folders, and says when the guess about the rest turns."""

    def __init__(self, least: int, share: float):
        self.least, self.share = least, share

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "listed long, with_folders long")

    def leafy(self, listed: int, with_folders: int) -> bool:
        return listed >= self.least and with_folders <= self.share * listed

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        listed, with_folders = self.seen.get() if self.seen.exists() else (0, 0)
        out = []
        for seq, had in pd.concat([f[["seq", "had_folders"]] for f in rows]).sort_values("seq").itertuples(index=False):
            before = self.leafy(listed, with_folders)
            listed, with_folders = listed + 1, with_folders + int(had)
            after = self.leafy(listed, with_folders)
            if before != after:
                out.append((key[0], int(seq), "one_level_on" if after else "one_level_off", listed, with_folders))
        self.seen.update((listed, with_folders))
        yield pd.DataFrame(out, columns=["parent", "seq", "event", "listed", "with_folders"])

    def close(self) -> None:
        pass


def learn(listed: DataFrame, least: int = 20, share: float = 0.1) -> DataFrame:
    """(parent, seq, event, listed, with_folders): when folders of a parent begin, or cease, to be listed one level at a time.

    listed: a stream of finished listings (path, seq, had_folders, from_start).  One level is enough once ``least`` siblings are listed and
    at most ``share`` of them held folders.  A listing resumed from a cursor (from_start false) that saw no folder says nothing.
    """
    told = listed.filter("had_folders or from_start").select(paths.parent(F.col("path")).alias("parent"), "seq", "had_folders")
    return told.groupBy("parent").transformWithStateInPandas(Siblings(least, share), "parent string, seq long, event string, listed long, with_folders long", "append", "None")


class Fresh(StatefulProcessor):
    """Lets each entry of a shard through once; pages come in the order of their numbers."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else None
        seen: set[int] = set()
        for frame in rows:
            new = frame[~frame["seq"].isin(seen) & ~frame["seq"].duplicated()]
            if last is not None:
                new = new[new["seq"] > last]
            seen.update(new["seq"].tolist())
            yield new
        if seen:
            self.last.update((max(seen),))

    def close(self) -> None:
        pass


def fresh(entries: DataFrame, shard: str = "shard_id") -> DataFrame:
    """A stream of a listing's entries without those that came before, in this batch or an earlier one.

    A shard's pages come in order, so its state is the number of the last entry (``seq``); entries go through as Arrow hands them over, in no order.
    """
    return entries.groupBy(shard).transformWithStateInPandas(Fresh(), entries.schema, "append", "None")
