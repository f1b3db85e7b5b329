"""Event-log queries that run alike over a table and over a stream: (ts timestamp, kind, ...)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str | None = None) -> DataFrame:
    """Events by kind in tumbling or sliding windows; ``late`` drops what comes later than that in a stream."""
    rows = events.withWatermark("ts", late) if late else events
    frame = F.window("ts", length, slide) if slide else F.window("ts", length)
    return rows.groupBy(frame.alias("w"), "kind").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "kind", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", key: str = "user_id", late: str | None = None) -> DataFrame:
    """Runs of a key's events with less than ``gap`` between them."""
    rows = events.withWatermark("ts", late) if late else events
    found = rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def last_hour(events: DataFrame, kind: str, now: float) -> DataFrame:
    """How many events of a kind the last hour saw; events(ts double in seconds, kind)."""
    return events.filter((F.col("kind") == kind) & (F.col("ts") > now - 3600)).agg(F.count("*").alias("n"))


def pace(events: DataFrame, seconds: int = 3600, key: str = "kind") -> DataFrame:
    """Adds the count of the key's events in the ``seconds`` up to each; events(ts_s long).

    Each event stands in its own stretch of ``seconds`` and in the next one, which together hold all that a count can reach; so a
    frequent key is counted stretch by stretch.
    """
    own = F.floor(F.col("ts_s") / F.lit(seconds))
    both = events.withColumn("_own", own).withColumn("_stretch", F.explode(F.array(F.col("_own"), F.col("_own") + 1)))
    frame = Window.partitionBy(key, "_stretch").orderBy("ts_s").rangeBetween(-seconds, 0)
    counted = both.withColumn("in_window", F.count("*").over(frame)).filter("_own = _stretch")
    return counted.select(*events.columns, "in_window")


def before(rows: DataFrame, key: str, order: list[str], at: str, values: list[str], width: int) -> DataFrame:
    """Adds ``_<value>`` of the row before, by key in ``order``; a key is sorted in stretches of ``width`` of ``at`` (its first order), not as a whole."""
    told = F.struct(*values)
    cut = rows.withColumn("_stretch", F.floor(F.col(at) / F.lit(width)))
    ends = cut.groupBy(key, "_stretch").agg(F.max_by(told, F.struct(*order)).alias("_end"))
    carried = ends.select(key, "_stretch", F.lag("_end").over(Window.partitionBy(key).orderBy("_stretch")).alias("_carried"))
    inside = F.lag(told).over(Window.partitionBy(key, "_stretch").orderBy(*order))
    both = cut.withColumn("_before", inside).join(carried, [key, "_stretch"]).withColumn("_before", F.coalesce("_before", "_carried"))
    return both.select(*rows.columns, *[F.col("_before")[v].alias("_" + v) for v in values])


def rates(ticks: DataFrame, key: str = "run", width: int = 86400) -> DataFrame:
    """Files per second between a run's ticks (ts_s, files); a long run is worked out in stretches of ``width`` seconds."""
    told = before(ticks, key, ["ts_s", "files"], "ts_s", ["ts_s", "files"], width)
    d_files, d_time = F.col("files") - F.col("_files"), F.col("ts_s") - F.col("_ts_s")
    return told.select(*ticks.columns, F.when(d_time > 0, d_files / d_time).alias("rate"))


def overloads_of(limited: DataFrame, width: float = 86400.0) -> DataFrame:
    """As :func:`overloads`, for a table: (source, overload, ts), a source being worked on in as many stretches as it has pauses.

    A row that comes after the end of every pause before it (a pause counting a second at least) surely begins an overload.  These ends are
    running maxima, which are found in stretches of ``width`` seconds; from one such row to the next a task follows the rows in their order,
    those of a stretch's beginnings together.
    """
    end = F.col("ts") + F.greatest("retry_after", F.lit(1.0))
    rows = limited.select("source", "ts", "retry_after", end.alias("_end"), F.floor(F.col("ts") / F.lit(width)).alias("_stretch"))
    tops = rows.groupBy("source", "_stretch").agg(F.max("_end").alias("_top"))
    earlier = Window.partitionBy("source").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select("source", "_stretch", F.max("_top").over(earlier).alias("_before"))
    order = Window.partitionBy("source", "_stretch").orderBy("ts", "retry_after")
    inside = F.max("_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    told = rows.withColumn("_inside", inside).join(tops, ["source", "_stretch"])
    reach = F.greatest("_inside", "_before")
    told = told.withColumn("_sure", reach.isNull() | (F.col("ts") >= reach))
    # the run of a row: that of the last sure beginning up to it, or at the same time, as equal rows may change places
    upto = Window.partitionBy("source", "_stretch").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    marks = told.withColumn("_mark", F.max(F.when(F.col("_sure"), F.col("ts"))).over(upto))
    last = told.filter("_sure").groupBy("source", "_stretch").agg(F.max("ts").alias("_last"))
    # stretches without one belong to the last of an earlier stretch
    last = tops.select("source", "_stretch").join(last, ["source", "_stretch"], "left").withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier)).select("source", "_stretch", "_carried")
    runs = marks.join(last, ["source", "_stretch"]).select("source", "ts", "retry_after", F.coalesce("_mark", "_carried").alias("_run"))
    # runs that begin in one stretch share a task: each begins with a row that surely begins an overload, so they are followed one after the other
    found = runs.groupBy("source", F.floor(F.col("_run") / F.lit(width)).alias("_begun")).applyInPandas(_overloads_of_runs, "source string, ts double")
    # numbered in stretches too
    found = found.withColumn("_stretch", F.floor(F.col("ts") / F.lit(width)))
    counts = found.groupBy("source", "_stretch").agg(F.count("*").alias("_n"))
    counts = counts.select("source", "_stretch", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_first"))
    nth = F.row_number().over(Window.partitionBy("source", "_stretch").orderBy("ts"))
    return found.withColumn("_nth", nth).join(counts, ["source", "_stretch"]).select("source", (F.col("_first") + F.col("_nth")).cast("long").alias("overload"), "ts")


def _begins(rows: pd.DataFrame, until: float) -> tuple[list[float], float]:
    """Times at which overloads begin, and when the last pause ends."""
    out = []
    for ts, retry in zip(rows["ts"], rows["retry_after"]):
        if ts >= until:
            out.append(ts)
            until = ts + max(retry, 1.0)
        else:
            until = max(until, ts + retry)
    return out, until


def _overloads_of_runs(rows: pd.DataFrame) -> pd.DataFrame:
    out, _ = _begins(rows.sort_values(["ts", "retry_after"]), float("-inf"))
    return pd.DataFrame({"source": rows["source"].iloc[0], "ts": out})


def _overloads(source: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One overload for each run of 429s that fall into the pause of the ones before, or within a second of its first."""
    until, n = state.get if state.exists else (float("-inf"), 0)
    begun, until = _begins(pd.concat([b[["ts", "retry_after"]] for b in batches]).sort_values(["ts", "retry_after"]), until)
    state.update((until, n + len(begun)))
    yield pd.DataFrame({"source": source[0], "overload": range(n + 1, n + 1 + len(begun)), "ts": begun})


def overloads(limited: DataFrame) -> DataFrame:
    """(source, overload, ts): rate-limit answers (source, ts double, retry_after double) grouped into overloads, for a stream, with a small state for each source.

    A source's answers of one batch are sorted as two doubles each; for a table see :func:`overloads_of`.
    """
    return limited.groupBy("source").applyInPandasWithState(_overloads, "source string, overload long, ts double", "until double, n long", "append", GroupStateTimeout.NoTimeout)


def progress(shards: DataFrame) -> DataFrame:
    """One row of counters over shards(state, n_files, n_dirs, bytes, pages)."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("n_files", "n_dirs", "bytes", "pages")]
    return shards.agg(F.count("*").alias("shards"), F.count_if(F.col("state") == "done").alias("done"), F.count_if(F.col("state") == "error").alias("failed"), *sums)
