"""Drafts: writes applied one at a time by key, and answers computed ahead that a write makes stale.

Events of a draft are ``write`` (a new value, which makes a new version), ``ahead`` (an answer was computed ahead, for the
version of that moment) and ``ask``: the answer is used if no write came since and its time isn't over. ``replayed`` tells
this for a whole table by windows; ``drafts`` is the same as a stream, whose state is a draft's version, value and answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds for which an answer computed ahead may be used.
TTL_S = 6 * 3600
OUT = "draft long, seq long, version long, held double, outcome string"


def replayed(events: DataFrame) -> DataFrame:
    """events: draft, seq, ts, kind, value. draft, seq, version, held (the value after the event) and outcome of each event,
    in the order of ts and seq."""
    w = Window.partitionBy("draft").orderBy("ts", "seq").rowsBetween(Window.unboundedPreceding, 0)
    writes = F.count(F.when(F.col("kind") == "write", True)).over(w)
    v = events.withColumns({"version": writes, "held": F.last(F.when(F.col("kind") == "write", F.col("value")), ignorenulls=True).over(w)})
    ahead = F.last(F.when(F.col("kind") == "ahead", F.struct("version", "ts")), ignorenulls=True).over(w)
    late = F.col("ts") > F.col("ahead.ts") + F.make_interval(secs=F.lit(TTL_S))
    asked = F.when(F.col("ahead").isNull(), "fresh").when(F.col("ahead.version") != F.col("version"), "stale").when(late, "expired").otherwise("used")
    return v.withColumn("ahead", ahead).select("draft", "seq", "version", "held", F.when(F.col("kind") != "ask", F.col("kind")).otherwise(asked).alias("outcome"))


class Drafts(StatefulProcessor):
    """Events wait until the watermark has passed them, so that late ones take their place; then they are applied in order."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "seq long, ms long, kind string, value double")
        self.now = handle.getValueState("now", "version long, held double, ahead long, ahead_ms long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            ms = pdf["ts"].astype("datetime64[ms]").astype("int64")
            for seq, at, kind, value in zip(pdf["seq"], ms, pdf["kind"], pdf["value"], strict=True):
                self.waiting.appendValue((int(seq), int(at), kind, None if pd.isna(value) else float(value)))
                self.handle.registerTimer(int(at))
        yield pd.DataFrame(columns=["draft", "seq", "version", "held", "outcome"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        waiting = sorted((w[1], w[0], w[2], w[3]) for w in self.waiting.get())
        due, rest = [w for w in waiting if w[0] <= upto], [w for w in waiting if w[0] > upto]
        if not due:  # another timer of the same batch was first
            return
        version, held, ahead, ahead_ms = self.now.get() if self.now.exists() else (0, None, None, None)
        out = []
        for ms, seq, kind, value in due:
            outcome = kind
            if kind == "write":
                version, held = version + 1, value
            elif kind == "ahead":
                ahead, ahead_ms = version, ms
            else:
                outcome = "fresh" if ahead is None else "stale" if ahead != version else "expired" if ms > ahead_ms + 1000 * TTL_S else "used"
            out.append((key[0], seq, version, held, outcome))
        self.now.update((version, held, ahead, ahead_ms))
        self.waiting.put([(seq, ms, kind, value) for ms, seq, kind, value in rest]) if rest else self.waiting.clear()
        yield pd.DataFrame(out, columns=["draft", "seq", "version", "held", "outcome"])

    def close(self) -> None:
        pass


def drafts(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """The same rows from a stream of events; needs the RocksDB state store. Events later than ``lateness`` are dropped."""
    timed = events.withWatermark("ts", lateness).groupBy("draft")
    return timed.transformWithStateInPandas(statefulProcessor=Drafts(), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
