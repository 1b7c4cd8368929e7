"""Prequential jobs on streams: predict, then learn, one event at a time for each key, in order and without gaps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key long, seq long, y int, pred int, losses long, failed boolean"
STATE = "next long, ones long, losses long, failed boolean"


def online_majority(events: DataFrame) -> DataFrame:
    """Majority-of-the-past predictions over a stream of (key, seq, y), with the losses so far.

    State is four numbers a key. An event whose seq isn't the next one makes its key fail for good; a failed key's events
    have no prediction and cost 1 each.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        following, ones, losses, failed = state.get if state.exists else (0, 0, 0, False)
        rows = []
        for frame in frames:
            for seq, y in zip(frame["seq"], frame["y"], strict=True):
                rows.append((int(seq), int(y)))
        out = []
        for seq, y in sorted(rows):
            failed = failed or seq != following
            pred = None if failed else int(2 * ones > following)
            losses += 1 if failed else int(pred != y)
            following, ones = following + 1, ones + y
            out.append((key[0], seq, y, pred, losses, failed))
        state.update((following, ones, losses, failed))
        frame = pd.DataFrame(out, columns=["key", "seq", "y", "pred", "losses", "failed"])
        yield frame.astype({"pred": "Int32"})

    return events.groupBy("key").applyInPandasWithState(step, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def online_confusion(scored: DataFrame, time: str, window: str, late: str) -> DataFrame:
    """Confusion counts of (y, pred) in tumbling windows of event time; rows later than the watermark are dropped."""
    count = lambda t, p: F.count_if((F.col("y") == t) & (F.col("pred") == p))
    grouped = scored.withWatermark(time, late).groupBy(F.window(time, window).alias("window"))
    return grouped.agg(count(1, 1).alias("tp"), count(1, 0).alias("fn"), count(0, 1).alias("fp"), count(0, 0).alias("tn"))


def sessions(events: DataFrame, key: str, time: str, gap: str, late: str) -> DataFrame:
    """Events of each key grouped by gaps of inactivity."""
    return events.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("session")).agg(F.count("*").alias("events"))
