"""Structured Streaming forms of the time operators.

Sessions by pause use session_window, whose state a watermark bounds, and share their code with batch.
Greedy spacing keeps one time per key in state, until the watermark has passed it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def pause_sessions(events: DataFrame, key: str, t: str, gap: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """key, start, end (of the last event plus the gap), n; batch or stream.  A stream drops events later than `late`."""
    rows = events.withColumn("t_", F.col(t).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("t_", late)
    grouped = rows.groupBy(key, F.session_window("t_", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def spaced(events: DataFrame, key: str, t: str, least: int, late: str = "1 hour") -> DataFrame:
    """Of a stream (key, t in ms as long) the events at least `least` after the last one kept, in order of arrival; events within a batch go by time.

    Events later than `late` are dropped.  Once the watermark has passed the last kept event by `least`, it can't
    hold back any event to come, and the key's state goes.
    """
    kind = dict(events.dtypes)[key]
    rows = events.select(key, t, F.timestamp_millis(t).alias("at_")).withWatermark("at_", late)

    def step(k: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = []
        if state.hasTimedOut:
            state.remove()
        else:
            last = state.get[0] if state.exists else None
            for at in sorted(x for pdf in batches for x in pdf[t]):
                if last is None or at - last >= least:
                    kept.append(at)
                    last = at
            if last is not None:
                state.update((int(last),))
                state.setTimeoutTimestamp(max(int(last) + least, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(kept), t: kept})

    out = f"{key} {kind}, {t} long"
    return rows.groupBy(key).applyInPandasWithState(step, out, "last long", "append", GroupStateTimeout.EventTimeTimeout)
