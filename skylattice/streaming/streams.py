"""The binning operators over streams (beyond the batch programs): watermarks bound their state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def resampled(points: DataFrame, time: str, key: str, width: str, late: str, means: list[str]) -> DataFrame:
    """Means and counts of each key and time window; rows later than `late` do not count."""
    binned = points.withWatermark(time, late).groupBy(key, F.window(time, width).alias("w"))
    return binned.agg(F.count("*").alias("n"), *(F.avg(c).alias(c) for c in means)).select(key, F.col("w.start").alias("bin"), "n", *means)


def sessions(points: DataFrame, time: str, key: str, gap: str, late: str) -> DataFrame:
    """Tracks of each key, cut where it is silent for longer than gap."""
    found = points.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w"))
    return found.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("t_start"), F.col("w.end").alias("t_end"), "n")


def plausible(points: DataFrame, time: str, key: str, altitude: str, climb_m: float = 1000.0, silence_ms: int = 3_600_000) -> DataFrame:
    """(key, time, altitude) of points whose altitude is within climb_m of the raw point before them; the last point is the state."""

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        for rows in [pd.concat(list(batches)).sort_values(time)]:
            before = rows[altitude].shift(1)
            if last is not None:
                before.iloc[0] = last
            last = float(rows[altitude].iloc[-1])
            yield rows[~((rows[altitude] - before).abs() > climb_m)][[key, time, altitude]]
        state.update((last,))
        state.setTimeoutDuration(silence_ms)

    kind = {f.name: f.dataType.simpleString() for f in points.schema.fields}
    schema = f"{key} {kind[key]}, {time} {kind[time]}, {altitude} {kind[altitude]}"
    return points.groupBy(key).applyInPandasWithState(step, schema, "last double", "append", GroupStateTimeout.ProcessingTimeTimeout)
