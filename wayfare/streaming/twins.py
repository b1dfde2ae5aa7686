"""Streaming twins of batch operators: slot counts with watermarks, and chains as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def od_stream(trips: DataFrame, minutes: int = 15, late: str = "1 hour") -> DataFrame:
    """Trips by slot, origin and destination from a stream of trips (``departure_time`` timestamp); append mode.

    A slot is final once the watermark has passed its end.
    """
    return (
        trips.withWatermark("departure_time", late)
        .groupBy(F.window("departure_time", f"{minutes} minutes").alias("slot"), "origin_cluster_id", "destination_cluster_id")
        .agg(F.count("*").alias("total_count"))
        .select(F.col("slot.start").alias("slot_start"), "origin_cluster_id", "destination_cluster_id", "total_count")
    )


CHAIN_SCHEMA = "driver_id long, date_ string, chain_seq long, chain_start timestamp, chain_end timestamp, num_segments long"
_STATE = "date_ string, chain_seq long, chain_start timestamp, chain_end timestamp, num_segments long"


def chain_stream(segments: DataFrame, max_gap_min: float = 60.0, late: str = "1 hour") -> DataFrame:
    """Chains of trip segments (driver_id, trip_start, trip_end as timestamps) from a stream; append mode.

    A driver's open chain is its state. A chain is given out when a segment breaks it, or when the watermark has
    passed its end by more than the gap; its date and number stay (with no segments) until the watermark has passed
    the day, so that the day's next chain has the next number. Segments of a driver are expected in order within a
    trigger's data.
    """
    names = ["driver_id", "date_", "chain_seq", "chain_start", "chain_end", "num_segments"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        driver = key[0]
        if state.hasTimedOut:
            date, seq, start, end, n = state.get
            if not n:
                state.remove()
                return
            state.update((date, seq, start, end, 0))
            state.setTimeoutTimestamp(max(int((pd.Timestamp(date, tz="UTC") + pd.Timedelta(days=1)).timestamp() * 1000), state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame([(driver, date, seq, start, end, n)], columns=names)
            return
        held = state.get if state.exists else None
        done = []
        rows = pd.concat(list(frames)).sort_values(["trip_start", "trip_end"])
        for begin, end in zip(rows["trip_start"], rows["trip_end"], strict=True):
            day = begin.strftime("%Y-%m-%d")
            if held and held[4] and held[0] == day and (begin - held[3]).total_seconds() <= 60 * max_gap_min:
                held = (day, held[1], held[2], end, held[4] + 1)
                continue
            if held and held[4]:
                done.append((driver, *held))
            held = (day, held[1] + 1 if held and held[0] == day else 1, begin, end, 1)
        state.update(held)
        close = int(held[3].timestamp() * 1000 + 60_000 * max_gap_min) + 1
        state.setTimeoutTimestamp(max(close, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(done, columns=names)

    keyed = segments.select("driver_id", "trip_start", "trip_end").withWatermark("trip_start", late).groupBy("driver_id")
    return keyed.applyInPandasWithState(step, CHAIN_SCHEMA, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
