"""Count-or-timeout micro-batches and windowed counters over streams."""

from __future__ import annotations

import time
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomvec.operators.batching import Window

_AT = "__at"


def stream_windows(events: DataFrame, key: str, seq: str, at: str, timeout_us: int, max_batch: int, late: str = "0 seconds") -> DataFrame:
    """The events of each window, at the moment it closes: key, seq, window, place, closed_by.

    ``at`` is microseconds. A window that the first arrival opens closes by ``count`` at
    ``max_batch`` arrivals, by ``arrival`` when one comes past ``timeout_us``, or by ``time``
    when the watermark (the latest time of all keys less ``late``) has passed its end and
    nothing more can join it. A trigger's events of a key are ordered by time and seq before
    they are dealt, so windows are those of the batch operator if events of a key arrive in
    order of time from trigger to trigger; events at or behind the watermark are dropped.

    State: the open window's number, start and seqs, at most ``max_batch`` of them.
    """
    kind = events.schema[seq].dataType.simpleString()

    def run(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        window = Window(timeout_us, max_batch)
        held: list = []
        if state.exists:
            window.number, start, held = state.get[0], state.get[1], list(state.get[2])
            window.start, window.count = (start if held else None), len(held)  # a closed window takes no more
        rows: list[tuple] = []

        def close(number: int, why: str) -> None:
            rows.extend((name[0], s, number, k, why) for k, s in enumerate(held, 1))
            held.clear()

        if state.hasTimedOut:
            close(window.number, "time")
        else:
            given = [b for b in batches if len(b)]
            arrived = pd.concat(given).sort_values([at, seq], kind="stable") if given else pd.DataFrame({at: [], seq: []})
            for t, s in zip(arrived[at].tolist(), arrived[seq].tolist(), strict=True):
                before = window.number
                number, _ = window.add(int(t))
                if held and number != before:
                    close(before, "arrival")
                held.append(s)
                if len(held) == window.most:
                    close(number, "count")
        if held:
            state.update((window.number, window.start, held))
            state.setTimeoutTimestamp(max((window.start + timeout_us) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        else:  # the number of the last window stays, no window is open
            state.update((window.number, window.start, []))
        yield pd.DataFrame(rows, columns=[key, seq, "window", "place", "closed_by"])

    timed = events.select(key, seq, at, F.timestamp_micros(at).alias(_AT)).withWatermark(_AT, late)
    out = f"`{key}` {events.schema[key].dataType.simpleString()}, `{seq}` {kind}, window long, place long, closed_by string"
    return timed.groupBy(key).applyInPandasWithState(run, out, f"number long, start long, held array<{kind}>", "append", GroupStateTimeout.EventTimeTimeout)


def drain(query: StreamingQuery, seconds: float = 30.0) -> bool:
    """Stop a stream when it has nothing left to do, at the latest after ``seconds``; whether all that was there is done."""
    end, done = time.monotonic() + seconds, False
    while query.isActive and not done and time.monotonic() < end:
        now = query.status
        done = not (now["isDataAvailable"] or now["isTriggerActive"]) and query.lastProgress is not None
        time.sleep(0 if done else 0.1)
    query.stop()
    return done


def windowed_counters(events: DataFrame, at: str, model: str, latency: str, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Requests and average latency of each model and event-time window, with a watermark for late events."""
    timed = events.withColumn("__at", F.col(at).cast("timestamp")).withWatermark("__at", late)
    out = timed.groupBy(F.window("__at", every), F.col(model).alias("model")).agg(F.count("*").alias("requests"), F.avg(latency).alias("avg_latency"))
    return out.select(F.col("window.start").alias("start"), "model", "requests", "avg_latency")
