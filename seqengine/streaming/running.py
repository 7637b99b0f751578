"""Structured Streaming forms of the batch operators, over an events-like stream."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_mean(events: DataFrame, ts: str, value: str, key: str, window: str, late: str) -> DataFrame:
    """Count and mean of each key and tumbling window, closed when the watermark passes it."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))


def running_best(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Rows with `is_best`, by key against all earlier batches; the state is the smallest value so far."""
    kind = {f.name: f.dataType.simpleString() for f in events.schema}

    def update(keys: tuple, rows: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else None
        found = pd.concat(list(rows)).sort_values(order, kind="stable")
        flags = []
        for v in found[value]:
            flags.append(best is None or v < best)
            best = v if best is None else min(best, v)
        state.update((float(best),))
        yield found[[key, order, value]].assign(is_best=flags)

    schema = f"{key} {kind[key]}, {order} {kind[order]}, {value} {kind[value]}, is_best boolean"
    return events.select(key, order, value).groupBy(key).applyInPandasWithState(update, schema, "best double", "append", "NoTimeout")


def collapse(frames: DataFrame, key: str, order: str, token: str) -> DataFrame:
    """The frames whose token differs from the one before, by key across batches; the state is the last token."""
    kind = {f.name: f.dataType.simpleString() for f in frames.schema}

    def update(keys: tuple, rows: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        found = pd.concat(list(rows)).sort_values(order, kind="stable")
        tokens = found[token].astype(str)
        before = tokens.shift(1)
        before.iloc[0] = last
        state.update((tokens.iloc[-1],))
        yield found[[key, order, token]][(tokens != before).to_numpy()]

    schema = f"{key} {kind[key]}, {order} {kind[order]}, {token} {kind[token]}"
    return frames.select(key, order, token).groupBy(key).applyInPandasWithState(update, schema, "last string", "append", "NoTimeout")


def each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands each batch to `write` and resumes from its checkpoint folder."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def every(rows: DataFrame, step: str, frequency: int) -> DataFrame:
    """The rows logged: every `frequency`-th step."""
    return rows.where(F.pmod(F.col(step), F.lit(frequency)) == 0)
