"""State over a stream of inputs: reduce and foreach for Structured Streaming, by key, with state in Spark's state store."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def reduce(events: DataFrame, by: list[str], **states) -> DataFrame:
    """Aggregates so far of each key: write with outputMode("update") or "complete"."""
    return events.groupBy(*by).agg(*[x.alias(name) for name, x in states.items()])


def reduce_windows(events: DataFrame, by: list[str], time: str, width: str, late: str, **states) -> DataFrame:
    """Aggregates by key and time window; rows later than `late` are left out, and a window is written when it can't change."""
    return events.withWatermark(time, late).groupBy(F.window(time, width), *by).agg(*[x.alias(name) for name, x in states.items()])


def foreach(events: DataFrame, by: str, order: str, value: str, start: float, step: Callable[[float, float], float], name: str = "state") -> DataFrame:
    """(by, order, value, state): the state after each row of a key. Rows of a micro-batch are taken in order; rows of an
    earlier order in a later batch come after."""
    kinds = dict(events.dtypes)
    out = f"{by} {kinds[by]}, {order} {kinds[order]}, {value} {kinds[value]}, {name} double"

    def run(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else start
        rows = pd.concat(list(frames)).sort_values(order, kind="stable")
        states = []
        for v in rows[value]:
            now = step(now, v)
            states.append(now)
        state.update((now,))
        yield pd.DataFrame({by: rows[by], order: rows[order], value: rows[value], name: states})

    return events.select(by, order, value).groupBy(by).applyInPandasWithState(run, out, "state double", "append", GroupStateTimeout.NoTimeout)


def inputs(spark, folder: str, schema: str) -> DataFrame:
    """JSON lines files as they come."""
    return spark.readStream.schema(schema).json(folder)
