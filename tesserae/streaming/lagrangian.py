"""Keyed state over a stream: positions that are advected by each arriving displacement, and a flow map that is emitted every so many steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

OUTPUT = "key long, steps long, start double, position double"
STATE = "steps long, start double, position double"


def advance(write_every: int):
    if write_every < 1:
        raise ValueError("write_every must be at least 1")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, start, position = state.get if state.exists else (0, 0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values("event_id", kind="stable")
        out = []
        for value in rows["value"]:
            position += float(value)
            steps += 1
            if steps % write_every == 0:
                out.append((key[0], steps, start, position))
                start = position
        state.update((steps, start, position))
        yield pd.DataFrame(out, columns=["key", "steps", "start", "position"])

    return step


def flow_map(stream: DataFrame, key: str = "user_id", write_every: int = 10) -> DataFrame:
    """A row (key, steps, start, position) whenever a key has taken write_every more steps. Rows of a trigger are taken in order of event_id."""
    return stream.groupBy(key).applyInPandasWithState(advance(write_every), OUTPUT, STATE, "append", "NoTimeout")
