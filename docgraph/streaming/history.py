"""Histories over streams: the open keyframe of each entity is the state, closed ones are the output."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "entity bigint, lo int, hi int, value string, late boolean"
STATE = "lo int, hi int, value string"


def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Extends or closes the open keyframe; versions must grow, older ones come out as late rows."""
    rows = pd.concat(list(batches)).sort_values("ver", kind="stable")
    lo, hi, value = state.get if state.exists else (None, None, None)
    out = []
    for ver, new in zip(rows["ver"].tolist(), rows["value"].tolist()):
        new = None if pd.isna(new) else new
        if hi is not None and ver <= hi:
            out.append((key[0], ver, ver, new, True))
        elif hi is not None and ver == hi + 1 and new == value:
            hi = ver
        else:
            if hi is not None:
                out.append((key[0], lo, hi, value, False))
            lo, hi, value = ver, ver, new
    state.update((lo, hi, value))
    yield pd.DataFrame(out, columns=["entity", "lo", "hi", "value", "late"])


def stream_push_history(observations: DataFrame) -> DataFrame:
    """Closed keyframes of a stream of (entity, ver, value); a later version of the entity closes the last."""
    return observations.groupBy("entity").applyInPandasWithState(fold, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
