"""State by key across a stream: open and settled cases with a time limit."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "user_id long, opened long, settled long, state string"
_STATE = "opened long, settles array<long>, done boolean"
_DAY = 86_400_000_000


def cases(events: DataFrame, opens: str, settles: str, late: str = "1 day", stale_days: int = 21) -> DataFrame:
    """(user_id, opened, settled, state): each user's first case.

    A case opens at the user's first ``opens`` event.  It is settled by the first
    ``settles`` event after that within ``stale_days``, else it becomes stale.
    A case is decided when the watermark passes the moment that decides it, so
    the result does not depend on the order in which rows arrive, as long as
    none is more than ``late`` behind.  A key holds its opening time and the
    settling times that the watermark has not passed.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, waiting, done = state.get if state.exists else (None, [], False)
        if done:
            return
        mark = state.getCurrentWatermarkMs() * 1000
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            first = rows.loc[rows.event_type == opens, "at"].min()
            if not pd.isna(first):
                opened = int(first) if opened is None else min(opened, int(first))
            waiting = sorted({*waiting, *rows.loc[rows.event_type == settles, "at"].tolist()})
        # an opening that is still to come lies after the watermark, and so do the times that can settle it
        waiting = [t for t in waiting if t > (mark if opened is None else min(mark, opened))]
        if opened is None:
            if waiting:
                state.update((None, waiting, False))
                state.setTimeoutTimestamp(-(-waiting[-1] // 1000) + 1)
            elif state.exists:
                state.remove()
            return
        limit = opened + stale_days * _DAY
        settled = next((t for t in waiting if opened < t <= limit), None)
        decides = limit if settled is None else settled
        if decides < mark:
            state.update((opened, [], True))
            yield pd.DataFrame({"user_id": [key[0]], "opened": [opened], "settled": pd.array([settled], "Int64"), "state": ["stale" if settled is None else "settled"]})
        else:
            state.update((opened, waiting, False))
            state.setTimeoutTimestamp(max(-(-decides // 1000), mark // 1000) + 1)

    timed = events.withWatermark("ts", late).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    found = timed.groupBy("user_id").applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.EventTimeTimeout)
    return found.withColumns({c: F.timestamp_micros(c) for c in ("opened", "settled")})
