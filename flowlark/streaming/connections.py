"""Sessions and trailing counts of a stream of connections, equal to the batch operators' on rows that are not late.

Event time is the column ``ts``. The watermark is the latest ts seen, less ``delay``. A row that is older than the watermark with
which the batch before its own began is late and dropped; all that are within ``delay`` count, in whatever order and batch they come. Results are appended once the watermark has
passed all that could change them.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from flowlark import fixed


def sessions(stream: DataFrame, gap: str = "2 hours", delay: str = "1 hour", key: str = "src", value: str = "src_bytes") -> DataFrame:
    """key, first_ts, last_ts, n and bytes of runs of a key's rows with less than ``gap`` and a microsecond between neighbours,
    as flows.sessions() has them. Spark keeps a row of state for each open run and merges runs that a row joins."""
    rows = stream.withWatermark("ts", delay)
    runs = rows.groupBy(key, F.session_window("ts", F.lit(f"{gap} 1 microsecond"))).agg(
        F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"), F.round(F.sum(value), 3).alias("bytes")
    )
    return runs.select(key, "first_ts", "last_ts", "n", "bytes")


_COUNTED = "flow_id long, key string, n long, e long, r long"


def trailing_counts(stream: DataFrame, window_us: int, delay: str = "1 hour", key: str = "dst") -> DataFrame:
    """flow_id, key, n, e, r: how many of the key's connections started at most ``window_us`` before (of the same start those of
    lower flow_id), all, half-open and rejected, as history.with_counts() has them.

    A key's state holds the rows that the watermark has not passed, and the window before them. It is as large as a key's
    window, so a key that is hot within one window should be refined (say, dst and service) rather than streamed whole.
    """
    flag = F.lower("flag")
    rows = stream.withWatermark("ts", delay).select(
        F.coalesce(F.col(key).cast("string"), F.lit("\0")).alias("key"), "ts", "flow_id",
        F.coalesce(flag.isin(fixed.HALF_OPEN), F.lit(False)).cast("long").alias("e"), F.coalesce(flag.isin(fixed.REJECTED), F.lit(False)).cast("long").alias("r"),
    )

    def step(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []  # (start, flow_id, e, r, counted before), by start and flow_id
        for b in batches:
            held += [[int(t.value) // 1000, int(i), int(e), int(r), 0] for t, i, e, r in zip(b["ts"], b["flow_id"], b["e"], b["r"], strict=True)]
        held.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        starts = [h[0] for h in held]
        sums = [(0, 0)]
        for h in held:
            sums.append((sums[-1][0] + h[2], sums[-1][1] + h[3]))
        out = []
        for i, h in enumerate(held):
            if h[4] or h[0] >= passed:
                continue
            low = bisect.bisect_left(starts, h[0] - window_us)
            out.append((h[1], None if name[0] == "\0" else name[0], i - low, sums[i][0] - sums[low][0], sums[i][1] - sums[low][1]))
            h[4] = 1
        waiting = [h for h in held if not h[4]]
        # a row that may still come starts at the watermark or later
        reach = min([passed, *(h[0] for h in waiting)]) - window_us
        held = [h for h in held if h[0] >= reach]
        if held:
            state.update((json.dumps(held),))
            # wake once the first that waits is passed, or the last that is kept is out of every window
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs() + 1, (waiting[0][0] if waiting else held[-1][0] + window_us) // 1000 + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in _COUNTED.split(", ")])

    return rows.groupBy("key").applyInPandasWithState(step, _COUNTED, "held string", "append", GroupStateTimeout.EventTimeTimeout)
