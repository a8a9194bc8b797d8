"""One-to-one matching of two radars' volumes as they arrive: the batch match, released once the watermark settles it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skyshear.operators.match import STRETCH

_HELD = "first array<bigint>, second array<bigint>, settled bigint"


def claimed(first: np.ndarray, second: np.ndarray, asked: np.ndarray, tolerance: int) -> list[tuple[int, int, int]]:
    """``t1, t2, diff`` of each ``asked`` time of the second radar that is some first time's nearest within ``tolerance``; the earliest claims it.

    All arrays are sorted and without repeats.
    """
    if not len(first) or not len(second):
        return []
    after = np.searchsorted(second, first)
    before, after = second[np.maximum(after - 1, 0)], second[np.minimum(after, len(second) - 1)]
    best = np.where(np.abs(first - before) <= np.abs(after - first), before, after)
    diff = np.abs(first - best)
    good = (diff <= tolerance) & np.isin(best, asked)
    _, at = np.unique(best[good], return_index=True)  # first times ascend, so the first of equals is the earliest
    return [(int(a), int(b), int(d)) for a, b, d in zip(first[good][at], best[good][at], diff[good][at], strict=True)]


def claims(first: DataFrame, second: DataFrame, tolerance: int = 120, late: str = "10 minutes", pair: tuple[str, ...] = ()) -> DataFrame:
    """``match.match_times`` on streams: ``pair, t1, t2, diff`` (seconds), each row once and never withdrawn.

    Both streams have ``ts`` and the columns ``pair`` that name which two radars
    belong together. A time t2 is settled once the watermark is past t2 and twice
    the tolerance: no first time that could claim it, and no second time that
    could be nearer to one of these, may still come. A group is a pair's stretch of
    64 tolerances with the times within two tolerances around it, so a pair with
    most rows is many groups; it holds no time that can't matter any more, and goes
    when it holds none. Null times are left out, repeated ones count once, and
    rows behind the watermark are dropped. Times still unsettled when a stream ends
    stay in its state and come when it goes on.
    """
    width, schemas = STRETCH * max(1, tolerance), first.select(*pair).schema.fields
    rows = first.select(*pair, F.lit(1).alias("side"), "ts").unionByName(second.select(*pair, F.lit(2).alias("side"), "ts"))
    rows = rows.filter("ts IS NOT NULL").withWatermark("ts", late).withColumn("sec", F.unix_timestamp("ts"))
    reach = F.when(F.col("side") == 1, tolerance).otherwise(2 * tolerance)
    stretch = F.explode(F.sequence(F.floor((F.col("sec") - reach) / width), F.floor((F.col("sec") + reach) / width)))
    rows = rows.withColumn("stretch", stretch)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held1, held2, settled = state.get if state.exists else ([], [], -(2**62))
        parts1, parts2 = [np.asarray(held1, np.int64)], [np.asarray(held2, np.int64)]
        if not state.hasTimedOut:
            for b in batches:
                parts1.append(b.loc[b["side"] == 1, "sec"].to_numpy(np.int64))
                parts2.append(b.loc[b["side"] == 2, "sec"].to_numpy(np.int64))
        one, two = np.unique(np.concatenate(parts1)), np.unique(np.concatenate(parts2))
        mark = state.getCurrentWatermarkMs()
        due = (two + 2 * tolerance + 1) * 1000
        own = two // width == key[-1]
        out = claimed(one, two, two[own & (due < mark) & (due >= settled)], tolerance)
        waiting = two[own & (due >= mark)]
        low = min(int(waiting[0]) if len(waiting) else mark // 1000, mark // 1000)
        one, two = one[one >= low - tolerance], two[two >= low - 2 * tolerance]
        if len(one) or len(two):
            until = int(waiting[0]) if len(waiting) else int(max(a[-1] for a in (one, two) if len(a)))
            state.update(([int(t) for t in one], [int(t) for t in two], max(mark, settled)))
            state.setTimeoutTimestamp(max((until + 2 * tolerance + 1) * 1000, mark))
        else:
            state.remove()
        if out:
            found = pd.DataFrame(out, columns=["t1", "t2", "diff"])
            for n, f in enumerate(schemas):
                found.insert(n, f.name, [key[n]] * len(found))
            yield found

    names = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in schemas)
    return rows.groupBy(*pair, "stretch").applyInPandasWithState(step, f"{names}t1 bigint, t2 bigint, diff bigint", _HELD, "append", GroupStateTimeout.EventTimeTimeout)
