"""Fixed-window request limiter (F01), in batch and as a stream.  An extension: the stream form has no counterpart.

A window starts at the first event of a key that no window holds, not at a boundary of the clock, so `window()` does not express
it.  In batch, every event points at the first one outside a window that would begin with it.  The windows of a key are what these
pointers meet from its first event on, found by doubling them (pointer jumping) in as many rounds as the logarithm of the most windows.
Time is cut into stretches as long as a window, of which each holds one window's beginning at most; so all joins and orderings are within a stretch
of a key, and a key with most of all events is spread over as many tasks as it has stretches.  The stream form holds a count and an end for each key, and lets them go when
the window has passed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources.kept import kept

#: Requests in a window, and its seconds, by action; those of any other action; actions that are not limited.
LIMITS = {
    "pagespeed": (20, 60), "keyword-intelligence": (20, 60), "site-audit": (40, 60), "visibility": (20, 60), "traffic-estimate": (20, 60), "ai-roadmap": (20, 60),
    "ai-summary": (20, 60), "schema-intelligence": (20, 60), "backlink-intelligence": (20, 60), "contact": (5, 600),
}
OTHER = (60, 60)
EXEMPT = ["health", "google-callback", "google-auth"]
_SCHEMA = "client string, action string, ts timestamp, allowed boolean, remaining int"


def _limit(action: str) -> tuple[int, int]:
    return LIMITS.get(action, OTHER)


def _judge(micros: list[int], action: str, count: int, ends: int) -> tuple[list[tuple[bool, int]], int, int]:
    """Whether each of the times passes and how many more would, and the window's state after them."""
    most, seconds = _limit(action)
    out = []
    for now in micros:
        if now >= ends:
            count, ends = 0, now + seconds * 1_000_000
        count += 1
        out.append((count <= most, max(0, most - count)))
    return out, count, ends


_NEVER = -(1 << 62)


def _by_action(k: int) -> Column:
    out = F.lit(OTHER[k])
    for action, limits in LIMITS.items():
        out = F.when(F.col("action") == action, limits[k]).otherwise(out)
    return out


def _joined(a: DataFrame, b: DataFrame, third: str, how: str = "inner") -> DataFrame:
    """a with the columns of b, by client, action and a third column; a null is equal to a null."""
    on = ["client", "action", third]
    b = b.withColumnsRenamed({c: f"_{c}" for c in on})
    return a.join(b, reduce(lambda x, c: x & F.col(c).eqNullSafe(F.col(f"_{c}")), on, F.lit(True)), how).drop(*[f"_{c}" for c in on])


def _pointers(times: DataFrame) -> DataFrame:
    """times (client, action, at, size, stretch, each once) with `after`: the first time that is `size` or more later; null if none is.

    It lies in the next stretch, or else is the first of the next one that has any."""
    key = ["client", "action", "size"]
    asked = times.select(*key, F.col("at").alias("by"), (F.col("at") + F.col("size")).alias("at"), (F.col("stretch") + 1).alias("stretch"), F.lit(None).cast("long").alias("is"))
    both = times.select(*key, F.lit(None).cast("long").alias("by"), "at", "stretch", F.col("at").alias("is")).unionByName(asked)
    from_here = Window.partitionBy("client", "action", "stretch").orderBy(F.desc("at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("near", F.min("is").over(from_here)).where("by is not null").select("client", "action", F.col("by").alias("at"), "stretch", "near")
    # of each stretch that is asked or has events, the first time in a later one: as many rows as stretches
    firsts = times.groupBy("client", "action", "stretch").agg(F.min("at").alias("first"))
    stretches = firsts.union(times.select("client", "action", F.col("stretch") + 1, F.lit(None).cast("long")).distinct())
    stretches = stretches.groupBy("client", "action", "stretch").agg(F.min("first").alias("first"))
    later = Window.partitionBy("client", "action").orderBy(F.desc("stretch")).rowsBetween(Window.unboundedPreceding, -1)
    later = stretches.select("client", "action", "stretch", F.min("first").over(later).alias("later"))
    return _joined(near, later, "stretch", "left").select("client", "action", "at", F.coalesce("near", "later").alias("after"))


def _beginnings(times: DataFrame) -> DataFrame:
    """(client, action, at): where windows begin."""
    found = kept(times.groupBy("client", "action").agg(F.min("at").alias("at")))
    jumps = kept(_pointers(times).where("after is not null"))
    while True:
        new = kept(_joined(found, jumps, "at").select("client", "action", F.col("after").alias("at")))
        if not new.limit(1).count():
            return found
        found = found.union(new)
        twice = jumps.select("client", "action", F.col("at").alias("from"), F.col("after").alias("at"))
        jumps = kept(_joined(twice, jumps, "at").select("client", "action", F.col("from").alias("at"), "after"))


def limit(events: DataFrame) -> DataFrame:
    """events (client, action, ts) with allowed and remaining; exempt actions always pass and have no remaining.  Events
    without a time are left out.  Of events of the same time, it does not matter which comes first: rows are alike but for that.
    A null client or action is a value like others."""
    rows = events.select("client", "action", F.col("ts").cast("timestamp").alias("ts")).where("ts is not null")
    exempt = F.coalesce(F.col("action").isin(EXEMPT), F.lit(False))
    free = rows.where(exempt).select("*", F.lit(True).alias("allowed"), F.lit(None).cast("int").alias("remaining"))
    timed = rows.where(~exempt).select("client", "action", "ts", F.unix_micros("ts").alias("at"), (_by_action(1) * 1_000_000).cast("long").alias("size"))
    timed = timed.withColumn("stretch", F.floor(F.col("at") / F.col("size")))
    begun = _beginnings(timed.select("client", "action", "at", "size", "stretch").distinct())
    begun = begun.withColumn("size", (_by_action(1) * 1_000_000).cast("long"))
    # a window holds events of the stretch in which it begins, and of the next
    begun = begun.select("client", "action", F.col("at").alias("begin"), F.explode(F.array(F.floor(F.col("at") / F.col("size")), F.floor(F.col("at") / F.col("size")) + 1)).alias("stretch"))
    held = begun.groupBy("client", "action", "stretch").agg(F.min("begin").alias("first"), F.max("begin").alias("last"))
    told = _joined(timed, held, "stretch").select("client", "action", "ts", "at", F.when(F.col("last") <= F.col("at"), F.col("last")).otherwise(F.col("first")).alias("begin"))
    place = F.row_number().over(Window.partitionBy("client", "action", "begin").orderBy("at"))
    counted = told.withColumn("place", place).withColumn("left", _by_action(0) - F.col("place"))
    return counted.select("client", "action", "ts", (F.col("left") >= 0).alias("allowed"), F.greatest(F.col("left"), F.lit(0)).cast("int").alias("remaining")).union(free)


def limit_stream(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The same over a stream; events of a micro-batch are taken in order of time, later batches after earlier ones.  A key's
    state goes when the watermark, `late` behind the newest event, has passed its window.  Events behind the watermark are not
    judged and not returned: Spark drops them, and counts them in the query's progress (`numRowsDroppedByWatermark`)."""
    state = T.StructType([T.StructField("count", T.IntegerType()), T.StructField("ends", T.LongType())])

    def fold(key, groups: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        if held.hasTimedOut:
            held.remove()
            return
        rows = pd.concat(list(groups)).sort_values("ts", kind="stable")
        count, ends = held.get if held.exists else (0, _NEVER)
        judged, count, ends = _judge([t.value // 1000 for t in rows["ts"]], key[1], count, ends)
        held.update((count, ends))
        held.setTimeoutTimestamp(max(ends // 1000, held.getCurrentWatermarkMs() + 1))
        yield rows[["client", "action", "ts"]].assign(allowed=[a for a, _ in judged], remaining=pd.array([r for _, r in judged], dtype="Int32"))

    counted = events.where(~F.col("action").isin(EXEMPT)).select("client", "action", "ts").withWatermark("ts", late)
    return counted.groupBy("client", "action").applyInPandasWithState(fold, _SCHEMA, state, "append", "EventTimeTimeout")
