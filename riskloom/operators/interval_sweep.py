"""First-in-window joins by a sorted sweep: for each event of a group, the first event of every other party within a reach of time.

An event j is the first of its party in the window of event i exactly if i lies in one stretch of the group's time order: after the
party's event before j has left the window and once j has come in, until j itself leaves. So one sweep over the sorted events gives
these stretches, and what is written is what is asked, not all pairs of a window. Groups of many events are cut into ranges of
time with an overlap of the reach, so that one group runs in many tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.graph_algorithms import written

DAY = 86_400_000_000
#: Events of a group beyond which it is cut, and of a range of it.
RANGE_EVENTS = 20_000
#: Rows of day counts of large groups that are broadcast; beyond, they are joined by hash.
BROADCAST_DAYS = 200_000
#: Events that a sweep takes at a time (whole ranges), and rows of a result batch.
CHUNK_ROWS, BATCH_ROWS = 100_000, 200_000


def _ranges(events: DataFrame, reach_days: int, most: int) -> DataFrame | None:
    """(g, day, range, own): of each day of a group of over ``most`` events, the ranges that see it; own where it lies in the range.
    None if there is no such group."""
    large = events.groupBy("g").agg(F.sum("n_events").alias("n")).where(F.col("n") > most).select("g")
    days = written(events.join(large, "g", "left_semi").groupBy("g", "day").agg(F.sum("n_events").alias("n")), "busy-days")
    if days.isEmpty():
        return None
    order = Window.partitionBy("g").orderBy("day")
    cut = F.floor((F.sum("n").over(order) - F.col("n")) / most)
    near = order.rangeBetween(-reach_days, reach_days)
    days = days.withColumn("of", cut).withColumns({"low": F.min("of").over(near), "high": F.max("of").over(near)})
    return days.select("g", "day", F.explode(F.sequence("low", "high")).alias("range"), "of").select("g", "day", "range", (F.col("of") == F.col("range")).alias("own"))


def first_in_window(events: DataFrame, reach_days: int, most: int = RANGE_EVENTS) -> DataFrame:
    """(g, src, dst, t, met): for each event of ``events(g, p, t)`` (group, party, microseconds) and each party dst above its own, the
    time ``met`` of dst's first event from t - reach to t + reach, if it has one. Equal events give equal rows, as many as they are.
    Null groups, parties and times meet nothing."""
    rows = events.where("g is not null and p is not null and t is not null").groupBy("g", "p", "t").agg(F.count(F.lit(1)).alias("copies"))
    rows = rows.withColumns({"day": F.floor(F.col("t") / DAY), "n_events": F.lit(1)})
    ranges = _ranges(rows, reach_days, most)
    if ranges is None:
        rows = rows.select("g", "p", "t", "copies", F.lit(0).cast("long").alias("range"), F.lit(True).alias("own"))
    else:
        ranges = written(ranges, "ranges")
        small = ranges.limit(BROADCAST_DAYS + 1).count() <= BROADCAST_DAYS
        rows = rows.join(F.broadcast(ranges) if small else ranges, ["g", "day"], "left")
        rows = rows.select("g", "p", "t", "copies", F.coalesce("range", F.lit(0)).alias("range"), F.coalesce("own", F.lit(True)).alias("own"))
    dealt = rows.repartition("g", "range").sortWithinPartitions("g", "range", "t", "p")
    reach = reach_days * DAY
    found = dealt.mapInArrow(lambda batches: _sweep(batches, reach), "g string, src string, dst string, t long, met long, copies long")
    # Copies are rows again; most events have one.
    return found.select("g", "src", "dst", "t", "met", F.explode(F.when(F.col("copies") == 1, F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), "copies"))).alias("copy")).drop("copy")


def _sweep(batches: Iterable[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """Whole ranges, as they come sorted; what is held is the ranges of a chunk and the largest range."""
    held: list[pa.RecordBatch] = []
    n, enough = 0, CHUNK_ROWS
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n < enough:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = _starts(table)
        if starts[-1]:
            yield from _swept(table.slice(0, starts[-1]), starts[:-1], reach)
        rest = table.slice(starts[-1])
        held, n = rest.combine_chunks().to_batches(), rest.num_rows
        enough = max(CHUNK_ROWS, 2 * n)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from _swept(table, _starts(table), reach)


def _starts(table: pa.Table) -> np.ndarray:
    """Rows at which a range begins."""
    n = table.num_rows
    g, r = table.column("g").combine_chunks(), table.column("range").combine_chunks()
    new = pc.or_(pc.not_equal(g.slice(1), g.slice(0, n - 1)), pc.not_equal(r.slice(1), r.slice(0, n - 1)))
    return np.concatenate([[0], np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1])


def _swept(table: pa.Table, starts: np.ndarray, reach: int) -> Iterator[pa.RecordBatch]:
    n = table.num_rows
    of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    t, own = table.column("t").to_numpy(), table.column("own").to_numpy()
    party = table.column("p").combine_chunks().dictionary_encode()
    names = party.dictionary
    rank = np.empty(len(names), dtype=np.int64)
    rank[np.argsort(np.array([x.encode() for x in names.to_pylist()], dtype=object))] = np.arange(len(names))
    p = rank[party.indices.to_numpy()]

    # The window of event i is [low, high): counts of events before (range, t - reach) and up to (range, t + reach).
    def count(edge: np.ndarray, inclusive: bool) -> np.ndarray:
        both = np.lexsort((np.repeat([0, 1] if inclusive else [1, 0], n), np.concatenate([t, edge]), np.concatenate([of, of])))
        seen = np.cumsum(both < n)
        out = np.empty(n, dtype=np.int64)
        out[both[both >= n] - n] = seen[both >= n]
        return out

    low, high = count(t - reach, False), count(t + reach, True)
    by_party = np.lexsort((np.arange(n), p, of))
    before = np.full(n, -1, dtype=np.int64)
    same = (p[by_party[1:]] == p[by_party[:-1]]) & (of[by_party[1:]] == of[by_party[:-1]])
    before[by_party[1:][same]] = by_party[:-1][same]
    # Event j is its party's first in the windows of events [begin, end): low is over the one before and at most j, high is over j.
    place = np.arange(n)
    begin = np.maximum(np.searchsorted(low, before, "right"), np.searchsorted(high, place, "right"))
    begin = np.maximum(begin, starts[of])
    end = np.searchsorted(low, place, "right")
    size = np.maximum(end - begin, 0)
    sums = np.concatenate([[0], np.cumsum(size)])
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(sums, sums[at] + BATCH_ROWS, "right")) - 1)
        js = np.repeat(np.arange(at, stop), size[at:stop])
        i = np.arange(len(js)) - np.repeat(sums[at:stop] - sums[at], size[at:stop]) + np.repeat(begin[at:stop], size[at:stop])
        good = own[i] & (p[i] < p[js]) & (of[i] == of[js])
        i, js = pa.array(i[good]), pa.array(js[good])
        at = stop
        if len(i):
            take = lambda c, k: table.column(c).take(k).combine_chunks()
            yield pa.RecordBatch.from_arrays([take("g", i), take("p", i), take("p", js), take("t", i), take("t", js), take("copies", i)], names=["g", "src", "dst", "t", "met", "copies"])
