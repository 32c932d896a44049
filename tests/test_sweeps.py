"""Interval sweep and similarity join against brute force, with hot groups."""

import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.operators import interval_sweep as sw
from riskloom.operators import similarity as sim

DAY = sw.DAY


def brute_first(events, reach):
    out = []
    for g, p, t in events:
        if None in (g, p, t):
            continue
        for q in {x[1] for x in events if x[0] == g and x[1] is not None and x[1] > p}:
            near = [u for h, x, u in events if h == g and x == q and u is not None and abs(u - t) <= reach]
            if near:
                out.append((g, p, q, t, min(near)))
    return Counter(out)


@pytest.mark.parametrize("most,days", [(20_000, 3), (6, 3), (6, 0), (1, 2), (3, 400)])
def test_first_in_window(spark, monkeypatch, most, days):
    rng = random.Random(most + days)
    events = [(rng.choice(["b1", "b2", "b3", None]), rng.choice(["p1", "p2", "é", "p10", None]), rng.choice([None, rng.randrange(-40 * DAY, 40 * DAY), rng.randrange(-9, 9) * DAY])) for _ in range(260)]
    events += events[:20] + [("b9", f"p{k}", 5) for k in range(3)]
    monkeypatch.setattr(sw, "CHUNK_ROWS", 40)
    monkeypatch.setattr(sw, "BATCH_ROWS", 50)
    df = spark.createDataFrame(events, "g string, p string, t long").repartition(3)
    got = Counter(map(tuple, sw.first_in_window(df, days, most).collect()))
    assert got == brute_first(events, days * DAY)
    assert sw.first_in_window(df.limit(0), days, most).isEmpty()


def test_a_busy_group_is_swept_in_many_ranges(spark):
    """A hundred thousand events of one group, of 40 parties over ten years."""
    df = spark.range(100_000).select(F.lit("all").alias("g"), F.concat(F.lit("p"), F.col("id") % 40).alias("p"), (F.xxhash64("id") % (1800 * DAY)).alias("t"))
    events = df.groupBy("g", "p", "t").agg(F.lit(1).alias("n_events")).withColumn("day", F.floor(F.col("t") / DAY))
    ranges = sw._ranges(events, 5, 5_000)
    assert ranges.select("range").distinct().count() >= 18
    assert ranges.where("own").groupBy("day").count().where("count > 1").isEmpty()
    began = time.time()
    found = sw.first_in_window(df, 5, 5_000)
    n = found.count()
    assert n > 1_500_000 and time.time() - began < 60
    rows = df.toPandas()
    sample = rows.sample(50, random_state=1)
    times = {p: np.sort(x.t.to_numpy()) for p, x in rows.groupby("p")}
    got = Counter((r.src, r.dst, r.t, r.met) for r in found.join(F.broadcast(spark.createDataFrame([(int(t),) for t in sample.t], "t long")), "t").collect())
    want = Counter()
    for p, t in zip(sample.p, sample.t, strict=True):
        for q, own in times.items():
            k = np.searchsorted(own, t - 5 * DAY)
            if q > p and k < len(own) and own[k] <= t + 5 * DAY:
                want[p, q, t, int(own[k])] += 1
    assert got == want


# -- similarity


def brute_similar(counts, threshold):
    by = {}
    for p, code, n in counts:
        if p is not None and code is not None:
            by.setdefault(p, {})[code] = n
    norm = {p: sum(n * n for n in v.values()) ** 0.5 for p, v in by.items()}
    every = {(p, q): sum(n * by[q].get(c, 0) for c, n in v.items()) / (norm[p] * norm[q]) for p, v in by.items() for q in by if p < q}
    return {k: round(c, 9) for k, c in every.items() if c >= threshold}


@pytest.mark.parametrize("threshold", [0.3, 0.8, 0.95, 1.0])
@pytest.mark.parametrize("block", [2, 256])
def test_similar_pairs(spark, threshold, block):
    rng = random.Random(int(threshold * 100) + block)
    vectors = [{f"c{c}": rng.randint(1, 9) for c in rng.sample(range(9), rng.randint(1, 6))} for _ in range(25)]
    parties = {f"p{k}": vectors[rng.randrange(len(vectors))] if k > 20 else vectors[k] for k in range(40)}
    parties |= {f"q{k}": v | {"all": 5 + k} for k, v in enumerate(vectors)}
    counts = [(p, c, n) for p, v in parties.items() for c, n in v.items()] + [(None, "c1", 2), ("p1", None, 3)]
    df = spark.createDataFrame(counts, "p string, code string, n long").repartition(3)
    got = sim.similar_pairs(df, threshold, block).collect()
    assert len({(r.src, r.dst) for r in got}) == len(got)
    want, near = brute_similar(counts, threshold - 1e-12), brute_similar(counts, threshold + 1e-12)
    found = {(r.src, r.dst): round(r.similarity, 9) for r in got}
    assert set(near) <= set(found) <= set(want) and all(want[k] == pytest.approx(v, abs=1e-8) for k, v in found.items())
    assert sim.similar_pairs(df.limit(0), threshold).isEmpty()


def test_a_code_of_all_parties_is_dealt_over_cells(spark):
    rows = [(f"p{k:05}", c, n) for k in range(3000) for c, n in (("all", 50), (f"own{k % 1500}", 1 + k % 40))]
    df = spark.createDataFrame(rows, "p string, code string, n long")
    prefix = df.where("code = 'all'").select(F.lit(1).cast("long").alias("place"), F.col("p").alias("rep"), F.lit(0.9).alias("share"), F.lit(None).cast("int").alias("vec"), F.lit(1.0).alias("norm"))
    sizes = sim._cells(prefix, 0.64, 256).groupBy("x", "y").count().collect()
    assert len(sizes) >= 66 and max(r["count"] for r in sizes) < 4 * 256
    low = sim._cells(prefix.withColumn("share", F.lit(0.65)), 0.64, 256)
    assert low.isEmpty()  # two shares of 0.65 can't reach 0.8 squared
    n = sim.similar_pairs(df, 0.99).count()
    by = {}
    for p, c, k in rows:
        by.setdefault(p, {})[c] = k
    own = np.array([1 + k % 40 for k in range(3000)], dtype=float)
    code = np.array([k % 1500 for k in range(3000)])
    dots = 2500 + np.where(code[:, None] == code[None], own[:, None] * own[None], 0)
    norm = np.sqrt(2500 + own**2)
    assert n == int((np.triu(dots / (norm[:, None] * norm[None]), 1) >= 0.99).sum())
