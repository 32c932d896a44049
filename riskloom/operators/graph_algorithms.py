"""Graph analytics on edge DataFrames. Undirected graphs are (src, dst, weight), both ways, as ``graph_build.project`` gives.

Loops over rounds are joins and aggregations; every ``CUT_ROUNDS`` rounds the state is written to the shared folder, which
cuts lineage and survives lost executors.
"""

from __future__ import annotations

import atexit
import math
import re
import shutil
import tempfile
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CUT_ROUNDS = 8
#: Edges of a node beyond which propagation deals them over all tasks.
HUB_EDGES = 1_000_000
#: Edges, about, that a task of the search for triangles holds.
TASK_EDGES = 6_000_000
#: Nodes up to which their communities are copied to all tasks, so that edges stay in their buckets.
COPIED_NODES = 500_000
#: Nodes from which on betweenness is not computed.
BETWEENNESS_NODES = 10_000


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a temporary folder of our own; only a local master may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        base = tempfile.mkdtemp(prefix="riskloom-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, name: str = "state") -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def vertices(graph: DataFrame) -> DataFrame:
    return graph.select(F.col("src").alias("node_id")).union(graph.select(F.col("dst").alias("node_id"))).distinct()


def restart_vector(graph: DataFrame, seeds: DataFrame, normalise: bool = True, uniform_fallback: bool = True) -> DataFrame:
    """(node_id, restart): equal on the ``seeds(node_id)`` in the graph, summing to 1 (or 1 each). Without such a seed: equal
    on all nodes, or 0."""
    nodes = vertices(graph)
    marked = nodes.join(seeds.select("node_id").distinct().withColumn("seed_", F.lit(1.0)), "node_id", "left").withColumn("seed_", F.coalesce("seed_", F.lit(0.0)))
    if not normalise:
        return marked.select("node_id", F.col("seed_").alias("restart"))
    totals = marked.agg(F.sum("seed_").alias("k_"), F.count(F.lit(1)).alias("n_"))
    none = 1 / F.col("n_") if uniform_fallback else F.lit(0.0)
    return marked.join(F.broadcast(totals)).select("node_id", F.when(F.col("k_") > 0, F.try_divide("seed_", "k_")).otherwise(none).alias("restart"))


def _co_partitioned(df: DataFrame, column: str | list[str], name: str) -> DataFrame:
    """``df`` written as a table bucketed by ``column``, or by several, in as many buckets as a shuffle has partitions, so that neither a join nor an
    aggregation by it shuffles the table again."""
    spark = df.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    by = [column] if isinstance(column, str) else column
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    return spark.table(table)


def propagate(graph: DataFrame, restart: DataFrame, damping: float, start: DataFrame | None = None, mode: str = "push", self_loops: bool = False, rounds: int = 20, tolerance: float | None = None, norm: str = "l1", adopt_last: bool = True, hub_edges: int | None = None) -> DataFrame:
    """(node_id, score) after rounds of ``score = damping * spread(score) + (1 - damping) * restart``.

    push: a node deals its score to its neighbours by edge weight (random walks). pull: a node takes the weighted mean of its
    neighbours (label propagation). ``start`` (node_id, score) defaults to the restart vector. With a ``tolerance`` the loop
    ends when the change is below it: the sum of absolute changes below tolerance times the nodes (l1), or their root of
    squares (l2); ``adopt_last`` tells whether that last round counts.

    Edges are bucketed by their source and scores by node, so a round shuffles partial sums only, once; a bucket's scores are hashed, so
    that its edges are not sorted in each round. The edges of nodes with over
    ``hub_edges`` (``HUB_EDGES``) of them, whose bucket would be one long task, stay outside the buckets and meet a broadcast of those nodes' scores.
    """
    if self_loops:
        loops = vertices(graph).select(F.col("node_id").alias("src"), F.col("node_id").alias("dst"), F.lit(1.0).alias("weight"))
        graph = graph.unionByName(loops)
    share = "src" if mode == "push" else "dst"
    totals = graph.groupBy(F.col(share).alias("t_")).agg(F.sum("weight").alias("total_"))
    steps = graph.join(totals, F.col(share) == F.col("t_")).select("src", "dst", (F.col("weight") / F.col("total_")).alias("part"))
    hubs = written(graph.groupBy("src").count().where(F.col("count") > (HUB_EDGES if hub_edges is None else hub_edges)).select(F.col("src").alias("hub")), "hubs")
    hub_steps = None
    if not hubs.isEmpty():  # one for each HUB_EDGES edges at most
        steps = written(steps, "steps")
        hub_steps = written(steps.join(F.broadcast(hubs), F.col("src") == F.col("hub"), "left_semi").repartition("src", "dst"), "hub_steps")
        steps = steps.join(F.broadcast(hubs), F.col("src") == F.col("hub"), "left_anti")
    steps = _co_partitioned(steps, "src", "steps")
    restart = _co_partitioned(restart, "node_id", "restart")
    state = restart.select("node_id", F.col("restart").alias("score")) if start is None else start
    n = restart.count() if tolerance is not None else 0
    for k in range(1, rounds + 1):
        dealt = steps.join(state.hint("shuffle_hash"), F.col("src") == F.col("node_id")).select(F.col("dst").alias("to_"), (F.col("score") * F.col("part")).alias("in_"))
        if hub_steps is not None:
            own = state.join(F.broadcast(hubs), F.col("node_id") == F.col("hub"), "left_semi")
            dealt = dealt.union(hub_steps.join(F.broadcast(own), F.col("src") == F.col("node_id")).select("dst", F.col("score") * F.col("part")))
        spread = dealt.groupBy("to_").agg(F.sum("in_").alias("in_"))
        after = restart.join(spread, F.col("node_id") == F.col("to_"), "left").select("node_id", (damping * F.coalesce("in_", F.lit(0.0)) + (1 - damping) * F.col("restart")).alias("score"))
        if tolerance is not None:
            after = _co_partitioned(after, "node_id", "scores")
            gap = F.col("a.score") - F.col("b.score")
            change = F.sum(F.abs(gap)) if norm == "l1" else F.sqrt(F.sum(gap * gap))
            moved = after.alias("a").join(state.alias("b"), "node_id").agg(change.alias("c")).first().c or 0.0
            if moved < tolerance * (n if norm == "l1" else 1):
                return after if adopt_last else state
        elif k < rounds and (k % CUT_ROUNDS == 0 or hub_steps is not None):  # with hubs a round reads the scores twice
            after = _co_partitioned(after, "node_id", "scores")
        state = after
    return state


def personalized_pagerank(graph: DataFrame, seeds: DataFrame, alpha: float = 0.85, rounds: int = 100, tolerance: float | None = 1e-6, hub_edges: int | None = None) -> DataFrame:
    """From an equal start, restart on the seeds; weights count where they aren't 1."""
    restart = restart_vector(graph, seeds)
    start = restart_vector(graph, seeds.limit(0)).select("node_id", F.col("restart").alias("score"))
    return propagate(graph, restart, alpha, start, rounds=rounds, tolerance=tolerance, hub_edges=hub_edges)


def random_walk_with_restart(graph: DataFrame, seeds: DataFrame, restart_prob: float = 0.15, rounds: int = 100, tolerance: float | None = 1e-6) -> DataFrame:
    """With a loop added at every node; no seeds: all 0. The round that meets the tolerance is not adopted."""
    restart = restart_vector(graph, seeds, uniform_fallback=False)
    return propagate(graph, restart, 1 - restart_prob, self_loops=True, rounds=rounds, tolerance=tolerance, norm="l2", adopt_last=False)


def label_propagation(graph: DataFrame, seeds: DataFrame, alpha: float = 0.8, rounds: int = 20) -> DataFrame:
    return propagate(graph, restart_vector(graph, seeds, normalise=False), alpha, mode="pull", rounds=rounds)


def _spread_together(graph: DataFrame, nodes: DataFrame, seeds: DataFrame, rounds: int) -> DataFrame:
    """(node_id, pagerank, rwr, label_propagation) of as many rounds as asked, as the three functions above have them: a round reads
    the edges once for all three, whose scores are copied to the tasks, and shuffles nothing."""
    from riskloom.operators.copied import Matrix

    heard = Matrix(graph, "dst", "src", nodes)
    out = heard.dense(graph.groupBy(F.col("src").alias("node_id")).agg(F.sum("weight").alias("w")), "w")
    into = heard.dense(graph.groupBy(F.col("dst").alias("node_id")).agg(F.sum("weight").alias("w")), "w")
    marked = heard.dense(seeds.select("node_id").distinct().withColumn("seed_", F.lit(1.0)), "seed_")
    k, n = marked.sum(), max(1, heard.count)
    shared = marked / k if k else marked
    restart = np.array([shared if k else np.full(heard.count, 1 / n), shared, marked])
    damping = np.array([[0.85], [1 - 0.15], [0.8]])
    over = lambda x, y: np.divide(x, y, out=np.zeros_like(x), where=y != 0)
    score = restart.copy()
    score[0] = 1 / n
    for _ in range(rounds):
        dealt = np.array([over(score[0], out), score[1] / (out + 1), score[2]])  # a walk with restart has a loop at every node
        spread = heard.over(dealt)
        spread[1] += dealt[1]
        spread[2] = over(spread[2], into)
        score = damping * spread + (1 - damping) * restart
    return heard.table(score, ["pagerank", "rwr", "label_propagation"])


def baseline_ensemble(graph: DataFrame, seeds: DataFrame, rounds: int | None = None) -> DataFrame:
    """node_id, pagerank, rwr, label_propagation, ensemble_score (their mean). ``rounds`` fixes the loops' length; the three then go
    over the edges together (``_spread_together``), if their scores are small enough to be copied."""
    from riskloom.operators.copied import small

    if rounds is not None and small((nodes := written(vertices(graph), "nodes")).count(), 3):
        df = _spread_together(graph, nodes, seeds, rounds)
        return df.withColumn("ensemble_score", (F.col("pagerank") + F.col("rwr") + F.col("label_propagation")) / 3)
    fixed = {} if rounds is None else {"rounds": rounds, "tolerance": None}
    parts = {"pagerank": personalized_pagerank(graph, seeds, **fixed), "rwr": random_walk_with_restart(graph, seeds, **fixed), "label_propagation": label_propagation(graph, seeds, rounds=rounds or 20)}
    df = vertices(graph)
    for name, part in parts.items():
        df = df.join(part.withColumnRenamed("score", name), "node_id", "left")
    return df.withColumn("ensemble_score", sum(F.coalesce(c, F.lit(0.0)) for c in parts) / len(parts))


def predict_risk(scores: DataFrame, ids: DataFrame) -> DataFrame:
    """(node_id, score) for each of ``ids(node_id)``, 0 where unknown."""
    return ids.join(scores, "node_id", "left").select("node_id", F.coalesce("score", F.lit(0.0)).alias("score"))


def top_risk(scores: DataFrame, n: int = 20, seeds: DataFrame | None = None) -> DataFrame:
    """The ``n`` greatest scores without those of ``seeds``; ties by id."""
    if seeds is not None:
        scores = scores.join(seeds.select("node_id").distinct(), "node_id", "left_anti")
    return scores.orderBy(F.desc("score"), "node_id").limit(n)


def evaluate_scores(scores: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: mean score of labels 1 and of labels 0 over the nodes in both, ``labels(node_id, label)``."""
    both = scores.join(labels, "node_id")
    return both.agg(F.avg(F.when(F.col("label") == 1, F.col("score"))).alias("mean_positive"), F.avg(F.when(F.col("label") == 0, F.col("score"))).alias("mean_negative"))


# -- local structure


def degree(graph: DataFrame) -> DataFrame:
    """(node_id, degree) of an undirected graph; a loop counts twice."""
    ends = graph.select(F.col("src").alias("node_id"), F.when(F.col("src") == F.col("dst"), 2).otherwise(1).alias("k"))
    return ends.groupBy("node_id").agg(F.sum("k").cast("long").alias("degree"))


def degree_centrality(edges: DataFrame) -> DataFrame:
    """(edge_type, node_id, degree_centrality): in and out edges of the simple directed graph of each type over its nodes but
    one; one aggregation for all types."""
    simple = edges.select("edge_type", "src", "dst").distinct()
    ends = simple.select("edge_type", F.col("src").alias("node_id")).union(simple.select("edge_type", F.col("dst").alias("node_id")))
    each = ends.groupBy("edge_type", "node_id").agg(F.count(F.lit(1)).alias("k"))
    sizes = each.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n_"))
    return each.join(F.broadcast(sizes), "edge_type").select("edge_type", "node_id", F.coalesce(F.try_divide("k", F.col("n_") - 1), F.lit(1.0)).alias("degree_centrality"))


def betweenness(edges: DataFrame, most_sources: int = 1000, seed: int = 42) -> DataFrame:
    """(node_id, betweenness) of a simple directed graph, normalised: exact up to ``most_sources`` nodes, from as many sources, the first
    by a hash, above. It is not computed for graphs of ``BETWEENNESS_NODES`` nodes or more: null for every node.

    All sources' searches run at once, a level a round: the frontier (source, node, shortest paths) joins the edges; what it reaches
    first is the next one, and the edges that led there are kept. Dependencies then come back level by level over these. Each level
    is written; its rows are the sources times the edges between the level and the one before, at most.
    """
    spark = edges.sparkSession
    simple = written(edges.where("src <> dst").select("src", "dst").distinct(), "simple")
    nodes = written(vertices(simple), "nodes")
    n = nodes.count()
    if n < 2:
        return spark.createDataFrame([], "node_id string, betweenness double")
    if n >= BETWEENNESS_NODES:
        return nodes.withColumn("betweenness", F.lit(None).cast("double"))
    sources = nodes if n <= most_sources else nodes.orderBy(F.xxhash64(F.lit(seed), "node_id"), "node_id").limit(most_sources)
    scale = 1 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    scale *= n / min(n, most_sources)

    level = written(sources.select(F.col("node_id").alias("s"), F.col("node_id").alias("v"), F.lit(1.0).alias("paths")), "level")
    levels, led, seen = [level], [], level.select("s", "v")
    while True:
        reached = simple.join(level, F.col("src") == F.col("v")).select("s", "v", F.col("dst").alias("w"), "paths")
        known = seen.select(F.col("s").alias("s_"), F.col("v").alias("w_"))
        fresh = written(reached.join(known, (F.col("s") == F.col("s_")) & (F.col("w") == F.col("w_")), "left_anti"), "led")
        if fresh.isEmpty():
            break
        level = written(fresh.groupBy("s", F.col("w").alias("v")).agg(F.sum("paths").alias("paths")), "level")
        levels.append(level)
        led.append(fresh)
        seen = seen.union(level.select("s", "v"))
        if len(levels) % CUT_ROUNDS == 0:
            seen = written(seen, "seen")
    if not led:
        return nodes.withColumn("betweenness", F.lit(0.0))
    owed, all_owed = levels[-1].withColumn("owed", F.lit(0.0)), []
    for level, back in zip(levels[-2:0:-1], led[:0:-1], strict=True):
        of = owed.select(F.col("s").alias("s_"), F.col("v").alias("w_"), F.col("paths").alias("all_paths"), "owed")
        share = F.col("paths") / F.col("all_paths") * (1 + F.col("owed"))
        due = back.join(of, (F.col("s") == F.col("s_")) & (F.col("w") == F.col("w_"))).groupBy("s", "v").agg(F.sum(share).alias("owed"))
        owed = written(level.join(due, ["s", "v"], "left").select("s", "v", "paths", F.coalesce("owed", F.lit(0.0)).alias("owed")), "owed")
        all_owed.append(owed.select("v", "owed"))
    sums = reduce(DataFrame.union, all_owed, levels[-1].select("v", F.lit(0.0).alias("owed"))).groupBy(F.col("v").alias("node_id")).agg(F.sum("owed").alias("b"))
    return nodes.join(sums, "node_id", "left").select("node_id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def eigenvector(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node_id, eigenvector): ``rounds`` steps of x + (sum over in-edges of x), scaled to length 1 at the end of each.
    In an acyclic graph, whose eigenvector is not defined, all are 0."""
    simple = written(edges.where("src <> dst").select("src", "dst").distinct(), "simple")
    nodes = written(vertices(simple), "nodes")
    live = simple
    before, left = -1, simple.count()
    while left and left != before:  # drop edges from nodes without in-edges: only cycles and what they reach stay
        live = written(live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"), "live")
        before, left = left, live.count()
    if not left:
        return nodes.withColumn("eigenvector", F.lit(0.0))
    state, steps = nodes.withColumn("x", F.lit(1.0)), _co_partitioned(simple, "src", "steps")  # a round neither shuffles nor sorts the edges
    for k in range(rounds):
        into = steps.join(state.hint("shuffle_hash"), F.col("src") == F.col("node_id")).groupBy("dst").agg(F.sum("x").alias("in_"))
        after = state.join(into, F.col("node_id") == F.col("dst"), "left").select("node_id", (F.col("x") + F.coalesce("in_", F.lit(0.0))).alias("x"))
        length = after.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("len_"))
        after = after.join(F.broadcast(length)).select("node_id", (F.col("x") / F.col("len_")).alias("x"))
        state = written(after) if k % 4 == 3 else after
    return state.select("node_id", F.col("x").alias("eigenvector"))


def _corners(blocks: int):
    """Triangles of a task's edges as (n, t), by corner. A task is three blocks of nodes, x <= y <= z; those that lie in one block wholly
    belong to the task of that block three times."""

    def run(table: pa.Table) -> pa.Table:
        task = table.column("task")[0].as_py()
        x, y, z = task // blocks**2, task // blocks % blocks, task % blocks
        lists = table.column("vs").combine_chunks()
        u = np.repeat(table.column("u").to_numpy(), lists.value_lengths().to_numpy())
        names, places = np.unique(np.concatenate([u, lists.flatten().to_numpy()]), return_inverse=True)
        u, v = places[: len(u)], places[len(u) :]
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        first = np.searchsorted(u, np.arange(len(names) + 1))
        size, block, of_one = np.diff(first), names % blocks, x != z and y in (x, z)
        found, mark = np.zeros(len(names), dtype=np.int64), np.zeros(len(names), dtype=bool)
        for a in np.flatnonzero(size > 1):
            near = v[first[a] : first[a + 1]]
            near_size = size[near]
            mark[near] = True
            b = np.repeat(near, near_size)
            c = v[np.arange(len(b)) + np.repeat(first[near] - np.cumsum(near_size) + near_size, near_size)]
            closed = mark[c]
            mark[near] = False
            if of_one:
                closed &= (block[b] != block[a]) | (block[c] != block[a])
            b, c = b[closed], c[closed]
            found[a] += len(b)
            found += np.bincount(b, minlength=len(names)) + np.bincount(c, minlength=len(names)) if len(b) else 0
        some = np.flatnonzero(found)
        return pa.table({"n": pa.array(names[some], pa.int64()), "t": pa.array(found[some], pa.int64())})

    return run


def clustering(graph: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(node_id, clustering) of the simple undirected graph. Each triangle is found once, from edges directed to the end of higher
    degree, so that hubs don't meet all pairs of their neighbours. Nodes are numbered by degree and dealt into blocks; an edge goes to
    each choice of three blocks that has its ends' (as many copies as blocks, whose number follows the root of the edges), and lists of
    neighbours are intersected there, so no pair of neighbours becomes a row."""
    from riskloom.operators.ordered import with_running_totals

    graph = graph.where("src <> dst").select("src", "dst").distinct()
    k = graph.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("d"))
    k = written(with_running_totals(k.withColumn("one_", F.lit(1).cast("long")), [F.col("d"), F.col("node_id")], {"n": "one_"}).select("node_id", "d", "n"), "degrees")
    ends = graph.where("src < dst").join(k.select(F.col("node_id").alias("src"), F.col("n").alias("ns")), "src").join(k.select(F.col("node_id").alias("dst"), F.col("n").alias("nd")), "dst")
    to = written(ends.select(F.least("ns", "nd").alias("u"), F.greatest("ns", "nd").alias("v")), "directed")
    blocks = max(1, math.ceil(math.sqrt(6 * to.count() / task_edges)))
    i, j, m = F.pmod("u", F.lit(blocks)), F.col("j"), F.lit(blocks)
    lists = to.groupBy("u", F.pmod("v", m).alias("j")).agg(F.collect_list("v").alias("vs"))
    three = lambda x: F.array_sort(F.array(i, j, x))
    tasks = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")), lambda x: (F.get(three(x), F.lit(0)) * m + F.get(three(x), F.lit(1))) * m + F.get(three(x), F.lit(2)))
    dealt = lists.select(F.explode(tasks).alias("task"), "u", "vs")
    corners = dealt.groupBy("task").applyInArrow(_corners(blocks), "n long, t long").groupBy("n").agg(F.sum("t").alias("t"))
    ratio = F.coalesce(F.try_divide(2 * F.col("t"), F.col("d") * (F.col("d") - 1)), F.lit(0.0))
    return k.join(corners, "n", "left").select("node_id", ratio.cast("double").alias("clustering"))


def ego_size(graph: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node_id, ego_size) of each of ``nodes(node_id)``: itself and its distinct neighbours."""
    near = graph.where("src <> dst").select("src", "dst").distinct().groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("k"))
    return nodes.select("node_id").join(near, "node_id", "left").select("node_id", (1 + F.coalesce("k", F.lit(0))).alias("ego_size"))


def seed_distance(graph: DataFrame, seeds: DataFrame, nodes: DataFrame | None = None, most_rounds: int = 10_000) -> DataFrame:
    """(node_id, distance): hops to the nearest seed, -1 if none is reachable; one search from all seeds at once. The frontier
    joins the edges; each round is written."""
    graph = written(graph.select("src", "dst").distinct(), "hops")
    nodes = vertices(graph) if nodes is None else nodes.select("node_id").distinct()
    seen = written(vertices(graph).join(seeds.select("node_id").distinct(), "node_id", "left_semi").withColumn("distance", F.lit(0)), "seen")
    frontier = seen
    for d in range(1, most_rounds + 1):
        near = graph.join(frontier, F.col("src") == F.col("node_id"), "left_semi").select(F.col("dst").alias("node_id")).distinct()
        fresh = written(near.join(seen, "node_id", "left_anti").withColumn("distance", F.lit(d)), "frontier")
        if fresh.isEmpty():
            break
        seen, frontier = seen.union(fresh), fresh
        if d % CUT_ROUNDS == 0:
            seen = written(seen, "seen")
    own = nodes.join(seeds.select("node_id").distinct().withColumn("own", F.lit(0)), "node_id", "left")
    return own.join(seen, "node_id", "left").select("node_id", F.coalesce("distance", "own", F.lit(-1)).cast("long").alias("distance"))


def core_number(graph: DataFrame, most_rounds: int = 1000, copied_nodes: int | None = None) -> DataFrame:
    """(node_id, core): each node's estimate falls from its degree to the h-index of its neighbours' estimates until none
    changes. Neighbours are counted by estimate before the h-index, so a hub needs no list of its neighbours. Edges are bucketed
    by the neighbour, so a round shuffles the counts, not the edges. Up to ``COPIED_NODES`` nodes, or ``copied_nodes``, the estimates are
    copied to the tasks and a round shuffles nothing."""
    from riskloom.operators.copied import Matrix, h_indices

    graph = graph.where("src <> dst").select("src", "dst").distinct()
    nodes = written(graph.select(F.col("src").alias("node_id")).distinct(), "nodes")
    if nodes.count() <= (COPIED_NODES if copied_nodes is None else copied_nodes):
        graph = written(graph.withColumn("weight", F.lit(1.0)), "simple")
        near = Matrix(graph, "src", "dst", nodes)
        core = near.dense(graph.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("k")), "k").astype(np.int64)[None]
        for _ in range(most_rounds):
            before, core = core, near.over(core, h_indices, core)
            if (core == before).all():
                return near.table(core, ["core"], "long")
        raise RuntimeError("core numbers did not settle")
    graph = _co_partitioned(graph, "dst", "simple")
    state = written(graph.groupBy(F.col("src").alias("node_id")).agg(F.count(F.lit(1)).alias("core")), "core")
    down = Window.partitionBy("node_id").orderBy(F.desc("e")).rowsBetween(Window.unboundedPreceding, 0)
    for _ in range(most_rounds):
        near = graph.join(state.select(F.col("node_id").alias("dst"), F.col("core").alias("other")).hint("shuffle_hash"), "dst")
        near = near.groupBy(F.col("src").alias("node_id"), "other").agg(F.count(F.lit(1)).alias("k")).join(state, "node_id")
        counts = near.groupBy("node_id", "core", F.least("other", "core").alias("e")).agg(F.sum("k").alias("n"))
        h = counts.withColumn("upto", F.sum("n").over(down)).groupBy("node_id", "core").agg(F.max(F.least("e", "upto")).alias("h"))
        after = written(h, "core")
        state = after.select("node_id", F.least("h", "core").alias("core"))
        if after.where("h < core").isEmpty():
            return state
    raise RuntimeError("core numbers did not settle")


# -- communities


def modularity(graph: DataFrame, parts: DataFrame) -> float:
    """Of ``parts(node_id, community)`` on an undirected weighted graph."""
    c = parts.select(F.col("node_id").alias("src"), F.col("community").alias("cs"))
    d = parts.select(F.col("node_id").alias("dst"), F.col("community").alias("cd"))
    joined = graph.join(c, "src").join(d, "dst")
    inside = joined.agg(F.sum(F.when(F.col("cs") == F.col("cd"), F.col("weight"))).alias("i"), F.sum("weight").alias("m")).first()
    squares = joined.groupBy("cs").agg(F.sum("weight").alias("k")).agg(F.sum(F.col("k") * F.col("k")).alias("s")).first().s
    return (inside.i or 0.0) / inside.m - squares / inside.m**2 if inside.m else 0.0


def _copied(df: DataFrame, copied: bool) -> DataFrame:
    return F.broadcast(df) if copied else df


def _best_moves(graph: DataFrame, state: DataFrame, total: float, copied: bool = False) -> DataFrame:
    """(node_id, b: to and gain, stay): of each node the neighbouring community of greatest gain, and the gain of its own. Where the
    state is small enough to be ``copied`` and edges are bucketed by src, none of them is shuffled."""
    sums = state.groupBy("community").agg(F.sum("k").alias("all_k"))
    links = graph.where("src <> dst").join(_copied(state.select(F.col("node_id").alias("dst"), F.col("community").alias("to")), copied), "dst").groupBy(F.col("src").alias("node_id"), "to").agg(F.sum("weight").alias("w"))
    options = links.join(_copied(state.select("node_id", "k", "community"), copied), "node_id").join(_copied(sums.select(F.col("community").alias("to"), "all_k"), copied), "to")
    minus = F.when(F.col("to") == F.col("community"), F.col("k")).otherwise(0.0)
    gain = F.round(F.col("w") - F.col("k") * (F.col("all_k") - minus) / total, 9)
    stay = F.max(F.when(F.col("to") == F.col("community"), gain))
    return options.groupBy("node_id").agg(F.max_by(F.struct("to", gain.alias("gain")), F.struct(gain, F.col("to"))).alias("b"), stay.alias("stay"))


def _moved(graph: DataFrame, state: DataFrame, total: float, rounds: int, copied: bool = False) -> DataFrame:
    """``state(node_id, k, community)`` after rounds of local moves. Moves to smaller labels count in even rounds, to greater ones in
    odd ones, so that pairs don't swap; a round's moves of less than half of the movers, chosen by a hash, end cycles."""
    for r in range(rounds):
        way = F.col("b.to") < F.col("community") if r % 2 == 0 else F.col("b.to") > F.col("community")
        better = (F.col("b.gain") > F.greatest(F.coalesce("stay", F.lit(0.0)), F.lit(0.0))) & way
        if r >= 4:
            better = better & (F.pmod(F.xxhash64("node_id", F.lit(r)), F.lit(4)) > 0)
        after = state.join(_best_moves(graph, state, total, copied), "node_id", "left").select("node_id", "k", F.when(F.coalesce(better, F.lit(False)), F.col("b.to")).otherwise(F.col("community")).alias("community"), F.coalesce(better, F.lit(False)).alias("moved"))
        after = written(after, "moves")
        state = after.select("node_id", "k", "community")
        if r % 2 and after.where("moved").isEmpty():
            break
    return state


def _refined(graph: DataFrame, state: DataFrame, total: float, rounds: int, copied: bool = False) -> DataFrame:
    """(node_id, community, part): each community built anew from single nodes. In a round the nodes that are still alone are movers or
    hosts by a hash; a mover that is well connected to its community joins the host part of greatest gain, if that part is well
    connected too. Hosts stay, so a part is connected however many join it."""
    within = graph.where("src <> dst").join(_copied(state.select(F.col("node_id").alias("src"), F.col("community").alias("cs")), copied), "src").join(_copied(state.select(F.col("node_id").alias("dst"), F.col("community").alias("cd")), copied), "dst")
    within = _co_partitioned(within.where("cs = cd").select("src", "dst", "weight"), "src", "within")
    whole = state.groupBy("community").agg(F.sum("k").alias("whole_k"))
    rows = written(state.join(whole, "community").select("node_id", "k", "community", "whole_k", F.col("node_id").alias("part")), "parts")
    for r in range(rounds):
        sums = rows.groupBy("part").agg(F.sum("k").alias("part_k"), F.count(F.lit(1)).alias("n"))
        at = rows.join(sums, "part").withColumn("host", (F.col("n") > 1) | (F.pmod(F.xxhash64("part", F.lit(r)), F.lit(2)) == 0))
        ends = within.join(_copied(at.select(F.col("node_id").alias("dst"), F.col("part").alias("to"), F.col("part_k").alias("to_k"), F.col("host").alias("to_host")), copied), "dst")
        ends = ends.join(_copied(at.select(F.col("node_id").alias("src"), "part", "k", "part_k", "whole_k", F.col("host").alias("from_host")), copied), "src").where("part <> to")
        enough = lambda w, k: F.col(w) >= F.col(k) * (F.col("whole_k") - F.col(k)) / total - 1e-9
        open_parts = ends.groupBy("part", "part_k", "whole_k").agg(F.sum("weight").alias("out")).where(enough("out", "part_k")).select(F.col("part").alias("good"))
        links = ends.where("not from_host and to_host").groupBy(F.col("src").alias("mover"), "part", "k", "to", "to_k").agg(F.sum("weight").alias("w"))
        gain = F.round(F.col("w") - F.col("k") * F.col("to_k") / total, 9)
        links = links.join(open_parts, F.col("part") == F.col("good"), "left_semi").join(open_parts, F.col("to") == F.col("good"), "left_semi").withColumn("gain", gain).where("gain > 0")
        best = links.groupBy("mover").agg(F.max_by("to", F.struct("gain", "to")).alias("to"))
        rows = rows.join(best, F.col("node_id") == F.col("mover"), "left").select("node_id", "k", "community", "whole_k", F.coalesce("to", "part").alias("part"), F.col("to").isNotNull().alias("joined"))
        rows = written(rows, "parts")
        idle = rows.where("joined").isEmpty()
        rows = rows.drop("joined")
        if idle and r % 2:
            break
    return rows.select("node_id", "community", "part")


def connected_parts(graph: DataFrame, parts: DataFrame, copied: bool = False) -> DataFrame:
    """(node_id, community): each community cut into its connected pieces, labelled by their smallest node; labels spread to
    neighbours and then to the label's own label, so that long pieces settle in few rounds."""
    c = parts.select(F.col("node_id").alias("src"), F.col("community").alias("cs"))
    d = parts.select(F.col("node_id").alias("dst"), F.col("community").alias("cd"))
    inside = _co_partitioned(graph.where("src <> dst").join(_copied(c, copied), "src").join(_copied(d, copied), "dst").where("cs = cd").select("src", "dst"), "src", "inside")
    labels = written(parts.select("node_id", F.col("node_id").alias("label")), "labels")
    while True:
        near = inside.join(_copied(labels.select(F.col("node_id").alias("dst"), "label"), copied), "dst").groupBy(F.col("src").alias("node_id")).agg(F.min("label").alias("near"))
        least = labels.join(near, "node_id", "left").select("node_id", "label", F.least("label", F.coalesce("near", "label")).alias("new"))
        jump = labels.select(F.col("node_id").alias("of"), F.col("label").alias("further"))
        after = written(least.join(jump, F.col("new") == F.col("of"), "left").select("node_id", "label", F.least("new", F.coalesce("further", "new")).alias("new")), "labels")
        labels = after.select("node_id", F.col("new").alias("label"))
        if after.where("new <> label").isEmpty():
            return labels.select("node_id", F.col("label").alias("community"))


def communities(graph: DataFrame, levels: int = 4, rounds: int = 12, copied_nodes: int | None = None) -> DataFrame:
    """(node_id, community): deterministic modularity optimisation with refinement. On each level nodes move between communities by
    gain; each community is then built anew from well-connected parts, and these become the nodes of the next level, which starts
    from the communities. At the end communities that are not connected are cut. Labels are the smallest node ids.

    Edges are bucketed by src. Up to ``COPIED_NODES`` nodes, counted, a round copies the nodes' state to all tasks and shuffles no edge;
    beyond, edges are joined with it by shuffles."""
    graph = _co_partitioned(graph.groupBy("src", "dst").agg(F.sum("weight").alias("weight")), "src", "graph")
    total = graph.agg(F.sum("weight")).first()[0] or 0.0
    first = graph
    whole = written(vertices(graph).withColumn("part", F.col("node_id")), "parts")
    if not total:
        return whole.select("node_id", F.col("part").alias("community"))
    copied = whole.count() <= (COPIED_NODES if copied_nodes is None else copied_nodes)
    start = whole.select("node_id", F.col("node_id").alias("community"))
    for level in range(levels):
        k = graph.groupBy(F.col("src").alias("node_id")).agg(F.sum("weight").alias("k"))
        state = _moved(graph, written(k.join(start, "node_id").select("node_id", "k", "community"), "strength"), total, rounds, copied)
        found = whole.join(state.select(F.col("node_id").alias("part"), "community"), "part").select("node_id", "community")
        if level == levels - 1:
            break
        fine = _refined(graph, state, total, rounds, copied)
        named = fine.groupBy("part").agg(F.min("node_id").alias("label"), F.min("community").alias("community"))
        fine = written(fine.select("node_id", "part").join(named, "part").select("node_id", F.col("label").alias("part"), "community"), "level")
        n, fewer = fine.count(), fine.select("part").distinct().count()
        if fewer == n:
            break
        whole = written(whole.select(F.col("node_id").alias("leaf"), F.col("part").alias("node_id")).join(fine, "node_id").select(F.col("leaf").alias("node_id"), "part"), "parts")
        start = fine.select(F.col("part").alias("node_id"), "community").distinct()
        ends = [fine.select(F.col("node_id").alias(e), F.col("part").alias(f"p_{e}")) for e in ("src", "dst")]
        graph = _co_partitioned(graph.join(_copied(ends[0], copied), "src").join(_copied(ends[1], copied), "dst").groupBy(F.col("p_src").alias("src"), F.col("p_dst").alias("dst")).agg(F.sum("weight").alias("weight")), "src", "graph")
    return connected_parts(first, found, copied)


def community_features(parts: DataFrame, providers: DataFrame, excluded: DataFrame) -> DataFrame:
    """Per provider: community_id, community_size, community_fraud_rate (share of excluded members); '-1', 0, 0 outside."""
    bad = parts.join(excluded.select("node_id").distinct().withColumn("bad", F.lit(1)), "node_id", "left")
    sizes = bad.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.count("bad").alias("n_bad"))
    own = providers.select("node_id").join(parts, "node_id", "left").join(sizes, "community", "left")
    return own.select("node_id", F.coalesce("community", F.lit("-1")).alias("community_id"), F.coalesce("size", F.lit(0)).alias("community_size"), F.coalesce(F.col("n_bad") / F.col("size"), F.lit(0.0)).alias("community_fraud_rate"))


def structural_features(nodes: DataFrame, edges: DataFrame, seeds: DataFrame, edge_types: list[str], rounds: int | None = 30) -> DataFrame:
    """One row a provider: centralities by edge type (0 where it has none; betweenness null where it was not computed), PPR,
    community, clustering, ego size, distance."""
    from riskloom.operators.graph_build import project, provider_nodes

    edges = written(edges, "edges")
    who = provider_nodes(nodes).select(F.col("id").alias("node_id"))
    graph = written(project(edges), "graph")
    between = written(project(edges, provider_nodes(nodes)), "graph")
    parts = [degree_centrality(edges).where(F.col("edge_type") == t).select("node_id", F.col("degree_centrality").alias(f"degree_cent_{t}")) for t in edge_types]
    for t in edge_types:
        own = edges.where(F.col("edge_type") == t)
        parts.append(betweenness(own).withColumnRenamed("betweenness", f"betweenness_{t}"))
        parts.append(eigenvector(own, 20).withColumnRenamed("eigenvector", f"eigenvector_{t}"))
    parts.append(personalized_pagerank(graph, seeds, rounds=rounds or 100, tolerance=None if rounds else 1e-6).withColumnRenamed("score", "pagerank_risk_score"))
    groups = communities(graph)
    parts.append(community_features(groups, who, seeds).drop("community_id"))
    parts.append(clustering(between).withColumnRenamed("clustering", "clustering_coefficient"))
    parts.append(ego_size(between, who))
    parts.append(seed_distance(graph, seeds, who).withColumnRenamed("distance", "min_distance_to_bad_actor"))
    df = who
    for p in parts:
        df = df.join(p.withColumn("has_", F.lit(True)), "node_id", "left")
        df = df.withColumns({c: F.when(F.col("has_"), F.col(c)).otherwise(F.lit(0.0)) for c in p.columns if c.startswith("betweenness_")}).drop("has_")
    return df.fillna(0, [c for c in df.columns if not c.startswith("betweenness_")])
