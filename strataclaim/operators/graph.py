"""Graph operators: edges, chains of bounded depth, belief propagation and rollouts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataclaim.functions import lexicons as lx
from strataclaim.functions.text import clamp
from strataclaim.session import broadcast_checked, cut

DECAY, STEP_SCALE, NOISE, START_NOISE = 0.96, 0.04, 0.005, 0.05
#: Edges, and bytes of them, up to which every task of the rollouts holds the whole graph.
GRAPH_ROWS, GRAPH_BYTES = 2_000_000, 160 * 2**20
#: Rows of a simulation that are handed out at once.
OUT_ROWS = 100_000


def chains(edges: DataFrame, starts: DataFrame, depth: int = 3, fan_out: int = 5) -> DataFrame:
    """All chains ``(start, path, relations, weakest, length)`` of 1 to ``depth`` edges from ``starts``.

    ``edges`` has (a, r, b, c): source, relation, target, confidence. From a node the ``fan_out`` most
    confident edges are followed (ties by target, then relation); no chain meets a node twice. Each
    level is one equality join.
    """
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("c"), "b", "r"))
    e = edges.withColumn("k", rank).where(F.col("k") <= fan_out).select(F.col("a").alias("_a"), F.col("r").alias("_r"), F.col("b").alias("_b"), F.col("c").alias("_c"))
    level = starts.select(F.col("concept").alias("start"), F.array("concept").alias("path"), F.array().cast("array<string>").alias("relations"), F.lit(1.0).alias("weakest"))
    found = None
    for n in range(1, depth + 1):
        level = level.join(e, F.element_at("path", -1) == F.col("_a")).where(~F.array_contains("path", F.col("_b")))
        level = level.select("start", F.concat("path", F.array("_b")).alias("path"), F.concat("relations", F.array("_r")).alias("relations"), F.least("weakest", "_c").alias("weakest"))
        step = level.withColumn("length", F.lit(n))
        found = step if found is None else found.unionByName(step)
    return found


def transitions(edges: DataFrame, scale: float = STEP_SCALE) -> DataFrame:
    """``(source, target, sign, strength)`` of edges (source, relation, target, weight)."""
    sign, most = F.lit(0), F.lit(0.15)
    for r, (s, m) in lx.RELATION_EFFECTS.items():
        sign = F.when(F.col("relation") == r, F.lit(s)).otherwise(sign)
        most = F.when(F.col("relation") == r, F.lit(m)).otherwise(most)
    return edges.select("source", "target", sign.alias("sign"), F.round(F.col("weight") * most * scale, 5).alias("strength"))


def adjacency(moves: DataFrame) -> DataFrame:
    """Transitions by source, ``(source, out)``, materialised once; broadcast if a count proves them few.

    A list holds the edges of one node; where edges are too many to broadcast they are joined by
    shuffle, still once a step.
    """
    moves = cut(moves)
    _, small = broadcast_checked(moves)
    out = moves.groupBy("source").agg(F.collect_list(F.struct("target", "sign", "strength")).alias("out"))
    return F.broadcast(out) if small else out


def step(beliefs: DataFrame, out_edges: DataFrame, keys: tuple[str, ...] = (), focus: tuple[str, ...] = (), noise: Callable[[Column], Column] | None = None, decay: float = DECAY) -> DataFrame:
    """One propagation step of ``(*keys, node, belief)`` along ``adjacency``.

    A node gains the signed strength of each incoming edge times its source's distance from .5, and
    is drawn back to .5. Edges that touch a node of ``focus`` are 2.5 times as strong, up to .12.
    ``noise`` of an edge's target is added to its push. Each row gives itself and its pushes, which one
    aggregation by node adds up, so a step is one join and one shuffle and refers to its input once.
    """
    pull = F.abs(F.col("belief") - 0.5) * 2.0

    def push(e: Column) -> Column:
        s = e["strength"]
        if focus:
            s = F.when(F.col("node").isin(*focus) | e["target"].isin(*focus), F.least(s * 2.5, F.lit(0.12))).otherwise(s)
        p = e["sign"] * pull * s
        return p if noise is None else p + noise(e["target"])

    own = F.array(F.struct(F.col("node").alias("n"), F.col("belief").alias("b"), F.lit(0.0).alias("p")))
    pushes = F.transform("out", lambda e: F.struct(e["target"].alias("n"), F.lit(None).cast("double").alias("b"), push(e).alias("p")))
    rows = beliefs.join(out_edges, F.col("node") == F.col("source"), "left").select(*keys, F.explode(F.when(F.col("out").isNull(), own).otherwise(F.concat(own, pushes))).alias("x"))
    sums = rows.groupBy(*keys, F.col("x.n").alias("node")).agg(F.max("x.b").alias("b"), F.sum("x.p").alias("push")).where("b is not null")
    return sums.select(*keys, "node", clamp(F.col("b") + F.col("push") + (0.5 - F.col("b")) * (1 - decay), 0.0, 1.0).alias("belief"))


def gaussian(*parts: Column | str, seed: int = 42) -> Column:
    """A standard normal number from a hash of ``parts``: the same wherever and whenever it is drawn."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(seed), F.lit(k), *parts), F.lit(1_000_003)) + 0.5) / 1_000_003.0
    return F.sqrt(-2.0 * F.log(u(1))) * F.cos(2.0 * F.pi() * u(2))


def rollouts(beliefs: DataFrame, moves: DataFrame, sims: int = 500, steps: int = 8, focus: tuple[str, ...] = (), seed: int = 42, also: tuple[str, ...] = ()) -> DataFrame:
    """Final beliefs ``(sim, node, belief, *also)`` of noisy rollouts from jittered starts.

    ``beliefs`` has one row a node; its columns ``also`` are other beliefs that start and move under
    the same noise. The whole graph goes to every task once, which works off its simulations as arrays
    and hands out nothing but their ends, so no step is joined, shuffled or written. A graph that a
    count proves too large for that takes ``joined_rollouts``. Noise is a hash of (seed, sim, step,
    edge), so a lost executor's part comes out the same again, and either way gives the same numbers.
    """
    spark, names = beliefs.sparkSession, ("belief", *also)
    moves = cut(moves)
    if not (broadcast_checked(moves, GRAPH_ROWS, GRAPH_BYTES)[1] and broadcast_checked(beliefs, GRAPH_ROWS, GRAPH_BYTES)[1]):
        ends = joined_rollouts(beliefs.select("node", "belief"), moves, sims, steps, focus, seed)
        for name in also:
            more = joined_rollouts(beliefs.select("node", F.col(name).alias("belief")), moves, sims, steps, focus, seed)
            ends = ends.join(more.withColumnRenamed("belief", name), ["sim", "node"])
        return ends
    nodes = beliefs.select("node", *(F.col(x).cast("double").alias(x) for x in names)).toArrow().sort_by("node").combine_chunks()
    s = F.col("strength").cast("double")
    if focus:
        s = F.when(F.col("source").isin(*focus) | F.col("target").isin(*focus), F.least(s * 2.5, F.lit(0.12))).otherwise(s)
    # edges of one pair of nodes share their noise
    pairs = moves.select("source", "target", (F.col("sign") * s).alias("w")).where("source is not null and w is not null").groupBy("source", "target").agg(F.sum("w").alias("w"), F.count(F.lit(1)).alias("n")).toArrow().combine_chunks()
    node = nodes["node"].combine_chunks()
    ends = [pc.index_in(pairs[x], value_set=node) for x in ("source", "target")]
    known = pc.and_(*map(pc.is_valid, ends))
    source, target, w, n = (x.filter(known).to_numpy() for x in (*ends, pairs["w"], pairs["n"]))
    starts = [nodes[x].to_numpy() for x in names]
    shared = spark.sparkContext.broadcast((node, starts, source, target, w, n))
    tasks = max(1, min(sims, 2 * spark.sparkContext.defaultParallelism))
    return spark.range(0, sims, 1, tasks).mapInArrow(_rolled(shared, names, steps, seed), "sim int, node string, " + ", ".join(f"`{x}` double" for x in names))


def _rolled(shared, names: tuple[str, ...], steps: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from strataclaim.operators.rollout import Rollouts

        r = None
        for b in batches:
            for sim in b.column(0).to_pylist():
                r = r or Rollouts(*shared.value, steps, seed)
                ends = r.run(sim)
                for at in range(0, len(r.node), OUT_ROWS):
                    part = r.node.slice(at, OUT_ROWS)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), sim, np.int32)), part, *(pa.array(x[at : at + OUT_ROWS]) for x in ends)], names=["sim", "node", *names])

    return run


def joined_rollouts(beliefs: DataFrame, moves: DataFrame, sims: int = 500, steps: int = 8, focus: tuple[str, ...] = (), seed: int = 42) -> DataFrame:
    """``rollouts`` of a graph that no task can hold.

    The simulations are rows; each step is a join and a sum by (sim, node). The lineage is cut half
    way, as eight steps of joins would make the plan long.
    """
    start = beliefs.select(F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("sim"), "node", "belief")
    out_edges = adjacency(moves)
    state = start.select("sim", "node", clamp(F.col("belief") + START_NOISE * gaussian("sim", "node", seed=seed), 0.0, 1.0).alias("belief"))
    for n in range(steps):
        state = step(state, out_edges, ("sim",), focus, lambda target, n=n: NOISE * gaussian("sim", F.lit(n), "node", target, seed=seed + 1))
        if n == steps // 2 - 1:
            state = cut(state)
    return state
