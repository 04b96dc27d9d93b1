"""Metropolis-Hastings samplers of two contamination-free arms close to the population.

A chain is a dependent sequence, so a chain is one group of a grouped map:
parallelism is the number of chains (network, size, sim). A graph of up to
SMALL_EDGES edges goes to the chains as one broadcast of arrays. A larger one
stays where it is: a chain looks at the nodes that it draws only, so each gets its
draws (numbers of nodes, from its seed) with their neighbours by joins, and the
driver has the population's counts by degree and clustering. Distances are kept
by counts that an exchange of two nodes changes in O(support), never rebuilt.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netexp.functions.ranks import offsets
from netexp.functions.tables import work_folder, written

#: The most edges that are broadcast to chains (about 1 GB of arrays); larger populations are cut into networks first.
MAX_BROADCAST_EDGES = 50_000_000
#: The most edges (each once) of a graph that samples get as a broadcast: 4 MB through the driver.
SMALL_EDGES = 500_000


def joint_cdf(points: np.ndarray, mass: np.ndarray) -> np.ndarray:
    """P(X <= x, Y <= y) at different points (x, y), by one running sum over y for each x."""
    xs, x = np.unique(points[:, 0], return_inverse=True)
    ys, y = np.unique(points[:, 1], return_inverse=True)
    out, by_y = np.empty(len(points)), np.zeros(len(ys))
    order = np.argsort(x, kind="stable")
    for own in np.split(order, np.searchsorted(x[order], np.arange(1, len(xs)))):
        np.add.at(by_y, y[own], mass[own])
        out[own] = np.cumsum(by_y)[y[own]]
    return out


@dataclass
class Population:
    """Arrays of a network: sorted node ids, neighbour offsets and indices, degree and rounded clustering."""

    nodes: np.ndarray
    start: np.ndarray
    near: np.ndarray
    degree: np.ndarray
    coef: np.ndarray
    points: np.ndarray = field(init=False)

    def __post_init__(self):
        both = np.column_stack((self.degree, self.coef))
        self.points, cell = np.unique(both, axis=0, return_inverse=True)
        self.cell = cell.astype(np.int32)
        self.mass = np.bincount(self.cell, minlength=len(self.points)) / max(1, len(self.nodes))
        self.cdf = joint_cdf(self.points, self.mass)
        self.keys, inverse = np.unique(self.degree, return_inverse=True)
        self.degree_cell = inverse.astype(np.int32)
        self.degree_cdf = np.cumsum(np.bincount(inverse)) / max(1, len(self.nodes))

    def hop1(self, v: int) -> np.ndarray:
        return self.near[self.start[v] : self.start[v + 1]]

    def hop2(self, v: int) -> np.ndarray:
        first = self.hop1(v)
        if not len(first):
            return first
        two = np.unique(np.concatenate([self.hop1(int(u)) for u in first]))
        return np.setdiff1d(two[two != v], first, assume_unique=False)

    def dominates(self, v: int) -> np.ndarray:
        return ((self.points[:, 0] >= self.degree[v]) & (self.points[:, 1] >= self.coef[v])).astype(float)


class Drawn(Population):
    """A population of which some nodes are known: ``cells`` (degree, coef, count) of all, and sorted ids, degree and clustering of these, with offsets and places of neighbours where they are needed."""

    def __init__(self, cells: np.ndarray, nodes: np.ndarray, degree: np.ndarray, coef: np.ndarray, start=None, near=None):
        self.nodes, self.degree, self.coef, self.start, self.near = nodes, degree, coef, start, near
        cells = cells[np.lexsort((cells[:, 1], cells[:, 0]))]
        self.points, self.size = cells[:, :2], int(cells[:, 2].sum())
        place = {(d, c): i for i, (d, c) in enumerate(self.points.tolist())}
        self.cell = np.array([place[x] for x in zip(degree.tolist(), coef.tolist(), strict=True)], dtype=np.int32)
        self.mass = cells[:, 2] / max(1, self.size)
        self.cdf = joint_cdf(self.points, self.mass)
        self.keys, inverse = np.unique(self.points[:, 0], return_inverse=True)
        self.degree_cell = np.searchsorted(self.keys, degree).astype(np.int32)
        self.degree_cdf = np.cumsum(np.bincount(inverse, weights=cells[:, 2])) / max(1, self.size)


class OutOfDraws(Exception):
    """A chain needs more draws than it was given."""


class Distance:
    """A sample's distance from the population: ``ks`` joint, ``ks_linear`` by degree, ``kl`` of the joint cells."""

    def __init__(self, pop: Population, kind: str, members):
        self.pop, self.kind, self.n = pop, kind, len(members)
        if kind == "ks":
            self.state = sum((pop.dominates(v) for v in members), np.zeros(len(pop.points)))
        elif kind == "ks_linear":
            self.state = np.zeros(len(pop.keys))
            for v in members:
                self.state[pop.degree_cell[v] :] += 1
        else:
            self.state = np.bincount(pop.cell[list(members)], minlength=len(pop.points)).astype(float)

    def exchanged(self, out: int, into: int) -> np.ndarray:
        pop = self.pop
        if self.kind == "ks":
            return self.state + pop.dominates(into) - pop.dominates(out)
        new = self.state.copy()
        if self.kind == "ks_linear":
            new[pop.degree_cell[into] :] += 1
            new[pop.degree_cell[out] :] -= 1
        else:
            new[pop.cell[into]] += 1
            new[pop.cell[out]] -= 1
        return new

    def value(self, state: np.ndarray) -> float:
        if self.kind == "ks":
            return float(np.abs(state / self.n - self.pop.cdf).max())
        if self.kind == "ks_linear":
            return float(np.abs(state / self.n - self.pop.degree_cdf).max())
        q = np.where(state > 0, state / self.n, 1e-10)
        q = q / q.sum()
        return float((self.pop.mass * np.log(self.pop.mass / q)).sum())


def greedy(pop: Population, size: int, hops: int, rng) -> tuple[list[int], set[int]]:
    """``size`` nodes no two of which are within ``hops``, and the nodes still free; empty if the pool runs out."""
    live = set(range(len(pop.nodes)))
    chosen: list[int] = []
    for v in rng.permutation(len(pop.nodes)).tolist():
        if len(chosen) == size:
            break
        if v in live:
            chosen.append(v)
            live.discard(v)
            live.difference_update(pop.hop1(v).tolist())
            if hops == 2:
                live.difference_update(pop.hop2(v).tolist())
    return (chosen, live) if len(chosen) == size else ([], set())


def greedy_overlap(pop: Population, size: int, loss_rate: float, rng) -> list[int]:
    """Egos of which less than ``loss_rate`` of the alters already touch an ego; stops when a pass over the pool adds none."""
    touched, chosen, pool = np.zeros(len(pop.nodes), bool), [], list(range(len(pop.nodes)))
    inside = np.zeros(len(pop.nodes), bool)
    while len(chosen) < size:
        added = False
        for v in rng.permutation(pool).tolist():
            near = pop.hop1(v)
            if inside[v] or inside[near].any():
                continue
            if len(near) == 0 or touched[near].mean() < loss_rate:
                chosen.append(v)
                inside[v] = True
                touched[near] = True
                added = True
                if len(chosen) == size:
                    break
        if not added:
            return []
        pool = [v for v in pool if not inside[v]]
    return chosen


def chain(pop: Population, size: int, p: float, steps: int, seed: int, hops: int = 1, kind: str = "ks"):
    """(arm 1, arm 2, distances, first distances) of a chain; None if the pool has no start.

    A step picks an arm in proportion to its distance, takes one of its nodes
    out, draws another from the free nodes (the removed one included), and
    accepts with chance (old / new) ** p. The best pair so far is replaced only
    by one that is better in both arms.
    """
    rng = np.random.default_rng(seed)
    start, free = greedy(pop, 2 * size, hops, rng)
    if not start or size < 1:
        return None
    order = rng.permutation(start).tolist()
    arms = [order[:size], order[size:]]
    gauges = [Distance(pop, kind, a) for a in arms]
    now = [g.value(g.state) for g in gauges]
    first, best, best_arms = list(now), list(now), [list(a) for a in arms]
    around = (lambda v: np.concatenate((pop.hop1(v), pop.hop2(v)))) if hops == 2 else pop.hop1
    blocks = np.zeros(len(pop.nodes), np.int32)  # egos within reach
    for v in order:
        blocks[around(v)] += 1
    pool, place = sorted(free), {}
    place = {v: i for i, v in enumerate(pool)}

    def drop(v):
        if v in place:
            i, last = place.pop(v), pool.pop()
            if last != v:
                pool[i] = last
                place[last] = i

    for _ in range(steps):
        total = now[0] + now[1]
        g = int(rng.random() * total >= now[0]) if total > 0 else int(rng.integers(2))
        i = int(rng.integers(size))
        v = arms[g][i]
        reach = around(v)
        opened = [int(u) for u in reach if blocks[u] == 1 and u not in place]
        extra = [v, *opened]
        k = int(rng.integers(len(pool) + len(extra)))
        w = pool[k] if k < len(pool) else extra[k - len(pool)]
        state = gauges[g].exchanged(v, w)
        new = gauges[g].value(state)
        if new == 0 or rng.random() < (now[g] / new) ** p:
            gauges[g].state, now[g], arms[g][i] = state, new, w
            blocks[reach] -= 1
            for u in extra:
                place[u] = len(pool)
                pool.append(u)
            blocks[around(w)] += 1
            drop(w)
            for u in around(w).tolist():
                drop(u)
            if now[0] < best[0] and now[1] < best[1]:
                best, best_arms = list(now), [list(a) for a in arms]
    return best_arms[0], best_arms[1], best, first


def drawn_chain(pop: Drawn, around: list, draws: list[int], size: int, p: float, steps: int, seed: int, kind: str = "ks"):
    """``chain`` where nodes come from ``draws``, places drawn from all nodes with repetition; ``around`` has the ids within reach of each place.

    A draw that is not free is passed over, so what is taken is uniform over the
    free nodes, which are never listed.
    """
    rng, source, ids = np.random.default_rng(seed), iter(draws), pop.nodes.tolist()
    blocks: dict[int, int] = {}  # egos within reach, of nodes that have some

    def mark(v, by):
        for u in around[v].tolist():
            blocks[u] = blocks.get(u, 0) + by
            if not blocks[u]:
                del blocks[u]

    def draw():
        w = next(source, None)
        if w is None:
            raise OutOfDraws
        return w

    chosen: list[int] = []
    while len(chosen) < 2 * size:
        if len(blocks) + len(chosen) == pop.size:
            return None
        v = draw()
        if v not in chosen and ids[v] not in blocks:
            chosen.append(v)
            mark(v, 1)
    if size < 1:
        return None
    order, inside = rng.permutation(chosen).tolist(), set(chosen)
    arms = [order[:size], order[size:]]
    gauges = [Distance(pop, kind, a) for a in arms]
    now = [g.value(g.state) for g in gauges]
    first, best, best_arms = list(now), list(now), [list(a) for a in arms]
    for _ in range(steps):
        total = now[0] + now[1]
        g = int(rng.random() * total >= now[0]) if total > 0 else int(rng.integers(2))
        i = int(rng.integers(size))
        v = arms[g][i]
        own, w = set(around[v].tolist()), draw()
        while w != v and (w in inside or blocks.get(ids[w], 0) != (ids[w] in own)):
            w = draw()
        state = gauges[g].exchanged(v, w)
        new = gauges[g].value(state)
        if new == 0 or rng.random() < (now[g] / new) ** p:
            gauges[g].state, now[g], arms[g][i] = state, new, w
            mark(v, -1)
            mark(w, 1)
            inside.remove(v)
            inside.add(w)
            if now[0] < best[0] and now[1] < best[1]:
                best, best_arms = list(now), [list(a) for a in arms]
    return best_arms[0], best_arms[1], best, first


def drawn_overlap(pop: Drawn, around: list, draws: list[int], size: int, loss_rate: float) -> list[int]:
    """``greedy_overlap`` over ``draws``: a node that is refused once is so for good, so one pass over all nodes is enough."""
    seen, inside, touched, chosen, ids = set(), set(), set(), [], pop.nodes.tolist()
    for v in draws:
        if len(chosen) == size or len(seen) == pop.size:
            break
        near = around[v].tolist()
        if v not in seen and inside.isdisjoint(near) and (not near or sum(u in touched for u in near) / len(near) < loss_rate):
            chosen.append(v)
            inside.add(ids[v])
            touched.update(near)
        seen.add(v)
    if len(chosen) < size and len(seen) < pop.size:
        raise OutOfDraws
    return chosen if len(chosen) == size else []


def alter_chain(pop: Population, egos: list[int], percent: float, p: float, steps: int, seed: int):
    """(alters, distance, first distance): a sample of the egos' alters close to the population.

    Each ego has at least max(1, percent of its degree) alters at first, and an
    exchange leaves it max(1, half its degree) of those it had at most.
    """
    rng = np.random.default_rng(seed)
    owner = {int(a): e for e in egos for a in pop.hop1(e)}
    every = sorted(owner)
    if not every:
        return [], 0.0, 0.0
    chosen: list[int] = []
    for e in egos:
        own = sorted(a for a in every if owner[a] == e)
        if own:
            chosen += rng.permutation(own)[: max(1, int(percent * len(own)))].tolist()
    held = {e: 0 for e in egos}
    for a in chosen:
        held[owner[a]] += 1
    outside = [a for a in every if a not in set(chosen)]
    gauge = Distance(pop, "ks", chosen)
    now = first = gauge.value(gauge.state)
    best, best_set = now, list(chosen)
    for _ in range(steps if outside else 0):
        i, j = int(rng.integers(len(chosen))), int(rng.integers(len(outside)))
        v, w = chosen[i], outside[j]
        least = max(1, int(0.5 * len(pop.hop1(owner[v]))))
        if owner[v] != owner[w] and held[owner[v]] - 1 < min(least, held[owner[v]]):
            continue
        state = gauge.exchanged(v, w)
        new = gauge.value(state)
        if new == 0 or rng.random() < (now / new) ** p:
            gauge.state, now, chosen[i], outside[j] = state, new, w, v
            held[owner[v]] -= 1
            held[owner[w]] += 1
            if now < best:
                best, best_set = now, list(chosen)
    return best_set, best, first


def pooled_alter_chain(pop: Population, alters: list[int], size: int, p: float, steps: int, seed: int):
    """(alters, distance, first): alters of degree 2 stay, the others are exchanged within the pool."""
    rng = np.random.default_rng(seed)
    keep = [a for a in alters if pop.degree[a] == 2]
    rest = rng.permutation([a for a in alters if pop.degree[a] != 2]).astype(int).tolist()
    inside, outside = rest[:size], rest[size:]
    if not inside:
        return keep, 0.0, 0.0
    gauge = Distance(pop, "ks", inside)
    now = first = gauge.value(gauge.state)
    best, best_set = now, list(inside)
    for _ in range(steps if outside else 0):
        i, j = int(rng.integers(len(inside))), int(rng.integers(len(outside)))
        state = gauge.exchanged(inside[i], outside[j])
        new = gauge.value(state)
        if new == 0 or rng.random() < (now / new) ** p:
            gauge.state, now = state, new
            inside[i], outside[j] = outside[j], inside[i]
            if now < best:
                best, best_set = now, list(inside)
    return best_set + keep, best, first


def broadcast_population(spark: SparkSession, adj: DataFrame, attributes: DataFrame):
    """The population as one broadcast; fails where it is too large for that."""
    edges = adj.count()
    if edges > MAX_BROADCAST_EDGES:
        raise ValueError(f"{edges} directed edges are more than chains get at once ({MAX_BROADCAST_EDGES})")
    # each edge comes to the driver once, as two ids of four bytes where they fit
    least, most = attributes.agg(F.min("node"), F.max("node")).first()
    kind = "int" if least is not None and least >= -(1 << 31) and most < 1 << 31 else "long"
    a = attributes.select(F.col("node").cast(kind).alias("node"), F.col("degree").cast("int").alias("degree"), F.bround("cluster_coef", 5).alias("coef")).toArrow()
    nodes = a["node"].to_numpy()
    order = np.argsort(nodes)
    nodes = nodes[order].astype(np.int64)
    once = adj.where("src < dst").select(F.col("src").cast(kind).alias("s"), F.col("dst").cast(kind).alias("d")).toArrow()
    s, d = (np.searchsorted(nodes, once[c].to_numpy()).astype(np.int32) for c in ("s", "d"))
    del once
    start, near = both_ways(s, d, len(nodes))
    pop = Population(nodes, start, near, a["degree"].to_numpy()[order].astype(np.float64), a["coef"].to_numpy()[order])
    return spark.sparkContext.broadcast(pop)


def both_ways(s: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour offsets and sorted neighbours of n nodes, from places (s, d) of each edge once."""
    src, dst = np.concatenate((s, d)), np.concatenate((d, s))
    by = np.lexsort((dst, src))
    return np.concatenate(([0], np.cumsum(np.bincount(src, minlength=n)))), dst[by]


def is_small(adj: DataFrame) -> bool:
    return adj.count() <= 2 * SMALL_EDGES


def _rounded(attributes: DataFrame) -> DataFrame:
    return attributes.select("node", F.col("degree").cast("double").alias("degree"), F.bround("cluster_coef", 5).alias("coef"))


def _cells(attributes: DataFrame) -> np.ndarray:
    """Rows (degree, coef, count) of the population."""
    t = _rounded(attributes).groupBy("degree", "coef").count().toArrow()
    return np.column_stack([t[c].to_numpy().astype(np.float64) for c in ("degree", "coef", "count")])


def _lists(column) -> list[np.ndarray]:
    """The sorted lists of an Arrow column; empty for null."""
    return [np.sort(np.asarray(x.values.to_numpy(zero_copy_only=False) if x.is_valid else [], dtype=np.int64)) for x in column]


def _from_draws(spark: SparkSession, adj: DataFrame, attributes: DataFrame, params: DataFrame, draws: int, hops: int, seed: tuple, sample, schema: str) -> DataFrame:
    """What ``sample(sim, nsample, pop, around, draws)`` returns for each row (sim, nsample) of params, an Arrow table of ``schema``; chains that run out of draws are repeated with four times as many."""
    folder, cells = work_folder(spark), spark.sparkContext.broadcast(_cells(attributes))
    n = int(cells.value[:, 2].sum())
    numbered = written(_rounded(attributes).repartitionByRange("node").withColumn("part", F.spark_partition_id()).withColumn("one", F.lit(1).cast("long")), folder, "numbered")
    inside = numbered.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("node")))
    numbered = inside.join(F.broadcast(offsets(numbered, ["one"])), "part").select("node", "degree", "coef", (F.col("k") + F.col("before_one") - 1).alias("number"))
    drawn = lambda sim, size, most: np.random.default_rng(seed_of(*seed, sim, size, "numbers")).integers(max(1, n), size=most if n else 0)
    key, out = ["sim", "nsample"], None
    left = written(params.select(*[F.col(c).cast("int").alias(c) for c in key]), folder, "params")
    while not left.isEmpty():  # both functions are sent within the round, with its number of draws

        def numbers(batches):
            for batch in batches:
                for sim, size in zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True):
                    own = np.unique(drawn(sim, size, draws))
                    yield pa.record_batch([pa.array([sim] * len(own), pa.int32()), pa.array([size] * len(own), pa.int32()), pa.array(own, pa.int64())], names=[*key, "number"])

        def run(group, table):
            sim, size = group[0].as_py(), group[1].as_py()
            table = table.sort_by("node")
            number = table["number"].to_numpy()
            by = np.argsort(number)
            places = by[np.searchsorted(number, drawn(sim, size, draws), sorter=by)].tolist()
            pop = Drawn(cells.value, table["node"].to_numpy(), table["degree"].to_numpy(), table["coef"].to_numpy())
            try:
                found, short = sample(sim, size, pop, _lists(table["around"]), places), False
            except OutOfDraws:
                found, short = None, True
            if short:
                found = pa.table({f.name: pa.array([{"sim": sim}.get(f.name)], f.type) for f in _arrow(schema)})
            return found.append_column("_size", pa.array([size] * found.num_rows, pa.int32())).append_column("short", pa.array([short] * found.num_rows, pa.bool_()))

        picked = written(left.mapInArrow(numbers, "sim int, nsample int, number long").join(numbered, "number"), folder, f"picked-{draws}")
        nodes = picked.select(F.col("node").alias("src")).distinct()
        near = adj.join(nodes, "src").select(F.col("src").alias("node"), F.col("dst").alias("other"))
        if hops == 2:
            near = near.unionAll(near.join(adj, F.col("other") == F.col("src")).select("node", F.col("dst").alias("other")).where("node <> other"))
        around = near.groupBy("node").agg(F.collect_set("other").alias("around"))
        rows = picked.join(around, "node", "left").select(*key, "number", "node", "degree", "coef", "around")
        got = written(rows.groupBy(*key).applyInArrow(run, f"{schema}, _size int, short boolean"), folder, f"drawn-{draws}")
        done = got.where("not short").drop("short", "_size")
        out = done if out is None else out.unionAll(done)
        left, draws = got.where("short").select("sim", F.col("_size").alias("nsample")), 4 * draws
    return spark.createDataFrame([], schema) if out is None else out


def _arrow(schema: str) -> list[pa.Field]:
    types = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    return [pa.field(name, types[kind]) for name, kind in (x.split() for x in schema.split(", "))]


def seed_of(*parts) -> int:
    """A seed from the chain's keys, the same on every run."""
    import hashlib

    return int(hashlib.md5("-".join(map(str, parts)).encode()).hexdigest()[:12], 16)


def sample_chains(spark: SparkSession, adj: DataFrame, attributes: DataFrame, params: DataFrame, p: float, steps: int, hops: int = 1, kind: str = "ks", seed: int = 0, shared=None) -> DataFrame:
    """(sim, nsample, arm, node, distance, first_distance): a chain per row (sim, nsample) of params; chains without a start have no rows. ``shared``: the broadcast population, if it is there."""
    schema = "sim int, nsample int, arm int, node long, distance double, first_distance double"

    def listed(pop, sim, size, found):
        columns = ([], [], [], [], [], [])
        if found:
            for arm in (0, 1):
                for v in found[arm]:
                    for c, x in zip(columns, (sim, size, arm + 1, int(pop.nodes[v]), found[2][arm], found[3][arm]), strict=True):
                        c.append(x)
        types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["sim", "nsample", "arm", "node", "distance", "first_distance"])

    if shared is None and not is_small(adj):

        def from_draws(sim, size, pop, around, draws):
            return listed(pop, sim, size, drawn_chain(pop, around, draws, size, p, steps, seed_of(seed, sim, size, hops, kind), kind))

        most = params.agg(F.max("nsample")).first()[0] or 1
        return _from_draws(spark, adj, attributes, params, 2 * steps + 4 * most + 64, hops, (seed, hops, kind), from_draws, schema)
    shared = shared or broadcast_population(spark, adj, attributes)

    def run(key, table):
        sim, size = key[0].as_py(), key[1].as_py()
        return listed(shared.value, sim, size, chain(shared.value, size, p, steps, seed_of(seed, sim, size, hops, kind), hops, kind))

    chains = params.select(F.col("sim").cast("int").alias("sim"), F.col("nsample").cast("int").alias("nsample"))
    return chains.groupBy("sim", "nsample").applyInArrow(run, schema)


def sample_alters(spark: SparkSession, adj: DataFrame, attributes: DataFrame, egos: DataFrame, p: float, steps: int, percent: float = 0.5, pooled: bool = False, seed: int = 0) -> DataFrame:
    """(sim, node, distance, first_distance) of alters of the egos (sim, node)."""
    shared = broadcast_population(spark, adj, attributes)

    def run(key, table):
        sim, pop = key[0].as_py(), shared.value
        mine = np.searchsorted(pop.nodes, np.sort(table["node"].to_numpy())).tolist()
        if pooled:
            alters = sorted({int(a) for e in mine for a in pop.hop1(e)} - set(mine))
            found, d, first = pooled_alter_chain(pop, alters, max(1, int(percent * len(alters))), p, steps, seed_of(seed, sim, "pool"))
        else:
            found, d, first = alter_chain(pop, mine, percent, p, steps, seed_of(seed, sim, "alter"))
        n = len(found)
        return pa.table([pa.array([sim] * n, pa.int32()), pa.array(pop.nodes[np.array(found, dtype=np.int64)], pa.int64()), pa.array([d] * n, pa.float64()), pa.array([first] * n, pa.float64())], names=["sim", "node", "distance", "first_distance"])

    return egos.select(F.col("sim").cast("int").alias("sim"), "node").groupBy("sim").applyInArrow(run, "sim int, node long, distance double, first_distance double")


def sample_overlapping(spark: SparkSession, adj: DataFrame, attributes: DataFrame, sims: DataFrame, size: int, loss_rate: float, seed: int = 0) -> DataFrame:
    """(sim, node): egos with bounded overlap of their alters."""
    if not is_small(adj):

        def from_draws(sim, _, pop, around, draws):
            found = drawn_overlap(pop, around, draws, size, loss_rate)
            return pa.table([pa.array([sim] * len(found), pa.int32()), pa.array(pop.nodes[np.array(found, dtype=np.int64)], pa.int64())], names=["sim", "node"])

        params = sims.select("sim", F.lit(size).alias("nsample"))
        return _from_draws(spark, adj, attributes, params, 8 * size + 64, 1, (seed, "overlap"), from_draws, "sim int, node long")
    shared = broadcast_population(spark, adj, attributes)

    def run(key, table):
        sim, pop = key[0].as_py(), shared.value
        found = greedy_overlap(pop, size, loss_rate, np.random.default_rng(seed_of(seed, sim, "overlap")))
        return pa.table([pa.array([sim] * len(found), pa.int32()), pa.array(pop.nodes[np.array(found, dtype=np.int64)], pa.int64())], names=["sim", "node"])

    return sims.select(F.col("sim").cast("int").alias("sim")).groupBy("sim").applyInArrow(run, "sim int, node long")


def matched_boundary(spark: SparkSession, adj: DataFrame, attributes: DataFrame, sizes: list[int], sims: int, p: float, steps: int, seed: int = 0) -> DataFrame:
    """(nsample, avg_remain, avg_KS, feasible) of chains by size; sizes stop once a mean passes three times the threshold."""
    from netexp.operators.sampling import KS_THRESHOLD, grid

    out, shared = None, broadcast_population(spark, adj, attributes) if is_small(adj) else None
    for i, n in enumerate(sizes):
        chains = sample_chains(spark, adj, attributes, grid(spark, sims, [n]), p, steps, seed=seed, shared=shared)
        one = chains.groupBy("sim", "nsample", "arm").agg(F.first("distance").alias("d")).groupBy("nsample").agg(F.avg("d").alias("avg_KS"))
        one = spark.createDataFrame([(n,)], "nsample int").join(one, "nsample", "left").select("nsample", F.when(F.col("avg_KS").isNotNull(), F.lit(float(n))).alias("avg_remain"), "avg_KS", F.coalesce(F.col("avg_KS") < KS_THRESHOLD, F.lit(False)).alias("feasible"))
        row = one.first()
        one = spark.createDataFrame([row], one.schema)
        out = one if out is None else out.unionAll(one)
        if i and row["avg_KS"] is not None and row["avg_KS"] > 3 * KS_THRESHOLD:
            break
    return out
