"""Operators whose plans hold at scale, against brute force: running sums, dominance, nested samples, packed simulations, Lanczos."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netexp.functions import distributions as D
from netexp.functions import ranks
from netexp.operators import causal, effects, graph, mcmc, nested, packed, sampling
from netexp.sources import networks, sinks


def random_edges(spark, n, m, seed, hub=False):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)} | ({(0, i) for i in range(1, n)} if hub else set())
    return sorted(pairs), networks.canonical(spark.createDataFrame(sorted(pairs), "a long, b long"))


def neighbours(pairs):
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    return near


def order_of(nodes, sim):
    return sorted(nodes, key=lambda v: (hashlib.md5(f"{v}-{sim}".encode()).hexdigest(), v))


def test_running_sums_over_ranges(spark):
    rng = random.Random(1)
    rows = [(v, rng.randrange(9)) for v in rng.sample(range(10000), 3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        t = ranks.running_sums(spark.createDataFrame(rows, "v long, n long").repartition(8), ["v"], ["n"])
        got = {r.v: (r.upto_n, r.part) for r in t.collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total, want = 0, {}
    for v, n in sorted(rows):
        total += n
        want[v] = total
    assert {v: s for v, (s, _) in got.items()} == want and len({p for _, p in got.values()}) > 1


@pytest.mark.parametrize("same_x", [False, True])
def test_dominance_over_ranges(spark, same_x):
    """Several ranges, also where all points share x."""
    rng = random.Random(2)
    points = sorted({(0 if same_x else rng.randrange(30), rng.randrange(4000)) for _ in range(900)})
    rows = [(x, y, rng.randrange(1, 4)) for x, y in points]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(r.x, r.y): r.below for r in ranks.dominance(spark.createDataFrame(rows, "x long, y long, n long").repartition(8)).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    xs, ys, ns = (np.array(c) for c in zip(*rows))
    assert got == {(x, y): int(ns[(xs <= x) & (ys <= y)].sum()) for x, y, _ in rows}


def test_distances_of_distinct_values(spark, monkeypatch):
    """An attribute without equal values; samples in several blocks; nulls are no points."""
    monkeypatch.setattr(D, "BLOCK_POINTS", 70)
    rng = np.random.default_rng(5)
    pop = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    smp = [(s, *pop[i]) for s in range(3) for i in rng.choice(400, 50, replace=False)] + [(0, 9999, None, 1.0)]
    population, sample = spark.createDataFrame(pop, "node long, x double, y double"), spark.createDataFrame(smp, "sim int, node long, x double, y double")
    p = np.array(pop)
    f = lambda t, x, y: ((t[:, 1] <= x) & (t[:, 2] <= y)).mean()
    for r in D.joint_ks(sample, population, "x", "y", ("sim",)).collect():
        own = np.array([t[1:] for t in smp if t[0] == r.sim and t[2] is not None])
        assert r.ks == pytest.approx(max(abs(f(own, x, y) - f(p, x, y)) for _, x, y in pop))
    for r in D.ks_two_sample(sample.dropna(), population, "x", ("sim",)).collect():
        own = np.array([t[2] for t in smp if t[0] == r.sim and t[2] is not None])
        assert r.ks == pytest.approx(max(abs((own <= x).mean() - (p[:, 1] <= x).mean()) for x in p[:, 1]))
    at = {(r.sim, r.x, r.y): r.f for r in D.joint_cdf(sample.dropna(), "x", "y", population.limit(20), ("sim",)).collect()}
    assert len(at) == 60
    for (sim, x, y), value in at.items():
        assert value == pytest.approx(f(np.array([t[1:] for t in smp if t[0] == sim and t[2] is not None]), x, y))


SIZES = [2, 5, 9]


@pytest.mark.parametrize("hub", [False, True])
def test_nested_sweep_matches_brute_force(spark, hub):
    pairs, e = random_edges(spark, 60, 70, 3, hub)
    near, adj = neighbours(pairs), graph.adjacency(e)
    deg = graph.degree(adj)
    mean = sum(len(v) for v in near.values()) / len(near)
    got = {r.sample_size: r for r in nested.contamination_sweep(adj, deg, 3, SIZES).collect()}
    feasible = {r.nsample: r for r in nested.max_feasible_sweep(adj, deg, 3, SIZES).collect()}
    boundary = {r.nsample: r for r in nested.exclusion_boundary(adj, deg, 3, SIZES).collect()}
    average = lambda v: sum(v) / len(v) if v else None
    for size in SIZES:
        shares, degrees, remain, apart = [], [], [], []
        for sim in (1, 2, 3):
            drawn = set(order_of(near, sim)[: 2 * size])
            one = {v for v in drawn if near[v] & drawn}
            two = one | {v for v in drawn if any((near[u] & drawn) - {v} for u in near[v])}
            clean = drawn - one
            shares.append((len(one) / len(drawn), len(two) / len(drawn)))
            degrees.append([average([len(near[v]) for v in drawn - hit]) for hit in (one, two)])
            remain.append(len(clean))
            apart.append(len([v for v in clean if not any((near[u] & clean) - {v} for u in near[v])]))
        r = got[size]
        assert (r.pcent_contaminated_1, r.pcent_contaminated_2) == pytest.approx(tuple(map(average, zip(*shares))))
        for j, value in ((1, r.avg_degree_clean_1), (2, r.avg_degree_clean_2)):
            assert value == pytest.approx(average([d[j - 1] for d in degrees if d[j - 1] is not None]))
        assert r.degree_diff_pct_1 == pytest.approx(average([(d[0] - mean) / mean for d in degrees if d[0] is not None]))
        if any(remain):
            assert feasible[size].remaining_1st == pytest.approx(average([x for x in remain if x]))
            assert feasible[size].remaining_2nd == pytest.approx(average([x for x in apart if x]))
        assert boundary[size].avg_remain == pytest.approx(average(remain) / 2)


def test_nested_sample_is_the_sample_of_its_size(spark):
    _, e = random_edges(spark, 80, 100, 4)
    deg = graph.degree(graph.adjacency(e))
    for size in (3, 10):
        want = {(r.sim, r.node) for r in sampling.srs(deg, sampling.grid(spark, 2), size).collect()}
        assert {(r.sim, r.node) for r in nested.places(deg, 2, 20).where(f"place <= {2 * size}").collect()} == want


@pytest.mark.parametrize("hub", [False, True])
def test_packed_roles_match_the_unpacked(spark, hub):
    """Three words of simulations."""
    _, e = random_edges(spark, 50, 60, 6, hub)
    adj = graph.adjacency(e)
    sample = sampling.srs(graph.degree(adj), sampling.grid(spark, 140), 4)
    got = sorted((r.sim, r.arm, r.role, r.node) for r in packed.roles(adj, sample).collect())
    egos = [(r.sim, r.arm, "ego", r.node) for r in sampling.clean_egos(adj, sample).collect()]
    alters = [(r.sim, r.arm, "alter", r.node) for r in sampling.arm_alters(adj, sample).collect()]
    assert got == sorted(egos + alters)


def test_packed_roles_of_nothing(spark):
    _, e = random_edges(spark, 10, 10, 1)
    assert packed.roles(graph.adjacency(e), spark.createDataFrame([], "sim int, node long, arm int")).count() == 0


def test_lanczos(spark):
    """Against numpy, on a network with a hub, on a bipartite one and on one with two parts; the residual holds, and rounds that are too few are an error."""
    for pairs in (random_edges(spark, 60, 90, 7, True)[0], [(a, b) for a in range(3) for b in range(3, 9)], [(0, 1), (1, 2), (0, 2), (10, 11)]):
        nodes = sorted({x for p in pairs for x in p})
        a = np.zeros((len(nodes), len(nodes)))
        for x, y in pairs:
            a[nodes.index(x), nodes.index(y)] = a[nodes.index(y), nodes.index(x)] = 1
        adj = graph.adjacency(networks.canonical(spark.createDataFrame(pairs, "a long, b long")))
        t, value, residual = graph.lanczos(adj)
        x = np.array([dict(t.collect())[v] for v in nodes])
        values, vectors = np.linalg.eigh(a)
        top = vectors[:, -1] * np.sign(vectors[:, -1].sum())
        assert value == pytest.approx(values[-1]) and x == pytest.approx(top, abs=1e-6)
        assert np.linalg.norm(a @ x - value * x) <= max(residual, 1e-9 * value) * 2 + 1e-9
    with pytest.raises(ArithmeticError):
        graph.lanczos(graph.adjacency(random_edges(spark, 60, 90, 7)[1]), rounds=2)
    with pytest.raises(ArithmeticError):
        graph.eigenvector(graph.adjacency(random_edges(spark, 60, 90, 7)[1]), rounds=2)


def test_long_paths_converge(spark):
    """Components and independent sets of a path take as many rounds as they need."""
    pairs = [(i, i + 1) for i in range(300)] + [(1000, 1001)]
    e = networks.canonical(spark.createDataFrame(pairs, "a long, b long"))
    assert graph.largest_component(e).count() == 300
    kept = {r.node for r in sampling.greedy_independent(graph.adjacency(e), graph.degree(graph.adjacency(e)), sampling.grid(spark, 1), 1000).collect()}
    near = neighbours(pairs)
    assert all(not near[v] & kept for v in kept) and all(v in kept or near[v] & kept for v in near)


@pytest.mark.parametrize("hub", [False, True])
def test_two_steps_as_bitmaps(spark, hub):
    pairs, e = random_edges(spark, 300, 200, 8, hub)
    near, adj = neighbours(pairs), graph.adjacency(e)
    want = {v: {u for m in near[v] for u in near[m]} - near[v] - {v} for v in near}
    assert {tuple(r) for r in graph.hop2(adj).collect()} == {(v, u) for v in want for u in want[v]}
    assert {r.node: r.n for r in graph.hop2_counts(adj).collect()} == {v: len(s) for v, s in want.items() if s}
    start = [0, 5, 5, 299]
    got = {tuple(r) for r in graph.hop2(adj, spark.createDataFrame([(v,) for v in start], "node long")).collect()}
    assert got == {(v, u) for v in start if v in want for u in want[v]}


def test_a_stored_adjacency_does_not_move(spark, tmp_path):
    """Bucketed by src: products shuffle the vector, bitmaps and degrees nothing of the edges; a session that doesn't know the table learns it."""
    folder = f"file://{tmp_path}/net"
    pairs, e = random_edges(spark, 200, 400, 9)
    adj = graph.adjacency(e)
    sinks.save_network(graph.degree(adj), adj, folder, buckets=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for known in (True, False):
            if not known:
                spark.sql(f"DROP TABLE {sinks._table_of(folder)}")
            stored = sinks.load_network(spark, folder)["hop1"]
            vector = spark.range(200).select(F.col("id").alias("node"), F.lit(1.0).alias("value"))
            for table, exchanges in ((graph.degree(stored), 0), (graph.bitmaps(stored), 0), (graph.spmv(stored, vector), 2), (graph.two_steps(stored), 2)):
                lines = table._jdf.queryExecution().executedPlan().toString().splitlines()
                assert sum("Exchange" in line for line in lines) == exchanges
                for i, line in enumerate(lines):
                    if "FileScan" in line:  # edges meet a join or a sum before any exchange
                        assert "Bucketed: true" in line
                        above = [x for x in reversed(lines[:i]) if "Exchange" in x or "Join" in x or "Aggregate" in x]
                        assert "Exchange" not in above[0]
            assert sorted(tuple(r) for r in graph.spmv(stored, vector).collect()) == sorted((v, float(len(s))) for v, s in neighbours(pairs).items())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_effects_from_moments(spark):
    """All effect sizes from one pass are those of each size on its own; outcomes of exactly 0 are missing either way."""
    _, e = random_edges(spark, 120, 160, 10)
    adj = graph.adjacency(e)
    deg = graph.degree(adj)
    base, expo = causal.baseline_outcome(deg, causal.covariates(deg)), causal.exposure(deg, 24)
    sample = sampling.srs(deg, sampling.grid(spark, 3), 12)
    egos = sampling.clean_egos(adj, sample)
    taus, names = [0.0, 0.02, 0.1], {m: m for m in ("dim", "ht", "hajek")}
    for zero in (False, True):
        if zero:  # an ego of the first simulation whose outcome is 0 without treatment
            node = egos.where("sim = 1 AND arm = 2").first().node
            line = effects.outcome_lines(adj, deg, base, sample, egos.select("sim", "node")).where(f"sim = 1 AND node = {node}").first()
            base = base.withColumn("y00", F.when(F.col("node") == node, F.col("y00") - line.a).otherwise(F.col("y00")))
        tests, groups = effects.effects(adj, deg, base, expo, sample, egos, taus, 2.5, "lastfm", names)
        got = {(r.tau1, r.estimator, r.estimand, r.sim): r for r in tests.collect()}
        by_group = {(r.tau1, r.sim, r.degree_group): r.est for r in groups.collect()}
        plain, plain_groups = effects._plainly(adj, deg, base, expo, sample, egos, taus, 2.5, "lastfm", names)
        want = plain.collect()
        assert len(got) == len(want) == 3 * 3 * 6
        for r in want:
            g = got[r.tau1, r.estimator, r.estimand, r.sim]
            for c in ("true_value", "est", "se", "t", "lo", "hi"):
                assert g[c] == pytest.approx(r[c], rel=1e-9, abs=1e-9) if r[c] is not None else g[c] is None
            assert (g.power, g.coverage) == (r.power, r.coverage)
        for r in plain_groups.collect():
            assert by_group[r.tau1, r.sim, r.degree_group] == pytest.approx(r.est) if r.est is not None else by_group[r.tau1, r.sim, r.degree_group] is None


def test_exposure_in_closed_form(spark):
    """Nine digits of the products, for small populations, hubs next to all nodes, and populations of millions."""
    for n, size, degrees in ((30, 10, [1, 2, 5, 19, 20, 21, 29]), (2_000_000, 1000, [1, 2, 30, 1000, 9000])):
        rows = spark.createDataFrame([(float(n - size), float(n - 1), float(k)) for k in degrees if n - size - k + 1 > 0], "t double, b double, k double")
        for r in rows.select("k", F.exp(causal.log_products(F.col("t"), F.col("b"), F.col("k"))).alias("p")).collect():
            want = 1.0
            for i in range(int(r.k)):
                want *= (n - size - i) / (n - 1 - i)
            assert r.p == pytest.approx(want, rel=1e-9)
    deg = spark.createDataFrame([(i, k) for i, k in enumerate([1, 2, 5, 19, 20, 21, 29] + [1] * 23)], "node long, degree long")
    for r in causal.exposure(deg, 10).collect():
        assert r.d11 + r.d10 + r.d0n + r.d01 + r.d00 == pytest.approx(1) and min(r.d11, r.d10, r.d0n, r.d01, r.d00) > -1e-12


@pytest.mark.parametrize(("hops", "size"), [(1, 3), (2, 3), (2, 40), (1, 5000)])
def test_greedy_looks_at_the_first_nodes_of_the_order(spark, monkeypatch, hops, size):

    rng = np.random.default_rng(4)
    near = {v: set() for v in range(3000)}
    for a, b in [*rng.integers(0, 3000, (3000, 2)).tolist(), *((0, v) for v in range(1, 2500))]:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    adj = spark.createDataFrame([(v, u) for v in near for u in near[v]], "src long, dst long")
    nodes = adj.selectExpr("src AS node").distinct()
    seen, rivals = [], sampling.rivals
    monkeypatch.setattr(sampling, "rivals", lambda adj, live, *rest, **more: (seen.append(live.count()), rivals(adj, live, *rest, **more))[1])
    want, out = set(), set()
    for v in sorted((v for v in near if near[v]), key=lambda v: (hashlib.md5(f"{v}-1".encode()).hexdigest(), v)):
        if v not in out and len(want) < size:
            want.add(v)
            out |= near[v] | (set().union(*(near[u] for u in near[v])) if hops == 2 else set())
    assert {r.node for r in sampling.greedy_independent(adj, nodes, sampling.grid(spark, 1), size, hops).collect()} == want
    assert seen[0] < 1000 or size > 1000
    assert seen == sorted(seen)


@pytest.mark.parametrize("shift", [0, 1 << 40])
def test_population_is_sent_once_an_edge(spark, monkeypatch, shift):
    edges, e = random_edges(spark, 200, 900, 3)
    e = e.selectExpr(f"s + {shift} AS s", f"d + {shift} AS d")
    adj, seen, to_arrow = graph.adjacency(e), [], type(e).toArrow
    attributes = graph.node_attributes(e).cache()
    monkeypatch.setattr(type(e), "toArrow", lambda df: (seen.append(to_arrow(df)), seen[-1])[1])
    pop = mcmc.broadcast_population(spark, adj, attributes).value
    near = {v: sorted({b for a, b in edges if a == v} | {a for a, b in edges if b == v}) for v in range(200)}
    assert pop.nodes.tolist() == [v + shift for v in range(200) if near[v]]
    for i, v in enumerate(pop.nodes.tolist()):
        assert pop.nodes[pop.hop1(i)].tolist() == [u + shift for u in near[v - shift]]
    assert seen[1].num_rows == len(edges) and seen[1].nbytes == len(edges) * (16 if shift else 8)
    calls = []
    monkeypatch.setattr(mcmc, "broadcast_population", lambda *a: (calls.append(1), spark.sparkContext.broadcast(pop))[1])
    assert mcmc.matched_boundary(spark, adj, attributes, [2, 3], 1, 2.0, 5).count() == 2 and len(calls) == 1


def test_exposure_draws_as_dense_counts(spark):
    _, e = random_edges(spark, 60, 150, 8, hub=True)
    adj, attributes = graph.adjacency(e), graph.node_attributes(e)
    got = {r.node: list(r)[1:] for r in causal.exposure_draws(spark, adj, attributes, 6, 21, parts=2).collect()}
    pop, want = mcmc.broadcast_population(spark, adj, attributes).value, np.zeros((5, 60), int)
    near = np.zeros((60, 60), int)
    for v in range(60):
        near[v, pop.hop1(v)] = 1
    for part, own in ((0, 11), (1, 10)):
        rng = np.random.default_rng(mcmc.seed_of(0, part, "draws"))
        for _ in range(own):
            d = np.zeros(60, int)
            d[rng.choice(60, 6, replace=False)] = 1
            nd = near @ d
            want += [(d == 1) & (nd > 0), (d == 1) & (nd == 0), (d == 0) & (nd > 1), (d == 0) & (nd == 1), (d == 0) & (nd == 0)]
    assert got == {int(v): want[:, i].tolist() for i, v in enumerate(pop.nodes)}
