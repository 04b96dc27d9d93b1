"""Hand-computed micro-graphs and properties of the network operators."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from netexp.__main__ import main
from netexp.functions import distributions as D
from netexp.operators import causal, graph, mcmc, sampling
from netexp.plans import pipeline, registry, reports
from netexp.sources import networks

TRIANGLE, PATH, STAR = [(0, 1), (1, 2), (0, 2)], [(0, 1), (1, 2), (2, 3)], [(0, 1), (0, 2), (0, 3), (0, 4)]


def edges(spark, pairs):
    return networks.canonical(spark.createDataFrame(pairs, "a long, b long"))


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_canonical_drops_loops_and_repeats(spark):
    assert rows(edges(spark, [(1, 0), (0, 1), (2, 2), (None, 1)]), "s", "d") == [(0, 1)]


@pytest.mark.parametrize("pairs, coef", [(TRIANGLE, {0: 1, 1: 1, 2: 1}), (PATH, {0: 0, 1: 0, 2: 0, 3: 0}), ([(a, b) for a in range(4) for b in range(a)], {i: 1 for i in range(4)})])
def test_clustering(spark, pairs, coef):
    assert dict(rows(graph.clustering(edges(spark, pairs)), "node", "cluster_coef")) == coef


def test_hop2(spark):
    assert rows(graph.hop2(graph.adjacency(edges(spark, PATH))), "src", "dst") == [(0, 2), (1, 3), (2, 0), (3, 1)]
    assert rows(graph.hop2(graph.adjacency(edges(spark, TRIANGLE))), "src", "dst") == []


def test_dense_ids_and_component(spark):
    e = edges(spark, [(10, 20), (20, 30), (5, 7)])
    assert rows(graph.dense_ids(e), "orig", "node") == [(5, 0), (7, 1), (10, 2), (20, 3), (30, 4)]
    assert rows(graph.largest_component(e), "s", "d") == [(10, 20), (20, 30)]


def test_star_contamination(spark):
    adj = graph.adjacency(edges(spark, STAR))
    sample = spark.createDataFrame([(1, 0, 1), (1, 1, 2)], "sim int, node long, arm int")
    assert rows(sampling.clean_egos(adj, sample), "node") == []
    one, two = sampling.contaminated_pairs(adj, spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "sim int, node long, arm int"))
    assert rows(one, "node", "mate") == [] and rows(two, "node", "mate") == [(1, 2), (2, 1)]


def test_population_against_itself(spark):
    pop = spark.createDataFrame([(i, i % 5, (i % 3) / 3) for i in range(60)], "node long, degree long, coef double")
    assert D.joint_ks(pop, pop, "degree", "coef").first()[0] == 0
    assert D.ks_two_sample(pop, pop, "degree").first()[0] == 0


def test_exposure_adds_up_and_matches_draws(spark):
    e = edges(spark, networks.PowerLawCluster(60, 3, 0.3, 42).edges().tolist())
    adj = graph.adjacency(e)
    deg = graph.degree(adj)
    x = causal.exposure(deg, 10)
    assert x.where("abs(d11 + d10 + d0n + d01 + d00 - 1) > 1e-9").count() == 0
    t = causal.exposure_draws(spark, adj, graph.node_attributes(e), 10, 4000).join(x.toDF("node", "a", "b", "c", "d", "e"), "node")
    assert t.agg(F.max(F.abs(F.col("d10") / 4000 - F.col("b")))).first()[0] < 0.05


def test_t_test_drops_missing(spark):
    rng = np.random.default_rng(1)
    y = [(1, 1, float(v)) for v in rng.normal(1, 1, 50)] + [(1, 2, float(v)) for v in rng.normal(0, 1, 50)] + [(1, 1, None)]
    r = causal.t_test(spark.createDataFrame(y, "sim int, arm int, y double"), 1.0).first()
    assert r.lo < r.est < r.hi and r.power


def test_chain_is_free_of_contamination_and_reproducible():
    e = networks.PowerLawCluster(300, 3, 0.3, 42).edges()
    both = np.concatenate((e, e[:, ::-1]))
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    start = np.searchsorted(both[:, 0], np.arange(301))
    pop = mcmc.Population(np.arange(300), start, both[:, 1], np.diff(start).astype(float), np.zeros(300))
    for hops, size in ((1, 8), (2, 2)):
        a, b, d, first = mcmc.chain(pop, size, 5.0, 300, 7, hops)
        assert (a, b, d, first) == mcmc.chain(pop, size, 5.0, 300, 7, hops)
        every = a + b
        assert len(set(every)) == 2 * size and all(x <= y for x, y in zip(d, first, strict=True))
        for v in every:
            near = set(pop.hop1(v).tolist()) | (set(pop.hop2(v).tolist()) if hops == 2 else set())
            assert not near & set(every)
    assert mcmc.chain(pop, 200, 5.0, 10, 7) is None


def test_features_from_files(spark, tmp_path):
    (tmp_path / "lastfm_asia_edges.csv").write_text("node_1,node_2\n0,1\n1,0\n1,2\n")
    e, features = networks.read_network(spark, "lastfm", str(tmp_path))
    assert rows(e, "s", "d") == [(0, 1), (1, 2)] and features is None
    (tmp_path / "f.json").write_text('{"0": [1, 1, 2], "1": [], "2": "x"}')
    assert rows(networks.read_feature_counts(spark, str(tmp_path / "f.json")), "node", "n_features") == [(0, 2), (1, 0), (2, 0)]
    with pytest.raises(FileNotFoundError):
        networks.read_network(spark, "twitch", str(tmp_path))


def test_pipeline(spark, tmp_path):
    folder = f"file://{tmp_path}/net"
    e = edges(spark, networks.PowerLawCluster(120, 3, 0.3, 42).edges().tolist())
    assert pipeline.prepare(spark, e, folder, "small").first().population_size == 120
    found = pipeline.sample(spark, folder, "small", 8, 2, 50)
    assert found["matched"].where("role = 'ego'").count() > 0
    assert pipeline.estimate(spark, folder, "small", 8, 2, [0.05]).count() == 8


def test_estimates_by_effect_size(spark, tmp_path):
    folder = f"file://{tmp_path}/net"
    e = edges(spark, networks.PowerLawCluster(150, 3, 0.3, 7).edges().tolist())
    pipeline.prepare(spark, e, folder, "small")
    pipeline.sample(spark, folder, "small", 12, 3, 50)
    tables = pipeline.estimate_tables(spark, folder, "small", 12, 3, [0.0, 0.1])
    both = {(r.tau1, r.estimator, r.estimand): r for r in tables["ate"].collect()}
    assert set(both) == {(t, m, d) for t in (0.0, 0.1) for m in ("dim", "ht", "hajek", "rp") for d in ("d10", "d01")}
    alone = {(r.estimator, r.estimand): r for r in pipeline.estimate(spark, folder, "small", 12, 3, [0.1]).collect()}
    for (tau, *name), r in both.items():
        assert tau or r.true_value == 0
        if tau and r.avg_est is not None:
            assert r.avg_est == pytest.approx(alone[tuple(name)].avg_est) and r.true_value == pytest.approx(alone[tuple(name)].true_value)
    cate = tables["cate"].collect()
    assert {r.estimator for r in cate} == {"dim", "ht", "hajek", "rp"} and all(r.avg_cate_est is None for r in cate if r.estimator in ("ht", "hajek"))


def test_zero_filled_t_test(spark):
    rng = np.random.default_rng(4)
    nodes = spark.range(200).select(F.col("id").alias("node"))
    some = [(1, a, int(v), float(y)) for a in (1, 2) for v, y in zip(rng.choice(200, 30, replace=False), rng.normal(5 * a, 3, 30), strict=True)]
    got = causal.t_test(spark.createDataFrame(some, "sim int, arm int, node long, y double"), 0.0, nodes=nodes).first()
    arms = [np.zeros(200), np.zeros(200)]
    for _, a, v, y in some:
        arms[a - 1][v] = y
    pooled = (arms[0].var(ddof=1) + arms[1].var(ddof=1)) / 2
    assert got.est == pytest.approx(arms[0].mean() - arms[1].mean()) and got.se == pytest.approx((pooled * 2 / 200) ** 0.5)


def test_distances_match_brute_force(spark):
    rng = np.random.default_rng(9)
    population = [(int(x), float(y)) for x, y in zip(rng.integers(1, 12, 150), rng.integers(0, 9, 150), strict=True)]
    sample = [(s, *population[i]) for s in (1, 2) for i in rng.choice(150, 17, replace=False)] + [(2, 40, 3.0), (1, 0, 0.5)]
    pop, smp = spark.createDataFrame(population, "x long, y double"), spark.createDataFrame(sample, "sim int, x long, y double")
    share = lambda rows, x, y=np.inf: sum(a <= x and b <= y for a, b in rows) / len(rows)
    for s in (1, 2):
        own = [r[1:] for r in sample if r[0] == s]
        values = {a for a, _ in population + own}
        assert D.ks_two_sample(smp, pop, "x", ("sim",)).where(f"sim = {s}").first().ks == pytest.approx(max(abs(share(own, v) - share(population, v)) for v in values))
        assert D.joint_ks(smp, pop, "x", "y", ("sim",)).where(f"sim = {s}").first().ks == pytest.approx(max(abs(share(own, *p) - share(population, *p)) for p in population))
    points, mass = np.unique(np.array(population), axis=0, return_counts=True)
    assert mcmc.joint_cdf(points, mass / 150) == pytest.approx([share(population, *p) for p in points])


def test_harmonic_sums(spark):
    ns = [2, 3, 5, 40, 1000]
    t = spark.createDataFrame([(float(n),) for n in ns], "n double").select("n", D.harmonic(F.col("n")).alias("h"), D.harmonic_squares(F.col("n")).alias("s")).collect()
    for r in t:
        n = int(r.n)
        assert r.h == pytest.approx(sum(1 / i for i in range(1, n + 1)), abs=1e-11) and r.s == pytest.approx(sum(1 / i**2 for i in range(1, n + 1)), abs=1e-11)
    n = 40
    double = sum(1 / ((n - i) * j) for j in range(1, n) for i in range(1, j))
    h = sum(1 / i for i in range(1, n))
    assert double == pytest.approx(h**2 - (h + 1 / n) ** 2 + sum(1 / i**2 for i in range(1, n + 1)))


def test_bounded_draw_is_the_whole_order(spark):
    nodes = spark.range(20_000).select(F.col("id").alias("node"))
    got = {(r.sim, r.nsample, r.node, r.arm) for r in sampling.srs(nodes, sampling.grid(spark, 2, [5, 40]), "nsample", ("sim", "nsample")).collect()}
    want = set()
    for sim in (1, 2):
        for size in (5, 40):
            order = sorted(range(20_000), key=lambda v: (hashlib.md5(f"{v}-{sim}-{size}".encode()).hexdigest(), v))[: 2 * size]
            want |= {(sim, size, v, 1 if i < size else 2) for i, v in enumerate(order)}
    assert got == want


def test_covariates_from_files(spark, tmp_path):
    (tmp_path / "lastfm_asia_target.csv").write_text("id,target\n0,3\n1,5\n2,0\n")
    with pytest.raises(FileNotFoundError):
        networks.load_covariates(spark, "lastfm", str(tmp_path))
    (tmp_path / "lastfm_asia_features.json").write_text('{"0": [1, 1, 2], "1": []}')
    assert rows(networks.load_covariates(spark, "lastfm", str(tmp_path)), "orig", "x1", "x2") == [(0, 3.0, 2.0), (1, 5.0, 0.0), (2, 0.0, 0.0)]
    (tmp_path / "large_twitch_features.csv").write_text("views,mature,life_time,created_at,updated_at,numeric_id,dead_account,language,affiliate\n7879,1,969,a,b,0,0,EN,1\n")
    assert rows(networks.load_covariates(spark, "twitch", str(tmp_path)), "orig", "x1", "x2", "x3", "x4") == [(0, 7879.0, 969.0, 1.0, 1.0)]
    (tmp_path / "soc-pokec-profiles.txt").write_text("1\t1\t14\t1\tr\tl\tr\t26\tb\textra\n2\t1\t62\t0\tr\tl\tr\t30\tb\n3\t1\t14\t0\tr\tl\tr\tnull\tb\n")
    got = rows(networks.load_covariates(spark, "pokec", str(tmp_path)), "orig", "x2", "z1", "z2")
    assert [(o, round(x, 6), round(z1, 6), round(z2, 6)) for o, x, z1, z2 in got] == [(1, 0.14, -1.0, -0.707107), (2, 0.62, 1.0, 1.414214), (3, 0.14, 0.0, -0.707107)]


def test_stages_over_networks(spark, tmp_path, monkeypatch):
    monkeypatch.setitem(networks.SIMULATED, "one", (120, 3, 0.3, 1))
    monkeypatch.setitem(networks.SIMULATED, "two", (90, 2, 0.3, 2))
    out = f"file://{tmp_path}"
    run = lambda stage, *more: main([stage, "--networks", "one,two", "--out", out, "--size", "8", "--sims", "2", "--steps", "30", "--sizes", "4,8", *more], spark)
    read = lambda name: spark.read.csv(f"{out}/{name}", header=True)
    run("prepare")
    assert {(r.network, r.population_size) for r in read("table1").collect()} == {("one", "120"), ("two", "90")}
    run("sample")
    run("summarise")
    assert read("sweep").count() == 4 and read("representativeness").count() == 8
    run("boundary")
    assert read("table3").columns == ["Network", "Exclusion", "Representative"] and read("table3").count() == 2
    run("estimate", "--taus", "0.05")
    assert read("ate").count() == 16
    run("sample_hop2")
    assert read("one/max_feasible_sweep").count() == 2
    assert read("one/matched_summary").where("avg_degree > 0").count() >= 0


def test_reports(spark):
    t = spark.createDataFrame([("lastfm", 0.05, "dim", "d10", 0.4), ("lastfm", 0.05, "dim", "d01", 0.2), ("other", 0.1, "ht", "d10", 0.6)], "network string, tau1 double, estimator string, estimand string, MAE double")
    assert rows(reports.percent(t, ["MAE"]), "MAE") == [(20.0,), (40.0,), (60.0,)]
    assert rows(t.select(reports.recode("network", reports.NETWORK_LABELS).alias("n")), "n") == [("LastFM",), ("LastFM",), ("other",)]
    assert rows(reports.effect_axis(t, 10.0), "estimand", "effect") == [("d01", 0.25), ("d10", 0.5), ("d10", 1.0)]
    assert rows(reports.estimator_means(t, ["MAE"]), "estimator", "MAE") == [("dim", 0.4), ("ht", 0.6)]
    both = reports.labelled_union({"a": t.select("MAE"), "b": t.select("tau1")}, "table")
    assert both.where("table = 'a' and tau1 is null").count() == 3 and both.where("table = 'b' and MAE is null").count() == 3


def test_whole_sparse_network_matches_brute_force(spark, tmp_path):
    rng = np.random.default_rng(5)
    lines = sorted({(int(o), int(p), "RN"[int(r)]) for o, p, r in zip(rng.integers(1, 60, 200), rng.integers(1, 90, 200), rng.integers(0, 2, 200), strict=True)})
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = {(p, q) for o, p, r in lines for o2, q, r2 in lines if o == o2 and r == r2 == "R" and p < q}
    assert set(rows(networks.cobuy_edges(spark, str(tmp_path)), "s", "d")) == want
    label = {v: v for e in want for v in e}
    for _ in label:
        for a, b in want:
            label[a] = label[b] = min(label[a], label[b])
    top = max(set(label.values()), key=lambda x: (list(label.values()).count(x), -x))
    assert registry.QUERIES["largest_component_whole"](spark, str(tmp_path)).first().n_edges == sum(label[a] == top for a, _ in want)
    summary = registry.QUERIES["table1_summary_sparse_whole"](spark, str(tmp_path)).first()
    assert (summary.population_size, summary.num_edges) == (len(label), len(want))


def test_boundary_over_the_sizes_of_the_study(spark, tmp_path):
    rng = np.random.default_rng(6)
    orders = [(o, int(c)) for o, c in enumerate(rng.integers(1, 400, 900))]
    lines = [(o, int(p), 50.0) for o, p in zip(range(900), rng.integers(1, 400, 900), strict=True)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    near, buyers = {}, {}
    for (_, c), (_, p, _) in zip(orders, lines, strict=True):
        buyers.setdefault(p, set()).add(c)
    for b in buyers.values():
        for x in b:
            near.setdefault(x, set()).update(b - {x})
    near = {x: ys for x, ys in near.items() if ys}
    want = {}
    for size in range(50, 501, 50):
        if 2 * size <= len(near):
            kept = 0
            for sim in range(1, 101):
                drawn = sorted(near, key=lambda v: (hashlib.md5(f"{v}-{sim}-{size}".encode()).hexdigest(), v))[: 2 * size]
                chosen = set(drawn)
                kept += sum(not near[v] & chosen for v in drawn)
            want[size] = round(kept / 200, 6)
    got = {r.nsample: r.avg_remain for r in registry.QUERIES["boundary_excl_full"](spark, str(tmp_path)).collect()}
    assert len(want) >= 2 and got == want
