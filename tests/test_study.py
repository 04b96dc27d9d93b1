"""The study's own checks: attributes, repeatable and improving chains, no contamination, published figures; seeds and labels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netexp.__main__ import main
from netexp.operators import graph, mcmc, nested, sampling
from netexp.plans import pipeline, reports
from netexp.sources import networks, sinks


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    """A growing network of 300 nodes, prepared in a folder."""
    folder = f"file://{tmp_path_factory.mktemp('study')}/net"
    e = networks.canonical(spark.createDataFrame(networks.PowerLawCluster(300, 3, 0.3, 42).edges().tolist(), "a long, b long"))
    return folder, e, pipeline.prepare(spark, e, folder, "net").first()


def test_attributes_are_those_that_were_saved(spark, prepared):
    folder, e, summary = prepared
    saved = {r.node: r for r in sinks.load_network(spark, folder)["attributes"].collect()}
    again = graph.node_attributes(e, eigen=True).collect()
    assert len(again) == len(saved) == summary.population_size == 300
    for r in again:
        s = saved[r.node]
        assert s.degree == r.degree and s.cluster_coef == pytest.approx(r.cluster_coef, abs=1e-12) and s.nb_degree == pytest.approx(r.nb_degree) and s.eigen_centrality == pytest.approx(r.eigen_centrality, abs=1e-8)


def test_chains_repeat_improve_and_are_clean(spark, prepared):
    """Twice with one seed the same; by another seed another; no farther than at first, and mostly nearer; ten samples without a contact."""
    folder, _, summary = prepared
    net = sinks.load_network(spark, folder)
    run = lambda seed, sims, size, steps: mcmc.sample_chains(spark, net["hop1"], net["attributes"], sampling.grid(spark, sims, [size]), summary.p, steps, seed=seed)
    rows = lambda t: sorted(tuple(r) for r in t.select("sim", "arm", "node", "distance").collect())
    one, two, other = rows(run(42, 1, 20, 2000)), rows(run(42, 1, 20, 2000)), rows(run(43, 1, 20, 2000))
    assert one == two != other
    trials = run(0, 10, 25, 1500)
    gaps = {(r.sim, r.arm): (r.first, r.last) for r in trials.groupBy("sim", "arm").agg(F.first("first_distance").alias("first"), F.first("distance").alias("last")).collect()}
    assert len(gaps) == 20 and all(last <= first + 1e-12 for first, last in gaps.values()) and sum(last < first for first, last in gaps.values()) >= 15
    near, _ = sampling.contaminated_pairs(net["hop1"], trials.select("sim", "node"))
    assert near.count() == 0 and trials.count() == 500


def test_published_figures_of_the_first_network(spark):
    """Any network of 7,624 nodes and 27,806 edges has the published mean degree and density."""
    n, m = 7624, 27806
    pairs = [(i, (i + k) % n) for k in (1, 2, 3) for i in range(n)] + [(i, i + 4) for i in range(m - 3 * n)]
    e = networks.canonical(spark.createDataFrame(pairs, "a long, b long"))
    r = graph.summary(graph.degree(graph.adjacency(e)), e).first()
    assert (r.population_size, r.num_edges) == (n, m)
    assert r.avg_degree == pytest.approx(7.2943336831, abs=1e-9) and r.density == pytest.approx(0.0009568849, abs=1e-9)


def test_seeds(spark, prepared, monkeypatch):
    folder, *_ = prepared
    deg = sinks.load_network(spark, folder)["attributes"].select("node", "degree")
    drawn = lambda seed: {tuple(r) for r in sampling.srs(deg, sampling.grid(spark, 2), 10, seed=seed).collect()}
    assert drawn(0) == drawn(0) != drawn(5) and drawn(5) == drawn(5) != drawn(6) and len(drawn(5)) == 40
    assert {(r.sim, r.node) for r in nested.places(deg, 2, 20, 5).collect()} == {(s, v) for s, v, _ in drawn(5)}
    passed = []
    for stage in ("sample", "sample_hop2", "summarise", "boundary", "estimate_tables"):
        def take(*values, seed=None, stage=stage):
            passed.append((stage, values[-1] if seed is None else seed))
            empty = spark.range(1)
            return {name: empty.withColumn("network", F.lit("net")) for name in ("sweep", "table2", "representativeness", "ate", "cate")} if stage != "boundary" else empty
        monkeypatch.setattr(pipeline, stage, take)
    for stage in ("sample", "sample_hop2", "summarise", "boundary", "estimate"):
        main([stage, "--networks", "net", "--out", folder + "-out", "--seed", "9"], spark)
    assert [s for _, s in passed] == [9] * 5


def test_labels_and_kinds_of_networks(spark):
    t = reports.network_columns(spark.createDataFrame([("lastfm", 1), ("simulate_sparse", 2), ("other", 3)], "network string, n int"))
    assert {tuple(r) for r in t.select("network", "n", "network_type").collect()} == {("LastFM", 1, "Real-world"), ("Simulated (sparse)", 2, "Simulated"), ("other", 3, None)}


@pytest.mark.parametrize("bound", [1 << 26, 0])
def test_clustering_by_words(spark, monkeypatch, bound):
    """With the sets broadcast, and by joins where they are too large; ids far apart."""
    monkeypatch.setattr(graph, "MAX_WORDS", bound)
    rng = np.random.default_rng(3)
    pairs = [(7 * int(a), 7 * int(b)) for a, b in rng.integers(0, 60, (500, 2))] + [(10**9, 0), (10**9, 7), (10**9 + 1, 10**9)]
    e = networks.canonical(spark.createDataFrame(pairs, "a long, b long"))
    want, got = dict(graph.clustering(e).collect()), dict(graph.clustering_by_words(e).collect())
    assert got == pytest.approx(want) and len(got) > 50
