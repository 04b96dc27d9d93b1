"""Chains on graphs that are too large for a broadcast: draws with their neighbours come by joins."""

import numpy as np
import pytest
from test_scale import neighbours, random_edges

from netexp.operators import graph, mcmc, sampling


@pytest.mark.parametrize(("kind", "hops", "size"), [("kl", 1, 4), ("ks_linear", 1, 4), ("ks", 2, 2)])
def test_large_graphs_do_not_pass_the_driver(spark, monkeypatch, kind, hops, size):
    pairs, e = random_edges(spark, 300, 400, 5)
    adj, attributes, near = graph.adjacency(e), graph.node_attributes(e).cache(), neighbours(pairs)
    whole, seen, to_arrow = mcmc.broadcast_population(spark, adj, attributes).value, [], type(e).toArrow
    monkeypatch.setattr(mcmc, "SMALL_EDGES", 0)
    monkeypatch.setattr(mcmc, "broadcast_population", None)
    monkeypatch.setattr(type(e), "toArrow", lambda df: (seen.append(to_arrow(df)), seen[-1])[1])
    got = mcmc.sample_chains(spark, adj, attributes, sampling.grid(spark, 2, [size, 290]), 5.0, 60, hops, kind).collect()
    assert len(got) == 2 * 2 * size and {r.nsample for r in got} == {size}  # 580 nodes apart from each other are not there
    assert sum(t.num_rows for t in seen) <= len(whole.points)
    at = {v: i for i, v in enumerate(whole.nodes.tolist())}
    for sim in (1, 2):
        nodes = {r.node for r in got if r.sim == sim}
        assert len(nodes) == 2 * size
        for v in nodes:
            reach = near[v] | (set().union(*(near[u] for u in near[v])) - {v} if hops == 2 else set())
            assert not reach & nodes
        for arm in (1, 2):
            own = [r for r in got if (r.sim, r.arm) == (sim, arm)]
            gauge = mcmc.Distance(whole, kind, [at[r.node] for r in own])
            assert own[0].distance == pytest.approx(gauge.value(gauge.state)) and own[0].distance <= own[0].first_distance + 1e-9


def test_overlap_from_draws(spark, monkeypatch):
    pairs, e = random_edges(spark, 200, 500, 6)
    adj, attributes, near = graph.adjacency(e), graph.node_attributes(e).cache(), neighbours(pairs)
    monkeypatch.setattr(mcmc, "SMALL_EDGES", 0)
    for size, found in ((6, 6), (200, 0)):
        got = mcmc.sample_overlapping(spark, adj, attributes, sampling.grid(spark, 2), size, 0.9).collect()
        for sim in (1, 2):
            nodes = {r.node for r in got if r.sim == sim}
            assert len(nodes) == found and not any(near[v] & nodes for v in nodes)


def test_draws_are_uniform_over_the_free_nodes():
    """From a star and free nodes, what a first node leaves open comes equally often."""
    cells = np.array([[1.0, 0.0, 5.0], [4.0, 0.0, 1.0]])
    pop = mcmc.Drawn(cells, np.arange(6), np.array([4.0, 1, 1, 1, 1, 1]), np.zeros(6))
    around = [np.array([1, 2, 3, 4]), *[np.array([0])] * 4, np.zeros(0, int)]
    rng, count = np.random.default_rng(1), {}
    for i in range(6000):
        a, b, _, _ = mcmc.drawn_chain(pop, around, rng.integers(6, size=200).tolist(), 1, 2.0, 0, i)
        pair = tuple(sorted(a + b))
        count[pair] = count.get(pair, 0) + 1
    assert (0, 1) not in count and count[0, 5] / 6000 == pytest.approx(1 / 6 + 1 / 6 / 5, abs=0.03)
    with pytest.raises(mcmc.OutOfDraws):
        mcmc.drawn_chain(pop, around, [1], 1, 2.0, 0, 0)
