"""End-to-end runs: prepare, sample, summarise, boundary, estimate. Every stage reads and writes tables in a folder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netexp.functions.scalar import DEGREE_GROUPS
from netexp.operators import causal, effects, graph, mcmc, nested, sampling
from netexp.plans import reports
from netexp.sources import networks, sinks


def prepare(spark: SparkSession, edges: DataFrame, folder: str, network: str, with_hop2: bool = True, extra: DataFrame | None = None) -> DataFrame:
    """Dense ids, attributes, covariates and neighbourhoods of a network into ``folder``; returns its summary row. ``extra``: (orig, covariates...)."""
    graph.dense_ids(edges).write.mode("overwrite").parquet(f"{folder}/ids")
    ids = spark.read.parquet(f"{folder}/ids")
    s, d = ids.select(F.col("orig").alias("s"), F.col("node").alias("a")), ids.select(F.col("orig").alias("d"), F.col("node").alias("b"))
    edges = edges.join(s, "s").join(d, "d").select(F.least("a", "b").alias("s"), F.greatest("a", "b").alias("d"))
    edges.write.mode("overwrite").parquet(f"{folder}/edges")
    edges = spark.read.parquet(f"{folder}/edges")
    adj = graph.adjacency(edges)
    attributes = graph.node_attributes(edges, eigen=True)
    attributes = attributes.join(causal.covariates(attributes), "node")
    if extra is not None:
        attributes = attributes.join(extra.join(ids, "orig").drop("orig"), "node", "left")
    sinks.save_network(attributes, adj, folder, graph.hop2(adj) if with_hop2 else None)
    summary = graph.summary(sinks.load_network(spark, folder)["attributes"], edges).withColumn("network", F.lit(network))
    sinks.save_table(summary, f"{folder}/summary")
    return summary


def network_input(spark: SparkSession, network: str, data: str) -> tuple[DataFrame, DataFrame | None]:
    """(edges, covariates by original id or None) of a registered network, from files below ``data`` or simulated."""
    if network in networks.SIMULATED:
        return networks.simulated_edges(spark, [(network, *networks.SIMULATED[network])]).select("s", "d"), None
    folder = f"{data}/{network}"
    return networks.read_network(spark, network, folder)[0], networks.load_covariates(spark, network, folder)


def each(stage, names: list[str], path: str | None = None) -> DataFrame:
    """The tables of ``stage(network)`` as one, also saved at ``path``."""
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [stage(n) for n in names])
    if path:
        sinks.save_table(out, path)
    return out


def sample(spark: SparkSession, folder: str, network: str, size: int, sims: int, steps: int, hops: int = 1, seed: int = 0) -> dict[str, DataFrame]:
    """Exclusion and matched samples of a prepared network, written as partitioned samples.

    With ``hops`` 2 the exclusion is of nodes within two steps, its summary that
    of second-degree contamination, and chains of under two nodes an arm are left out.
    """
    net = sinks.load_network(spark, folder)
    adj, attributes = net["hop1"], net["attributes"]
    drawn = sampling.srs(attributes, sampling.grid(spark, sims), size, seed=seed)
    clean = sampling.clean_egos(adj, drawn)
    deg = attributes.select("node", "degree")
    if hops == 2:
        sinks.save_table(sampling.second_degree(adj, attributes, clean, size), f"{folder}/removal_summary_hop2")
        clean = clean.join(sampling.sharing(*sampling.messages(adj, clean, ("sim",), "clean"), ("sim",)), ["sim", "node"], "left_anti")
    else:
        sinks.save_table(sampling.exclusion(adj, deg, drawn, size), f"{folder}/removal_summary")
    p = graph.summary(attributes, spark.read.parquet(f"{folder}/edges")).first()["p"]
    sizes = clean.groupBy("sim", "arm").count().groupBy("sim").agg(F.floor(F.sum("count") / 2).cast("int").alias("nsample")).where(F.col("nsample") >= hops)
    chains = mcmc.sample_chains(spark, adj, attributes, sizes, p, steps, hops, seed=seed)
    tag = lambda t, method, role: t.select(F.lit(network).alias("network"), F.lit(method).alias("method"), "sim", "arm", F.lit(role).alias("role"), "node")
    rows = tag(clean, "exclusion", "ego").unionByName(tag(sampling.arm_alters(adj, drawn), "exclusion", "alter")).unionByName(tag(chains, "matched", "ego"))
    sinks.save_samples(rows, f"{folder}/samples")
    out = {m: sinks.load_samples(spark, f"{folder}/samples", network, m) for m in ("exclusion", "matched")}
    egos = out["matched"].where("role = 'ego'").join(deg, "node")
    sinks.save_table(egos.groupBy("sim", "arm").agg(F.count("*").alias("size"), F.avg("degree").alias("avg_degree")), f"{folder}/matched_summary")
    return out


def sample_hop2(spark: SparkSession, folder: str, network: str, size: int, sims: int, steps: int, sizes: list[int], seed: int = 0) -> dict[str, DataFrame]:
    """Samples without contamination within two steps, and the sweep of what remains after either exclusion."""
    net = sinks.load_network(spark, folder)
    sweep = nested.max_feasible_sweep(net["hop1"], net["attributes"], sims, sizes, seed)
    sinks.save_table(sweep, f"{folder}/max_feasible_sweep")
    return sample(spark, folder, network, size, sims, steps, hops=2, seed=seed) | {"sweep": sweep}


def summarise(spark: SparkSession, folder: str, network: str, sizes: list[int], sims: int, table2_size: int, seed: int = 0) -> dict[str, DataFrame]:
    """Contamination sweep, attributes of excluded egos, and representativeness of both methods."""
    net = sinks.load_network(spark, folder)
    adj, attributes = net["hop1"], net["attributes"]
    columns = ["degree", "cluster_coef", "eigen_centrality", "nb_degree"]
    typed = attributes.select("node", *[F.col(c).cast("double").alias(c) for c in columns])
    drawn = sampling.srs(attributes, sampling.grid(spark, sims), table2_size, seed=seed)
    samples = {m: sinks.load_samples(spark, f"{folder}/samples", network, m).where("role = 'ego'").select("sim", "node") for m in ("exclusion", "matched")}
    out = {
        "sweep": nested.contamination_sweep(adj, attributes.select("node", "degree"), sims, sizes, seed),
        "table2": sampling.excluded_attributes(adj, typed, drawn, columns).withColumn("network", F.lit(network)),
        "representativeness": sampling.representativeness(typed, samples["matched"], samples["exclusion"], columns),
    }
    for name, table in out.items():
        sinks.save_table(table, f"{folder}/{name}")
    return out


def boundary(spark: SparkSession, folder: str, network: str, sizes: list[int], sims: int, steps: int, seed: int = 0) -> DataFrame:
    """The largest feasible remainder of both methods."""
    net = sinks.load_network(spark, folder)
    adj, attributes = net["hop1"], net["attributes"]
    p = graph.summary(attributes, spark.read.parquet(f"{folder}/edges")).first()["p"]
    excluded = sampling.max_feasible(nested.exclusion_boundary(adj, attributes.select("node", "degree"), sims, sizes, seed)).withColumn("method", F.lit("exclusion"))
    matched = sampling.max_feasible(mcmc.matched_boundary(spark, adj, attributes, sizes, sims, p, steps, seed)).withColumn("method", F.lit("matched"))
    return reports.boundary_table(excluded.unionByName(matched).withColumn("network", F.lit(network)))


def estimate(spark: SparkSession, folder: str, network: str, size: int, sims: int, taus: list[float] | None = None, seed: int = 0) -> DataFrame:
    """The table of effects (tau1, estimator, estimand)."""
    return estimate_tables(spark, folder, network, size, sims, taus, seed)["ate"]


def estimate_tables(spark: SparkSession, folder: str, network: str, size: int, sims: int, taus: list[float] | None = None, seed: int = 0) -> dict[str, DataFrame]:
    """``ate`` (tau1, estimator, estimand, ...) and ``cate`` (tau1, estimator, degree_group, ...) over the exclusion samples and, as RP, the matched ones.

    Outcomes are lines in the effect size: one plan serves any number of them.
    """
    net = sinks.load_network(spark, folder)
    adj, attributes = net["hop1"], net["attributes"]
    deg = attributes.select("node", "degree")
    work = graph.work_folder(spark)
    base = graph.written(causal.baseline_outcome(deg, attributes.drop("degree"), network), work, "base")
    expo = sinks.reuse(spark, f"{folder}/exposure_{2 * size}", lambda: causal.exposure(deg, 2 * size))
    taus = taus or causal.TAU1
    mean = deg.agg(F.avg("degree")).first()[0]
    drawn = graph.written(sampling.srs(attributes, sampling.grid(spark, sims), size, seed=seed), work, "drawn")
    clean = graph.written(sampling.clean_egos(adj, drawn), work, "clean")
    matched = sinks.load_samples(spark, f"{folder}/samples", network, "matched").where("role = 'ego'").select("sim", "arm", "node")
    groups_of = network if network in DEGREE_GROUPS else "simulate_base"
    tests, groups = effects.effects(adj, deg, base, expo, drawn, clean, taus, mean, groups_of, {m: m for m in ("dim", "ht", "hajek")})
    rp_tests, rp_groups = effects.effects(adj, deg, base, expo, matched, matched, taus, mean, groups_of, {"dim": "rp"})
    ate = causal.effect_table(tests.unionByName(rp_tests), ["tau1", "estimator", "estimand"])
    by_name = causal.cate_by_estimator(groups, ["dim", "ht", "hajek"], ("tau1",)).unionByName(causal.cate_by_estimator(rp_groups, ["rp"], ("tau1",)))
    out = {"ate": ate, "cate": causal.cate_table(by_name, causal.true_effects(deg, taus, groups_of), ("tau1", "estimator"))}
    for name, table in out.items():
        sinks.save_table(table, f"{folder}/{name}")
    return out
