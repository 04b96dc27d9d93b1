"""Random samples, contamination, exclusion, sweeps and greedy independent samples.

Loops over sizes and simulations are key columns: ``keys`` name a sample, and
every operator handles all samples in one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netexp.functions.distributions import ks_two_sample
from netexp.operators.graph import hop2, neighbours_of, spmv, work_folder, written

KS_THRESHOLD = 0.1


def grid(spark: SparkSession, sims: int, sizes: list[int] | None = None) -> DataFrame:
    """(sim[, nsample]) of a parameter grid."""
    out = spark.range(1, sims + 1).select(F.col("id").cast("int").alias("sim"))
    if sizes is None:
        return out
    return out.crossJoin(spark.createDataFrame([(s,) for s in sizes], "nsample int"))


def order_hash(keys: tuple, seed: int = 0) -> Column:
    """The md5 by which nodes are ordered in a simulation (keys...): of node and keys, and of the seed where one is given."""
    return F.md5(F.concat_ws("-", *([F.lit(str(seed))] if seed else []), F.col("node").cast("string"), *[F.col(k).cast("string") for k in keys]))


def srs(nodes: DataFrame, params: DataFrame, size, keys: tuple = ("sim",), seed: int = 0) -> DataFrame:
    """(keys..., node, arm): 2 * size nodes without replacement per row of params, the first half arm 1.

    The order is that of md5 of node and sim (and seed): uniform, the same in
    any engine and on every run of a seed. Only nodes whose md5 is below a bound are ranked. Of N
    nodes 4 * size + 400 are below it on average, so fewer than 2 * size are
    with a chance under exp(-50): a sample of a large population moves few rows.
    """
    size = F.lit(size) if isinstance(size, int) else F.col(size)
    params = F.broadcast(params.crossJoin(nodes.agg(F.count("*").alias("_n"))).withColumn("_bound", hash_bound((4.0 * size + 400) / F.greatest("_n", F.lit(1)))))
    hashed = nodes.select("node").crossJoin(params).withColumn("h", order_hash(keys, seed))
    ranked = hashed.where(F.col("h") < F.col("_bound")).withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "node")))
    return ranked.where(F.col("rn") <= 2 * size).select(*keys, "node", F.when(F.col("rn") <= size, 1).otherwise(2).alias("arm"))


def sampled_neighbours(adj: DataFrame, sample: DataFrame, keys: tuple = ("sim",)) -> DataFrame:
    """(keys..., node, nd): how many neighbours of a node are in the sample; nodes without one are absent."""
    return spmv(adj, sample.select(*keys, "node", F.lit(1).cast("long").alias("value")), keys).withColumnRenamed("value", "nd")


def clean_egos(adj: DataFrame, sample: DataFrame, keys: tuple = ("sim",)) -> DataFrame:
    """The sampled nodes without a sampled neighbour."""
    return sample.join(sampled_neighbours(adj, sample, keys), [*keys, "node"], "left_anti")


def clean_alters(adj: DataFrame, sample: DataFrame, keys: tuple = ("sim",)) -> DataFrame:
    """(keys..., node): unsampled nodes with exactly one sampled neighbour."""
    return sampled_neighbours(adj, sample, keys).where("nd = 1").join(sample.select(*keys, "node"), [*keys, "node"], "left_anti").select(*keys, "node")


def arm_alters(adj: DataFrame, sample: DataFrame, keys: tuple = ("sim",)) -> DataFrame:
    """(keys..., arm, node): the clean alters next to an arm's egos."""
    near = neighbours_of(adj, sample.select(*keys, "arm", "node"), (*keys, "arm"))
    return near.join(clean_alters(adj, sample, keys), [*keys, "node"], "left_semi").select(*keys, "arm", "node")


def exclusion(adj: DataFrame, deg: DataFrame, sample: DataFrame, size: int, keys: tuple = ("sim",)) -> DataFrame:
    """(keys..., arm, size, pcent, avg_degree, ks): the clean egos of each arm; arms with none have size 0."""
    clean = clean_egos(adj, sample, keys).join(deg, "node")
    by = (*keys, "arm")
    stats = clean.groupBy(*by).agg(F.count("*").alias("size"), F.avg("degree").alias("avg_degree")).join(ks_two_sample(clean, deg, "degree", by), list(by))
    every = sample.select(*by).distinct()
    return every.join(stats, list(by), "left").select(*by, F.coalesce("size", F.lit(0)).alias("size"), (F.coalesce("size", F.lit(0)) / F.lit(size)).alias("pcent"), "avg_degree", "ks")


def contaminated_pairs(adj: DataFrame, sample: DataFrame, keys: tuple = ("sim",)) -> tuple[DataFrame, DataFrame]:
    """((keys..., node, mate) at distance 1, the same at distance exactly 2) within a sample, unfolded from sampled nodes only."""
    s = sample.select(*keys, "node")
    mate = s.withColumnRenamed("node", "mate")
    one = s.join(adj.select(F.col("src").alias("node"), F.col("dst").alias("mate")), "node").join(mate, [*keys, "mate"], "left_semi")
    pairs = hop2(adj, s).select(F.col("src").alias("node"), F.col("dst").alias("mate"))
    two = s.join(pairs, "node").join(mate, [*keys, "mate"], "left_semi")
    return one.select(*keys, "node", "mate"), two.select(*keys, "node", "mate")


def messages(adj: DataFrame, sample: DataFrame, keys: tuple, name: str) -> tuple[DataFrame, DataFrame]:
    """((keys..., node, dst) along the edges of sampled nodes, (keys..., dst, n) how many of them arrive), of a sample (keys..., node); both serve what lies within two steps without its paths."""
    folder = work_folder(adj.sparkSession)
    sent = written(sample.select(*keys, "node").join(adj.withColumnRenamed("src", "node"), "node").select(*keys, "node", "dst"), folder, f"{name}_sent")
    return sent, written(sent.groupBy(*keys, "dst").agg(F.count("*").alias("n")), folder, f"{name}_heard")


def sharing(sent: DataFrame, heard: DataFrame, keys: tuple) -> DataFrame:
    """(keys..., node) of the sampled nodes with a neighbour that another sampled node has, too."""
    return sent.join(heard.where("n > 1").select(*keys, "dst"), [*keys, "dst"], "left_semi").select(*keys, "node").distinct()


def contamination(adj: DataFrame, deg: DataFrame, sample: DataFrame, keys: tuple = ("sim",)) -> DataFrame:
    """(keys..., n, n1, n2, ct1_pct, deg_clean1, pct_clean1, deg_diff1, and the same with 2): contamination by neighbours, and by nodes within two steps, of the n sampled nodes."""
    sent, heard = messages(adj, sample, keys, "contamination")
    flag1 = heard.select(*keys, F.col("dst").alias("node"), F.lit(1).alias("c1"))
    flag2 = sharing(sent, heard, keys).withColumn("c2", F.lit(1))
    t = sample.select(*keys, "node").join(deg, "node").join(flag1, [*keys, "node"], "left").join(flag2, [*keys, "node"], "left")
    t = t.withColumn("c1", F.coalesce("c1", F.lit(0))).withColumn("c2", F.greatest("c1", F.coalesce("c2", F.lit(0))))
    pop = deg.agg(F.avg("degree").alias("pop_avg_degree"))
    r = t.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sum("c1").alias("n1"), F.sum("c2").alias("n2"),
        F.avg("c1").alias("ct1_pct"), F.avg(F.when(F.col("c1") == 0, F.col("degree"))).alias("deg_clean1"), F.avg(1 - F.col("c1")).alias("pct_clean1"),
        F.avg("c2").alias("ct2_pct"), F.avg(F.when(F.col("c2") == 0, F.col("degree"))).alias("deg_clean2"), F.avg(1 - F.col("c2")).alias("pct_clean2"),
    ).crossJoin(F.broadcast(pop))
    gap = lambda c: (F.col(c) - F.col("pop_avg_degree")) / F.col("pop_avg_degree")
    return r.withColumn("deg_diff1", gap("deg_clean1")).withColumn("deg_diff2", gap("deg_clean2"))


def contamination_sweep(adj: DataFrame, deg: DataFrame, params: DataFrame, seed: int = 0) -> DataFrame:
    """Means over sims by nsample of ``contamination`` on samples of 2 * nsample; params: (sim, nsample)."""
    keys = ("sim", "nsample")
    one = contamination(adj, deg, srs(deg, params, "nsample", keys, seed), keys)
    columns = []
    for j in (1, 2):
        # samples of one size: a mean of shares is a share of sums, which are whole
        hit, clean = F.sum(f"n{j}") / F.sum("n"), F.sum(F.col("n") - F.col(f"n{j}")) / F.sum("n")
        columns += [hit.alias(f"pcent_contaminated_{j}"), F.avg(f"deg_clean{j}").alias(f"avg_degree_clean_{j}"), clean.alias(f"pcent_clean_{j}"), F.avg(f"deg_diff{j}").alias(f"degree_diff_pct_{j}")]
    return one.groupBy(F.col("nsample").alias("sample_size")).agg(*columns, F.avg("pop_avg_degree").alias("pop_avg_degree"))


def excluded_attributes(adj: DataFrame, attributes: DataFrame, sample: DataFrame, columns: list[str]) -> DataFrame:
    """(attribute, population_mean, excluded_mean): the mean over sims of the contaminated egos' means."""
    hit = sample.join(sampled_neighbours(adj, sample), ["sim", "node"], "left_semi").join(attributes, "node")
    per = hit.groupBy("sim").agg(*[F.avg(c).alias(c) for c in columns]).agg(*[F.avg(c).alias(c) for c in columns])
    pop = attributes.agg(*[F.avg(c).alias(c) for c in columns])
    long = lambda t, name: t.unpivot([], columns, "attribute", name)
    return long(pop, "population_mean").join(long(per, "excluded_mean"), "attribute")


def attribute_pivot(long: DataFrame, networks: list[str]) -> DataFrame:
    """excluded_mean of (network, attribute, ...) with a column per network."""
    return long.groupBy("attribute").pivot("network", networks).agg(F.avg("excluded_mean"))


def second_degree(adj: DataFrame, attributes: DataFrame, clean: DataFrame, size: int) -> DataFrame:
    """Per sim, of clean egos (sim, node, arm): how many share an alter with another, or with a treated one, and what remains."""
    folder = work_folder(adj.sparkSession)
    # clean egos are no neighbours: those that share one are at distance 2
    sent = written(clean.select("sim", "node", (F.col("arm") == 1).cast("long").alias("treated")).join(adj.withColumnRenamed("src", "node"), "node").select("sim", "node", "treated", "dst"), folder, "sent")
    heard = sent.groupBy("sim", "dst").agg(F.count("*").alias("n"), F.sum("treated").alias("nt")).where("n > 1")
    two = written(sent.join(heard, ["sim", "dst"]).groupBy("sim", "node").agg(F.max(F.col("nt") > F.col("treated")).alias("by_treated")), folder, "two")
    ct2 = two.select("sim", "node")
    ct2_t = two.where("by_treated").select("sim", "node")
    first = clean.groupBy("sim").agg(F.count("*").alias("RM_1st_remain"))
    rest = clean.join(ct2, ["sim", "node"], "left_anti").join(attributes.select("node", "degree", "cluster_coef"), "node")
    rest = written(rest, folder, "rest")
    left = rest.groupBy("sim").agg(F.count("*").alias("RM_2nd_remain"), F.avg("degree").alias("avg_degree_2nd"), F.avg("cluster_coef").alias("avg_cluster_2nd"))
    pop = attributes.select("degree", "cluster_coef")
    ks_d = ks_two_sample(rest, pop, "degree", ("sim",)).withColumnRenamed("ks", "KS_degree_2nd")
    ks_c = ks_two_sample(rest, pop, "cluster_coef", ("sim",)).withColumnRenamed("ks", "KS_cluster_2nd")
    n2, n2t = ct2.groupBy("sim").agg(F.count("*").alias("n2")), ct2_t.groupBy("sim").agg(F.count("*").alias("n2t"))
    t = first.join(left, "sim", "left").join(ks_d, "sim", "left").join(ks_c, "sim", "left").join(n2, "sim", "left").join(n2t, "sim", "left")
    part = lambda c: F.coalesce(c, F.lit(0)) / F.col("RM_1st_remain")
    return t.select("sim", F.lit(size).alias("initial_sample"), "RM_1st_remain", part("n2").alias("pcent_2nd_contamination"), F.coalesce("RM_2nd_remain", F.lit(0)).alias("RM_2nd_remain"), "avg_degree_2nd", "avg_cluster_2nd", "KS_degree_2nd", "KS_cluster_2nd", part("n2t").alias("pcent_2nd_causal_contamination"))


def max_feasible_sweep(adj: DataFrame, attributes: DataFrame, params: DataFrame, seed: int = 0) -> DataFrame:
    """By nsample: means over sims of what remains after exclusion by neighbours, then by distance 2. Empty remainders are left out."""
    keys = ("sim", "nsample")
    folder = work_folder(adj.sparkSession)
    clean = written(clean_egos(adj, srs(attributes, params, "nsample", keys, seed), keys), folder, "clean")
    rest = written(clean.join(sharing(*messages(adj, clean, keys, "clean"), keys), [*keys, "node"], "left_anti"), folder, "rest")

    def stats(sample, suffix):
        t = sample.join(attributes.select("node", "degree"), "node")
        one = t.groupBy(*keys).agg(F.count("*").alias("remaining"), F.avg("degree").alias("avg_degree")).join(ks_two_sample(t, attributes, "degree", keys), list(keys))
        return one.groupBy("nsample").agg(F.avg("remaining").alias(f"remaining_{suffix}"), F.avg("avg_degree").alias(f"avg_degree_{suffix}"), F.avg("ks").alias(f"KS_degree_{suffix}"))

    return stats(clean, "1st").join(stats(rest, "2nd"), "nsample", "left")


def exclusion_boundary(adj: DataFrame, deg: DataFrame, params: DataFrame, seed: int = 0) -> DataFrame:
    """(nsample, avg_remain, avg_KS, feasible): sims with nothing left count as 0 remaining and no KS."""
    keys = ("sim", "nsample")
    clean = clean_egos(adj, srs(deg, params, "nsample", keys, seed), keys).join(deg, "node")
    one = clean.groupBy(*keys).agg(F.count("*").alias("n")).join(ks_two_sample(clean, deg, "degree", keys), list(keys))
    full = params.select(*keys).join(one, list(keys), "left")
    r = full.groupBy("nsample").agg(F.avg(F.coalesce("n", F.lit(0)) / 2).alias("avg_remain"), F.avg("ks").alias("avg_KS"))
    return r.withColumn("feasible", F.coalesce(F.col("avg_KS") < KS_THRESHOLD, F.lit(False)))


def max_feasible(boundary: DataFrame) -> DataFrame:
    """(max_remain): the most that remains at a feasible size, 0 if none."""
    return boundary.agg(F.coalesce(F.max(F.when(F.col("feasible"), F.col("avg_remain"))), F.lit(0.0)).alias("max_remain"))


def matched_size(summary: DataFrame) -> DataFrame:
    """(sim, nsample): the truncated mean size of the two arms of ``exclusion``."""
    return summary.groupBy("sim").agg(F.floor(F.avg("size")).cast("int").alias("nsample"))


def greedy_independent(adj: DataFrame, nodes: DataFrame, sims: DataFrame, size: int, hops: int = 1) -> DataFrame:
    """(sim, node): nodes in random order, each kept unless within ``hops`` of a kept one; the first ``size`` per sim.

    The order is by md5, so the result is the lexicographically first maximal
    independent set: in rounds, a live node that comes before all its live
    neighbours is kept and they go. A few rounds do, whatever the size. Only
    the nodes whose md5 is below a bound are looked at; where they hold too few,
    the bound is raised, until all nodes are below it.
    """
    folder = work_folder(adj.sparkSession)
    order = F.md5(F.concat_ws("-", F.col("node").cast("string"), F.col("sim").cast("string")))
    n = nodes.count()
    share, attempt = (4.0 * size + 400) / max(n, 1), 0
    while True:
        # what is kept of the first nodes of the order does not depend on those after them
        hashed = nodes.select("node").crossJoin(F.broadcast(sims.select("sim"))).withColumn("h", order)
        live = written(hashed.where(F.col("h") < hash_bound(F.lit(share))), folder, f"first{attempt}")
        kept = first_independent(live, rivals(adj, live, hops, whole=share >= 1), f"{folder}/{attempt}")
        ranked = kept.withColumn("rn", F.row_number().over(Window.partitionBy("sim").orderBy("h", "node")))
        out = ranked.where(F.col("rn") <= size)
        if share >= 1 or out.where(F.col("rn") == size).count() == sims.count():
            return out.select("sim", "node")
        share, attempt = share * 8, attempt + 1


def hash_bound(share: Column) -> Column:
    """The hexadecimal digits that a share of all md5 values is below; beyond all of them from 1 on."""
    bound = F.ceil(share * 2.0**32)
    return F.when(share >= 1, F.lit("g")).otherwise(F.lower(F.lpad(F.hex(bound.cast("long")), 8, "0")))


def rivals(adj: DataFrame, live: DataFrame, hops: int, whole: bool) -> DataFrame:
    """(sim, node, rival): of the nodes live (sim, node, h) those within ``hops`` of each other, the rival first in the order."""
    if hops == 2 and whole:
        adj = adj.unionByName(hop2(adj))  # no two-paths of a whole network
    sent = live.join(adj.withColumnRenamed("src", "node"), "node")
    later = live.select("sim", F.col("node").alias("rival"), F.col("h").alias("rh"))
    pairs = sent.withColumnRenamed("dst", "rival").join(later, ["sim", "rival"])
    if hops == 2 and not whole:
        heard = sent.select("sim", "dst", F.col("node").alias("rival"), F.col("h").alias("rh"))
        pairs = pairs.unionByName(sent.join(heard, ["sim", "dst"]).select(*pairs.columns))
    before = (F.col("rh") < F.col("h")) | ((F.col("rh") == F.col("h")) & (F.col("rival") < F.col("node")))
    return pairs.where(before).select("sim", "node", "rival").distinct()


def first_independent(live: DataFrame, rivals: DataFrame, folder: str) -> DataFrame:
    """The nodes (sim, node, h) of live without a kept rival, in rounds: a live node without live rivals is kept, and those that have it as a rival go."""
    rivals, kept, i = written(rivals, folder, "rivals0"), None, 0
    while not live.isEmpty():
        i += 1
        chosen = written(live.join(rivals.select("sim", "node").distinct(), ["sim", "node"], "left_anti"), folder, f"chosen{i}")
        kept = chosen if kept is None else kept.unionAll(chosen)
        named = chosen.select("sim", F.col("node").alias("rival"))
        gone = written(rivals.join(named, ["sim", "rival"], "left_semi").select("sim", "node").distinct(), folder, f"gone{i}")
        out = chosen.select("sim", "node").unionAll(gone)
        live = written(live.join(out, ["sim", "node"], "left_anti"), folder, f"live{i}")
        left = rivals.join(gone, ["sim", "node"], "left_anti").join(gone.withColumnRenamed("node", "rival"), ["sim", "rival"], "left_anti")
        rivals = written(left, folder, f"rivals{i}")
    return live if kept is None else kept


def representativeness(attributes: DataFrame, matched: DataFrame, excluded: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, population_value, represent, rp_vs_population, remove, rm_vs_population), means over sims; samples: (sim, node)."""

    def by_attribute(sample, mean, gap):
        out = None
        for c in columns:
            t = sample.join(attributes.select("node", c), "node")
            one = t.groupBy("sim").agg(F.avg(c).alias("m")).join(ks_two_sample(t, attributes, c, ("sim",)), "sim").agg(F.avg("m").alias(mean), F.avg("ks").alias(gap)).withColumn("variable", F.lit(c))
            out = one if out is None else out.unionByName(one)
        return out

    pop = attributes.agg(*[F.avg(c).alias(c) for c in columns]).unpivot([], columns, "variable", "population_value")
    return pop.join(by_attribute(matched, "represent", "rp_vs_population"), "variable").join(by_attribute(excluded, "remove", "rm_vs_population"), "variable")
