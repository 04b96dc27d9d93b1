"""Covariates, outcomes, exposure and effect estimators; sims and effect sizes are key columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netexp.functions.scalar import degree_group, hash_normal, hash_uniform, t975
from netexp.operators.graph import spmv, work_folder, written
from netexp.operators.sampling import arm_alters

#: Spillover, and the coefficients of the baseline outcome.
BETA = 0.5
ALPHA = (1.0, 0.5, -0.5, 0.5, -0.5)
TAU1 = [round(0.01 * i, 2) for i in range(11)]


def _scalars(t: DataFrame, *columns: Column) -> DataFrame:
    """The table with one-row aggregates beside every row: no window gathers all rows in one task."""
    return t.crossJoin(F.broadcast(t.agg(*columns)))


def zscores(t: DataFrame, columns: dict[str, str]) -> DataFrame:
    """The table with standard scores (population deviation) of columns, as {column: name of its score}; missing ones are 0."""
    t = _scalars(t, *[f(F.col(c)).alias(f"_{n}_{i}") for i, c in enumerate(columns) for f, n in ((F.avg, "m"), (F.stddev_pop, "sd"))])
    for i, (c, name) in enumerate(columns.items()):
        t = t.withColumn(name, F.coalesce(F.try_divide(F.col(c) - F.col(f"_m_{i}"), F.col(f"_sd_{i}")), F.lit(0.0)))
    return t.drop(*[f"_{n}_{i}" for i in range(len(columns)) for n in ("m", "sd")])


def covariates(deg: DataFrame) -> DataFrame:
    """(node, Z1, Z2, Z3): correlated with degree by -0.7 and 0.3, on [0, 10]; and a fair coin. Noise is hashed."""
    t = _scalars(deg.select("node", "degree"), F.avg("degree").alias("m"), F.stddev_pop("degree").alias("sd"))
    z = (F.col("degree") - F.col("m")) / F.col("sd")
    mixed = lambda rho, name: rho * z + (1 - rho * rho) ** 0.5 * hash_normal(F.col("node"), name)
    t = t.select("node", mixed(-0.7, "z1").alias("a"), mixed(0.3, "z2").alias("b"))
    t = _scalars(t, F.min("a").alias("a0"), F.max("a").alias("a1"), F.min("b").alias("b0"), F.max("b").alias("b1"))
    scale = lambda c: (F.col(c) - F.col(f"{c}0")) / (F.col(f"{c}1") - F.col(f"{c}0")) * 10
    return t.select("node", scale("a").alias("Z1"), scale("b").alias("Z2"), (hash_uniform(F.col("node"), "z3") < 0.5).cast("double").alias("Z3"))


def baseline_outcome(deg: DataFrame, cov: DataFrame, network: str = "simulated") -> DataFrame:
    """(node, y00, ego_effect). Networks: simulated (Z1, Z2, Z3), lastfm and twitch (x2), pokec (z1, z2)."""
    k, (a0, a1, a2, a3, a4) = F.col("degree"), ALPHA
    t = deg.select("node", "degree").join(cov, "node")
    if network in ("lastfm", "twitch"):
        t = zscores(t, {"x2": "_z"})
        mean = a0 + a1 * F.log(k + 1) + (a2 if network == "lastfm" else a3) * F.col("_z")
    elif network == "pokec":
        mean = a0 + a1 * F.log(k) + a3 * F.col("z1") + a4 * F.col("z2")
    else:
        mean = a0 + a1 * F.log(k) + a2 * F.log(F.col("Z1") + 1) + a3 * F.log(F.col("Z2") + 1) + a4 * F.col("Z3")
    return t.select("node", (mean + hash_normal(F.col("node"), "noise")).alias("y00"), hash_normal(F.col("node"), "ego").alias("ego_effect"))


#: Terms before the series of the gamma function, which is exact to 12 digits beyond them.
_SHIFT = 16


def log_products(top: Column, bottom: Column, k: Column) -> Column:
    """The logarithm of the product of (top - i) / (bottom - i) for i below k, all positive: ratios of gamma functions by Stirling's series.

    Both ratios are written with log1p(-k / x), so that nothing of the size of
    log gamma itself is subtracted: populations of any size keep their digits.
    """

    def part(z):
        """log gamma(z + 1) - log gamma(z + 1 - k) without its term k log x."""
        x = z + 1 + _SHIFT
        low = x - k
        series = lambda v: 1 / (12 * v) - 1 / (360 * v**3) + 1 / (1260 * v**5)
        out = -(low - 0.5) * F.log1p(-k / x) - k + series(x) - series(low)
        for j in range(1, _SHIFT + 1):
            out = out + F.log1p(-k / (z + j))
        return out

    return k * F.log((top + 1 + _SHIFT) / (bottom + 1 + _SHIFT)) + part(top) - part(bottom)


def exposure(deg: DataFrame, size: int) -> DataFrame:
    """(node, d11, d10, d0n, d01, d00): the exact chances that a node is an ego with or without sampled neighbours, or no ego with several, one or none, when ``size`` of all nodes are drawn.

    They depend on the degree only, so the products are made once a degree,
    in closed form (see log_products).
    """
    N, k, n = F.col("N"), F.col("degree").cast("double"), float(size)
    t = _scalars(deg.select("node", "degree"), F.count("*").cast("double").alias("N"))
    one = t.select("degree", "N").distinct()
    product = lambda top, bottom, steps: F.when(top - steps + 1 > 0, F.exp(log_products(top, bottom, steps))).otherwise(0.0)
    d10 = n / N * product(N - n, N - 1, k)
    d00 = (N - n) / N * product(N - 1 - n, N - 1, k)
    d01 = (N - n) / N * k * n / (N - 1) * F.when(k > 1, product(N - 1 - n, N - 2, k - 1)).otherwise(1.0)
    chances = one.select("degree", "N", d10.alias("d10"), d00.alias("d00"), d01.alias("d01"))
    chances = chances.select("degree", (n / N - F.col("d10")).alias("d11"), "d10", ((N - n) / N - F.col("d00") - F.col("d01")).alias("d0n"), "d01", "d00")
    return deg.select("node", "degree").join(F.broadcast(chances), "degree").select("node", "d11", "d10", "d0n", "d01", "d00")  # a row per degree


def exposure_draws(spark: SparkSession, adj: DataFrame, attributes: DataFrame, size: int, draws: int, seed: int = 0, parts: int = 8) -> DataFrame:
    """The same five columns as counts over random draws; drawn in ``parts`` tasks, each adding up its own."""
    from netexp.operators.mcmc import broadcast_population, seed_of

    shared = broadcast_population(spark, adj, attributes)

    def run(batches):
        for batch in batches:
            for part in batch.column(0).to_pylist():
                pop, rng = shared.value, np.random.default_rng(seed_of(seed, part, "draws"))
                n = len(pop.nodes)
                own = draws // parts + (part < draws % parts)
                # a draw touches its nodes and their neighbours; all others are d00 in it
                total, drawn = np.zeros((5, n), np.int32), np.zeros(n, bool)
                for _ in range(own):
                    egos = rng.choice(n, size, replace=False)
                    drawn[egos] = True
                    near, nd = np.unique(np.concatenate([pop.near[:0], *(pop.hop1(v) for v in egos)]), return_counts=True)
                    met = drawn[near]
                    total[0, near[met]] += 1
                    drawn[near[met]] = False
                    total[1, egos[drawn[egos]]] += 1
                    total[2, near[~met & (nd > 1)]] += 1
                    total[3, near[~met & (nd == 1)]] += 1
                    drawn[egos] = False
                total[4] = own - total[:4].sum(axis=0)
                yield pa.record_batch([pa.array(pop.nodes), *(pa.array(x, pa.int64()) for x in total)], names=["node", "d11", "d10", "d0n", "d01", "d00"])

    names = ["d11", "d10", "d0n", "d01", "d00"]
    rows = spark.range(parts).repartition(parts).mapInArrow(run, "node long, " + ", ".join(f"{c} long" for c in names))
    return rows.groupBy("node").agg(*[F.sum(c).alias(c) for c in names])


def with_effect_sizes(sample: DataFrame, taus: list[float]) -> DataFrame:
    """A sample (sim, ...) once for each effect size: ``sim`` becomes the struct (tau1, sim), so one plan serves all sizes."""
    sizes = F.array(*[F.lit(float(x)) for x in taus])
    return sample.withColumn("_tau1", F.explode(sizes)).withColumn("sim", F.struct(F.col("_tau1").alias("tau1"), F.col("sim"))).drop("_tau1")


def realised_outcome(adj: DataFrame, deg: DataFrame, base: DataFrame, sample: DataFrame, tau1=0.05, members: DataFrame | None = None) -> DataFrame:
    """(sim, node, y): y00 + tau T + beta A (tau T) + ego d + A (ego d), with tau = tau1 * degree; T: egos of arm 1, d: egos.

    tau1: a number or a column. Of all nodes in every sim, or of ``members`` (sim, node).
    """
    t = sample.join(deg, "node").join(base, "node").select("sim", "node", F.when(F.col("arm") == 1, tau1 * F.col("degree")).otherwise(0.0).alias("tt"), F.col("ego_effect").alias("eg"))
    own = t.select("sim", "node", (F.col("tt") + F.col("eg")).alias("value"))
    near = spmv(adj, t.select("sim", "node", (BETA * F.col("tt") + F.col("eg")).alias("value")), ("sim",))
    added = own.unionByName(near).groupBy("sim", "node").agg(F.sum("value").alias("value"))
    base = base.select("node", "y00")
    nodes = base.crossJoin(F.broadcast(sample.select("sim").distinct())) if members is None else members.select("sim", "node").join(base, "node")
    return nodes.join(added, ["sim", "node"], "left").select("sim", "node", (F.col("y00") + F.coalesce("value", F.lit(0.0))).alias("y"))


def t_test(values: DataFrame, true_value, keys: tuple = ("sim",), nodes: DataFrame | None = None) -> DataFrame:
    """(keys..., est, se, t, lo, hi, power, coverage) of values (keys..., arm 1 or 2, y). Pooled variance; power: lo > 0.

    Missing y are dropped. With ``nodes`` each arm has a value for every node of
    it instead, 0 where there is none: only the present ones are added up.
    """
    arm = lambda a: F.when(F.col("arm") == a, F.col("y"))
    if nodes is None:
        arms = values.where("y is not null").groupBy(*keys).agg(*[f(arm(a)).alias(f"{n}{a}") for a in (1, 2) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    else:
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        arms = values.groupBy(*keys).agg(*[zero(F.sum(arm(a) ** p)).alias(f"s{p}{a}") for a in (1, 2) for p in (1, 2)]).crossJoin(F.broadcast(nodes.agg(F.count("*").alias("N"))))
        every = F.col("N")
        arms = arms.select(*keys, *[c for a in (1, 2) for c in (every.alias(f"n{a}"), (F.col(f"s1{a}") / every).alias(f"m{a}"), ((F.col(f"s2{a}") - F.col(f"s1{a}") * F.col(f"s1{a}") / every) / (every - 1)).alias(f"v{a}"))])
    return test_of_arms(arms, true_value if isinstance(true_value, Column) else F.lit(true_value), keys)


def test_of_arms(arms: DataFrame, true_value: Column, keys: tuple) -> DataFrame:
    """The t-tests of arms (keys..., n1, m1, v1, n2, m2, v2)."""
    n1, n2 = F.col("n1"), F.col("n2")
    df = n1 + n2 - 2
    se = F.sqrt(((n1 - 1) * F.col("v1") + (n2 - 1) * F.col("v2")) / df * (1 / n1 + 1 / n2))
    r = arms.select(*keys, (F.col("m1") - F.col("m2")).alias("est"), se.alias("se"), df.alias("df"))
    half = t975(F.col("df")) * F.col("se")
    r = r.select(*keys, "est", "se", F.try_divide(F.col("est"), F.col("se")).alias("t"), (F.col("est") - half).alias("lo"), (F.col("est") + half).alias("hi"))
    return r.withColumn("power", F.col("lo") > 0).withColumn("coverage", (F.col("lo") < true_value) & (true_value < F.col("hi")))


def observed(outcome: DataFrame, members: DataFrame) -> DataFrame:
    """(sim, arm, node, y) of members (sim, arm, node); an outcome of exactly 0 is missing."""
    return members.join(outcome, ["sim", "node"]).select("sim", "arm", "node", F.nullif("y", F.lit(0.0)).alias("y"))


def weighted(obs: DataFrame, expo: DataFrame, column: str) -> DataFrame:
    """Observed outcomes over their exposure (halved: either arm); no exposure: missing. ``w`` is the weight."""
    half = F.col(column) / 2
    return obs.join(expo.select("node", column), "node").select("sim", "arm", "node", F.try_divide(F.col("y"), half).alias("y"), F.when(F.col("y").isNotNull(), F.try_divide(F.lit(1.0), half)).alias("w"))


def hajek(values: DataFrame, nodes: DataFrame) -> DataFrame:
    """Weighted outcomes over the mean weight of their arm (over all nodes)."""
    total = nodes.agg(F.count("*").alias("N"))
    norm = values.groupBy("sim", "arm").agg(F.sum("w").alias("sw")).crossJoin(F.broadcast(total))
    return values.join(norm, ["sim", "arm"]).select("sim", "arm", "node", F.try_divide(F.col("y"), F.col("sw") / F.col("N")).alias("y"))


def alter_means(adj: DataFrame, egos: DataFrame, alters: DataFrame) -> DataFrame:
    """(sim, arm, node, y): per ego the mean outcome of its alters (sim, arm, node, y); egos without one are missing."""
    near = egos.select("sim", "arm", F.col("node").alias("src")).join(adj, "src").withColumnRenamed("dst", "node")
    return near.join(alters.select("sim", "arm", "node", "y"), ["sim", "arm", "node"]).groupBy("sim", "arm", F.col("src").alias("node")).agg(F.avg("y").alias("y"))


def alter_sums(adj: DataFrame, deg: DataFrame, egos: DataFrame, alters: DataFrame, by_weight: bool) -> DataFrame:
    """Per ego the sum of its alters' weighted outcomes over its degree (no alter: 0), or over their weights (none: missing)."""
    near = egos.select("sim", "arm", F.col("node").alias("src")).join(adj, "src").withColumnRenamed("dst", "node")
    sums = near.join(alters, ["sim", "arm", "node"]).groupBy("sim", "arm", F.col("src").alias("node")).agg(F.sum("y").alias("sy"), F.sum("w").alias("sw"))
    if by_weight:
        return sums.select("sim", "arm", "node", F.try_divide(F.col("sy"), F.col("sw")).alias("y"))
    return egos.select("sim", "arm", "node").join(sums, ["sim", "arm", "node"], "left").join(deg, "node").select("sim", "arm", "node", (F.coalesce("sy", F.lit(0.0)) / F.col("degree")).alias("y"))


def estimates(adj: DataFrame, deg: DataFrame, base: DataFrame, expo: DataFrame, sample: DataFrame, egos: DataFrame, tau1, mean_degree: float) -> dict[str, DataFrame]:
    """The t-tests of DIM, HT and Hajek for the effect on egos (dte) and on alters (ite): name -> (sim, est, se, ...). tau1: a number or a column."""
    folder = work_folder(adj.sparkSession)
    near = written(arm_alters(adj, sample), folder, "near")
    members = egos.select("sim", "node").unionAll(near.select("sim", "node")).distinct()
    outcome = written(realised_outcome(adj, deg, base, sample, tau1, members), folder, "outcome")
    obs = observed(outcome, egos.select("sim", "arm", "node"))
    alters = observed(outcome, near)
    true_d = tau1 * mean_degree
    true_i = BETA * true_d
    ht_e, ht_a = weighted(obs, expo, "d10"), weighted(alters, expo, "d01")
    return {
        "dim_dte": t_test(obs, true_d),
        "dim_ite": t_test(alter_means(adj, egos, alters), true_i),
        "ht_dte": t_test(ht_e, true_d, nodes=deg),
        "ht_ite": t_test(alter_sums(adj, deg, egos, ht_a, False), true_i),
        "hajek_dte": t_test(hajek(ht_e, deg), true_d, nodes=deg),
        "hajek_ite": t_test(alter_sums(adj, deg, egos, ht_a, True), true_i),
    }


def cate(deg: DataFrame, obs: DataFrame, network: str) -> DataFrame:
    """(sim, degree_group, est): difference in means by degree group."""
    t = obs.join(deg.select("node", degree_group(F.col("degree"), network).alias("degree_group")), "node")
    return t.groupBy("sim", "degree_group").agg((F.avg(F.when(F.col("arm") == 1, F.col("y"))) - F.avg(F.when(F.col("arm") == 2, F.col("y")))).alias("est"))


def cate_by_estimator(groups: DataFrame, estimators: list[str], keys: tuple = ()) -> DataFrame:
    """(keys..., sim, degree_group, estimator, est): of ``estimators`` the first has the estimates of ``groups``, the others null ones: their groups are not estimated."""
    est = F.when(F.col("estimator") == estimators[0], F.col("est")).alias("est")
    return groups.withColumn("estimator", F.explode(F.array(*map(F.lit, estimators)))).select(*keys, "sim", "degree_group", "estimator", est)


def effect_table(tests: DataFrame, keys: list[str], true_value: str = "true_value") -> DataFrame:
    """Over sims: avg_est, avg_se, sd_est, bias, MAE, mse, rmse, power, coverage of tests (keys..., true_value, est, se, power, coverage)."""
    gap = F.col("est") - F.col(true_value)
    r = tests.groupBy(*keys).agg(
        F.avg(true_value).alias("true_value"), F.avg("est").alias("avg_est"), F.avg("se").alias("avg_se"), F.stddev_pop("est").alias("sd_est"), F.avg(gap).alias("bias"),
        F.avg(F.abs(gap)).alias("MAE"), F.avg(gap * gap).alias("mse"), F.avg(F.col("power").cast("double")).alias("power"), F.avg(F.col("coverage").cast("double")).alias("coverage"),
    )
    return r.withColumn("rmse", F.sqrt("mse"))


def ate_grid(tests: dict[str, DataFrame], mean_degree: float) -> DataFrame:
    """effect_table by (tau1, estimator, estimand) of tests named <estimator>_<dte or ite> whose ``sim`` is (tau1, sim)."""
    out = None
    for name, t in tests.items():
        estimator, kind = name.split("_")
        true = F.col("sim.tau1") * (mean_degree * (1.0 if kind == "dte" else BETA))
        one = t.select(F.col("sim.tau1").alias("tau1"), F.lit(estimator).alias("estimator"), F.lit("d10" if kind == "dte" else "d01").alias("estimand"), true.alias("true_value"), "est", "se", "power", "coverage")
        out = one if out is None else out.unionByName(one)
    return effect_table(out, ["tau1", "estimator", "estimand"])


def cate_table(groups: DataFrame, true_groups: DataFrame, keys: tuple = ()) -> DataFrame:
    """(keys..., degree_group, true_cate, avg_cate_est, sd_cate_est, MAE, rmse) of cate (keys..., sim, degree_group, est). A null estimate stays null."""
    gap = F.col("est") - F.col("true_cate")
    on = [c for c in (*keys, "degree_group") if c in true_groups.columns]
    t = groups.join(F.broadcast(true_groups), on)  # a row per group
    return t.groupBy(*keys, "degree_group").agg(F.avg("true_cate").alias("true_cate"), F.avg("est").alias("avg_cate_est"), F.stddev_pop("est").alias("sd_cate_est"), F.avg(F.abs(gap)).alias("MAE"), F.sqrt(F.avg(gap * gap)).alias("rmse"))


def true_effects(deg: DataFrame, tau1, network: str) -> DataFrame:
    """(degree_group, true_cate): the mean of tau1 * degree by group; for a list of effect sizes (tau1, degree_group, true_cate)."""
    mean = deg.groupBy(degree_group(F.col("degree"), network).alias("degree_group")).agg(F.avg("degree").alias("mean"))
    if isinstance(tau1, list):
        return mean.withColumn("tau1", F.explode(F.array(*[F.lit(float(x)) for x in tau1]))).select("tau1", "degree_group", (F.col("tau1") * F.col("mean")).alias("true_cate"))
    return mean.select("degree_group", (tau1 * F.col("mean")).alias("true_cate"))
