"""Effect tables for any number of effect sizes at the cost of one.

An outcome is a line in the effect size tau: y = a + tau b, where a is what
comes without treatment and b what a unit of tau adds by own and neighbours'
treatment. All estimators are linear in y, so their values are lines, too, and
a t-test needs the moments of (a, b) by arm: means, variances, one covariance.
Tables of effect sizes are arithmetic on these, a row for each simulation and
estimator. An outcome of exactly 0 counts as missing; if any is at one of the
sizes, the tables are made from the outcomes of each size instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netexp.functions.scalar import degree_group
from netexp.functions.tables import work_folder, written
from netexp.operators import causal
from netexp.operators.causal import BETA


def outcome_lines(adj: DataFrame, deg: DataFrame, base: DataFrame, sample: DataFrame, members: DataFrame) -> DataFrame:
    """(sim, node, a, b) of members (sim, node): the outcome of causal.realised_outcome at tau1 is a + tau1 * b."""
    t = sample.join(deg.select("node", "degree"), "node").join(base, "node").select("sim", "node", F.when(F.col("arm") == 1, F.col("degree").cast("double")).otherwise(0.0).alias("tt"), F.col("ego_effect").alias("eg"))
    near = t.withColumnRenamed("node", "dst").join(adj, "dst").groupBy("sim", F.col("src").alias("node")).agg(F.sum("eg").alias("na"), F.sum(BETA * F.col("tt")).alias("nb"))
    r = members.select("sim", "node").distinct().join(base.select("node", "y00"), "node").join(t, ["sim", "node"], "left").join(near, ["sim", "node"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return r.select("sim", "node", (F.col("y00") + zero("eg") + zero("na")).alias("a"), (zero("tt") + zero("nb")).alias("b"))


def _weighted(obs: DataFrame, expo: DataFrame, column: str) -> DataFrame:
    half = F.col(column) / 2
    t = obs.join(expo.select("node", column), "node")
    return t.select("sim", "arm", "node", F.try_divide(F.col("a"), half).alias("a"), F.try_divide(F.col("b"), half).alias("b"), F.try_divide(F.lit(1.0), half).alias("w"))


def estimator_lines(adj: DataFrame, deg: DataFrame, expo: DataFrame, egos: DataFrame, alters: DataFrame, lines: DataFrame, names: dict) -> DataFrame:
    """(estimator, estimand, filled, sim, arm, a, b): the values that the t-tests compare, as lines; filled ones stand beside a 0 for every other node."""
    obs = egos.select("sim", "arm", "node").join(lines, ["sim", "node"])
    oa = alters.select("sim", "arm", "node").join(lines, ["sim", "node"])
    near = egos.select("sim", "arm", F.col("node").alias("ego")).join(adj.select(F.col("src").alias("ego"), F.col("dst").alias("node")), "ego")
    of_ego = lambda t, *agg: near.join(t, ["sim", "arm", "node"]).groupBy("sim", "arm", "ego").agg(*agg)
    tag = lambda t, name, kind, filled=False: t.select(F.lit(names[name]).alias("estimator"), F.lit(kind).alias("estimand"), F.lit(filled).alias("filled"), "sim", "arm", "a", "b")
    parts = []
    if "dim" in names:
        parts += [tag(obs, "dim", "d10"), tag(of_ego(oa, F.avg("a").alias("a"), F.avg("b").alias("b")), "dim", "d01")]
    if "ht" in names:
        he, ha = _weighted(obs, expo, "d10"), _weighted(oa, expo, "d01")
        sums = of_ego(ha, F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum("w").alias("sw"))
        every = egos.select("sim", "arm", F.col("node").alias("ego")).join(sums, ["sim", "arm", "ego"], "left").join(deg.select(F.col("node").alias("ego"), "degree"), "ego")
        norm = he.groupBy("sim", "arm").agg(F.sum("w").alias("sw")).crossJoin(F.broadcast(deg.agg(F.count("*").alias("N"))))
        ratio = lambda c: F.try_divide(F.col(c), F.col("sw") / F.col("N")).alias(c)
        parts += [
            tag(he, "ht", "d10", True), tag(every.select("sim", "arm", *[(F.coalesce(f"s{c}", F.lit(0.0)) / F.col("degree")).alias(c) for c in "ab"]), "ht", "d01"),
            tag(he.drop("w").join(norm, ["sim", "arm"]).select("sim", "arm", ratio("a"), ratio("b")), "hajek", "d10", True), tag(sums.select("sim", "arm", F.try_divide("sa", "sw").alias("a"), F.try_divide("sb", "sw").alias("b")), "hajek", "d01"),
        ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def arm_moments(lines: DataFrame, nodes: DataFrame) -> DataFrame:
    """By estimator, estimand and sim, of each arm: n, means (a, b), variances (aa, bb) and covariance (ab), with the zeros of filled ones."""
    at = lambda arm, c: F.when(F.col("arm") == arm, F.col(c))
    agg = []
    for k in (1, 2):
        agg += [F.count(at(k, "a")).alias(f"n{k}"), F.avg(at(k, "a")).alias(f"a{k}"), F.avg(at(k, "b")).alias(f"b{k}"), F.var_samp(at(k, "a")).alias(f"aa{k}"), F.var_samp(at(k, "b")).alias(f"bb{k}"), F.covar_samp(at(k, "a"), at(k, "b")).alias(f"ab{k}")]
    t = lines.groupBy("estimator", "estimand", "filled", "sim").agg(*agg).crossJoin(F.broadcast(nodes.agg(F.count("*").alias("N"))))
    columns = []
    for k in (1, 2):
        n, m = F.col(f"n{k}"), F.when(F.col("filled"), F.col("N")).otherwise(F.col(f"n{k}"))
        zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
        columns += [m.alias(f"n{k}"), *[F.when(F.col("filled"), n * zero(f"{c}{k}") / F.col("N")).otherwise(F.col(f"{c}{k}")).alias(f"{c}{k}") for c in "ab"]]
        for x, y in ("aa", "bb", "ab"):
            both = ((n - 1) * zero(f"{x}{y}{k}") + n * (1 - n / F.col("N")) * zero(f"{x}{k}") * zero(f"{y}{k}")) / (F.col("N") - 1)
            columns.append(F.when(F.col("filled"), both).otherwise(F.col(f"{x}{y}{k}")).alias(f"{x}{y}{k}"))
    return t.select("estimator", "estimand", "sim", *columns)


def _each(t: DataFrame, taus: list[float]) -> DataFrame:
    return t.withColumn("tau1", F.explode(F.array(*[F.lit(float(x)) for x in taus])))


def line_tests(moments: DataFrame, taus: list[float], mean_degree: float) -> DataFrame:
    """(tau1, estimator, estimand, sim, true_value, est, se, t, lo, hi, power, coverage): the t-tests of all effect sizes from moments."""
    tau = F.col("tau1")
    at: dict[str, Column] = {f"m{k}": F.col(f"a{k}") + tau * F.col(f"b{k}") for k in (1, 2)}
    at |= {f"v{k}": F.col(f"aa{k}") + 2 * tau * F.col(f"ab{k}") + tau * tau * F.col(f"bb{k}") for k in (1, 2)}
    true = tau * mean_degree * F.when(F.col("estimand") == "d10", 1.0).otherwise(BETA)
    keys = ("tau1", "estimator", "estimand", "sim", "true_value")
    arms = _each(moments, taus).withColumn("true_value", true).select(*keys, "n1", "n2", *[c.alias(n) for n, c in at.items()])
    return causal.test_of_arms(arms, F.col("true_value"), keys)


def group_lines(deg: DataFrame, obs: DataFrame, network: str) -> DataFrame:
    """(sim, degree_group, a, b): the difference in means of the arms by degree group, as a line."""
    t = obs.join(deg.select("node", degree_group(F.col("degree"), network).alias("degree_group")), "node")
    gap = lambda c: (F.avg(F.when(F.col("arm") == 1, F.col(c))) - F.avg(F.when(F.col("arm") == 2, F.col(c)))).alias(c)
    return t.groupBy("sim", "degree_group").agg(gap("a"), gap("b"))


def effects(adj: DataFrame, deg: DataFrame, base: DataFrame, expo: DataFrame, sample: DataFrame, egos: DataFrame, taus: list[float], mean_degree: float, network: str, names: dict) -> tuple[DataFrame, DataFrame]:
    """((tau1, estimator, estimand, sim, true_value, est, se, ...), (tau1, sim, degree_group, est)) of a sample (sim, node, arm) and its clean egos, at all effect sizes.

    names: what the estimators dim, ht and hajek are called; ht and hajek go together.
    """
    folder = work_folder(adj.sparkSession)
    near = written(causal.arm_alters(adj, sample), folder, "near")
    members = egos.select("sim", "node").unionAll(near.select("sim", "node"))
    lines = written(outcome_lines(adj, deg, base, sample, members), folder, "lines")
    missing = F.lit(False)
    for x in taus:
        missing = missing | (F.col("a") + float(x) * F.col("b") == 0)
    if not lines.where(missing).isEmpty():
        return _plainly(adj, deg, base, expo, sample, egos, taus, mean_degree, network, names)
    tests = line_tests(arm_moments(estimator_lines(adj, deg, expo, egos, near, lines, names), deg), taus, mean_degree)
    groups = _each(group_lines(deg, egos.select("sim", "arm", "node").join(lines, ["sim", "node"]), network), taus)
    return tests, groups.select("tau1", "sim", "degree_group", (F.col("a") + F.col("tau1") * F.col("b")).alias("est"))


def _plainly(adj, deg, base, expo, sample, egos, taus, mean_degree, network, names):
    """The same from the outcomes of each effect size."""
    folder = work_folder(adj.sparkSession)
    sample, egos = (written(causal.with_effect_sizes(t, taus), folder, name) for t, name in ((sample, "sample"), (egos, "egos")))
    tau = F.col("sim.tau1")
    out = None
    for name, t in causal.estimates(adj, deg, base, expo, sample, egos, tau, mean_degree).items():
        estimator, kind = name.split("_")
        if estimator in names:
            true = tau * (mean_degree * (1.0 if kind == "dte" else BETA))
            one = t.select(tau.alias("tau1"), F.lit(names[estimator]).alias("estimator"), F.lit("d10" if kind == "dte" else "d01").alias("estimand"), F.col("sim.sim").alias("sim"), true.alias("true_value"), "est", "se", "t", "lo", "hi", "power", "coverage")
            out = one if out is None else out.unionByName(one)
    seen = causal.observed(causal.realised_outcome(adj, deg, base, sample, tau, egos), egos.select("sim", "arm", "node"))
    groups = causal.cate(deg, seen, network).select(tau.alias("tau1"), F.col("sim.sim").alias("sim"), "degree_group", "est")
    return out, groups
