"""Distributions and distances, by group: every function takes ``keys``, the columns that identify a sample."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netexp.functions.ranks import dominance, dominance_counts, running_sums


def epdf(values: DataFrame, columns: list[str], keys: tuple = ()) -> DataFrame:
    """(keys..., columns..., p): relative frequencies."""
    counts = values.groupBy(*keys, *columns).agg(F.count("*").alias("n"))
    total = values.groupBy(*keys).agg(F.count("*").alias("total")) if keys else values.agg(F.count("*").alias("total"))
    joined = counts.join(total, list(keys)) if keys else counts.crossJoin(F.broadcast(total))
    return joined.select(*keys, *columns, (F.col("n") / F.col("total")).alias("p"))


def _points(t: DataFrame, x: str, y: str) -> DataFrame:
    return t.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), F.col(y).alias("y"))


def joint_cdf(nodes: DataFrame, x: str, y: str, support: DataFrame, keys: tuple = ()) -> DataFrame:
    """(keys..., x, y, f): P(X <= x, Y <= y) at the distinct support points (x, y).

    Without keys by dominance counts in range partitions; with keys every
    sample's points are counted at the support where that lies.
    """
    if keys:
        at = _points(support, x, y).distinct()
        return _at_points(nodes, at.withColumn("g", F.lit(0.0)), x, y, keys).select(*keys, F.col("x").alias(x), F.col("y").alias(y), "f")
    own = _points(nodes, x, y).groupBy("x", "y").agg(F.count("*").alias("n")).withColumn("asked", F.lit(0))
    both = own.unionByName(_points(support, x, y).distinct().select("x", "y", F.lit(0).cast("long").alias("n"), F.lit(1).alias("asked")))
    points = both.groupBy("x", "y").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    below = dominance(points).join(points.where("asked = 1").select("x", "y"), ["x", "y"], "left_semi")
    total = nodes.agg(F.count("*").alias("total"))
    return below.crossJoin(F.broadcast(total)).select(F.col("x").alias(x), F.col("y").alias(y), (F.col("below") / F.col("total")).alias("f"))


#: Points of samples that are broadcast at once, 16 bytes each.
BLOCK_POINTS = 1 << 21


def _sample_blocks(sample: DataFrame, x: str, y: str, keys: tuple):
    """(names of the samples, their points as (x, y) arrays) in blocks of BLOCK_POINTS; samples are drawn, so one of them is small beside a population."""
    sized = sample.groupBy(*keys).agg(F.count("*").alias("_n")).collect()
    at, names = 0, []
    for row in [*sized, None]:
        if names and (row is None or at + row["_n"] > BLOCK_POINTS):
            wanted = sample.sparkSession.createDataFrame([tuple(r) for r in names], sample.select(*keys).schema) if keys else None
            part = sample.join(F.broadcast(wanted), list(keys), "left_semi") if keys else sample
            t = part.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).toArrow()
            number = {tuple(r): i for i, r in enumerate(names)}
            which = np.array([number[k] for k in zip(*(t.column(c).to_pylist() for c in keys), strict=True)] if keys else [0] * t.num_rows, dtype=np.int64)
            order = np.argsort(which, kind="stable")
            bounds = np.searchsorted(which[order], np.arange(len(names) + 1))
            xs, ys = (t.column(c).to_numpy()[order] for c in ("_x", "_y"))
            yield names, [(xs[a:b], ys[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            at, names = 0, []
        if row is not None:
            if row["_n"] > BLOCK_POINTS:
                raise ValueError(f"a sample of {row['_n']} points is a population: join it with joint_cdf")
            at += row["_n"]
            names.append([row[k] for k in keys])


def _over_points(sample: DataFrame, at: DataFrame, x: str, y: str, keys: tuple, run, schema: str) -> DataFrame:
    """``run(number, x, y, g, f)`` for every sample over each task's points (x, y, g), f being the sample's distribution there; with the keys of the samples."""
    spark = sample.sparkSession
    out = None
    for names, samples in _sample_blocks(sample.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, y, keys):
        shared = spark.sparkContext.broadcast(samples)

        def count(batches, shared=shared):
            for batch in batches:
                px, py, g = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
                for i, (sx, sy) in enumerate(shared.value):
                    f = dominance_counts(sx, sy, np.ones(len(sx), dtype=np.int64), px, py) / len(sx)
                    yield run(i, px, py, g, f)

        rows = at.select(F.col("x").cast("double"), F.col("y").cast("double"), "g").mapInArrow(count, schema)
        if keys:
            fields = sample.select(*keys).schema
            named = spark.createDataFrame([(i, *n) for i, n in enumerate(names)], "number int, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields))
            rows = rows.join(F.broadcast(named), "number")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        empty = sample.select(*keys).limit(0)
        out = empty.select(*keys, *[F.lit(None).cast(f.split()[1]).alias(f.split()[0]) for f in schema.split(", ")])
    return out.drop("number")


def _at_points(sample, at, x, y, keys):
    def each(i, px, py, g, f):
        return pa.record_batch([pa.array(np.full(len(f), i, dtype=np.int32)), pa.array(px), pa.array(py), pa.array(f)], names=["number", "x", "y", "f"])

    kinds = dict(at.dtypes)
    t = _over_points(sample, at, x, y, keys, each, "number int, x double, y double, f double")
    return t.select(*keys, F.col("x").cast(kinds["x"]), F.col("y").cast(kinds["y"]), "f")


def joint_ks(sample: DataFrame, population: DataFrame, x: str, y: str, keys: tuple = ()) -> DataFrame:
    """(keys..., ks): the largest gap between the joint distributions, over the population's points.

    The population's distribution is one dominance count in range partitions.
    Samples are broadcast in blocks of bounded size; a task counts each at its
    own points by merging, without comparing pairs, and a maximum leaves it.
    """

    def largest(i, px, py, g, f):
        return pa.record_batch([pa.array([i], pa.int32()), pa.array([float(np.max(np.abs(f - g)))] if len(f) else pa.array([None], pa.float64()))], names=["number", "ks"])

    g = joint_cdf(population, x, y, population).select(F.col(x).alias("x"), F.col(y).alias("y"), F.col("f").alias("g"))
    gaps = _over_points(sample, g, x, y, keys, largest, "number int, ks double")
    return gaps.groupBy(*keys).agg(F.max("ks").alias("ks")) if keys else gaps.agg(F.max("ks").alias("ks"))


def population_cdf(population: DataFrame, value: str, also: DataFrame) -> DataFrame:
    """(value, np, part, at, below): the population's distribution at its values and those of ``also``, and just below them; running sums in range partitions."""
    counts = population.groupBy(value).agg(F.count("*").alias("np")).unionByName(also.select(value, F.lit(0).cast("long").alias("np"))).groupBy(value).agg(F.sum("np").alias("np"))
    total = population.agg(F.count("*").alias("tp"))
    cdf = running_sums(counts, [value], ["np"]).crossJoin(F.broadcast(total))
    return cdf.select(value, "np", "part", (F.col("upto_np") / F.col("tp")).alias("at"), ((F.col("upto_np") - F.col("np")) / F.col("tp")).alias("below"), "upto_np", "tp")


def ks_two_sample(sample: DataFrame, population: DataFrame, value: str, keys: tuple = ()) -> DataFrame:
    """(keys..., ks): the largest gap between two empirical distributions. The population is one; samples are per keys.

    Between two values of a sample its distribution is constant and the
    population's rises, so the gap is largest at a value of the sample or just
    below one; the population's distribution is made once, at its and the
    samples' values, and no sample meets all of them.
    """
    smp = sample.groupBy(*keys, value).agg(F.count("*").alias("ns"))
    cdf = population_cdf(population, value, smp)
    whole = Window.partitionBy(*keys)
    cs, ts = F.sum("ns").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)), F.sum("ns").over(whole)
    f = smp.select(*keys, value, (cs / ts).alias("f"), ((cs - F.col("ns")) / ts).alias("f_below")).join(cdf, value)
    gap = F.max(F.greatest(F.abs(F.col("f") - F.col("at")), F.abs(F.col("f_below") - F.col("below")))).alias("ks")
    return f.groupBy(*keys).agg(gap) if keys else f.agg(gap)


def ks_linear(sample: DataFrame, population: DataFrame, value: str, keys: tuple = ()) -> DataFrame:
    """As ks_two_sample, but looked at only where the population has values."""
    return ks_two_sample(sample.join(population.select(value).distinct(), value, "left_semi"), population, value, keys)


def kl_joint(sample: DataFrame, population: DataFrame, columns: list[str], keys: tuple = ()) -> DataFrame:
    """(keys..., kl): divergence of the population from the sample; a missing cell of the sample is 1e-10, both sum to 1 again."""
    p = epdf(population, columns).withColumnRenamed("p", "pp")
    q = epdf(sample, columns, keys).withColumnRenamed("p", "q")
    cells = sample.select(*keys).distinct().crossJoin(p) if keys else p
    joined = cells.join(q, [*keys, *columns], "left").withColumn("q", F.coalesce("q", F.lit(1e-10)))
    whole = Window.partitionBy(*keys)
    norm = joined.withColumn("q", F.col("q") / F.sum("q").over(whole)).withColumn("pp", F.col("pp") / F.sum("pp").over(whole))
    kl = F.sum(F.col("pp") * F.log(F.col("pp") / F.col("q"))).alias("kl")
    return norm.groupBy(*keys).agg(kl) if keys else norm.agg(kl)


def kl_univariate(sample: DataFrame, population: DataFrame, value: str, keys: tuple = ()) -> DataFrame:
    """(keys..., kl): |sum s ln(s / g)| over the values that both have."""
    s = epdf(sample, [value], keys).withColumnRenamed("p", "s")
    joined = s.join(epdf(population, [value]).withColumnRenamed("p", "g"), value)
    kl = F.abs(F.sum(F.col("s") * F.log(F.col("s") / F.col("g")))).alias("kl")
    return joined.groupBy(*keys).agg(kl) if keys else joined.agg(kl)


def harmonic(k: Column) -> Column:
    """1 + 1/2 + ... + 1/k by the asymptotic series, 32 terms further on, where it is exact to 12 digits."""
    x = k + 32
    series = F.log(x) + 0.5772156649015329 + 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4)
    return series - reduce(lambda a, b: a + b, [1 / (k + i) for i in range(1, 33)])


def harmonic_squares(k: Column) -> Column:
    """1 + 1/4 + ... + 1/k^2, in the same way."""
    x = k + 32
    series = math.pi**2 / 6 - 1 / x + 1 / (2 * x**2) - 1 / (6 * x**3) + 1 / (30 * x**5)
    return series - reduce(lambda a, b: a + b, [1 / ((k + i) * (k + i)) for i in range(1, 33)])


def anderson_darling(sample: DataFrame, population: DataFrame, value: str, keys: tuple = ()) -> DataFrame:
    """(keys..., ad): the two-sample statistic with midranks, standardised (Scholz and Stephens 1987)."""
    # running counts of the population are global, those of a sample have an offset for each range: no task sees a whole group
    smp = sample.groupBy(*keys, value).agg(F.count("*").alias("f1"))
    pop = population_cdf(population, value, smp).select(value, "part", F.col("np").alias("f2"), F.col("upto_np").alias("c2"), F.col("tp").alias("n2"))
    sizes = sample.groupBy(*keys).agg(F.count("*").alias("n1")) if keys else sample.agg(F.count("*").alias("n1"))
    placed = smp.join(pop.select(value, "part"), value)
    own = placed.groupBy(*keys, "part").agg(F.sum("f1").alias("f1"))
    grid = sizes.crossJoin(pop.select("part").distinct())
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = grid.join(own, [*keys, "part"], "left").select(*keys, "part", "n1", F.coalesce(F.sum("f1").over(earlier), F.lit(0)).alias("before"))
    both = pop.join(F.broadcast(before), "part").join(smp, [*keys, value], "left").withColumn("f1", F.coalesce("f1", F.lit(0)))
    w = Window.partitionBy(*keys, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    c = lambda e: F.col(e).cast("double")
    t = both.select(*keys, "f1", "f2", "c2", "n1", "n2", (F.col("before") + F.sum("f1").over(w)).alias("c1"))
    t = t.withColumn("l", F.col("f1") + F.col("f2")).withColumn("cl", F.col("c1") + F.col("c2")).withColumn("n", F.col("n1") + F.col("n2"))
    b = c("cl") - c("l") / 2
    term = lambda cum, f, n: (c("l") / c("n")) * F.pow(c("n") * (c(cum) - c(f) / 2) - c(n) * b, F.lit(2.0)) / (b * (c("n") - b) - c("n") * c("l") / 4) / c(n)
    agg = [F.sum(F.when(c("n") == c("l"), 0.0).otherwise(term("c1", "f1", "n1") + term("c2", "f2", "n2"))).alias("s"), F.first("n").alias("n"), F.first("n1").alias("n1"), F.first("n2").alias("n2")]
    r = t.groupBy(*keys).agg(*agg) if keys else t.agg(*agg)
    # h = sum 1/i below n; g = sum of 1 / ((n - i) j) over i < j below n, which is H(n-1)^2 - H(n)^2 + H2(n)
    r = r.withColumn("h", harmonic(c("n") - 1))
    r = r.withColumn("g", F.col("h") ** 2 - (F.col("h") + 1 / c("n")) ** 2 + harmonic_squares(c("n")))
    n, h, gg, H = c("n"), F.col("h"), F.col("g"), 1.0 / c("n1") + 1.0 / c("n2")
    a = (4 * gg - 6) + (10 - 6 * gg) * H
    bb = (2 * gg - 4) * 4 + 16 * h + (2 * gg - 14 * h - 4) * H - 8 * h + 4 * gg - 6
    cc = (6 * h + 2 * gg - 2) * 4 + (4 * h - 4 * gg + 6) * 2 + (2 * h - 6) * H + 4 * h
    d = (2 * h + 6) * 4 - 8 * h
    var = (a * n * n * n + bb * n * n + cc * n + d) / ((n - 1) * (n - 2) * (n - 3))
    return r.select(*keys, (((n - 1) / n * F.col("s") - 1) / F.sqrt(var)).alias("ad"))
