"""Sweeps over sample sizes by ranks: a simulation has one random order of the nodes, and its samples are the prefixes of that order.

A prefix of a random order is a simple random sample, so each size has the
samples that it would have on its own; only the sizes of one simulation share
nodes. What depends on the size becomes a place in the order, known once for
all sizes: a node is contaminated from the size at which both it and the
first of its neighbours are drawn. Messages go along the edges of drawn
nodes, once, whatever the number of sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netexp.functions.distributions import ks_two_sample
from netexp.functions.tables import work_folder, written
from netexp.operators.sampling import KS_THRESHOLD, grid, order_hash


def places(nodes: DataFrame, sims: int, most: int, seed: int = 0) -> DataFrame:
    """(sim, node, place): the first ``most`` nodes of each simulation's order, numbered from 1; one hash for each node and simulation.

    The order is that of ``srs``. Of N nodes only those
    below a hash bound that 2 * most + 400 are expected to pass leave their
    task: fewer than ``most`` do with a chance under exp(-50).
    """
    sim = F.broadcast(grid(nodes.sparkSession, sims).crossJoin(nodes.agg(F.count("*").alias("_n"))))
    hashed = nodes.select("node").crossJoin(sim).withColumn("h", order_hash(("sim",), seed))
    low = F.conv(F.substring("h", 1, 8), 16, 10).cast("double") * F.col("_n") < (2.0 * most + 400) * 2.0**32
    ranked = hashed.where(low).withColumn("place", F.row_number().over(Window.partitionBy("sim").orderBy("h", "node")))
    return ranked.where(F.col("place") <= most).select("sim", "node", "place")


def contamination_places(adj: DataFrame, placed: DataFrame) -> DataFrame:
    """(sim, node, place, hit1, hit2): from which place on a drawn node has a drawn neighbour, and a drawn node within two steps; null if it never has.

    A node hears of the first two drawn neighbours of each neighbour, so that
    it isn't told of itself; no path of two steps is made. A list to sort is no
    longer than the places of a simulation.
    """
    folder = work_folder(adj.sparkSession)
    sent = written(placed.join(adj.withColumnRenamed("src", "node"), "node").select("sim", "node", "place", "dst"), folder, "sent")
    heard = written(sent.groupBy("sim", "dst").agg(F.slice(F.array_sort(F.collect_list("place")), 1, 2).alias("first")), folder, "heard")
    other = F.when(F.col("first")[0] == F.col("place"), F.get("first", F.lit(1))).otherwise(F.col("first")[0])
    two = sent.join(heard, ["sim", "dst"]).groupBy("sim", "node").agg(F.min(other).alias("two"))
    one = heard.select("sim", F.col("dst").alias("node"), F.col("first")[0].alias("one"))
    t = placed.join(one, ["sim", "node"], "left").join(two, ["sim", "node"], "left")
    hit = lambda c: F.when(F.col(c).isNotNull(), F.greatest("place", c))
    return t.select("sim", "node", "place", hit("one").alias("hit1"), F.least(hit("one"), hit("two")).alias("hit2"))


def _step(place: Column, sizes: list[int]) -> Column:
    """The number of the first size (two arms of it) that reaches a place; as many as there are sizes if none does."""
    return sum((F.when(place > 2 * s, 1).otherwise(0) for s in sizes), F.lit(0))


def contamination_sweep(adj: DataFrame, deg: DataFrame, sims: int, sizes: list[int], seed: int = 0) -> DataFrame:
    """By sample_size, means over sims of contamination by neighbours and within two steps, and of what stays clean: the columns of sampling.contamination_sweep.

    A node is three events: drawn, hit by a neighbour, hit within two steps.
    Events are added up by simulation and step, and running sums over the
    steps are the samples.
    """
    sizes = sorted(sizes)
    hits = contamination_places(adj, places(deg, sims, 2 * max(sizes, default=0), seed)).join(deg.select("node", "degree"), "node")
    event = lambda c, i: F.struct(_step(F.coalesce(F.col(c), F.lit(2**31 - 1)), sizes).alias("step"), *[(F.lit(1) if j == i else F.lit(0)).cast("long").alias(f"n{j}") for j in range(3)], *[(F.col("degree") if j == i else F.lit(0)).cast("long").alias(f"d{j}") for j in range(3)])
    events = hits.select("sim", F.explode(F.array(event("place", 0), event("hit1", 1), event("hit2", 2))).alias("e")).select("sim", "e.*").where(F.col("step") < len(sizes))
    names = [f"{k}{j}" for k in "nd" for j in range(3)]
    sums = events.groupBy("sim", "step").agg(*[F.sum(c).alias(c) for c in names])
    spark = adj.sparkSession
    steps = F.broadcast(spark.createDataFrame(list(enumerate(sizes)), "step int, sample_size int"))  # a row for each size
    upto = Window.partitionBy("sim").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    full = grid(spark, sims).crossJoin(steps).join(sums, ["sim", "step"], "left").select("sim", "sample_size", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(c) for c in names])
    full = full.crossJoin(F.broadcast(deg.agg(F.avg("degree").alias("pop"))))
    columns = []
    for j in (1, 2):
        hit, rest = F.sum(f"n{j}"), F.sum(F.col("n0") - F.col(f"n{j}"))
        clean = F.try_divide(F.col("d0") - F.col(f"d{j}"), F.col("n0") - F.col(f"n{j}"))
        columns += [F.try_divide(hit, F.sum("n0")).alias(f"pcent_contaminated_{j}"), F.avg(clean).alias(f"avg_degree_clean_{j}"), F.try_divide(rest, F.sum("n0")).alias(f"pcent_clean_{j}"), F.avg((clean - F.col("pop")) / F.col("pop")).alias(f"degree_diff_pct_{j}")]
    return full.groupBy("sample_size").agg(*columns, F.avg("pop").alias("pop_avg_degree"))


def clean_masks(adj: DataFrame, deg: DataFrame, sims: int, sizes: list[int], seed: int = 0) -> DataFrame:
    """(sim, node, mask): bit i is set where the node is in the sample of the i-th of the sorted ``sizes`` without a sampled neighbour; 62 sizes at most."""
    if len(sizes) > 62:
        raise ValueError("62 sizes at most")
    placed = places(deg, sims, 2 * max(sizes, default=0), seed)
    sent = placed.join(adj.withColumnRenamed("src", "node"), "node")
    one = sent.groupBy("sim", F.col("dst").alias("node")).agg(F.min("place").alias("one"))
    hit = F.coalesce(F.greatest("place", "one"), F.lit(2**31 - 1))
    t = placed.join(one, ["sim", "node"], "left").withColumn("hit", F.when(F.col("one").isNull(), F.lit(2**31 - 1)).otherwise(hit))
    mask = sum((F.when((F.col("place") <= 2 * s) & (F.col("hit") > 2 * s), 1 << i).otherwise(0).cast("long") for i, s in enumerate(sorted(sizes))), F.lit(0).cast("long"))
    return t.select("sim", "node", mask.alias("mask")).where("mask <> 0")


def apart_masks(adj: DataFrame, clean: DataFrame, n_sizes: int) -> DataFrame:
    """clean (sim, node, mask) without the bits of sizes at which another clean node shares a neighbour.

    Clean nodes are no neighbours, so these are at distance 2. A node in the
    middle counts its clean neighbours by size and says which sizes have two.
    """
    sent = written(clean.join(adj.withColumnRenamed("src", "node"), "node").select("sim", "node", "mask", "dst"), work_folder(adj.sparkSession), "clean")
    bit = lambda i: F.expr(f"shiftright(mask, {i}) & 1")
    counts = sent.groupBy("sim", "dst").agg(*[F.sum(bit(i)).alias(f"n{i}") for i in range(n_sizes)])
    shared = sum((F.when(F.col(f"n{i}") > 1, 1 << i).otherwise(0).cast("long") for i in range(n_sizes)), F.lit(0).cast("long"))
    told = counts.select("sim", "dst", shared.alias("shared")).where("shared <> 0")
    near = sent.join(told, ["sim", "dst"]).groupBy("sim", "node").agg(F.bit_or(F.col("mask").bitwiseAND(F.col("shared"))).alias("near"))
    left = clean.join(near, ["sim", "node"], "left").select("sim", "node", F.col("mask").bitwiseAND(F.bitwise_not(F.coalesce("near", F.lit(0).cast("long")))).alias("mask"))
    return left.where("mask <> 0")


def by_size(masks: DataFrame, sizes: list[int]) -> DataFrame:
    """(sim, nsample, node) of masks (sim, node, mask)."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).alias("nsample")) for i, s in enumerate(sorted(sizes))]))
    return masks.withColumn("e", each).where(F.expr("shiftright(mask, e.i) & 1 = 1")).select("sim", "e.nsample", "node")


def _by_sim(sample: DataFrame, deg: DataFrame) -> DataFrame:
    """(sim, nsample, remaining, avg_degree, ks) of (sim, nsample, node)."""
    keys = ["sim", "nsample"]
    t = written(sample.join(deg.select("node", "degree"), "node"), work_folder(deg.sparkSession), "rest")
    return t.groupBy(*keys).agg(F.count("*").alias("remaining"), F.avg("degree").alias("avg_degree")).join(ks_two_sample(t, deg, "degree", tuple(keys)), keys)


def max_feasible_sweep(adj: DataFrame, deg: DataFrame, sims: int, sizes: list[int], seed: int = 0) -> DataFrame:
    """By nsample, means over sims of what remains after exclusion by neighbours, then by distance 2: the columns of sampling.max_feasible_sweep. Empty remainders are left out."""
    clean = written(clean_masks(adj, deg, sims, sizes, seed), work_folder(adj.sparkSession), "masks")
    both = by_size(clean, sizes).withColumn("kind", F.lit("1st")).unionByName(by_size(apart_masks(adj, clean, len(sizes)), sizes).withColumn("kind", F.lit("2nd")))
    keys = ["sim", "nsample", "kind"]
    t = written(both.join(deg.select("node", "degree"), "node"), work_folder(deg.sparkSession), "rest")
    one = t.groupBy(*keys).agg(F.count("*").alias("remaining"), F.avg("degree").alias("avg_degree")).join(ks_two_sample(t, deg, "degree", tuple(keys)), keys)
    wide = lambda kind: [F.avg(F.when(F.col("kind") == kind, F.col(c))).alias(f"{name}_{kind}") for c, name in (("remaining", "remaining"), ("avg_degree", "avg_degree"), ("ks", "KS_degree"))]
    return one.groupBy("nsample").agg(*wide("1st"), *wide("2nd")).where("remaining_1st IS NOT NULL")


def exclusion_boundary(adj: DataFrame, deg: DataFrame, sims: int, sizes: list[int], seed: int = 0) -> DataFrame:
    """(nsample, avg_remain, avg_KS, feasible): sims with nothing left count as 0 remaining and no KS."""
    spark = adj.sparkSession
    one = _by_sim(by_size(clean_masks(adj, deg, sims, sizes, seed), sizes), deg)
    full = grid(spark, sims, sorted(sizes)).join(one, ["sim", "nsample"], "left")
    r = full.groupBy("nsample").agg(F.avg(F.coalesce("remaining", F.lit(0)) / 2).alias("avg_remain"), F.avg("ks").alias("avg_KS"))
    return r.withColumn("feasible", F.coalesce(F.col("avg_KS") < KS_THRESHOLD, F.lit(False)))
