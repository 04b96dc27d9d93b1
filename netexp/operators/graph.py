"""Graph operators over canonical edges (s, d) and the adjacency (src, dst)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netexp.functions.ranks import offsets
from netexp.functions.tables import work_folder, written
from netexp.operators import tiles


def adjacency(edges: DataFrame) -> DataFrame:
    """Both directions of every edge."""
    return edges.select(F.col("s").alias("src"), F.col("d").alias("dst")).unionAll(edges.select("d", "s"))


def dense_ids(edges: DataFrame) -> DataFrame:
    """(orig, node): ids 0..N-1 in order, without one task that sorts all: range partitions are numbered by their offsets."""
    nodes = adjacency(edges).select(F.col("src").alias("orig")).distinct().repartitionByRange("orig").withColumn("part", F.spark_partition_id())
    # the numbers of the partitions hold for the written table only
    nodes = written(nodes.withColumn("one", F.lit(1).cast("long")), work_folder(edges.sparkSession), "nodes")
    inside = nodes.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("orig")))
    return inside.join(F.broadcast(offsets(nodes, ["one"])), "part").select("orig", (F.col("k") + F.col("before_one") - 1).alias("node"))


def degree(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) of every triangle, once: wedges hang from the end with the smaller degree, which bounds them on skewed graphs."""
    deg = degree(adjacency(edges))
    ranked = edges.join(deg.select(F.col("node").alias("s"), F.col("degree").alias("ks")), "s").join(deg.select(F.col("node").alias("d"), F.col("degree").alias("kd")), "d")
    up = (F.col("ks") < F.col("kd")) | ((F.col("ks") == F.col("kd")) & (F.col("s") < F.col("d")))
    out = ranked.select(F.when(up, F.col("s")).otherwise(F.col("d")).alias("a"), F.when(up, F.col("d")).otherwise(F.col("s")).alias("b"))
    wedges = out.join(out.withColumnRenamed("b", "c"), "a").where("b < c")
    return wedges.join(edges, (F.col("b") == F.col("s")) & (F.col("c") == F.col("d"))).select("a", "b", "c")


def clustering(edges: DataFrame) -> DataFrame:
    """(node, cluster_coef): 2T / (k (k - 1)), 0 where k < 2."""
    corners = triangles(edges).select(F.explode(F.array("a", "b", "c")).alias("node")).groupBy("node").agg(F.count("*").alias("t"))
    k = F.col("degree")
    return degree(adjacency(edges)).join(corners, "node", "left").select("node", F.when(k >= 2, 2.0 * F.coalesce("t", F.lit(0)) / (k * (k - 1))).otherwise(0.0).alias("cluster_coef"))


def neighbour_degree(adj: DataFrame) -> DataFrame:
    """(node, nb_degree): the mean degree of a node's neighbours."""
    deg = degree(adj).withColumnRenamed("node", "src")
    return adj.join(deg, "src").groupBy(F.col("dst").alias("node")).agg(F.avg("degree").alias("nb_degree"))


def spmv(adj: DataFrame, vector: DataFrame, keys: tuple = ()) -> DataFrame:
    """Neighbour sums of a sparse vector (keys..., node, value): (keys..., node, value); nodes without one are absent.

    Values are sent along the edges from src, by which a stored adjacency is bucketed: only the vector moves.
    """
    v = vector.withColumnRenamed("node", "src")
    return adj.join(v, "src").groupBy(*keys, F.col("dst").alias("node")).agg(F.sum("value").alias("value"))


def eigenvector(adj: DataFrame, rounds: int = 100, tol: float = 1e-6, every: int = 5) -> DataFrame:
    """(node, eigen_centrality): power iteration on A + I (no oscillation on bipartite graphs), of length 1.

    Stops when N * tol bounds the summed change, tested every few rounds, where
    the vector is also written; an error if it doesn't within ``rounds``. With
    tol 0 it is the vector after just these rounds.
    """
    folder = work_folder(adj.sparkSession)
    nodes = adj.select(F.col("src").alias("node")).distinct()
    # the loops stand for I: the vector is read once a round, so the plan grows by one join
    adj = written(adj.unionAll(nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))), folder, "adj")
    n = nodes.count()
    x = nodes.withColumn("value", F.lit(1.0 / max(n, 1) ** 0.5))
    previous, done = None, tol == 0 or n == 0
    for i in range(1, rounds + 1):
        x = spmv(adj, x)
        if i % every == 0 or i == rounds:
            norm = x.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
            x = written(x.crossJoin(F.broadcast(norm)).select("node", (F.col("value") / F.col("length")).alias("value")), folder, f"x{i}")
            if tol and previous is not None and x.join(previous.withColumnRenamed("value", "was"), "node").agg(F.sum(F.abs(F.col("value") - F.col("was")))).first()[0] < n * tol:
                done = True
                break
            previous = x
    if not done:
        raise ArithmeticError(f"no convergence in {rounds} rounds; lanczos takes fewer")
    return x.withColumnRenamed("value", "eigen_centrality")


def lanczos(adj: DataFrame, tol: float = 1e-9, rounds: int = 200) -> tuple[DataFrame, float, float]:
    """``lanczos_of_lists`` of an adjacency."""
    return lanczos_of_lists(hop1_lists(adj), tol, rounds)


def lanczos_of_lists(lists: DataFrame, tol: float = 1e-9, rounds: int = 200) -> tuple[DataFrame, float, float]:
    """((node, eigen_centrality) of length 1, the largest eigenvalue, the residual |A x - value x| that the recurrence states), of neighbours in both directions.

    A three-term recurrence: each round is one product with the adjacency and
    one row of sums; the small tridiagonal matrix tells the eigenvalue and how
    far the vector is off, and the vector is the sum of the rounds' vectors.
    Stops when the residual is below tol times the value, with an error after
    ``rounds``. It needs far fewer products than power iteration, as the whole
    sequence is used and not its last vector alone. Vectors are kept by tiles
    of ids, so a round moves the matrix in four or eight bytes an entry, and
    each tile of the vector at most some sixteen times.
    """
    folder = work_folder(lists.sparkSession)
    n = lists.count()
    if not n:
        return lists.select("node", F.lit(None).cast("double").alias("eigen_centrality")), 0.0, 0.0
    bits = tiles.segment_bits(lists)
    blocks = written(tiles.blocks(lists, bits), folder, "blocks")
    near = written(blocks.select("b", "c").distinct(), folder, "near")
    t = tiles.segments(lists, bits).select("b", "at", F.transform("at", lambda _: F.lit(n**-0.5)).alias("v"), F.transform("at", lambda _: F.lit(0.0)).alias("u"))
    alphas, betas, kept = [], [], []
    for i in range(1, rounds + 1):
        w = written(tiles.product_less(blocks, near, t, betas[-1] if betas else 0.0, bits), folder, f"w{i}")
        each = w.select(F.explode(F.arrays_zip("v", "w")).alias("e")).select("e.v", "e.w")
        a = each.agg(F.sum(F.col("w") * F.col("v"))).first()[0]
        b = each.agg(F.sum((F.col("w") - a * F.col("v")) ** 2)).first()[0] ** 0.5
        alphas.append(a)
        betas.append(b)
        kept.append(w)
        values, vectors = np.linalg.eigh(np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1))
        value, s = float(values[-1]), vectors[:, -1]
        residual = abs(b * float(s[-1]))
        if residual <= tol * abs(value):
            break
        t = w.select("b", "at", F.zip_with("w", "v", lambda x, v: (x - a * v) / b).alias("v"), F.col("v").alias("u"))
    else:
        raise ArithmeticError(f"residual {residual} of {value} after {rounds} rounds")
    s = s * np.sign(s[0])
    x = tiles.combined(kept, s, bits)
    norm = x.agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("length"))
    return x.crossJoin(F.broadcast(norm)).select("node", (F.col("value") / F.col("length")).alias("eigen_centrality")), value, residual


def node_attributes(edges: DataFrame, eigen: bool = False) -> DataFrame:
    """(node, degree, cluster_coef, nb_degree[, eigen_centrality])."""
    adj = adjacency(edges)
    out = degree(adj).join(clustering(edges), "node").join(neighbour_degree(adj), "node")
    return out.join(lanczos(adj)[0], "node") if eigen else out


def hop1_lists(adj: DataFrame) -> DataFrame:
    return adj.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("nbrs"))


def bitmaps(pairs: DataFrame) -> DataFrame:
    """(src, chunk, bits) of pairs (src, dst): the set of dst as words of 64 ids; dst is bit dst % 64 of chunk dst // 64."""
    return pairs.groupBy("src", F.expr("shiftright(dst, 6)").alias("chunk")).agg(F.bit_or(F.expr("shiftleft(1L, cast(dst & 63 as int))")).alias("bits"))


#: Bytes of neighbour words that are broadcast.
MAX_WORDS = 64 << 20


def clustering_by_words(edges: DataFrame) -> DataFrame:
    """(node, cluster_coef) as ``clustering``, for dense networks: triangles are bits that two neighbours' sets share, 64 nodes at a time, and no wedge is made.

    Sets are broadcast as words if they fit in MAX_WORDS; else edges meet them
    by joins on node and chunk.
    """
    adj = adjacency(edges)
    own = written(bitmaps(adj), work_folder(edges.sparkSession), "words")
    small = own.count() * 24 <= MAX_WORDS
    if small:
        sets = own.groupBy("src").agg(F.map_from_entries(F.collect_list(F.struct("chunk", "bits"))).alias("words"))
        a, b = F.broadcast(sets.toDF("s", "ws")), F.broadcast(sets.toDF("d", "wd"))
        common = F.aggregate(F.map_entries("ws"), F.lit(0).cast("long"), lambda n, e: n + F.bit_count(e["value"].bitwiseAND(F.coalesce(F.try_element_at("wd", e["key"]), F.lit(0).cast("long")))))
        shared = edges.repartition("s").join(a, "s").join(b, "d").select("s", "d", common.alias("n"))
    else:
        half = edges.join(own.toDF("s", "chunk", "ws"), "s")
        shared = half.join(own.toDF("d", "chunk", "wd"), ["d", "chunk"]).groupBy("s", "d").agg(F.sum(F.bit_count(F.col("ws").bitwiseAND(F.col("wd")))).alias("n"))
    ends = shared.select(F.explode(F.array("s", "d")).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("t2"))
    k = F.col("degree")
    return degree(adj).join(ends, "node", "left").select("node", F.when(k >= 2, F.coalesce("t2", F.lit(0)) / (k * (k - 1))).otherwise(0.0).alias("cluster_coef"))


def two_steps(adj: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(src, chunk, bits): the nodes at distance exactly 2 as bitmaps; with ``start`` (node) only from there.

    A node's set is the union of its neighbours' sets, by ``bit_or``: paths are
    united before the shuffle and never sorted, and a hub sends words of 64
    nodes to its neighbours, not a row for each pair of them.
    """
    first = adj if start is None else adj.join(start.select(F.col("node").alias("src")).distinct(), "src", "left_semi")
    own = bitmaps(adj if start is None else adj.join(first.select(F.col("dst").alias("src")).distinct(), "src", "left_semi"))
    mids = first.select(F.col("dst").alias("mid"), F.col("src").alias("from"))
    if start is None:  # both directions are there: keyed by src, as the sets are
        mids = adj.select(F.col("src").alias("mid"), F.col("dst").alias("from"))
    united = mids.join(own.withColumnRenamed("src", "mid"), "mid").groupBy(F.col("from").alias("src"), "chunk").agg(F.bit_or("bits").alias("bits"))
    near = own if start is None else bitmaps(first)
    self_bit = F.when(F.col("chunk") == F.expr("shiftright(src, 6)"), F.expr("shiftleft(1L, cast(src & 63 as int))")).otherwise(F.lit(0).cast("long"))
    known = F.coalesce(F.col("near"), F.lit(0).cast("long")).bitwiseOR(self_bit)
    left = united.join(near.withColumnRenamed("bits", "near"), ["src", "chunk"], "left").select("src", "chunk", F.col("bits").bitwiseAND(F.bitwise_not(known)).alias("bits"))
    return left.where("bits <> 0")


def hop2(adj: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(src, dst) at distance exactly 2; with ``start`` (node) only from there."""
    if start is None:
        return tiles.hop2(hop1_lists(adj))
    at = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.col("bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0))
    return two_steps(adj, start).select("src", "chunk", at.alias("at")).select("src", (F.col("chunk") * 64 + F.col("at")).alias("dst"))


def hop2_counts(adj: DataFrame) -> DataFrame:
    """(node, n): how many nodes are at distance exactly 2; nodes without one are absent."""
    return tiles.hop2(hop1_lists(adj), counts=True)


def neighbours_of(adj: DataFrame, sample: DataFrame, keys: tuple = ()) -> DataFrame:
    """(keys..., node) next to a sample (keys..., node) and not in it."""
    s = sample.select(*keys, "node")
    near = adj.join(s.withColumnRenamed("node", "src"), "src").select(*keys, F.col("dst").alias("node")).distinct()
    return near.join(s, [*keys, "node"], "left_anti")


def summary(attributes: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """One row: population_size, num_edges (without ``edges`` half the degrees) and the means of the attributes, density and the exponent p."""
    columns = [c for c in ("degree", "cluster_coef", "nb_degree", "eigen_centrality") if c in attributes.columns]
    names = {"degree": "avg_degree", "cluster_coef": "avg_clustering", "nb_degree": "avg_neighbor_degree", "eigen_centrality": "avg_eigen_centrality"}
    one = attributes.agg(F.count("*").alias("population_size"), *[F.avg(c).alias(names[c]) for c in columns])
    e = edges.agg(F.count("*").alias("num_edges")) if edges is not None else attributes.agg((F.sum("degree") / 2).cast("long").alias("num_edges"))
    n, m = F.col("population_size"), F.col("num_edges")
    return one.crossJoin(e).withColumn("density", 2.0 * m / (n * (n - 1))).withColumn("p", exponent(n, m))


def exponent(n: Column, m: Column) -> Column:
    """The sampler's exponent: 10 (E / N) log10 N."""
    return 10.0 * m / n * F.log10(n.cast("double"))


def largest_component(edges: DataFrame) -> DataFrame:
    """Edges of the largest connected component (the one with the smallest node if several): labels spread by minimum, with jumps."""
    folder = work_folder(edges.sparkSession)
    adj = written(adjacency(edges), folder, "adj")
    label = written(adj.groupBy(F.col("src").alias("node")).agg(F.least(F.min("dst"), F.col("node")).alias("label")), folder, "l0")
    i = 0
    while True:  # labels only fall, and a round that changes none is the last
        i += 1
        near = adj.join(label.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("near"))
        step = label.join(near, "node").select("node", F.least("label", "near").alias("label"))
        jump = step.join(step.select(F.col("node").alias("label"), F.col("label").alias("far")), "label").select("node", F.least("label", "far").alias("label"))
        after = written(jump, folder, f"l{i}")
        if after.join(label.withColumnRenamed("label", "was"), "node").where("label <> was").isEmpty():
            break
        label = after
    top = label.groupBy("label").count().orderBy(F.desc("count"), "label").limit(1)
    keep = label.join(F.broadcast(top), "label", "left_semi").select(F.col("node").alias("s"))
    return edges.join(keep, "s", "left_semi")
