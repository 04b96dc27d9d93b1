"""Sources: edge lists, node features, and networks derived from relational tables."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The registry of networks: edge file, feature file, separator, header.
NETWORK_FILES = {
    "lastfm": ("lastfm_asia_edges.csv", "lastfm_asia_target.csv", ",", True),
    "twitch": ("large_twitch_edges.csv", "large_twitch_features.csv", ",", True),
    "pokec": ("soc-pokec-relationships.txt", "soc-pokec-profiles.txt", "\t", False),
}
#: Simulated networks: nodes, edges per new node, chance of a triangle, seed.
SIMULATED = {"simulate_base": (100_000, 10, 0.6, 1), "simulate_sparse": (100_000, 2, 0.6, 1), "simulate_small": (10_000, 2, 0.6, 1)}
#: Where covariates stand: id column, and columns by covariate.
COVARIATES = {"lastfm": ("id", {"x1": "target"}), "twitch": ("numeric_id", {"x1": "views", "x2": "life_time", "x3": "mature", "x4": "affiliate"}), "pokec": ("user_id", {"x1": "AGE", "x2": "completion_percentage", "x3": "gender"})}
FEATURE_LISTS = {"lastfm": "lastfm_asia_features.json"}


def canonical(pairs: DataFrame) -> DataFrame:
    """(s, d) with s < d, once each: a simple undirected graph of the first two columns; self-loops and nulls go."""
    a, b = (F.col(f"`{c}`").cast("long") for c in pairs.columns[:2])
    return pairs.select(F.least(a, b).alias("s"), F.greatest(a, b).alias("d")).where("s < d").distinct()


def read_edges(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    """The edges of a delimited file; column names are ignored, the first two columns count."""
    return canonical(spark.read.csv(path, sep=sep, header=header, schema="a long, b long", enforceSchema=True))


def read_network(spark: SparkSession, name: str, folder: str) -> tuple[DataFrame, DataFrame | None]:
    """(edges, features or None) of a registered network."""
    edge_file, feature_file, sep, header = NETWORK_FILES[name]
    check_inputs(spark, [f"{folder}/{edge_file}"])
    edges = read_edges(spark, f"{folder}/{edge_file}", sep, header)
    path = f"{folder}/{feature_file}"
    if not exists(spark, path):
        return edges, None
    return edges, read_profiles(spark, path) if name == "pokec" else spark.read.csv(path, header=True)


def load_covariates(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """(orig, covariates...) of a registered network's nodes, by their ids in the edge file.

    lastfm: x1 target, x2 number of different liked artists. twitch: x1 views, x2
    life time, x3 mature, x4 affiliate. pokec: x1 age, x2 completed share of the
    profile, x3 gender, z1 and z2 the standard scores of x1 and x2, 0 where missing.
    """
    from netexp.operators.causal import zscores

    _, feature_file, _, _ = NETWORK_FILES[name]
    lists = FEATURE_LISTS.get(name)
    check_inputs(spark, [f"{folder}/{f}" for f in (feature_file, lists) if f])
    path, (key, columns) = f"{folder}/{feature_file}", COVARIATES[name]
    raw = read_profiles(spark, path) if name == "pokec" else spark.read.csv(path, header=True)
    out = raw.select(F.col(key).cast("long").alias("orig"), *[F.col(c).cast("double").alias(x) for x, c in columns.items()])
    if lists:
        counts = read_feature_counts(spark, f"{folder}/{lists}").select(F.col("node").alias("orig"), F.col("n_features").cast("double").alias("x2"))
        out = out.join(counts, "orig", "left").withColumn("x2", F.coalesce("x2", F.lit(0.0)))
    if name == "pokec":
        out = zscores(out.withColumn("x2", F.col("x2") / 100), {"x1": "z1", "x2": "z2"})
    return out


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """The first nine columns of a headerless profile file."""
    names = ["user_id long", "public int", "completion_percentage double", "gender int", "region string", "last_login string", "registration string", "AGE double", "body string"]
    return spark.read.csv(path, sep="\t", header=False, schema=", ".join(names), enforceSchema=True)


def read_feature_counts(spark: SparkSession, path: str) -> DataFrame:
    """(node, n_features) of a JSON object node -> list: the number of different entries; 0 where the value is no list."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "map<string, string>")).alias("node", "raw"))
    items = F.from_json("raw", "array<string>")
    return entries.select(F.col("node").cast("long").alias("node"), F.coalesce(F.size(F.array_distinct(items)), F.lit(0)).alias("n_features")).withColumn("n_features", F.greatest("n_features", F.lit(0)))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def check_inputs(spark: SparkSession, paths: list[str]) -> None:
    """Fails with the list of missing paths."""
    missing = [p for p in paths if not exists(spark, p)]
    if missing:
        raise FileNotFoundError("missing inputs: " + ", ".join(missing))


def copurchases(spark: SparkSession, sf_dir: str, least: float | None = 45) -> DataFrame:
    """(n, p), once each: customer n bought part p in a line of ``least`` or more; None: in any line."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    lines = (lines if least is None else lines.where(F.col("l_quantity") >= least)).select("l_orderkey", F.col("l_partkey").alias("p"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.col("o_custkey").alias("n"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("n", "p").distinct()


def copurchase_edges(spark: SparkSession, sf_dir: str, least: float | None = 45) -> DataFrame:
    """Customers who bought the same part in a line of ``least`` or more; None: in any line."""
    bought = copurchases(spark, sf_dir, least)
    x, y = bought.select(F.col("n").alias("s"), "p"), bought.select(F.col("n").alias("d"), "p")
    return x.join(y, "p").where("s < d").select("s", "d").distinct()


def cobuy_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts returned in one order."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey")
    a, b = lines.select("l_orderkey", F.col("l_partkey").alias("s")), lines.select("l_orderkey", F.col("l_partkey").alias("d"))
    return a.join(b, "l_orderkey").where("s < d").select("s", "d").distinct()


@dataclass
class PowerLawCluster:
    """Growing network with preferential attachment and triangle closure: n nodes, m edges a new node, closure with chance p."""

    n: int
    m: int
    p: float
    seed: int

    def edges(self) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        near: list[list[int]] = [[] for _ in range(self.n)]
        ends: list[int] = list(range(self.m))  # a node stands here once an edge end
        out = []
        for new in range(self.m, self.n):
            chosen: set[int] = set()
            target = None
            while len(chosen) < self.m:
                close = [x for x in near[target] if x not in chosen and x != new] if target is not None and rng.random() < self.p else []
                target = close[rng.integers(len(close))] if close else ends[rng.integers(len(ends))]
                if target not in chosen:
                    chosen.add(target)
            for t in sorted(chosen):
                near[new].append(t)
                near[t].append(new)
                out.append((t, new))
                ends += [t, new]
        return np.array(out, dtype=np.int64).reshape(-1, 2)


def simulated_edges(spark: SparkSession, networks: list[tuple[str, int, int, float, int]]) -> DataFrame:
    """(network, s, d): one growing network is sequential, so each is a task of its own; networks: (name, n, m, p, seed)."""
    rows = spark.createDataFrame(networks, "network string, n int, m int, p double, seed int")

    def grow(batches):
        for batch in batches:
            for r in batch.to_pylist():
                e = PowerLawCluster(r["n"], r["m"], r["p"], r["seed"]).edges()
                yield pa.record_batch([pa.array([r["network"]] * len(e)), pa.array(e[:, 0]), pa.array(e[:, 1])], names=["network", "s", "d"])

    return rows.repartition(max(1, len(networks)), "network").mapInArrow(grow, "network string, s long, d long")
