"""Sinks: network data, samples and summary tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from netexp.sources.networks import exists


#: Edges of a bucket of the stored adjacency, unless the caller says how many buckets.
BUCKET_EDGES = 2_000_000


def _table_of(folder: str) -> str:
    return f"netexp_hop1_{hashlib.md5(folder.encode()).hexdigest()[:16]}"


def save_network(attributes: DataFrame, adjacency: DataFrame, folder: str, hop2: DataFrame | None = None, buckets: int | None = None) -> None:
    """Node attributes (covariates are more columns), hop-1 and optionally hop-2 pairs as Parquet.

    The adjacency is bucketed and sorted by src, so that joins and sums by node
    read it without moving it.
    """
    spark = attributes.sparkSession
    attributes.write.mode("overwrite").parquet(f"{folder}/attributes")
    pairs = adjacency.select("src", "dst")
    buckets = buckets or max(1, -(-pairs.count() // BUCKET_EDGES))
    name = _table_of(folder)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    pairs.repartition(buckets, "src").write.mode("overwrite").bucketBy(buckets, "src").sortBy("src").option("path", f"{folder}/hop1").saveAsTable(name)
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/hop1_buckets")
    if hop2 is not None:
        hop2.write.mode("overwrite").parquet(f"{folder}/hop2")


def load_network(spark: SparkSession, folder: str) -> dict[str, DataFrame | None]:
    """attributes, hop1 and hop2 (None where it isn't stored). The session's catalog learns of the buckets, which the files alone do not tell."""
    path, name = f"{folder}/hop2", _table_of(folder)
    # always anew: another session may have written the folder since
    buckets = spark.read.parquet(f"{folder}/hop1_buckets").first()[0]
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(f"{folder}/hop1").schema)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY (src) SORTED BY (src) INTO {buckets} BUCKETS LOCATION '{folder}/hop1'")
    return {"attributes": spark.read.parquet(f"{folder}/attributes"), "hop1": spark.table(name), "hop2": spark.read.parquet(path) if exists(spark, path) else None}


def save_samples(samples: DataFrame, folder: str) -> None:
    """(network, method, sim, arm, role, node), one folder per network, method and sim: readers prune to the sims they want."""
    samples.write.mode("overwrite").partitionBy("network", "method", "sim").parquet(folder)


def load_samples(spark: SparkSession, folder: str, network: str, method: str) -> DataFrame:
    """The samples of a network; sims without files are just not there."""
    return spark.read.parquet(folder).where(f"network = '{network}' and method = '{method}'")


def save_table(table: DataFrame, path: str) -> None:
    """A small summary table as one CSV file with a header."""
    table.coalesce(1).write.mode("overwrite").csv(path, header=True)


def reuse(spark: SparkSession, path: str, compute: Callable[[], DataFrame]) -> DataFrame:
    """The table at path; computed and written where it isn't there."""
    if not exists(spark, path):
        compute().write.parquet(path)
    return spark.read.parquet(path)
