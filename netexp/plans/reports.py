"""Summary tables in the shapes that figures read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of networks and estimators.
NETWORK_LABELS = {"lastfm": "LastFM", "twitch": "Twitch", "pokec": "Pokec", "simulate_base": "Simulated (base)", "simulate_sparse": "Simulated (sparse)", "simulate_small": "Simulated (small)"}

#: Kinds of networks.
NETWORK_TYPES = {name: "Simulated" if name.startswith("simulate") else "Real-world" for name in NETWORK_LABELS}


def network_columns(table: DataFrame, column: str = "network") -> DataFrame:
    """The table with the network's label in place of its name, and its kind as ``network_type`` (null for names that are not registered)."""
    known = F.col(column).isin(list(NETWORK_TYPES))
    return table.withColumn("network_type", F.when(known, recode(column, NETWORK_TYPES))).withColumn(column, recode(column, NETWORK_LABELS))


def labelled_union(tables: dict[str, DataFrame], column: str = "network") -> DataFrame:
    """One table of several, with a column that names each."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [t.withColumn(column, F.lit(name)) for name, t in tables.items()])


def percent(table: DataFrame, columns: list[str]) -> DataFrame:
    return table.withColumns({c: F.col(c) * 100 for c in columns})


def recode(column: str, labels: dict[str, str]) -> Column:
    """Labels for values; other values stay."""
    return reduce(lambda out, item: F.when(F.col(column) == item[0], item[1]).otherwise(out), reversed(list(labels.items())), F.col(column))


def value_and_distance(table: DataFrame, ids: list[str], values: list[str], distances: list[str], names: list[str]) -> DataFrame:
    """(ids..., method, value, ks): the value columns and the distance columns unpivoted, and joined by ids and method."""
    rename = lambda t, old: t.withColumnsRenamed(dict(zip(old, names, strict=True)))
    v = rename(table.select(*ids, *values), values).unpivot(ids, names, "method", "value")
    d = rename(table.select(*ids, *distances), distances).unpivot(ids, names, "method", "ks")
    return v.join(d, [*ids, "method"], "left")


def effect_axis(table: DataFrame, mean_degree: float, spill: float = 0.5) -> DataFrame:
    """Adds ``effect``: tau1 * mean degree for d10, ``spill`` times that for d01."""
    return table.withColumn("effect", F.col("tau1") * mean_degree * F.when(F.col("estimand") == "d01", spill).otherwise(1.0))


def estimator_means(table: DataFrame, metrics: list[str], estimand: str = "d10") -> DataFrame:
    return table.where(F.col("estimand") == estimand).groupBy("estimator").agg(*[F.avg(m).alias(m) for m in metrics])


def boundary_table(rows: DataFrame) -> DataFrame:
    """(Network, Exclusion, Representative) of (network, method, max_remain)."""
    return rows.groupBy(F.col("network").alias("Network")).pivot("method", ["exclusion", "matched"]).agg(F.max("max_remain")).toDF("Network", "Exclusion", "Representative")
