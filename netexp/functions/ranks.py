"""Running sums and dominance counts over tables of any size: range partitions count inside, small tables of partitions give what stands before."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netexp.functions.tables import work_folder, written


def offsets(parts: DataFrame, columns: list[str]) -> DataFrame:
    """(part, before_<column>...): the sums over all earlier partitions; a row a partition."""
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = parts.groupBy("part").agg(*[F.sum(c).alias(c) for c in columns])
    return sums.select("part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in columns])


def running_sums(t: DataFrame, order: list[str], columns: list[str]) -> DataFrame:
    """The rows of ``t`` with ``part`` and, for each of ``columns``, upto_<column>: its sum over all rows up to this one in ``order``, whose values are distinct.

    Rows are written once in range partitions of the order, which number
    them: no task sees more than its range, and the offsets are a row each.
    """
    parts = written(t.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), work_folder(t.sparkSession), "ranges")
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    both = parts.join(F.broadcast(offsets(parts, columns)), "part")
    return both.select(*t.columns, "part", *[(F.col(f"before_{c}") + F.sum(c).over(inside)).alias(f"upto_{c}") for c in columns])


def dominance_counts(x: np.ndarray, y: np.ndarray, n: np.ndarray, at_x: np.ndarray, at_y: np.ndarray) -> np.ndarray:
    """For every (at_x, at_y) the sum of n over points with x <= at_x and y <= at_y, by merging halves of the order of x."""
    m = len(x)
    xs, ys, ask = np.concatenate((x, at_x)), np.concatenate((y, at_y)), np.repeat([0, 1], [m, len(at_x)])
    weight = np.concatenate((n, np.zeros(len(at_x), dtype=np.int64)))
    total, place = len(xs), np.empty(len(xs), dtype=np.int64)
    place[np.lexsort((ask, ys, xs))] = np.arange(total)
    by_y = np.lexsort((ask, ys))
    place, weight = place[by_y], weight[by_y]
    out = np.zeros(total, dtype=np.int64)
    for level in range(max(total - 1, 0).bit_length()):
        group, right = place >> (level + 1), (place >> level & 1).astype(bool)
        order = np.argsort(group, kind="stable")
        upto = np.cumsum(np.where(right[order], 0, weight[order]))
        g = group[order]
        first = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        base = np.concatenate(([0], upto))[first]
        inside = upto - np.repeat(base, np.diff(np.append(first, total)))
        out[order] += np.where(right[order], inside, 0)
    back = np.empty(total, dtype=np.int64)
    back[by_y] = out
    return back[m:]


def _inner(batches):
    """The points of one range with the counts inside it, themselves included."""
    held = list(batches)
    if held:
        t = pa.Table.from_batches(held)
        x, y, n = (t.column(i).to_numpy() for i in range(3))
        inside = dominance_counts(x, y, n, x, y)
        table = t.append_column("inside", pa.array(inside)).append_column("part", pa.array(np.full(len(x), TaskContext.get().partitionId(), dtype=np.int32)))
        yield from table.to_batches()


def dominance(points: DataFrame) -> DataFrame:
    """(x, y, n, below) of points (x, y, n) without nulls, each (x, y) once: below is the sum of n over all points with X <= x and Y <= y.

    Points lie in ranges of the order (x, y), which may part equal x; inside a
    range they are counted in its task. Ranges are joined in halves, quarters
    and so on: at each level the points of a right half get the running sum
    over y of their left half, and all levels are one distributed running sum.
    """
    folder = work_folder(points.sparkSession)
    kinds = dict(points.dtypes)
    ranged = points.select("x", "y", F.col("n").cast("long").alias("n")).repartitionByRange("x", "y")
    parts = written(ranged.mapInArrow(_inner, f"x {kinds['x']}, y {kinds['y']}, n long, inside long, part int"), folder, "parts")
    last = parts.agg(F.max("part")).first()[0] or 0
    levels = last.bit_length()
    if levels == 0:
        return parts.select("x", "y", "n", F.col("inside").alias("below"))
    each = parts.withColumn("level", F.explode(F.array(*map(F.lit, range(levels)))))
    each = each.withColumn("grp", F.expr("shiftright(part, level + 1)")).withColumn("right", F.expr("shiftright(part, level) & 1 = 1"))
    left = F.sum(F.when(F.col("right"), 0).otherwise(F.col("n"))).alias("left")
    sums = written(running_sums(each.groupBy("level", "grp", "y").agg(left), ["level", "grp", "y"], ["left"]), folder, "sums")
    # what stands before a group: at most two groups a partition
    base = sums.groupBy("level", "grp").agg(F.min(F.col("upto_left") - F.col("left")).alias("base"))
    here = each.where("right").join(sums.select("level", "grp", "y", "upto_left"), ["level", "grp", "y"]).join(F.broadcast(base), ["level", "grp"])
    more = here.groupBy("x", "y").agg(F.sum(F.col("upto_left") - F.col("base")).alias("more"))
    return parts.join(more, ["x", "y"], "left").select("x", "y", "n", (F.col("inside") + F.coalesce("more", F.lit(0))).alias("below"))
