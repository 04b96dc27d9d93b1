"""Helpers that hold on a real cluster: written intermediate tables and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary folder; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = f"file://{tempfile.gettempdir()}/netexp-shared"
    return found


def small_batches(spark: SparkSession) -> None:
    """At most 1024 rows of text in a Python worker at once, unless the session says otherwise."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1024")


class Scratch:
    """Written tables of one operator call; a table cuts the lineage and survives lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        small_batches(spark)
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
        self._paths: list[str] = []

    def write(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = f"{self.root}/{len(self._paths) + 1:03d}-{label}"
        self._paths.append(path)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._netexp_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        self._delete([t._netexp_path for t in tables])

    def finish(self, *kept: DataFrame) -> None:
        """Delete all tables but those that the result is read from."""
        left = {t._netexp_path for t in kept}
        self._delete([p for p in self._paths if p not in left])

    def _delete(self, paths: list[str]) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for p in paths:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Connected components of edges (a, b): rows (node, label), label the smallest node.

    Each round sends every node to its smallest neighbour (itself included),
    relabels the edges by that, and goes on with the contracted graph, whose
    smallest node always stays; all state is in written tables. Nodes
    without an edge to another node have no row.
    """
    left = scratch.write(edges.where("a <> b").select("a", "b").distinct(), "edges")
    labels = None
    while not left.isEmpty():
        both = left.select(F.col("a").alias("node"), F.col("b").alias("other")).unionAll(left.select("b", "a"))
        step = scratch.write(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("to")), "step")
        if labels is None:
            merged = step.select("node", F.col("to").alias("label"))
        else:
            merged = labels.join(step.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        merged = scratch.write(merged, "labels")
        to_a = step.select(F.col("node").alias("a"), F.col("to").alias("x"))
        to_b = step.select(F.col("node").alias("b"), F.col("to").alias("y"))
        after = left.join(to_a, "a").join(to_b, "b").where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        after = scratch.write(after, "edges")
        scratch.drop(left, step, *([labels] if labels is not None else []))
        left, labels = after, merged
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    scratch.drop(left)
    return labels


#: Bits of the largest filter of keys that is broadcast: 2 ** 24 bits are some 270,000 rows, 8 MB.
FILTER_BITS = 24


def _filter_of(wanted: DataFrame, rows: int) -> tuple[DataFrame | None, int]:
    """(bitmap of the hashed keys as a broadcast table (_nx_word, _nx_bits), its bits), with eight bits a key, or two at least at the bound, where some four in ten other rows pass; none with more keys."""
    bits = min(1 << FILTER_BITS, max(1 << 14, 1 << (8 * max(1, rows) - 1).bit_length()))
    if 2 * rows > bits:
        return None, bits
    slot = wanted.select(F.pmod(F.xxhash64(F.col("_nx_key")), F.lit(bits)).alias("_nx_slot"))
    word = slot.select(F.floor(F.col("_nx_slot") / 62).alias("_nx_word"), F.expr("shiftleft(1L, cast(_nx_slot % 62 as int))").alias("_nx_bit"))
    return F.broadcast(word.groupBy("_nx_word").agg(F.bit_or("_nx_bit").alias("_nx_bits"))), bits


def _placed(docs: DataFrame, key: str, bitmap: DataFrame, bits: int, how: str) -> DataFrame:
    slotted = docs.withColumn("_nx_slot", F.pmod(F.xxhash64(F.col(key)), F.lit(bits)))
    slotted = slotted.withColumn("_nx_at", F.floor(F.col("_nx_slot") / 62))
    return slotted.join(bitmap, F.col("_nx_at") == F.col("_nx_word"), how)


_HIT = "_nx_bits & shiftleft(1L, cast(_nx_slot % 62 as int)) <> 0"


def some_rows(docs: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose column ``key`` is in the one column of the written table ``wanted``, and a few others.

    Docs are not shuffled: a filter with eight bits a key is broadcast. With
    more keys than FILTER_BITS allows, all rows are returned and the join that
    follows does the work. That should be an inner join: Spark puts a left_semi or
    left_anti one before the filter.
    """
    wanted = wanted.toDF("_nx_key")
    bitmap, bits = _filter_of(wanted, wanted.count())
    if bitmap is None:
        return docs
    return _placed(docs, key, bitmap, bits, "inner").where(F.expr(_HIT)).select(*[F.col(f"`{c}`") for c in docs.columns])


def other_rows(docs: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose column ``key`` is not in the one column of the written table ``gone``: those off the filter pass without a shuffle."""
    gone, columns = gone.toDF("_nx_key"), [F.col(f"`{c}`") for c in docs.columns]
    bitmap, bits = _filter_of(gone, gone.count())
    if bitmap is None:
        return docs.join(gone, F.col(key) == F.col("_nx_key"), "left_anti")
    placed = _placed(docs, key, bitmap, bits, "left")
    hit = F.coalesce(F.expr(_HIT), F.lit(False))
    off = placed.where(~hit).select(*columns)
    # not left_anti, which Spark would push below the filter, so that all rows would be shuffled
    on = placed.where(hit).select(*columns).join(gone, F.col(key) == F.col("_nx_key"), "left").where("_nx_key is null").select(*columns)
    return off.unionByName(on)
