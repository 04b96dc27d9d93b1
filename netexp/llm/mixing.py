"""Mixing sources to target weights by hash-threshold histograms; built-in functions only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, 1, 2, ... and
share all words; a target stops at ``max_repeat`` times its source's words and
the excess is shared again by weight until none is above (water filling, solved
in one ordered pass over the sources).

A source takes each document ``base`` times and, for the rest of its target,
those whose hash is below a threshold. The threshold is found by histograms of
words by source and hash bucket: cumulated, they show the bucket in which the
budget ends; only that bucket is cut finer, 12 bits of the hash a level, until it
holds one hash. Nothing is sorted by document, and a document's fate depends on
its own hash and a row per source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netexp.llm.cluster import Scratch

LEVEL_BITS, LEVELS = 12, 5
#: Most sources whose rows are broadcast; with more, documents are joined with them by shuffle.
MAX_BROADCAST_SOURCES = 50_000
WORD = "[^\\x20\\x09-\\x0D]+"


def doc_hash() -> Column:
    """60 bits of md5 of the id, the same in any engine; a null id hashes as the word null."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, max_repeat: int = 3) -> DataFrame:
    """(source, source_size, target) for documents (source, size)."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("w", (F.row_number().over(in_order) - 1) % 3 + 1)
    every = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        "source", "source_size", "w",
        F.sum("source_size").over(every).alias("total"),
        (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0))).alias("w_left"),
        (max_repeat * F.coalesce(F.sum("source_size").over(before), F.lit(0))).alias("capped"),
    )
    fits = (F.col("total") - F.col("capped")) * F.col("w") <= max_repeat * F.col("source_size") * F.col("w_left")
    # the first source that fits fixes the level: all before it stop at their cap
    level = F.min(F.when(fits, F.struct(F.col("capped"), F.col("w_left")))).over(every)
    per = per.withColumn("level", level)
    share = (F.col("w") * (F.col("total") - F.col("level.capped"))).cast("double") / F.col("level.w_left").cast("double")
    return per.select("source", "source_size", F.least(share, (max_repeat * F.col("source_size")).cast("double")).alias("target"))


def beside(table: DataFrame) -> DataFrame:
    """A written table with a row per source, to be broadcast if its size allows."""
    return F.broadcast(table) if table.count() <= MAX_BROADCAST_SOURCES else table


def mix_plan(spark: SparkSession, sized: DataFrame, max_repeat: int = 3) -> DataFrame:
    """A row per source: source, source_size, target, base, below (hashes under it are taken once more), edge (its hash too), most (max_repeat).

    ``sized`` is a written table (doc_id, source, size, h): it is read once a level.
    """
    targets = source_targets(sized, max_repeat)
    size, target = F.col("source_size"), F.col("target")
    base = F.when(size > 0, F.floor(target / size)).otherwise(0).cast("long")
    state = targets.withColumn("base", base).withColumn("budget", target - F.col("base") * size).withColumn("low", F.lit(0).cast("long")).withColumn("used", F.lit(0).cast("long"))
    state = state.withColumn("found", F.lit(True))
    scratch = Scratch(spark, "mixing")
    for level in range(1, LEVELS + 1):
        shift = LEVEL_BITS * (LEVELS - level)
        width = 1 << (shift + LEVEL_BITS)
        state = scratch.write(state, f"level{level}")
        inside = sized.join(beside(state).select(F.col("source").alias("src"), "low", "found"), F.col("source").eqNullSafe(F.col("src")))
        inside = inside.where(F.col("found") & (F.col("h") >= F.col("low")) & (F.col("h") < F.col("low") + width))
        histogram = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        cumulated = histogram.withColumn("upto", F.sum("words").over(upto)).select(F.col("source").alias("src"), "bucket", "words", "upto")
        joined = state.select("source", "source_size", "target", "base", "budget", "low", "used").join(cumulated, F.col("source").eqNullSafe(F.col("src")), "left")
        ends = F.col("used") + F.col("upto") > F.col("budget")
        edge = F.min(F.when(ends, F.struct(F.col("bucket"), (F.col("upto") - F.col("words")).alias("before"), F.col("words"))))
        state = joined.groupBy("source", "source_size", "target", "base", "budget", "low", "used").agg(edge.alias("edge"))
        state = state.select(
            "source", "source_size", "target", "base", "budget",
            F.coalesce(F.shiftleft(F.col("edge.bucket"), shift), F.col("low")).alias("low"),
            (F.col("used") + F.coalesce(F.col("edge.before"), F.lit(0))).alias("used"),
            F.col("edge").isNotNull().alias("found"), F.col("edge.words").alias("words"),
        )
    # what is left is one hash: it is taken if that comes nearer to the budget
    near = F.coalesce(F.col("found") & (2 * (F.col("budget") - F.col("used")) >= F.col("words")), F.lit(False))
    # without an edge the budget is the whole source (target a multiple of its size, or no words): nothing more is taken
    plan = scratch.write(state.select("source", "source_size", "target", "base", F.when(F.col("found"), F.col("low")).otherwise(F.lit(0).cast("long")).alias("below"), near.alias("edge"), F.lit(max_repeat).cast("long").alias("most")), "plan")
    scratch.finish(plan)
    return plan


def sized_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): size is the number of words of the text, 0 for null."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), doc_hash().alias("h"))


def with_copies(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """``docs`` (doc_id, source, h, ...) with source_size, target and copies, the times the mix takes a document (0 to max_repeat)."""
    plan = beside(plan).withColumnRenamed("source", "plan_source")
    extra = (F.col("h") < F.col("below")) | (F.col("edge") & (F.col("h") == F.col("below")))
    copies = F.least(F.col("base") + extra.cast("long"), F.col("most"))  # at the cap only texts without words come before the edge
    return docs.join(plan, F.col("source").eqNullSafe(F.col("plan_source")), "left").withColumn("copies", copies).drop("plan_source", "base", "below", "edge", "most")


def mix_documents(spark: SparkSession, docs: DataFrame, max_repeat: int = 3) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, source): doc_id, size, source_size, target, taken, source.

    taken = copies * size. Documents are taken whole; the one at which a budget
    ends is taken if that is nearer. Rows that share doc_id and source are taken
    or left together. A null source is a source of its own, last in order; null
    and empty texts have size 0. An empty table gives an empty result. The hash
    is of doc_id only: reruns, other partitionings and other columns agree.
    """
    scratch = Scratch(spark, "mixing-docs")
    sized = scratch.write(sized_documents(docs), "sized")
    out = with_copies(sized, mix_plan(spark, sized, max_repeat))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source")


def repeat_documents(spark: SparkSession, docs: DataFrame, max_repeat: int = 3) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; the columns stay as they are."""
    scratch = Scratch(spark, "mixing-docs")
    sized = scratch.write(sized_documents(docs), "sized")
    plan = mix_plan(spark, sized, max_repeat)
    hashed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", doc_hash().alias("h"))
    return with_copies(hashed, plan).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")


ORACLE_SQL = """
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
                  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
c AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total,
             (sum(w) OVER () - coalesce(sum(w) OVER b, 0))::BIGINT AS w_left, (3 * coalesce(sum(source_size) OVER b, 0))::BIGINT AS capped
      FROM s WINDOW b AS (ORDER BY source_size::DOUBLE / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT capped AS lc, w_left AS lw FROM c WHERE (total - capped) * w <= 3 * source_size * w_left ORDER BY capped, w_left LIMIT 1),
t AS (SELECT source, source_size, least((w * (total - lc))::DOUBLE / lw::DOUBLE, (3 * source_size)::DOUBLE) AS target FROM c, l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS base FROM t),
r AS (SELECT d.*, p.source_size, p.target, p.base, p.target - p.base * p.source_size AS budget,
             (sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto,
             (sum(size) OVER (PARTITION BY d.source, h))::BIGINT AS here
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
e AS (SELECT source, min(h) AS edge FROM r WHERE upto > budget GROUP BY source)
SELECT r.doc_id, r.size, r.source_size, r.target, r.source,
       (r.base + CASE WHEN e.edge IS NULL THEN 0 WHEN h < e.edge THEN 1 WHEN h = e.edge AND 2 * (budget - (upto - here)) >= here THEN 1 ELSE 0 END) * size AS taken
FROM r LEFT JOIN e ON r.source IS NOT DISTINCT FROM e.source
"""
