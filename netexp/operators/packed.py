"""Roles of nodes in all simulations at once: a simulation is a bit, 64 of them a word, and the edges are read once for all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _or(columns: list[Column]) -> Column:
    out = columns[0]
    for c in columns[1:]:
        out = out.bitwiseOR(c)
    return out


def packed(sample: DataFrame) -> DataFrame:
    """(node, word, arm1, arm2) of a sample (sim, node, arm): bit sim % 64 of word sim // 64, by arm."""
    bit = F.expr("shiftleft(1L, cast(sim & 63 as int))")
    arm = lambda a: F.bit_or(F.when(F.col("arm") == a, bit).otherwise(F.lit(0).cast("long"))).alias(f"arm{a}")
    return sample.groupBy("node", F.expr("shiftright(cast(sim as long), 6)").alias("word")).agg(arm(1), arm(2))


def near_bits(adj: DataFrame, bits: DataFrame) -> DataFrame:
    """(node, word, near1, near2, several): simulations in which a neighbour is drawn into arm 1, into arm 2, and in which two or more neighbours are drawn.

    Two neighbours differ in some bit of their ids. So for each bit of the
    ids the words of neighbours that have it, and of those that do not, are
    united: a simulation is in both for some bit just where it has two
    neighbours. All of it is ``bit_or``, which combines before the shuffle and
    takes a hub's neighbours in parts.
    """
    span = adj.agg(F.min("dst"), F.max("dst")).first()
    width = 64 if span[0] is not None and span[0] < 0 else max(int(span[1] or 0).bit_length(), 1)
    t = adj.join(bits.withColumnRenamed("node", "dst"), "dst").withColumn("any", F.col("arm1").bitwiseOR(F.col("arm2")))
    none = F.lit(0).cast("long")
    has = lambda b: F.expr(f"shiftright(dst, {b}) & 1 = 1")
    sides = [F.bit_or(F.when(has(b) if on else ~has(b), F.col("any")).otherwise(none)).alias(f"b{b}_{on}") for b in range(width) for on in (0, 1)]
    united = t.groupBy(F.col("src").alias("node"), "word").agg(F.bit_or("arm1").alias("near1"), F.bit_or("arm2").alias("near2"), *sides)
    several = _or([F.col(f"b{b}_0").bitwiseAND(F.col(f"b{b}_1")) for b in range(width)])
    return united.select("node", "word", "near1", "near2", several.alias("several"))


def roles(adj: DataFrame, sample: DataFrame) -> DataFrame:
    """(sim, arm, role, node): clean egos (drawn, no neighbour drawn) and clean alters (not drawn, one neighbour drawn: that one's arm) of a sample (sim, node, arm)."""
    own = packed(sample)
    t = near_bits(adj, own).join(own, ["node", "word"], "full")
    word = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    drawn, near = word("arm1").bitwiseOR(word("arm2")), word("near1").bitwiseOR(word("near2"))
    single = F.bitwise_not(word("several").bitwiseOR(drawn))
    kinds = [("ego", a, word(f"arm{a}").bitwiseAND(F.bitwise_not(near))) for a in (1, 2)] + [("alter", a, word(f"near{a}").bitwiseAND(single)) for a in (1, 2)]
    each = F.explode(F.array(*[F.struct(F.lit(role).alias("role"), F.lit(a).alias("arm"), bits.alias("bits")) for role, a, bits in kinds]))
    rows = t.select("node", "word", each.alias("e")).where("e.bits <> 0")
    sims = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.expr("e.bits").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0))
    return rows.withColumn("bit", sims).select((F.col("word") * 64 + F.col("bit")).cast("int").alias("sim"), "e.arm", "e.role", "node")
