"""Exact top-k search over binary codes by incremental multi-index hashing.

A code of ``bits`` bits is cut into m segments, each indexed by its value. Step
s probes every segment at Hamming distance s from the query's; after it every
code within m * (s + 1) - 1 has been a candidate (pigeonhole), so a query is
finished once its k-th verified distance is within that. A query that has k
candidates probes only as many segments as its k-th distance still needs, and
candidates beyond that distance do not leave the join. The first bound of that
distance is the k-th among SEEDS codes, with which every query is compared. m is
the cheapest for codes of that number spread at random.

Equal codes are one index entry with its k + 1 smallest ids, and one query, so a
very common code is one candidate and searched for once.
"""

from __future__ import annotations

import json
from math import ceil, comb

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netexp.llm.cluster import Scratch

WIDEST = 24
#: Codes for the first bound; the cost of a candidate, compared inside the join, in probes, which are shuffled and sorted.
SEEDS, CANDIDATE = 2048, 0.1


def sign_codes(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, code): bit i of the code is set where component i is above 0.

    A null component is not above 0. Null vectors and vectors without an id have
    no code. A vector of more than 64 components is an error.
    """
    vector = F.col(vector_col)
    fits = F.when(F.size(vector) > 64, F.raise_error(F.lit("vectors of more than 64 components have no 64-bit code"))).otherwise(vector)
    bits = F.transform(fits, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    code = F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(b))
    return vectors.where(vector.isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), code.alias("code"))


def expected_radius(bits: int, rows: int, k: int) -> int:
    """The distance within which ``rows`` random codes have k of a query on average."""
    within = 0
    for r in range(bits + 1):
        within += comb(bits, r)
        if rows * within >= k << bits:
            return r
    return bits


def segments_of(bits: int, rows: int, k: int) -> list[tuple[int, int]]:
    """(first bit, width) of the segments."""
    radius = expected_radius(bits, rows, k)

    def cost(m: int) -> float:
        w = ceil(bits / m)
        return sum(min(m, radius + 1 - m * s) * comb(w, s) * (1 + CANDIDATE * rows / 2**w) for s in range(radius // m + 1))

    m = min(range(ceil(bits / WIDEST), max(ceil(bits / WIDEST), bits // 4) + 1), key=cost)
    edges = [round(j * bits / m) for j in range(m + 1)]
    return [(a, b - a) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _value(code: Column, first: int, width: int) -> Column:
    return F.shiftrightunsigned(code, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def with_masks(rows: DataFrame, width: int, s: int) -> DataFrame:
    """``rows`` once for each mask of s bits among ``width``, as column ``mask``: masks of the lower half, then fitting ones of the upper half.

    The constants are the 2 ** (width / 2) masks of the halves.
    """
    low, high = width // 2, width - width // 2
    lower = [x for x in range(1 << low) if 0 <= s - x.bit_count() <= high]
    upper = [[x << low for x in range(1 << high) if x.bit_count() == r] for r in range(min(s, high) + 1)]
    rows = rows.withColumn("lower", F.explode(F.split(F.lit(",".join(map(str, lower))), ",").cast("array<bigint>")))
    table = F.from_json(F.lit(json.dumps(upper)), "array<array<bigint>>")
    rows = rows.withColumn("upper", F.explode(F.element_at(table, F.lit(s + 1) - F.bit_count("lower"))))
    return rows.withColumn("mask", F.col("lower").bitwiseOR(F.col("upper"))).drop("lower", "upper")


def hamming_topk(spark: SparkSession, codes: DataFrame, queries: DataFrame, k: int = 10, bits: int = 64) -> DataFrame:
    """The k nearest rows of ``codes`` (id long, code long) for each row of ``queries`` (id, code).

    Rows: query_id, rank (1..k), id, distance; nearest first, ties by id, the
    query's own id left out. Fewer than k other rows: all of them. Rows with a
    null id or code are left out. Repeated (id, code) rows count once; an id
    with several codes may appear with each. Empty tables give an empty result.
    """
    scratch = Scratch(spark, "hamming")
    codes = codes.select("id", "code").where("id is not null and code is not null")
    queries = queries.select("id", "code").where("id is not null and code is not null").distinct()
    most = k + 1  # the query's own id is among them, as a rule
    per_code = Window.partitionBy("code").orderBy("id")
    entries = codes.distinct().withColumn("r", F.row_number().over(per_code)).where(F.col("r") <= most)
    entries = scratch.write(entries.groupBy("code").agg(F.collect_list("id").alias("ids")), "entries")
    segments = segments_of(bits, entries.count(), most)
    m = len(segments)
    each = F.array(*[F.struct(F.lit(j).alias("seg"), _value(F.col("code"), *s).alias("value")) for j, s in enumerate(segments)])
    index = scratch.write(entries.select("code", "ids", F.explode(each).alias("s")).select("code", "ids", "s.seg", "s.value"), "index")
    seeds = [r.code for r in entries.orderBy(F.xxhash64("code"), "code").limit(SEEDS).collect()]
    bound = F.lit(None).cast("int")  # with fewer than k + 1 codes nothing is known beforehand
    if len(seeds) >= most:
        seed_codes = F.split(F.lit(",".join(map(str, seeds))), ",").cast("array<bigint>")
        bound = F.get(F.array_sort(F.transform(seed_codes, lambda c: F.bit_count(F.col("code").bitwiseXOR(c)))), F.lit(k)).cast("int")
    active = scratch.write(queries.select("code").distinct().select(F.col("code").alias("query"), bound.alias("kth")), "active")
    best, results = None, []
    for s in range(max(w for _, w in segments) + 1):
        if active.isEmpty():
            break
        every = None
        for j, (first, width) in enumerate(segments):
            if s <= width:
                need = F.col("kth").isNull() | (F.lit(j) < F.col("kth") + 1 - m * s)
                value = _value(F.col("query"), first, width).bitwiseXOR(F.col("mask")).alias("value")
                one = with_masks(active.where(need), width, s).select("query", "kth", F.lit(j).alias("seg"), value)
                every = one if every is None else every.unionAll(one)
        # the planner takes the exploded probes for as small as the queries and would broadcast them
        p, e = every.alias("p"), index.hint("shuffle_merge").alias("e")
        distance = F.bit_count(F.col("p.query").bitwiseXOR(F.col("e.code"))).cast("int")
        near = F.col("p.kth").isNull() | (distance <= F.col("p.kth"))
        found = p.join(e, (F.col("p.seg") == F.col("e.seg")) & (F.col("p.value") == F.col("e.value")) & near)
        found = found.select("query", F.explode("ids").alias("id"), distance.alias("distance"))
        if best is not None:
            found = found.unionAll(best)
        order = Window.partitionBy("query").orderBy("distance", "id")
        best = found.repartition("query").distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")
        best = scratch.write(best, "best")
        state = best.groupBy("query").agg(F.max("distance").alias("far"), F.count("*").alias("n"))
        kth = F.when(F.col("n") >= most, F.col("far")).otherwise(F.col("kth")).alias("kth")
        state = scratch.write(active.join(state, "query", "left").select("query", kth), "state")
        done = F.col("kth") <= m * (s + 1) - 1
        results.append(best.join(state.where(done).select("query"), "query"))
        active = state.where(F.coalesce(~done, F.lit(True)))
        best = best.join(active.select("query"), "query")
    if best is None:
        return queries.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), "id", F.lit(0).alias("distance")).limit(0)
    result = best  # queries with fewer than k + 1 ids within reach of all probes: there are no others
    for r in results:
        result = result.unionAll(r)
    lists = scratch.write(result.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("distance", "id"))).alias("near")), "lists")
    asked = queries.withColumnRenamed("id", "query_id").join(lists, F.col("code") == F.col("query"))
    others = F.slice(F.filter("near", lambda x: x["id"] != F.col("query_id")), 1, k)
    ranked = asked.select("query_id", F.posexplode(others).alias("place", "hit"))
    return ranked.select("query_id", (F.col("place") + 1).cast("int").alias("rank"), "hit.id", "hit.distance")
