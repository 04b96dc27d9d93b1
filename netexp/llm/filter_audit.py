"""Audit of how filters interact: what each removes at each place of each order, and its Shapley share.

Documents are reduced to a mask of the filters they fail, and masks are
counted by part. From the counts alone follows everything else: the number
that a set of filters removes is a polynomial over {0, 1}^5 (the multilinear
extension of the set function), kept as one coefficient per set. Its corners
are the survivors of a prefix of an order, and a filter's Shapley value is the
integral of its partial derivative along the diagonal, in exact rationals.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netexp.llm.cluster import Scratch, small_batches

FILTERS = "ABCDE"
#: Bit of the filter that looks at the whole table: identical to the text of a smaller doc_id.
COPY = 1 << FILTERS.index("E")

_UPPER = bytes(range(65, 91))
_MARKS = b"#$%&*|"
_INNER = bytes(range(0x80, 0xC0))

MIN_WORDS = 200
DISTINCT_PERCENT = 50
UPPER_PERCENT = 3

AUDIT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails."""
    words = text.split()  # on space and 0x09-0x0D
    upper = len(text) - len(text.translate(None, _UPPER))
    points = len(text.translate(None, _INNER))
    failed = (len(words) < MIN_WORDS, 100 * len(set(words)) < DISTINCT_PERCENT * len(words), 100 * upper > UPPER_PERCENT * points, len(text.translate(None, _MARKS)) < len(text))
    return sum(1 << i for i, bad in enumerate(failed) if bad)


def _masks(batches):
    for batch in batches:
        texts = batch.column(2).cast(pa.large_binary())
        masks, digests = [], []
        for value in texts:
            text = value.as_py() or b""
            masks.append(text_mask(text))
            digests.append(hashlib.sha256(text).digest())
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])


def failure_masks(spark: SparkSession, docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, part, mask) of every row of docs (doc_id, text, lang).

    A null text is empty, a null lang is the part ''. Texts are identical if
    their SHA-256 is. Rows that repeat a doc_id with one text fail E together,
    if at all; a row without doc_id is smaller than none and never fails it.
    The least doc_id of a text meets its rows by (text, doc_id), so a large
    group of copies is not one key.
    """
    small_batches(spark)
    plain = docs.select("doc_id", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), F.col("text").cast("string").alias("text"))
    rows = scratch.write(plain.mapInArrow(_masks, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, mask int, digest binary"), "masks")
    least = rows.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("least", F.lit(True))
    flagged = rows.join(least, ["digest", "doc_id"], "left")
    late = F.col("least").isNull() & F.col("doc_id").isNotNull()
    return flagged.select("doc_id", "part", F.when(late, F.col("mask").bitwiseOR(F.lit(COPY))).otherwise(F.col("mask")).alias("mask"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and mask, and of these the ones with a label quality = 1 and toxic = 1."""
    known = labels.groupBy(F.col("doc_id").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    joined = masks.select("doc_id", "part", "mask").join(known, "doc_id", "left")
    return joined.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic"))


class RemovalPolynomial:
    """The number of documents that a set of filters removes, as a polynomial with one variable a filter.

    A document with mask m is removed unless all filters of m are off:
    1 - prod(1 - x_i, i in m). The sum over documents, multiplied out, has one
    whole coefficient a set of filters.
    """

    def __init__(self, counts: dict[int, int], n: int):
        self.n = n
        self.coefficients = [0] * (1 << n)
        for s in range(1, 1 << n):
            sign = 1 if s.bit_count() % 2 else -1
            self.coefficients[s] = sign * sum(c for m, c in counts.items() if m & s == s)

    def corner(self, on: int) -> int:
        """Documents removed by the set ``on``: the value where its variables are 1 and the others 0."""
        return sum(c for s, c in enumerate(self.coefficients) if s & on == s)

    def shapley(self, i: int) -> Fraction:
        """The integral over t of the partial derivative by variable i at (t, ..., t)."""
        return sum((Fraction(c, s.bit_count()) for s, c in enumerate(self.coefficients) if s >> i & 1), Fraction(0))


def audit_part(part: str, masks: list[tuple[int, int, int, int]]) -> list[tuple]:
    """The rows of AUDIT of a part from its (mask, n, good, toxic)."""
    n = len(FILTERS)
    total = sum(row[1] for row in masks)
    every, good, toxic = (RemovalPolynomial({row[0]: row[j] for row in masks}, n) for j in (1, 2, 3))
    whole = (1 << n) - 1
    fails = [every.corner(1 << i) for i in range(n)]
    alone = [every.corner(whole) - every.corner(whole ^ 1 << i) for i in range(n)]
    share = [int(every.shapley(i) * 120) for i in range(n)]
    out = []
    for order in permutations(range(n)):
        before = 0
        for step, i in enumerate(order, 1):
            after = before | 1 << i
            gone = every.corner(after) - every.corner(before)
            name = "".join(FILTERS[j] for j in order)
            out.append((part, name, step, total - every.corner(after), gone, fails[i] - gone, alone[i], good.corner(after) - good.corner(before), toxic.corner(after) - toxic.corner(before), share[i]))
            before = after
    return out


def _audit(batches):
    for batch in batches:
        for row in batch.to_pylist():
            rows = audit_part(row["part"], [(m["mask"], m["n"], m["good"], m["toxic"]) for m in row["masks"]])
            fields = [f.split() for f in AUDIT.split(", ")]
            types = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
            yield pa.record_batch([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[name for name, _ in fields])


def filter_audit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """AUDIT: a row per part, order of the filters and step.

    docs: doc_id, text, lang; labels: doc_id, quality, toxic (rows that repeat
    a doc_id count once; one without doc_id is of no document). Counts are of rows of docs. An empty table has no
    parts and no rows.
    """
    scratch = Scratch(spark, "filter-audit")
    counts = mask_counts(failure_masks(spark, docs, scratch), labels)
    # at most 32 masks a part
    parts = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    out = scratch.write(parts.mapInArrow(_audit, AUDIT), "audit")
    scratch.finish(out)
    return out


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
f AS (SELECT doc_id, part, (len(ws) < {MIN_WORDS})::INTEGER + 2 * (100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws))::INTEGER
        + 4 * (100 * len(regexp_extract_all(t, '[A-Z]')) > {UPPER_PERCENT} * length(t))::INTEGER + 8 * regexp_matches(t, '[#$%&*|]')::INTEGER
        + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INTEGER AS mask FROM d),
l AS (SELECT doc_id, max((quality = 1)::INTEGER) AS good, max((toxic = 1)::INTEGER) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic FROM f LEFT JOIN l ON l.doc_id = f.doc_id GROUP BY ALL),
x AS (SELECT unnest(range(5)) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
s AS (SELECT list_aggregate(list_transform(p, lambda i: 'ABCDE'[i + 1]), 'string_agg', '') AS filter_order, unnest(range(1, 6)) AS step, p FROM o),
b AS (SELECT filter_order, step, 1 << p[step] AS bit, coalesce(list_sum(list_transform(p[1:step - 1], lambda i: 1 << i)), 0)::BIGINT AS before FROM s),
r AS (SELECT part, filter_order, step::INTEGER AS step, bit,
        sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END)::BIGINT AS kept,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS removed,
        sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END)::BIGINT AS redundant,
        sum(CASE WHEN mask = bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END)::BIGINT AS good_lost,
        sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
      FROM c CROSS JOIN b GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM r
"""
