"""Importance resampling towards a target set: hashed n-gram models of target and raw text, drawn by noisy scores.

Two passes over the raw texts. The first counts features by bucket: one vector
a partition, merged by treeReduce. The second gathers the buckets' gains, a
broadcast vector of fixed length, and sums them by document. Neither shuffles
texts or features. The draw needs ranks of the highest scores only: a
histogram of the whole-numbered scores finds the score at which it ends.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netexp.llm.cluster import Scratch, small_batches
from netexp.llm.textkit import slices

BUCKETS = 10000
MIN_WORDS = 20
PERCENT = 25
SEED = "7"

#: Bytes to those of words, lower-cased: digits, letters and all bytes of other alphabets; the rest is a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def buckets(texts: list[bytes], n_buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, bucket of each feature, text of each feature): all words, then all pairs of consecutive words of a text."""
    split = [t.translate(WORD_BYTES).split() for t in texts]
    n = np.array([len(w) for w in split], dtype=np.int64)
    words = [w for ws in split for w in ws]
    owner = np.repeat(np.arange(len(texts)), n)
    single = np.fromiter(map(crc32, words), dtype=np.uint32, count=len(words))
    # a checksum goes on where the first word's ended
    second = np.fromiter(map(crc32, [b" " + w for w in words[1:]], single[:-1].tolist()), dtype=np.uint32, count=max(len(words) - 1, 0))
    inside = owner[1:] == owner[:-1]
    crc = np.concatenate((single, second[inside]))
    return n, (crc % np.uint32(n_buckets)).astype(np.int64), np.concatenate((owner, owner[:-1][inside]))


def _texts(column):
    """(first row, end row, texts as bytes) of slices of bounded size."""
    for at, to, buf, offsets in slices(column):
        whole, bounds = buf.tobytes(), offsets.tolist()
        yield at, to, [whole[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _counter(n_buckets: int):
    def count(batches):
        total = np.zeros(n_buckets, dtype=np.int64)
        for batch in batches:
            for _, _, texts in _texts(batch.column(0)):
                total += np.bincount(buckets(texts, n_buckets)[1], minlength=n_buckets)
        yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["counts"])

    return count


def feature_counts(texts: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """Features by bucket over the whole column ``text``: one vector a partition, merged in a tree. No rows count nothing."""
    vectors = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counter(n_buckets), "counts binary").rdd
    if vectors.getNumPartitions() == 0:
        return np.zeros(n_buckets, dtype=np.int64)
    return vectors.map(lambda row: np.frombuffer(row[0], dtype=np.int64)).treeReduce(np.add, depth=3)


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket: floor(1000 ln((t + 1) (S + n) / ((s + 1) (T + n)))), in doubles."""
    n = len(raw)
    s, t = raw.astype(np.float64), target.astype(np.float64)
    ratio = (t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], dtype=np.int64)


def _weigher(gain):
    def weigh(batches):
        by_bucket = gain.value
        for batch in batches:
            for at, to, texts in _texts(batch.column(1)):
                n, bucket, owner = buckets(texts, len(by_bucket))
                features = n + np.maximum(n - 1, 0)
                total = np.bincount(owner, weights=by_bucket[bucket].astype(np.float64), minlength=len(texts)).astype(np.int64)
                weight = np.where(features > 0, total // np.maximum(features, 1), 0)
                yield pa.record_batch([batch.column(0).slice(at, to - at), pa.array(n), pa.array(features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return weigh


def importance_weights(spark: SparkSession, docs: DataFrame, target: DataFrame, n_buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of docs (doc_id, text): the floored mean gain of its features.

    Null and texts without words have no features and weight 0. The counts
    are made at once, the weights when the result is used.
    """
    small_batches(spark)
    gain = spark.sparkContext.broadcast(gains(feature_counts(docs, n_buckets), feature_counts(target, n_buckets)))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_weigher(gain), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noisy_scores(weights: DataFrame, seed: str = SEED) -> DataFrame:
    """The weights with ``score``: weight plus Gumbel noise that hangs on seed and doc_id alone; a row without doc_id has the noise of the empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    return weights.withColumn("score", F.col("weight") + noise)


def drawn_ranks(scored: DataFrame, scratch: Scratch, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """``scored`` (a written table) with ``rank``: 1, 2, ... over the highest scores of rows of min_words or more, null for those not drawn.

    floor(percent * N / 100) of these N rows are drawn; ties go to the
    smaller doc_id (null last), then to fewer features. Scores are whole and
    bounded: a gain lies within 1000 ln of the counts, the noise within 3,200
    below and 23,000 above, so that some 100,000 values are the most, and
    their histogram is small whatever the corpus. Only rows at or above the
    last score drawn are shuffled, rows that repeat as a count.
    """
    fit = F.col("n_words") >= min_words
    histogram = scratch.write(scored.where(fit).groupBy("score").agg(F.count("*").alias("n")), "histogram")
    total = histogram.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = percent * total // 100
    above = histogram.withColumn("above", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    above = scratch.write(above.where(F.col("above") < most).select("score", "above"), "above")
    least = above.agg(F.min("score")).first()[0]
    near = (fit & (F.col("score") >= F.lit(least))) if least is not None else F.lit(False)
    columns = scored.columns
    same = scored.where(near).groupBy(*columns).agg(F.count("*").alias("_nx_n"))
    order = Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "n_features", "weight", "n_words")
    before = F.coalesce(F.sum("_nx_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = same.withColumn("_nx_before", before).join(F.broadcast(above), "score")
    each = placed.withColumn("_nx_at", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_nx_n"))))
    place = F.col("above") + F.col("_nx_before") + F.col("_nx_at")
    ranked = each.select(*columns, F.when(place <= most, place).alias("rank"))
    rest = scored.where(~F.coalesce(near, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest)


def target_resampling(spark: SparkSession, docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: str = SEED, n_buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of every row of docs (doc_id, text): which of them to train on for a target (text).

    Features are words and pairs of words, words being runs of digits, letters
    and characters beyond ASCII, with A-Z lower-cased.
    """
    scratch = Scratch(spark, "target-resampling")
    scored = scratch.write(noisy_scores(importance_weights(spark, docs, target, n_buckets), seed), "scored")
    out = scratch.write(drawn_ranks(scored, scratch, percent, min_words), "ranked")
    scratch.finish(out)
    return out


def drawn_documents(spark: SparkSession, docs: DataFrame, target: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that are drawn; rows that share a doc_id come or stay away together."""
    drawn = target_resampling(spark, docs, target, **parameters).where("rank IS NOT NULL").select(F.col("doc_id").alias("_nx_id")).distinct()
    return docs.join(drawn, F.col("doc_id") == F.col("_nx_id"), "left_semi")


ORACLE_SQL = f"""
WITH c AS (SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
df AS (SELECT r, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM b),
fs AS (SELECT f, sum(s) AS s, sum(t) AS t FROM (SELECT f, count(*) AS s, 0 AS t FROM df GROUP BY f UNION ALL SELECT f, 0, count(*) FROM bf GROUP BY f) GROUP BY f),
h AS (SELECT f, s, t, hex(encode(f)) AS x FROM fs),
k AS (SELECT f, s, t, xor(list_reduce(list_concat([4294967295], list_transform(range(len(x) // 2), lambda i: ('0x' || x[2 * i + 1:2 * i + 2])::BIGINT)), lambda a, y: xor(a >> 8, tab[(xor(a, y) & 255) + 1])), 4294967295) % {BUCKETS} AS bucket FROM h, c),
g AS (SELECT bucket, floor(1000 * ln((sum(t)::DOUBLE + 1) * ((SELECT sum(s) FROM fs)::DOUBLE + {BUCKETS}) / ((sum(s)::DOUBLE + 1) * ((SELECT sum(t) FROM fs)::DOUBLE + {BUCKETS}))))::BIGINT AS gain FROM k GROUP BY bucket),
w AS (SELECT r, sum(gain) AS total, count(*) AS n FROM df JOIN k ON k.f = df.f JOIN g ON g.bucket = k.bucket GROUP BY r),
e AS (SELECT d.r, doc_id, len(ws) AS n_words, coalesce(w.n, 0)::BIGINT AS n_features, coalesce((w.total - ((w.total % w.n) + w.n) % w.n) // w.n, 0)::BIGINT AS weight,
        ('0x' || sha256('{SEED}:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT AS h FROM d LEFT JOIN w ON w.r = d.r),
z AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))))::BIGINT AS score FROM e),
q AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place FROM z WHERE n_words >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * (SELECT count(*) FROM q) // 100 THEN place END AS rank FROM z LEFT JOIN q ON q.r = z.r
"""
