"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k.

Unigrams and bigrams of words, and of the shapes of words, are hashed to
BUCKETS. Shapes (letters by case, digits, marks; runs as one) say what junk looks
like where a small labelled sample has few of its words. The raw model is their
distribution over all documents, the target model over a bounded sample of
documents labelled good. A document's log weight is the sum of the log ratios of
its n-grams, neither tempered nor scaled: the log of the ratio of the two
models' probabilities of the text. Adding standard Gumbel noise, drawn from a
hash of the id, and keeping the k largest samples k documents without
replacement in proportion to their weights.

k is a parameter, as a share of the documents. Without one it is the expected
number of documents like the target: the sum, over all documents, of the
probability of being good at their weight, which a logistic curve fitted on the
other half of the labelled sample gives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netexp.llm.cluster import Scratch, other_rows
from netexp.llm.line_dedup import row_key
from netexp.llm.textkit import U, Prefix, mix, slices, words

BITS = 14
BUCKETS = 1 << BITS
#: Bound of the labelled sample; weights beyond it, either way, count as it in the logistic curve.
MAX_LABELLED, FAR = 20_000, 100.0


#: Bytes to classes: letters by case (other alphabets as small ones), digits; marks stand for themselves.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[97:123], SHAPE[65:91], SHAPE[48:58], SHAPE[128:] = 97, 65, 48, 97


def shapes(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with their bytes as classes, of which equal neighbours are one: ``Well, 20 men!`` is ``Aa, 0 a!``."""
    classes = SHAPE[buf]
    kept = np.ones(len(buf), dtype=bool)
    kept[1:] = classes[1:] != classes[:-1]
    kept[offsets[:-1][offsets[:-1] < len(buf)]] = True
    return classes[kept], np.concatenate(([0], np.cumsum(kept)))[offsets]


def _grams(buf: np.ndarray, offsets: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    s, e, first = words(buf, offsets)
    h = Prefix(buf).hashes(s, e)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    uni = (mix(h + U(salt)) >> U(64 - BITS)).astype(np.int64)
    inside = doc[:-1] == doc[1:]
    bi = (mix(h[:-1] * U(0xA0761D6478BD642F) + h[1:] + U(salt - 1)) >> U(64 - BITS)).astype(np.int64)[inside]
    return np.concatenate((uni, bi)), np.concatenate((doc, doc[:-1][inside]))


def ngram_buckets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every unigram and bigram, of words and then of their shapes, and the text each belongs to."""
    parts = [_grams(buf, offsets, 1), _grams(*shapes(buf, offsets), 2)]
    return np.concatenate([b for b, _ in parts]), np.concatenate([d for _, d in parts])


def _count(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        good = batch.column(1).to_numpy(zero_copy_only=False)
        for at, to, buf, offsets in slices(batch.column(0)):
            bucket, doc = ngram_buckets(buf, offsets)
            raw += np.bincount(bucket, minlength=BUCKETS)
            hit = good[at:to]
            if hit.any():
                target += np.bincount(bucket[hit[doc]], minlength=BUCKETS)
    at = np.flatnonzero(raw)
    yield pa.record_batch([pa.array(at, pa.int32()), pa.array(raw[at]), pa.array(target[at])], names=["bucket", "raw", "target"])


def labelled_sample(labels: DataFrame, column: str, limit: int) -> DataFrame:
    """(label_id, label) of at most ``limit`` labelled documents, by hash of the id; null labels are left out."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(F.max(column).cast("int").alias("label"))
    return rows.orderBy(F.xxhash64("label_id"), "label_id").limit(limit)


def in_fit():
    """Half of the labelled sample is for the target model, the other half for the number that is kept: weights of texts of the model itself are too high."""
    return F.pmod(F.xxhash64(F.col("label_id"), F.lit(3)), F.lit(2)) == 0


def fit_log_ratio(spark: SparkSession, docs: DataFrame, sample: DataFrame) -> np.ndarray:
    """log target / raw probability by bucket (add-one smoothing): BUCKETS numbers, from all documents."""
    good = F.broadcast(sample.where(F.col("label") == 1).where(in_fit()).select("label_id"))  # at most MAX_LABELLED ids
    marked = docs.join(good, F.col("doc_id") == F.col("label_id"), "left").select("text", F.col("label_id").isNotNull().alias("good"))
    rows = marked.mapInArrow(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.ones(BUCKETS), np.ones(BUCKETS)
    raw[rows["bucket"].to_numpy(dtype=np.int64)] += rows["raw"].to_numpy(dtype=float)
    target[rows["bucket"].to_numpy(dtype=np.int64)] += rows["target"].to_numpy(dtype=float)
    if target.sum() == BUCKETS:  # no labelled text: all documents weigh the same
        return np.zeros(BUCKETS)
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _score(table):
    def score(batches):
        ratio = table.value
        for batch in batches:
            for at, to, buf, offsets in slices(batch.column(1)):
                bucket, doc = ngram_buckets(buf, offsets)
                n = np.bincount(doc, minlength=to - at)
                total = np.bincount(doc, weights=ratio[bucket], minlength=to - at)
                yield pa.record_batch([batch.column(0).slice(at, to - at), batch.column(2).slice(at, to - at), pa.array(n.astype(np.int64)), pa.array(total)], names=["doc_id", "row", "n_grams", "log_weight"])

    return score


def logistic_curve(weights: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) of the log odds of being good at a weight, by Newton's method; the targets are drawn in a little, so separable weights have a finite slope."""
    x, y = np.clip(weights, -FAR, FAR), good.astype(float)
    y = np.where(good, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    design, theta = np.column_stack((x, np.ones(len(x)))), np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), design.T @ (y - p) - 1e-6 * theta)
        theta = theta + step * min(1.0, 1.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-10:
            break
    return float(theta[0]), float(theta[1])


def expected_good(scored: DataFrame, known: DataFrame) -> int:
    """The expected number of good rows of ``scored``; all of them if ``known`` (w, label) lacks good or bad ones."""
    known = known.toPandas()  # bounded as the sample
    good = known["label"].to_numpy() == 1
    if good.all() or not good.any():
        return scored.count()
    slope, intercept = logistic_curve(known["w"].to_numpy(dtype=float), good)
    odds = slope * F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.col("log_weight"))) + intercept
    part = F.round(1e6 / (1 + F.exp(-odds))).cast("long")  # whole numbers: the sum has no order
    return round((scored.agg(F.sum(part)).first()[0] or 0) / 1e6)


def kth_largest(keys: DataFrame, k: int, scratch: Scratch) -> float | None:
    """The k-th largest of a column ``key`` by histograms of the interval that holds it; ties are one value."""
    low, high, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if not n or k <= 0:
        return None
    if k >= n:
        return low
    above = 0  # keys over the interval
    for _ in range(12):
        width = (high - low) / 4096
        if width <= 0:
            break
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        slot = F.least(F.lit(4095), F.floor((F.col("key") - low) / width)).alias("slot")
        bins = sorted(inside.groupBy(slot).agg(F.count("*"), F.min("key"), F.max("key")).collect(), reverse=True)  # 4096 rows at most
        for _, count, least, most in bins:
            if above + count >= k:
                low, high = least, most
                break
            above += count
        if low == high:
            break
    return low


def quality_resampling(spark: SparkSession, docs: DataFrame, labels: DataFrame, share: float | None = None, max_labelled: int = MAX_LABELLED, seed: int = 17) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, row (a hash of id and text), n_grams, log_weight, sample_key, kept.

    ``labels``: (doc_id, quality 0/1); rows with a null are left out, of several
    for one id the largest counts. ``share`` of the rows are kept; without it
    the expected number of good ones. Null and empty texts have log weight 0, as
    do all with no document labelled good. Rows that share a doc_id share their
    noise, as do those without one. Keys that tie with the k-th are kept with
    it. Without both good and bad labels every row is kept; an empty table gives
    an empty result. Other columns are ignored.
    """
    scratch = Scratch(spark, "quality")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key().alias("row"))
    sample = scratch.write(labelled_sample(labels, "quality", max_labelled), "labels")
    ratio = spark.sparkContext.broadcast(fit_log_ratio(spark, docs, sample))
    scored = docs.mapInArrow(_score(ratio), "doc_id long, row long, n_grams long, log_weight double")
    uniform = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    scored = scratch.write(scored.withColumn("sample_key", F.col("log_weight") - F.log(-F.log(uniform))), "scored")
    ratio.destroy()
    if share is None:
        known = scored.join(F.broadcast(sample.where(~in_fit())), F.col("doc_id") == F.col("label_id"))
        k = expected_good(scored, known.groupBy("label_id").agg(F.min("log_weight").alias("w"), F.max("label").alias("label")))
    else:
        k = round(share * scored.count())
    threshold = kth_largest(scored.select(F.col("sample_key").alias("key")), k, scratch)
    kept = F.lit(False) if threshold is None else F.col("sample_key") >= threshold
    return scored.withColumn("kept", kept)


def quality_filter(spark: SparkSession, docs: DataFrame, labels: DataFrame, share: float | None = None) -> DataFrame:
    """The rows of ``docs`` that the sample keeps, with their columns, whatever their names; each row, ids null or repeated, has its own verdict."""
    rejected = Scratch(spark, "quality-filter").write(quality_resampling(spark, docs, labels, share).where("not kept").select("row").distinct(), "rejected")
    return other_rows(docs.withColumn("_nx_row", row_key()), rejected, "_nx_row").select(*[F.col(f"`{c}`") for c in docs.columns])
