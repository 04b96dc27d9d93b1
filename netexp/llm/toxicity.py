"""Toxicity by a classifier chain over hashed words.

The categories are columns of the labels; they are predicted in order, the last
one is the verdict. A later category's linear model has the earlier categories'
probabilities (as log odds) beside its words. In training these are out-of-fold
predictions, so a later model sees earlier ones as they will be on new
documents. A category's words are those that speak for it by a chi-square test.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netexp.llm.cluster import small_batches
from netexp.llm.textkit import LOWER, U, Prefix, mix, slices, words

BITS = 18
#: Bound of the fit: labelled documents.
MAX_LABELLED = 8_000
FOLDS, STEPS = 3, 300
#: The 0.999 quantile of chi-square with one degree of freedom.
CHI_SQUARE = 10.83

_PUNCT = np.zeros(256, dtype=bool)
_PUNCT[list(b".,;:!?\"'()[]{}*#$%&|<>_-/\\`~+=@^")] = True


def word_buckets(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of each text's words (lower case, ASCII punctuation parts words) with the index of each text's first (len + 1)."""
    buf = LOWER[np.where(_PUNCT[buf], np.uint8(32), buf)]
    s, e, first = words(buf, offsets)
    n = len(offsets) - 1
    bucket = (mix(Prefix(buf).hashes(s, e) + U(5)) >> U(64 - BITS)).astype(np.int64)
    both = np.unique((np.repeat(np.arange(n), np.diff(first)) << BITS) | bucket)
    return both & ((1 << BITS) - 1), np.searchsorted(both >> BITS, np.arange(n + 1))


def _features(batches):
    for batch in batches:
        for at, to, buf, offsets in slices(batch.column(0)):
            values, bounds = word_buckets(buf, offsets)
            buckets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.astype(np.int32)))
            yield pa.record_batch([buckets, batch.column(1).slice(at, to - at)], names=["buckets", "marks"])


class Logistic:
    """L2-regularised logistic regression on binary words and some real columns, by Adam on all rows."""

    def __init__(self, n_words: int, n_real: int):
        self.w, self.v, self.b = np.zeros(n_words), np.zeros(n_real), 0.0

    def fit(self, row: np.ndarray, col: np.ndarray, real: np.ndarray, y: np.ndarray) -> Logistic:
        n = max(1, len(y))
        l2 = 1.0 / n
        theta = np.concatenate((self.w, self.v, [0.0 if not 0 < y.mean() < 1 else np.log(y.mean() / (1 - y.mean()))])) if len(y) else np.zeros(len(self.w) + len(self.v) + 1)
        a, b, k = len(self.w), len(self.w) + len(self.v), 0.0
        m, s = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, STEPS + 1):
            z = np.bincount(row, weights=theta[:a][col], minlength=len(y)) + real @ theta[a:b] + theta[b]
            r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / n
            g = np.concatenate((np.bincount(col, weights=r[row], minlength=a), real.T @ r, [r.sum()]))
            g[:b] += l2 * theta[:b]
            m, s = 0.9 * m + 0.1 * g, 0.999 * s + 0.001 * g * g
            theta = theta - 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-9)
        self.w, self.v, self.b = theta[:a], theta[a:b], float(theta[b])
        return self

    def odds(self, row: np.ndarray, col: np.ndarray, real: np.ndarray, n: int) -> np.ndarray:
        return np.bincount(row, weights=self.w[col], minlength=n) + real @ self.v + self.b


class Chain:
    """The fitted models of ``names``, in order; ``cut`` is the log odds from which a document has the last category.

    ``features`` has the distinct buckets of each labelled document, ``marks`` a
    row each with 1, 0 or -1 (unknown) by category: a document is in the fit of
    the categories that are known of it.
    """

    def __init__(self, names: list[str], features: list[np.ndarray], marks: np.ndarray):
        self.names, n = names, len(features)
        every = np.concatenate([*features, np.zeros(0, np.int64)]).astype(np.int64)
        owner = np.repeat(np.arange(n), [len(f) for f in features])
        fold = np.arange(n) % FOLDS
        real = np.zeros((n, 0))
        self.places, self.models = [], []
        for j in range(len(names)):
            known = marks[:, j] >= 0
            y = (marks[:, j] == 1).astype(float)
            place = self.speaking_words(every[known[owner]], (y == 1)[owner][known[owner]], y[known])
            col = place[every]
            row, col = owner[col >= 0], col[col >= 0]
            out = np.zeros(n)
            for f in range(FOLDS):
                part = self._fit(place, known & (fold != f), row, col, real, y)
                out[fold == f] = part.odds(row, col, real, n)[fold == f]
            self.places.append(place)
            self.models.append(self._fit(place, known, row, col, real, y))
            real = np.column_stack((real, np.clip(out, -10, 10)))
        self.cut = self._best_cut(real[known, -1], y[known] == 1)

    @staticmethod
    def speaking_words(buckets: np.ndarray, positive: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Feature number of each bucket, -1 for those that do not speak for the category: a text is never in it by what it lacks."""
        count = np.bincount(buckets, minlength=1 << BITS)
        hits = np.bincount(buckets[positive], minlength=1 << BITS)
        rate = y.mean() if len(y) else 0.0
        expected = count * rate
        chi = np.where((count >= 3) & (hits > expected), (hits - expected) ** 2 / np.maximum(expected * (1 - rate), 1e-9), 0)
        chosen = np.flatnonzero(chi > CHI_SQUARE)
        place = np.full(1 << BITS, -1, dtype=np.int32)
        place[chosen] = np.arange(len(chosen))
        return place

    @staticmethod
    def _fit(place: np.ndarray, use: np.ndarray, row: np.ndarray, col: np.ndarray, real: np.ndarray, y: np.ndarray) -> Logistic:
        number, inside = np.cumsum(use) - 1, use[row]
        return Logistic(int(place.max()) + 1, real.shape[1]).fit(number[row[inside]], col[inside], real[use], y[use])

    @staticmethod
    def _best_cut(odds: np.ndarray, y: np.ndarray) -> float:
        """The cut with the best F1 out of fold, midway in the widest gap among the best."""
        if not y.any():
            return np.inf
        order = np.argsort(-odds, kind="stable")
        tp = np.cumsum(y[order])
        f1 = 2 * tp / (np.arange(1, len(y) + 1) + y.sum())
        s = odds[order]
        gap = np.append(s[:-1] - s[1:], 1.0)
        best = max(np.flatnonzero((f1 >= f1.max() - 1e-12) & (gap > 0)), key=lambda i: gap[i])
        return float(s[best] - gap[best] / 2)

    def odds(self, values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Log odds (rows: texts, columns: categories) of texts with distinct buckets ``values``."""
        n = len(bounds) - 1
        owner, real = np.repeat(np.arange(n), np.diff(bounds)), np.zeros((n, 0))
        for place, model in zip(self.places, self.models, strict=True):
            col = place[values]
            real = np.column_stack((real, np.clip(model.odds(owner[col >= 0], col[col >= 0], real, n), -10, 10)))
        return real


def fit_chain(docs: DataFrame, labels: DataFrame, chain: list[str], max_labelled: int = MAX_LABELLED) -> Chain:
    """Fitted on the driver on at most ``max_labelled`` labelled documents, chosen by hash of the id, one row each: of rows that share an id the one with the least hash of its text."""
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_nx_label_id"))
    marks = known.agg(*[F.coalesce(F.max(F.col(f"`{c}`")).cast("int"), F.lit(-1)).alias(f"m{j}") for j, c in enumerate(chain)])
    marks = marks.where(f"m{len(chain) - 1} >= 0").select("_nx_label_id", F.array(*[f"m{j}" for j in range(len(chain))]).alias("_nx_marks"))
    sample = F.broadcast(marks.orderBy(F.xxhash64("_nx_label_id"), "_nx_label_id").limit(max_labelled))
    texts = docs.select(F.col("doc_id").cast("long").alias("_nx_id"), F.col("text").cast("string").alias("text")).join(sample, F.col("_nx_id") == F.col("_nx_label_id"))
    # one row an id, however often it stands there
    one = texts.groupBy("_nx_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "_nx_marks")).alias("r")).select("r.text", "r._nx_marks")
    rows = one.mapInArrow(_features, "buckets array<int>, marks array<int>").toArrow()
    buckets = rows["buckets"].to_pylist() if rows.num_rows else []
    features = [np.array(x, dtype=np.int64) for x in buckets]
    found = np.array(rows["marks"].to_pylist() if rows.num_rows else [], dtype=np.int64).reshape(-1, len(chain))
    order = sorted(range(len(features)), key=lambda i: (features[i].tobytes(), found[i].tolist()))  # whatever the order of arrival
    order = [order[i] for i in np.random.default_rng(11).permutation(len(order))]
    return Chain(chain, [features[i] for i in order], found[order])


def toxicity_chain(spark: SparkSession, docs: DataFrame, labels: DataFrame, chain: list[str], max_labelled: int = MAX_LABELLED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, p_<category> for each of ``chain``, toxic (the verdict on the last).

    ``labels``: doc_id and a column of 1 and 0 for each category; a null is
    unknown and leaves a document out of that category's fit, a null in the last
    category or in doc_id out of all; of several rows for an id the largest
    counts. Null and empty texts get the models' intercepts. Without a document
    of the last category nothing is toxic. Texts are read whole; repeated rows
    are judged alike, an empty table gives an empty result, and other columns
    are ignored.
    """
    small_batches(docs.sparkSession)
    fitted = spark.sparkContext.broadcast(fit_chain(docs, labels, list(chain), max_labelled))
    names = [f"p_{c}" for c in chain]

    def predict(batches):
        model = fitted.value
        for batch in batches:
            for at, to, buf, offsets in slices(batch.column(1)):
                odds = model.odds(*word_buckets(buf, offsets))
                p = 1 / (1 + np.exp(-odds))
                yield pa.record_batch([batch.column(0).slice(at, to - at), *(pa.array(p[:, j]) for j in range(len(names))), pa.array(odds[:, -1] >= model.cut)], names=["doc_id", *names, "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(predict, f"doc_id {kind}, {', '.join(f'{x} double' for x in names)}, toxic boolean")
