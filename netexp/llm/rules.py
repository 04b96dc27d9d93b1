"""Quality rules as a ledger of failure bits.

Every rule is evaluated once: its measurement is stored and its failure is one
bit of ``fail_bits``. A policy is a version with a bitmask of hard rules and a
bitmask of soft rules with the number of soft failures it allows; applying
another version, or asking what a rule alone rejects, only reads the ledger.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netexp.llm.cluster import small_batches
from netexp.llm.textkit import U, Prefix, mix, slices, words

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]

#: Rules by bit: (name, condition of failure over the measurements, all in whole numbers).
RULES = [
    ("too_few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
]
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}

#: Versions of the policy: (hard rules, soft rules, soft failures that are allowed).
POLICIES = {
    "v1": (BIT["too_few_words"] | BIT["repeated_words"] | BIT["symbols"] | BIT["short_words"] | BIT["long_words"] | BIT["duplicate_lines"], 0, 0),
    "v2": (BIT["too_few_words"] | BIT["repeated_words"], BIT["symbols"] | BIT["short_words"] | BIT["long_words"] | BIT["duplicate_lines"], 1),
}

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def _repeated(keys: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether each (group, key) occurs twice or more; rows are in order of group."""
    both = mix(keys ^ mix(group.astype(U) + U(0x2545F491)))
    _, inverse, count = np.unique(both, return_inverse=True, return_counts=True)
    return count[inverse] > 1


def measure_slice(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The measurements (rows: texts, columns: MEASURES) of a slice of whole texts."""
    n = len(offsets) - 1
    out = np.zeros((n, len(MEASURES)), dtype=np.int64)
    if not len(buf):
        return out
    s, e, first = words(buf, offsets)
    out[:, 0] = np.diff(first)
    lead = np.concatenate(([0], np.cumsum((buf & 0xC0) != 0x80)))
    inside = np.concatenate(([0], np.cumsum(lead[e] - lead[s])))
    out[:, 1] = np.diff(inside[first])
    out[:, 2] = np.diff(np.concatenate(([0], np.cumsum(_SYMBOL[buf])))[offsets])
    prefix = Prefix(buf)
    doc = np.repeat(np.arange(n), np.diff(first))

    # lines: a text of no bytes has one empty line
    breaks = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    owner = np.searchsorted(offsets, breaks, "right") - 1
    line_doc = np.sort(np.concatenate((np.arange(n), owner)))
    ends = np.sort(np.concatenate((offsets[1:], breaks)))
    out[:, 5] = np.bincount(line_doc, minlength=n)
    worded = np.searchsorted(s, ends) > np.searchsorted(s, starts)
    starts, ends, line_doc = starts[worded], ends[worded], line_doc[worded]
    if len(starts):
        key = mix(prefix.hashes(starts, ends) ^ mix(line_doc.astype(U)))
        order = np.argsort(key, kind="stable")
        again = np.zeros(len(key), dtype=bool)
        again[order[1:]] = key[order[1:]] == key[order[:-1]]
        out[:, 3] = np.bincount(line_doc[again], minlength=n)

    if len(s) >= 3:
        h = prefix.hashes(s, e)
        three = mix(mix(h[:-2] * U(0xA0761D6478BD642F) + h[1:-1]) * U(0xE7037ED1A0B428DB) + h[2:])
        whole = np.flatnonzero(doc[:-2] == doc[2:])
        hit = np.zeros(len(s), dtype=bool)
        if len(whole):
            twice = whole[_repeated(three[whole], doc[whole])]
            for j in range(3):
                hit[twice + j] = True
        out[:, 4] = np.bincount(doc[hit], minlength=n)
    return out


def _measure(batches):
    for batch in batches:
        for at, to, buf, offsets in slices(batch.column(1)):
            values = measure_slice(buf, offsets)
            yield pa.record_batch([batch.column(0).slice(at, to - at), *(pa.array(values[:, j]) for j in range(len(MEASURES)))], names=["doc_id", *MEASURES])


def measure(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): the measurements. Null and empty texts measure 0 words and one line less of bytes: one empty line.

    n_words: runs of characters other than space and 0x09-0x0D; word_chars: code
    points in them; n_symbols: characters of ``#*$%&|<>``; n_dup_lines:
    newline-split lines with a word that equal an earlier line; n_repeat_words:
    words in three-word windows found twice or more; n_lines.
    """
    small_batches(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_measure, "doc_id " + docs.schema["doc_id"].dataType.simpleString() + "".join(f", {m} long" for m in MEASURES))


def ledger(docs: DataFrame, rules=RULES) -> DataFrame:
    """doc_id, the measurements, and fail_bits: bit i is set where rule i fails."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, (_, fails) in enumerate(rules)])
    return measure(docs).withColumn("fail_bits", bits)


def apply_policy(book: DataFrame, version: str, policies=POLICIES) -> DataFrame:
    """The ledger with ``kept`` by a version of the policy."""
    hard, soft, allowed = policies[version]
    bits = F.col("fail_bits")
    return book.withColumn("kept", (bits.bitwiseAND(F.lit(hard).cast("long")) == 0) & (F.bit_count(bits.bitwiseAND(F.lit(soft).cast("long"))) <= allowed))


def ablation(book: DataFrame, rules=RULES) -> DataFrame:
    """A row per rule: how many documents fail it, how many fail nothing else, and the union of bits seen with it."""
    exploded = book.groupBy("fail_bits").agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(i).alias("bit"), F.lit(name).alias("rule")) for i, (name, _) in enumerate(rules)])
    each = exploded.select("fail_bits", "n", F.explode(names).alias("r")).where(F.expr("shiftright(fail_bits, r.bit) & 1 = 1"))
    return each.groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit")).agg(F.sum("n").alias("failed"), F.sum(F.when(F.bit_count("fail_bits") == 1, F.col("n")).otherwise(0)).alias("failed_alone"), F.bit_or("fail_bits").alias("seen_with"))
