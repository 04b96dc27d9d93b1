"""Filter audit, target resampling and decontamination against brute force; nulls, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from itertools import permutations
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from netexp.llm import decontaminate, filter_audit, fm_index, line_dedup, queries, target_resampling

DOCS = "doc_id long, text string, lang string, n_words long, mask int, rank long, score long, spans string, part string"


def docs(spark, rows):
    """Rows (doc_id, text, lang) with columns that the operators use names of."""
    return spark.createDataFrame([(i, t, g, 7, 7, 7, 7, "x", "p") for i, t, g in rows], DOCS)


def lower_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def prose(n, seed, vocabulary=40):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


# filter audit


def failed_by_force(rows):
    out = []
    for i, t, g in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        f = set()
        f |= {"A"} if len(w) < 200 else set()
        f |= {"B"} if 100 * len(set(w)) < 50 * len(w) else set()
        f |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        f |= {"D"} if re.search("[#$%&*|]", t) else set()
        f |= {"E"} if i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows) else set()
        out.append((g or "", f, i))
    return out


def audit_by_force(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    failed, out = failed_by_force(rows), {}
    for part in {p for p, _, _ in failed}:
        here, total = [(f, i) for p, f, i in failed if p == part], Counter()
        for order in permutations("ABCDE"):
            left = here
            for step, name in enumerate(order, 1):
                gone = [x for x in left if name in x[0]]
                left = [x for x in left if name not in x[0]]
                fails = [x for x in here if name in x[0]]
                total[name] += len(gone)
                out[part, "".join(order), step] = (len(left), len(gone), len(fails) - len(gone), sum(x[0] == {name} for x in here), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone))
        for key in [k for k in out if k[0] == part]:
            out[key] += (total[key[1][key[2] - 1]],)
    return out


AUDITED = [(None, "a", "en"), (None, "a", "en"), (1, "a", None), (2, "a", "en"), (2, "a", "de"), (3, None, "en"), (4, "", ""), (5, "SHOUT " * 250, "en"), (6, prose(260, 1, 4000), "en"), (7, prose(260, 1, 4000), "de"), (8, prose(260, 2, 4000) + " #", "en"), (9, "é " * 300, "en"), (10, "É $ x", "de"), (10, "É $ x", "de"), (11, "x y " * 40000, "fr")]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, None), (5, None, 1), (8, 1, None), (None, 1, 1), (10, 1, 1), (77, 1, 1)]


def test_audit_matches_brute_force(spark):
    t = filter_audit.filter_audit(spark, docs(spark, AUDITED), spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int"))
    assert {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in t.collect()} == audit_by_force(AUDITED, LABELS)
    assert t.count() == 600 * 4


def test_audit_of_nothing(spark):
    assert filter_audit.filter_audit(spark, docs(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_removal_polynomial():
    """Every corner, and Shapley values that add up to what all filters remove."""
    rng = random.Random(3)
    counts = {m: rng.randrange(50) for m in range(32)}
    p = filter_audit.RemovalPolynomial(counts, 5)
    assert all(p.corner(on) == sum(c for m, c in counts.items() if m & on) for on in range(32))
    assert sum(p.shapley(i) for i in range(5)) == p.corner(31)


# target resampling


def resampled_by_force(rows, target):
    def features(text):
        w = lower_words(text)
        return [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]

    bucket = lambda f: crc32(f.encode()) % 10000
    s, t = Counter(bucket(f) for _, x, _ in rows for f in features(x)), Counter(bucket(f) for x in target for f in features(x))
    total_s, total_t = sum(s.values()), sum(t.values())
    out = []
    for i, x, _ in rows:
        f = features(x)
        gain = [math.floor(1000 * math.log((t[bucket(g)] + 1) * (total_s + 10000) / ((s[bucket(g)] + 1) * (total_t + 10000)))) for g in f]
        weight = sum(gain) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(lower_words(x))])
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = [(*r[:4], k) for k, r in enumerate(fit[: 25 * len(fit) // 100], 1)]
    rest = [(*r[:4], None) for r in fit[len(drawn) :]] + [(*r[:4], None) for r in out if r[4] < 20]
    return Counter(drawn + rest)


RAW = [(None, prose(30, 9), "en"), *[(i, prose(5 + i % 60, i), "en") for i in range(120)], (5, prose(44, 5), "en"), *[(500, prose(40, 7), "en")] * 9, (600, None, "en"), (601, "", "en"), (602, " .,;\x00\x7f ", "en"), (603, "Ünicode Wörter 9a B_c " * 9000, "en")]
TARGET = [prose(80, 100, 12), None, "", "Wörter 9A", prose(30, 101)]


def test_resampling_matches_brute_force(spark):
    t = target_resampling.target_resampling(spark, docs(spark, RAW), spark.createDataFrame([(i, x) for i, x in enumerate(TARGET)], "item_id long, text string"))
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in t.collect()) == resampled_by_force(RAW, TARGET)


def test_resampling_edges(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert target_resampling.target_resampling(spark, docs(spark, []), none).count() == 0
    few = docs(spark, [(1, prose(30, 1), "en"), (2, prose(30, 2), "en"), (3, prose(30, 3), "en")])
    assert target_resampling.target_resampling(spark, few, none).where("rank is not null").count() == 0
    every = target_resampling.drawn_documents(spark, few, none, percent=100)
    assert every.columns == few.columns and every.count() == 3


def test_drawn_documents_are_like_the_target(spark):
    rows = [(i, prose(40, i, 20) if i % 2 else " ".join(f"v{j}" for j in range(i, i + 40)), "en") for i in range(400)]
    t = target_resampling.drawn_documents(spark, docs(spark, rows), spark.createDataFrame([(prose(3000, 1, 20),)], "text string"))
    assert t.count() == 100 and t.where("doc_id % 2 = 1").count() > 75  # without weights 50


# decontamination


def test_fm_index_finds_every_phrase():
    rng = np.random.default_rng(1)
    for _ in range(60):
        symbols = np.concatenate([np.concatenate((rng.integers(1, rng.integers(2, 9), n), [0])) for n in rng.integers(0, 80, rng.integers(1, 6))]).astype(np.int32)
        index = fm_index.FMIndex.load(*fm_index.FMIndex.build(symbols).parts())
        assert index.locate(np.arange(len(symbols))).tolist() == fm_index.suffix_order(symbols).tolist()
        for k in (1, 2, 4, 9):
            asked = np.array([p for p in (symbols[i : i + k] for i in range(len(symbols) - k + 1)) if p.all()] or np.zeros((0, k)), dtype=np.int64).reshape(-1, k)
            for p, a, b in zip(asked, *index.ranges(asked, np.full(len(asked), k)), strict=True):
                assert sorted(index.locate(np.arange(a, b))) == [i for i in range(len(symbols) - k + 1) if (symbols[i : i + k] == p).all()]


def test_suffixes_of_equal_texts():
    text = np.random.default_rng(2).integers(1, 50, 400)
    symbols = np.concatenate([np.concatenate((text, [0]))] * 30).astype(np.int32)
    order = fm_index.suffix_order(symbols)
    ranked = [*(tuple(symbols[i:].tolist()[: symbols[i:].tolist().index(0)]) for i in order)]
    assert ranked == sorted(ranked) and sorted(order) == list(range(len(symbols)))


def hit_by_force(rows, items, window=10):
    phrases = defaultdict(set)
    for item, text in items:
        w = lower_words(text)
        for i in range(max(len(w) - window + 1, 1 if w else 0)):
            phrases[tuple(w[i : i + window])].add(item)
    out = []
    for i, text, _ in rows:
        w, hit, found = lower_words(text), set(), set()
        for k in {len(p) for p in phrases}:
            for j in range(len(w) - k + 1):
                if tuple(w[j : j + k]) in phrases:
                    hit |= set(range(j, j + k))
                    found |= {str(x) for x in phrases[tuple(w[j : j + k])] if x is not None}
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return Counter(out)


ITEMS = [(1, prose(25, 1, 3000)), (2, "Only five Words, here!"), (3, prose(25, 1, 3000) + " more"), (10, "ünï Wörd"), (4, None), (5, ""), (6, " -- "), (None, prose(12, 2, 3000)), (7, "a"), (7, prose(11, 3, 3000)), (11, "b " * 14)]
READ = [
    (1, "x " + prose(25, 1, 3000) + " y", "en"), (2, prose(25, 1, 3000).upper(), "en"), (3, " ".join(prose(25, 1, 3000).split()[5:14]), "en"), (4, " ".join(prose(25, 1, 3000).split()[5:15]), "en"),
    (5, "say: only-five.words\nHERE, only five words", "en"), (6, None, "en"), (7, "", "en"), (8, ". - ", "en"), (9, prose(12, 2, 3000), "en"), (9, prose(12, 2, 3000), "en"), (9, "other text", "en"), (None, "ÜNÏ ünï wörd", "en"),
    (10, "a a b A", "en"), (11, "b " * 30, "en"), (12, " ".join([prose(300, 8, 3000), prose(11, 3, 3000), prose(300, 9, 3000), prose(25, 1, 3000)] * 3), "en"), (13, "b " * 9 + "c", "en"),
]


@pytest.mark.parametrize(("shard", "block"), [(1 << 20, 1 << 25), (64, 1 << 25), (200, 300)])
def test_decontamination_matches_brute_force(spark, monkeypatch, shard, block):
    """In one shard, in many (texts are cut), and with phrases in several blocks."""
    monkeypatch.setattr(decontaminate, "LOCATE", 7 if shard == 64 else 1 << 20)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    t = decontaminate.contamination_report(spark, docs(spark, READ), items, shard_words=shard, block_bytes=block)
    got = Counter((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), len(r["items"]), hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(), bool(r.spans)) for r in t.collect())
    assert got == hit_by_force(READ, ITEMS)
    assert all(a.end < b.start for r in t.collect() for a, b in zip(r.spans, r.spans[1:]))


def test_decontamination_edges(spark):
    none, items = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.contamination_report(spark, docs(spark, []), items).count() == 0
    assert decontaminate.contamination_report(spark, docs(spark, READ), none).where("size(spans) > 0").count() == 0


def test_contamination_is_removed(spark):
    items = spark.createDataFrame([(1, prose(25, 1, 3000)), (2, "Only five Words, here!")], "item_id long, text string")
    frame = docs(spark, READ)
    t = decontaminate.remove_contamination(spark, frame, items)
    assert t.columns == frame.columns and t.count() == len(READ)
    text = {r.doc_id: r.text for r in t.where("doc_id <> 9").collect()}
    assert text[1] == "x  y" and text[2] == "" and text[3] == READ[2][1] and text[5] == "say: , only five words" and text[6] is None
    assert t.where("doc_id = 9").select("text").distinct().count() == 2
    assert decontaminate.contamination_report(spark, t, items).where("size(spans) > 0").count() == 0


def test_queries_are_registered():
    for name in ("op11_filter_audit", "op12_decontamination", "op13_target_resampling"):
        assert name in queries.QUERIES and name in queries.ORACLES


# line dedup by path


def test_lines_by_path(spark):
    """Long repeated passages are told by chunks and their extensions to their first and last line, whatever stands around; only runs too short for a chunk are left to pairs."""
    passages = [[prose(12, 1000 * p + i, 9000) for i in range(25)] for p in range(4)]
    texts = ["\n".join([*(prose(9, 50 * i + j, 9000) for j in range(i % 3)), *passages[i % 4], *(prose(9, 70000 + 50 * i + j, 9000) for j in range(2))]) for i in range(16)]
    report = {r.doc_id: r for r in line_dedup.line_dedup_report(spark, docs(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    assert all(report[i].n_removed_lines == 0 for i in range(4))
    assert all(report[i].n_removed_lines == report[i].n_chunk_lines == 25 and report[i].n_removed_chunks == 1 for i in range(4, 16))
    short = ["a b\nc d", "e f\na b\nc d\ng h", "i j\nk l", "i j\nk l\nm n"]
    report = line_dedup.line_dedup_report(spark, docs(spark, [(i, t, "en") for i, t in enumerate(short)])).collect()
    assert sum(r.n_removed_lines for r in report) == 4 and all(r.n_chunk_lines <= r.n_removed_lines for r in report)


def test_extension_stops_where_lines_differ(spark):
    """To the line; empty tables and very long lines."""
    base = [prose(8, i, 9000) for i in range(40)]
    texts = ["\n".join(base), "\n".join(["first", *base[:30], *(f"other {x}" for x in base[30:])]), "\n".join([*(f"x {x}" for x in base[:7]), *base[7:]]), None, "", "\n\n", "one line"]
    report = {r.doc_id: (r.n_removed_lines, r.n_chunk_lines) for r in line_dedup.line_dedup_report(spark, docs(spark, [(i, t, "en") for i, t in enumerate(texts)])).collect()}
    assert report == {0: (0, 0), 1: (30, 30), 2: (33, 33), 3: (0, 0), 4: (0, 0), 5: (0, 0), 6: (0, 0)}
    assert line_dedup.line_dedup_report(spark, docs(spark, [])).count() == 0
    huge = "\n".join([prose(30, 5, 9000), "w " * 300_000, prose(30, 6, 9000)])
    rows = {r.doc_id: r.n_removed_lines for r in line_dedup.line_dedup_report(spark, docs(spark, [(1, huge, "en"), (2, huge, "en")])).collect()}
    assert rows == {1: 0, 2: 3}
