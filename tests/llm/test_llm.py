"""Edge cases and brute-force comparisons of the text-pipeline operators on small fixtures."""

import hashlib
import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from netexp.llm import induced, licenses, line_dedup, mixing, ngram_join, quality, queries, rules, spm, suffix_dedup, topk, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, sources=None):
    return spark.createDataFrame([(i, t, "en", (sources or ["a"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)], DOCS)


def words(n, seed, vocabulary=200):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def near(text, n, seed):
    w, rng = text.split(), random.Random(seed)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
    return " ".join(w)


BASE = words(120, 1)
TEXTS = [None, "", "  \n\t", "one", "One", "a b c", "a b c d", "A b C d", BASE, BASE, *[near(BASE, 1 + i % 3, i) for i in range(8)], *[words(40, i) for i in range(50, 54)], "x y é ü " * 30]


def components_by_force(rows, k=4, num=85, den=100):
    """{doc_id: (n_shingles, component_id, n_links)} for rows (doc_id, text) with different ids."""
    sets = []
    for _, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set())
    label, links = [i for i, _ in rows], [0] * len(rows)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            links[i] += bool(i != j and a and b and den * len(a & b) >= num * len(a | b))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                if a and b and den * len(a & b) >= num * len(a | b):
                    label[i] = label[j] = min([x for x in (label[i], label[j]) if x is not None], default=None)
    return {d: (len(s), label[i], links[i]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))}


def joined(frame, **parameters):
    return [(r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in ngram_join.ngram_jaccard_components(frame.sparkSession, frame, **parameters).collect()]


@pytest.mark.parametrize("block, times", [(384, 4), (3, 1)])
def test_join_matches_brute_force(spark, monkeypatch, block, times):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "HISTOGRAM_BLOCK", 2 * block)
    d = docs(spark, TEXTS).withColumn("n", F.lit(1)).withColumn("sig", F.lit("clash")).withColumn("row", F.lit(0)).withColumn("node", F.lit(0))
    assert {i: tuple(x) for i, *x in joined(d, frequent_times=times)} == components_by_force(list(enumerate(TEXTS)))


def test_join_with_null_and_repeated_ids(spark):
    rows = [(None, BASE), (7, near(BASE, 1, 1)), (9, near(BASE, 1, 2)), (None, words(50, 91)), (3, words(50, 92)), (9, words(50, 92)), (5, words(50, 93)), (5, words(50, 93)), (8, None), (4, words(50, 94)), (None, words(50, 94).upper())]
    got = sorted(joined(spark.createDataFrame(rows, "doc_id long, text string")), key=str)
    # 7, 9 and the first null are near copies; 9 also has the text of 3; the repeated row of 5 is one document
    assert got == sorted([(None, 117, 3, 2), (7, 117, 3, 2), (9, 117, 3, 2), (None, 47, None, 0), (3, 47, 3, 1), (9, 47, 3, 1), (5, 47, 5, 0), (5, 47, 5, 0), (8, 0, 8, 0), (4, 47, 4, 1), (None, 47, 4, 1)], key=str)


def test_frequency_sums(monkeypatch):
    import pyarrow as pa

    width = 1 << 12
    rng = np.random.default_rng(6)
    counts, rows = np.zeros(2 * width, np.int64), []
    for part in range(5):
        for chunk in range(2):
            at = np.sort(rng.choice(width, int(rng.integers(1, width)), replace=False))
            n = rng.integers(1, 256, len(at)).astype(np.uint8)
            counts[chunk * width + at] += n
            dense = np.zeros(width, np.uint8)
            dense[at] = n
            rows.append((chunk, part // 2, b"" if part % 2 else at.astype(np.uint16).tobytes(), dense.tobytes() if part % 2 else n.tobytes()))

    def batches(rows, kinds):
        rows = sorted(rows, key=lambda r: r[: len(kinds) - 2])
        for i in range(0, len(rows), 3):
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*rows[i : i + 3], strict=True), kinds, strict=True)], names=[str(j) for j in range(len(kinds))])

    some = [(b.column(0)[0].as_py(), b.column(1)[0].as_py(), b.column(2)[0].as_py()) for b in ngram_join._add_counts(2, width, False)(batches(rows, [pa.int32(), pa.int64(), pa.binary(), pa.binary()]))]
    assert len(some) == 6
    levels = {b.column(0)[0].as_py(): b.column(2)[0].as_py() for b in ngram_join._add_counts(1, width, True)(batches(some, [pa.int32(), pa.binary(), pa.binary()]))}
    expected = np.where(counts > 0, np.rint(2 * np.log2(np.maximum(counts, 1))) + 1, 0).astype(np.uint8)
    assert levels[0] + levels[1] == expected.tobytes()


def test_order_with_full_buckets():
    """Where each bucket holds a hundred shingles, those in a few dozen more sets still come last, and the table grows with a large corpus."""
    import pyarrow as pa

    rng = np.random.default_rng(8)
    counts = rng.poisson(100, 1 << 16)
    counts[:200] += 40
    (row,) = ngram_join._add_counts(1, 1 << 16, True, ngram_join.LEVELS)([pa.record_batch([pa.array([0], pa.int32()), pa.array([b""]), pa.array([counts.astype(np.uint32).tobytes()])], names=["chunk", "at", "n"])])
    levels = np.frombuffer(row.column(2)[0].as_py(), dtype=np.uint8)
    assert levels[:200].min() > np.quantile(levels[200:], 0.5)
    assert np.mean(levels[:200] > np.quantile(levels[200:], 0.999)) > 0.7
    assert ngram_join.frequent_class(levels, 4) <= ngram_join.LEVELS * np.log2(150) + 2
    assert [ngram_join.bits_for(size) for size in (6 << 20, 840_000_000, 10_000_000_000)] == [21, 24, 27]


def test_join_of_nothing(spark):
    assert ngram_join.ngram_jaccard_components(spark, docs(spark, ["a"]).limit(0)).count() == 0


def test_histograms_part_no_links():
    rng = np.random.default_rng(3)
    sets = []
    for n in (3, 40, 300, 300, 9000):
        x = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
        for _ in range(8):
            kept = x[rng.permutation(len(x))[rng.integers(0, len(x) // 6 + 1) :]]
            sets.append(np.unique(np.concatenate((kept, rng.integers(1, 1 << 62, rng.integers(0, len(x) // 8 + 1)).astype(np.uint64)))))
    ids, n, bins = list(range(len(sets))), np.array([len(s) for s in sets]), ngram_join.histograms(sets)

    def parts(edges):
        label = list(ids)
        for _ in ids:
            for a, b in edges:
                label[a] = label[b] = min(label[a], label[b])
        return label

    possible, linked = parts(ngram_join.possible_forest(ids, n, bins, 17, 20)), ngram_join.linked_forest(ids, sets, 17, 20)
    assert linked and all(possible[a] == possible[b] for a, b in linked)
    assert len(set(possible)) >= 5


def test_signatures_meet():
    rng = np.random.default_rng(0)
    for frequent in (1, 30, 255):
        for n in (3, 6, 20, 150, 900):
            table = rng.integers(0, 60, 1 << ngram_join.BUCKET_BITS).astype(np.uint8)
            x = np.unique(rng.integers(1, 1 << 62, n).astype(np.uint64))
            for _ in range(20):
                y = x
                while True:
                    cut = rng.integers(0, n // 6 + 1)
                    y = np.unique(np.concatenate((rng.permutation(x)[cut:], rng.integers(1, 1 << 62, rng.integers(0, n // 8 + 1)).astype(np.uint64))))
                    both = len(np.intersect1d(x, y))
                    if 100 * both >= 85 * (len(x) + len(y) - both):
                        break
                if len(y) == len(x) == both:
                    continue
                a, b = (ngram_join.signatures(s, table, frequent, 17, 20) for s in (x, y))
                assert len(np.intersect1d(a, b))


MODEL = queries.SPM_MODEL


def test_sentencepiece_matches_the_library_as_unigram(tmp_path):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    with open(MODEL, "rb") as f:
        raw = f.read()
    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(raw)
    proto.trainer_spec.model_type = 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    codec = spm.SentencePieceCodec(raw)
    for text in ["", "a", "Hello  world", " lead and trail ", "naïve café über", "日本語 😀 \x00\n\t", "x" * 60, words(30, 3)]:
        assert codec.encode(text).tolist() == library.encode(text), text
        assert codec.decode(codec.encode(text).tolist()) == text


def test_sentencepiece_round_trip(spark):
    d = docs(spark, [*TEXTS, "z" * 5000])
    coded = spm.sentencepiece_encode(spark, d, MODEL)
    assert coded.where("not round_trip").count() == 0 and coded.where("n_tokens <> size(token_ids)").count() == 0
    back = {r.doc_id: r.text for r in spm.sentencepiece_decode(spark, coded, MODEL).collect()}
    assert back == {i: t or "" for i, t in enumerate([*TEXTS, "z" * 5000])}


def test_sentencepiece_edges(spark):
    d = docs(spark, ["a b", None, "a b"]).withColumn("token_ids", F.lit(1)).withColumn("n_tokens", F.lit(2))
    coded = spm.sentencepiece_encode(spark, d.unionAll(d), MODEL).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in coded) == Counter({(0, len(coded[0].token_ids)): 2, (1, 0): 2, (2, len(coded[0].token_ids)): 2})
    assert spm.sentencepiece_encode(spark, d.limit(0), MODEL).count() == 0
    assert [r.text for r in spm.sentencepiece_decode(spark, spark.createDataFrame([(1, None)], "doc_id long, token_ids array<int>"), MODEL).collect()] == [""]


def test_viterbi_matches_brute_force():
    with open(MODEL, "rb") as f:
        codec = spm.SentencePieceCodec(f.read())
    pieces = {p: (i, own) for p, (i, _, own) in ((k, codec.automaton.get(k)) for k in codec.automaton.keys())}
    rng = random.Random(5)
    for _ in range(60):
        text = "".join(rng.choice("▁athe日xé") for _ in range(rng.randrange(1, 9)))
        best = [0.0] + [-1e18] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(end):
                if text[start:end] in pieces:
                    best[end] = max(best[end], best[start] + pieces[text[start:end]][1])
            if text[end - 1] not in pieces:
                best[end] = max(best[end], best[end - 1] + codec.unknown_score)
        total, owner = 0.0, {i: p for p, (i, _) in pieces.items()}
        for i in codec.best(text):
            if i in owner:
                total += pieces[owner[i]][1]
        unknown = sum(i not in owner for i in codec.best(text))
        chars = sum(len(c.encode()) for c in text if c not in pieces)
        assert unknown <= chars and (unknown or abs(total - best[-1]) < 1e-6)


@pytest.mark.parametrize("budget", [0, 1 << 20])
def test_suffix_order(budget):
    rng = np.random.default_rng(budget)
    for trial in range(120):
        n = int(rng.integers(1, 80))
        raw = rng.integers(97, 97 + int(rng.integers(1, 4)), n).astype(np.uint8)
        if trial % 3 == 0:
            raw = np.tile(raw[:5], 16)[:n].astype(np.uint8)
        gaps, cap = np.flatnonzero(rng.random(len(raw)) < 0.05), int(rng.integers(1, 30))
        text = raw.astype(int) + 2
        text[gaps] = 1
        text = [*text.tolist(), 0]
        order = sorted(range(len(text)), key=lambda i: text[i:])
        common = [0] + [next((k for k in range(cap) if max(a, b) + k >= len(text) or text[a + k] != text[b + k]), cap) for a, b in zip(order, order[1:], strict=False)]
        got = list(induced.suffix_order(raw, gaps, cap, budget))
        assert [int(x) for p, _ in got for x in p] == order and [int(x) for _, v in got for x in v] == common


def removed_by_force(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = {}
    for d, r in enumerate(raw):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out[d] = (len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [40, 400])
def test_suffix_dedup_matches_brute_force(spark, length):
    passage = words(120, 77, 5000)
    texts = [*TEXTS, passage, f"{words(30, 5)} {passage} {words(20, 6)}", f"{words(9, 7)} {passage[30:600]} end", "ab" * 400, "q" * 900, f"{BASE} {BASE}"]
    found = suffix_dedup.suffix_dedup_report(spark, docs(spark, texts).withColumn("key", F.lit(1)).withColumn("spans", F.lit(2)), length, shard_bytes=2000).collect()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found}
    assert got == removed_by_force(texts, length)
    assert all(r.repeats for r in found if r.n_removed)


def passages_by_force(texts, short, most):
    out = {}
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + short] for r in raw for i in range(len(r) - short + 1))
    for d, r in enumerate(raw):
        gone = np.zeros(len(r), bool)
        for i in range(len(r) - short + 1):
            if seen[r[i : i + short]] > 1:
                gone[i : i + short] = True
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0]))))
        out[d] = any(len(re.findall(rb"[^\x20\x09-\x0d]+", r[a:b])) > most for a, b in zip(edges[::2], edges[1::2], strict=True))
    return out


def test_suffix_dedup_tells_passages(spark):
    passage, brief = words(56, 21, 300), words(40, 22, 300)  # under 400 bytes both
    texts = [f"{words(60, 30 + i, 5000)}\n{passage}\n{words(20, 40 + i, 5000)}" for i in range(3)] + [f"{words(60, 50 + i, 5000)} {brief} {words(20, 60 + i, 5000)}" for i in range(3)]
    texts += [words(90, 70, 5000), None, "", f"{words(200, 71, 5000)}", f"x {words(200, 71, 5000)}"]
    assert len(passage) < 400
    got = suffix_dedup.suffix_dedup_report(spark, docs(spark, texts), 400, passage=150).collect()
    force, passages = removed_by_force(texts, 400), passages_by_force(texts, 150, 50)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == force
    assert {r.doc_id: r.repeats for r in got} == {d: passages[d] or force[d][1] > 0 for d in force} == {d: d in (0, 1, 2, 9, 10) for d in force}
    assert all(g.begin <= r.begin and r.end <= g.end for t in [texts] for g, r in regions_and_repeats(spark, t, 150))


def regions_and_repeats(spark, texts, length):
    """Pairs (region, repeated span in it): every span must have its region."""
    keyed = docs(spark, texts).where("text is not null").select(F.col("doc_id").alias("key"), "text")
    regions = {r.key: r.spans for r in suffix_dedup.candidate_regions(spark, keyed, length).collect()}
    for r in suffix_dedup.repeated_spans(spark, keyed, length, 2000).collect():
        for span in r.spans:
            yield next(g for g in regions[r.key] if g.end > span.begin), span


def test_suffix_dedup_edges(spark):
    long = words(100, 12, 5000)
    d = docs(spark, [long, long[:399], f"{long} {long}", None, "é" * 400])
    same = d.where("doc_id = 0").unionAll(d.where("doc_id = 0")).withColumn("doc_id", F.lit(None).cast("long"))
    got = sorted((r.doc_id, r.n_removed) for r in suffix_dedup.suffix_dedup_report(spark, d, 400).collect())
    assert [x for x in got if x[0] != 4] == [(0, len(long)), (1, 0), (2, 2 * len(long)), (3, 0)] and got[4][1] == 800
    assert [r.n_removed for r in suffix_dedup.suffix_dedup_report(spark, same, 400).collect()] == [len(long)] * 2
    assert suffix_dedup.suffix_dedup_report(spark, d.limit(0), 400).count() == 0


def test_topk_matches_brute_force(spark):
    rng = random.Random(4)
    codes = [(i, rng.getrandbits(64) - (1 << 63)) for i in range(300)] + [(300 + i, 12345) for i in range(30)]
    df = spark.createDataFrame(codes, "id long, code long")
    got = {}
    for r in topk.hamming_topk(spark, df, df.where("id % 50 = 0"), 5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.distance, r.id))
    for q, c in codes:
        if q % 50 == 0:
            best = sorted(((c ^ x) & (1 << 64) - 1).bit_count() * 10_000 + i for i, x in codes if i != q)[:5]
            assert sorted(got[q]) == [(k + 1, v // 10_000, v % 10_000) for k, v in enumerate(best)]
    few = df.limit(3)
    assert topk.hamming_topk(spark, few, few, 5).count() == 6
    assert topk.hamming_topk(spark, df.limit(0), df.limit(0), 5).count() == 0


def test_topk_edges(spark):
    schema = "vec_id long, embedding array<float>, code string"
    one = [1.0, -1.0] * 32
    rows = [(1, one, "x"), (1, one, "y"), (2, None, "x"), (None, one, "x"), (3, [], "x"), (4, [None, 1.0], "x"), (5, one, "x")]
    codes = topk.sign_codes(spark.createDataFrame(rows, schema), "vec_id", "embedding")
    assert sorted(r.id for r in codes.collect()) == [1, 1, 3, 4, 5]
    got = [(r.rank, r.id, r.distance) for r in topk.hamming_topk(spark, codes, codes.where("id = 1"), 3).collect()]
    assert sorted(got) == [(1, 5, 0), (2, 3, 32), (3, 4, 33)]
    wide = spark.createDataFrame([(1, [1.0] * 65, "x")], schema)
    with pytest.raises(Exception, match="more than 64 components"):
        topk.sign_codes(wide, "vec_id", "embedding").collect()


def test_topk_masks(spark):
    for width, s in [(1, 0), (1, 1), (5, 2), (8, 8), (13, 3), (24, 2)]:
        masks = [r.mask for r in topk.with_masks(spark.range(1), width, s).collect()]
        assert sorted(masks) == sorted(sum(1 << b for b in c) for c in combinations(range(width), s))
    assert all(sum(w for _, w in topk.segments_of(64, n, 11)) == 64 for n in (0, 1, 300, 10**4, 10**6, 10**9))


def labelled(spark):
    good = [words(60, i, 300) for i in range(60)]
    bad = [" ".join(f"{w}!!" for w in words(60, 900 + i, 300).upper().split()) for i in range(20)]
    mean = [f"{words(40, 2000 + i, 300)} you idiot {words(20, 3000 + i)} worthless scum" for i in range(20)]
    texts = [*good, *bad, *mean, None, ""]
    d = docs(spark, texts)
    labels = spark.createDataFrame([(i, int(not 60 <= i < 80), int(80 <= i < 100)) for i in range(0, 100, 2)] + [(1, None, None)], "doc_id long, quality int, toxic int")
    return d, labels


def resampled_by_force(texts, good_fit, known, seed=17):
    """(log weights, number kept by the logistic curve) recomputed with dictionaries from the buckets' definition."""
    from netexp.llm.quality import BUCKETS, logistic_curve, ngram_buckets

    grams = []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        grams.append(Counter(ngram_buckets(raw, np.array([0, len(raw)]))[0].tolist()))
    raw, target = Counter(), Counter()
    for i, g in enumerate(grams):
        raw.update(g)
        if i in good_fit:
            target.update(g)
    n_raw, n_target = sum(raw.values()) + BUCKETS, sum(target.values()) + BUCKETS
    weights = [sum(n * (math.log((target[b] + 1) / n_target) - math.log((raw[b] + 1) / n_raw)) for b, n in g.items()) for g in grams]
    slope, intercept = logistic_curve(np.array([weights[i] for i in known]), np.array([known[i] == 1 for i in known]))
    return weights, round(sum(1 / (1 + math.exp(-(slope * max(-100, min(100, w)) + intercept))) for w in weights))


def test_quality_matches_brute_force(spark):
    d, labels = labelled(spark)
    d = d.withColumn("row", F.lit(1)).withColumn("label", F.lit(2)).withColumn("label_id", F.lit(0)).withColumn("_nx", F.lit(0))
    rows = {r.doc_id: r for r in quality.quality_resampling(spark, d, labels).collect()}
    texts = [r.text for r in d.orderBy("doc_id").collect()]
    half = {r.label_id: r.fit for r in quality.labelled_sample(labels, "quality", 1000).withColumn("fit", quality.in_fit()).collect()}
    mark = {i: int(not 60 <= i < 80) for i in half}
    weights, k = resampled_by_force(texts, {i for i in half if half[i] and mark[i]}, {i: mark[i] for i in half if not half[i]})
    assert all(abs(rows[i].log_weight - w) < 1e-6 for i, w in enumerate(weights))
    keys = {i: r.sample_key for i, r in rows.items()}
    cut = sorted(keys.values(), reverse=True)[k - 1]
    assert {i for i, r in rows.items() if r.kept} == {i for i, key in keys.items() if key >= cut}
    noise = [rows[i].sample_key - rows[i].log_weight for i in rows]
    assert 0.8 < np.std(noise) < 1.9 and len(set(noise)) == len(noise)  # standard Gumbel: 1.28
    assert sum(rows[i].kept for i in range(60)) >= 57 and sum(rows[i].kept for i in range(60, 80)) <= 2


def test_quality_share_draws_in_proportion(spark):
    same = docs(spark, ["a b c"] * 400)
    labels = spark.createDataFrame([(i, 1) for i in range(0, 40)], "doc_id long, quality int")
    drawn = [{r.doc_id for r in quality.quality_resampling(spark, same, labels, share=0.25, seed=s).where("kept").collect()} for s in (1, 2)]
    assert [len(x) for x in drawn] == [100, 100] and len(drawn[0] & drawn[1]) < 60  # equal weights: the noise alone decides


def test_quality_edges(spark):
    d, labels = labelled(spark)
    assert quality.quality_resampling(spark, d, labels.limit(0)).where("kept").count() == 102
    assert quality.quality_resampling(spark, d.limit(0), labels).count() == 0
    twice = d.unionAll(d.where("doc_id in (3, 65)")).unionAll(d.where("doc_id = 65").withColumn("doc_id", F.lit(None).cast("long"))).withColumn("word", F.lit("x")).withColumn("_word", F.lit("y"))
    out = quality.quality_filter(spark, twice, labels)
    assert out.columns == twice.columns
    verdict = Counter(r.doc_id for r in quality.quality_resampling(spark, twice, labels).where("kept").collect())
    left = Counter(r.doc_id for r in out.collect())
    assert left == verdict and sum(left.values()) >= 75 and left[65] == 0 and left[None] == 0 and left[3] in (0, 2)


def mean_labels(labels):
    return labels.select("doc_id", (1 - F.col("quality")).alias("unfit"), "toxic")


def test_toxicity(spark):
    d, labels = labelled(spark)
    found = toxicity.toxicity_chain(spark, d.withColumn("toxic", F.lit(5)).withColumn("label", F.lit(5)), mean_labels(labels), ["unfit", "toxic"]).collect()
    toxic = {r.doc_id: r.toxic for r in found}
    assert all(toxic[i] for i in range(80, 100)) and not any(toxic[i] for i in [*range(80), 100, 101])
    assert all(0 <= r.p_unfit <= 1 and 0 <= r.p_toxic <= 1 for r in found)
    assert toxicity.toxicity_chain(spark, d, mean_labels(labels).limit(0), ["unfit", "toxic"]).where("toxic").count() == 0
    assert toxicity.toxicity_chain(spark, d.limit(0), mean_labels(labels), ["unfit", "toxic"]).count() == 0
    twice = toxicity.toxicity_chain(spark, d.unionAll(d), mean_labels(labels.unionAll(labels)), ["toxic"]).collect()
    assert len(twice) == 204 and all(r.toxic == (80 <= r.doc_id < 100) for r in twice)


def test_toxicity_feeds_out_of_fold_odds():
    rng = np.random.default_rng(2)
    features = [np.unique(rng.integers(0, 50, 8)) for _ in range(240)]
    first = np.array([int(3 in f) for f in features])
    marks = np.column_stack((first, first))
    marks[::7, 0] = -1  # unknown
    chain = toxicity.Chain(["a", "b"], features, marks)
    assert chain.models[0].v.shape == (0,) and chain.models[1].v.shape == (1,) and chain.models[1].v[0] > 0.1
    bounds = np.concatenate(([0], np.cumsum([len(f) for f in features])))
    odds = chain.odds(np.concatenate(features), bounds)
    assert ((odds[:, 1] >= chain.cut) == (first == 1)).all()


def test_rules(spark):
    texts = [None, "", "a b c a b c", "l1 x\nl1 x\n\nl1 x", "é#é $", words(80, 1, 5000), "\n\n"]
    got = {r.doc_id: r for r in rules.apply_policy(rules.ledger(docs(spark, texts)), "v1").collect()}
    assert [got[2].n_words, got[2].n_repeat_words, got[2].word_chars] == [6, 6, 6]
    assert [got[3].n_dup_lines, got[3].n_lines, got[3].n_repeat_words] == [2, 4, 6]
    assert [got[4].n_symbols, got[4].word_chars] == [2, 4]
    assert got[5].kept and not got[0].kept and got[6].n_lines == 3
    book = rules.ledger(docs(spark, texts))
    assert {r.rule: r.failed for r in rules.ablation(book).collect()}["too_few_words"] == 6


def test_rules_policies_and_edges(spark):
    texts = [words(80, 1, 5000), f"{words(80, 2, 5000)} {'# ' * 30}", f"{words(80, 3, 5000)} {'# ' * 30} {'y' * 9000}", words(20, 4, 5000), f"{words(30, 5)} {words(30, 5)}"]
    d = docs(spark, texts).withColumn("n_words", F.lit(1)).withColumn("fail_bits", F.lit(2))
    book = rules.ledger(d.unionAll(d))
    first = {r.doc_id: r.kept for r in rules.apply_policy(book, "v1").collect()}
    second = {r.doc_id: r.kept for r in rules.apply_policy(book, "v2").collect()}  # one soft failure is allowed
    assert first == {0: True, 1: False, 2: False, 3: False, 4: False} and second == {0: True, 1: True, 2: False, 3: False, 4: False}
    found = {r.rule: (r.failed, r.failed_alone) for r in rules.ablation(book).collect()}
    bits = {r.doc_id: r.fail_bits for r in book.collect()}
    for name, bit in rules.BIT.items():
        expected = (2 * sum(bool(b & bit) for b in bits.values()), 2 * sum(b == bit for b in bits.values()))
        assert found.get(name, (0, 0)) == expected
    assert rules.ledger(d.limit(0)).count() == 0 and rules.ablation(rules.ledger(d.limit(0))).count() == 0


def test_mixing_at_the_cap_and_repeated_ids(spark):
    # b is small, so it stops at three times its words; its texts without words are taken three times too
    sources = ["a"] * 60 + ["b"] * 12
    texts = [words(50, i) for i in range(60)] + [words(5, i) for i in range(6)] + [""] * 6
    d = docs(spark, texts, sources)
    d = d.unionAll(d.where("doc_id in (3, 61)")).withColumn("size", F.lit(1)).withColumn("target", F.lit(2)).withColumn("most", F.lit(3))
    got = mixing.mix_documents(spark, d).collect()
    assert {r.target for r in got if r.source == "b"} == {3.0 * 35} and all(r.taken == 3 * r.size for r in got if r.source == "b")
    assert len({r.taken for r in got if r.doc_id == 3}) == 1 and len(got) == 74
    out = Counter(r.doc_id for r in mixing.repeat_documents(spark, d).collect())
    assert max(out[i] for i in range(60, 72) if i != 61) == 3 and out[61] == 6


def test_mixing(spark):
    sources = ["a"] * 40 + ["b"] * 40 + [None] * 10
    d = docs(spark, [words(10 + i % 7, i) for i in range(88)] + [None, ""], sources)
    got = mixing.mix_documents(spark, d)
    assert got.where("taken > 3 * size or taken < 0").count() == 0 and got.count() == 90
    gap = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.max("size").alias("m"))
    assert gap.where("abs(t - target) > m").count() == 0
    assert mixing.mix_documents(spark, d.limit(0)).count() == 0
    out = mixing.repeat_documents(spark, d)
    assert out.columns == d.columns and out.select(F.sum(F.expr("regexp_count(text, '[^ ]+')"))).first()[0] == got.agg(F.sum("taken")).first()[0]


#: (family, wording): none is a template.
HELD_OUT = [
    ("MIT", "available under the terms of the mit license for everyone"), ("Apache-2.0", "Distributed under the Apache 2.0 license"), ("Apache-2.0", "This file is made available under the Apache License, Version 2.0 (the License)"),
    ("GPL", "This file is covered by the GNU General Public License, version 2"), ("GPL", "You may copy this under the GNU GPL"), ("LGPL", "Covered by the GNU Lesser General Public License"), ("AGPL", "The server is under the GNU Affero General Public License v3"),
    ("BSD", "This source code is available under a BSD 3-clause license"), ("MPL", "The contents are covered by the Mozilla Public License"), ("CC-BY-NC", "Text available under CC BY-NC 3.0"), ("CC-BY", "Content is available under the Creative Commons Attribution-ShareAlike License 3.0"),
    ("Public-Domain", "To the extent possible the author released this software into the public domain, free and unencumbered"),
]


def scan_by_force(model, texts):
    """{(doc, line): family} of single lines, by the model's own numbers and the templates, without a gate."""
    out = {}
    for d, t in enumerate(texts):
        for i, line in enumerate((t or "").lower().split("\n")):
            words = licenses.tokens_of(line)
            z = (model._logits([words]) / model.temperature)[0]
            family = model.classes[int(z.argmax())]
            if any(r["family"] == family and len(set(words) & set(r["template"])) >= r["need"] for r in licenses.template_rows()):
                out[d, i] = family
    return out


def test_licences(spark):
    ordinary = [words(12, i) for i in range(200)]
    model = licenses.LicenceModel(ordinary)
    assert model.held_out_accuracy > 0.95
    long_line = f"{words(1500, 5)} Licensed under the Apache License, Version 2.0. {words(1500, 6)}"
    texts = ["text\nReleased under the MIT License.\nmore", "Licensed under CC BY-NC 4.0.", "x This work is licensed under the GNU General Public License, version 3. y", long_line, "he lost his driving license again", None, "", words(30, 1), "\n".join(t for _, t in HELD_OUT)]
    got = licenses.licence_scan(spark, docs(spark, [*texts, *texts[:1]]).withColumn("line", F.lit(1)).withColumn("words", F.lit(2)).withColumn("p", F.lit(3)), model).collect()
    assert all(0 <= r.p_unknown < r.probability <= 1 for r in got)
    found = {(r.doc_id, r.paragraph): r.family for r in got if r.doc_id < len(texts)}
    assert found == scan_by_force(model, texts)
    assert found == {(0, 1): "MIT", (1, 0): "CC-BY-NC", (2, 0): "GPL", (3, 0): "Apache-2.0"} | {(8, i): f for i, (f, _) in enumerate(HELD_OUT)}
    assert licenses.licence_scan(spark, docs(spark, ["a"]).limit(0), model).count() == 0


def test_licences_wrapped_and_repeated(spark):
    model = licenses.LicenceModel([words(12, i) for i in range(200)])
    wrapped = f"{words(9, 1)}\nPermission is hereby granted, free of charge, to any\nperson obtaining a copy of this software and\n{words(9, 2)}"
    got = [(r.doc_id, r.paragraph, r.family) for r in licenses.licence_scan(spark, docs(spark, [wrapped]).unionAll(docs(spark, [wrapped])), model).collect()]
    assert got == [(0, 1, "MIT")]


def test_licence_gate_loses_nothing():
    gate = licenses.gate_words([words(12, i) for i in range(50)])
    rng = random.Random(3)
    for row in licenses.template_rows():
        for _ in range(20):
            assert any(g in w for w in rng.sample(row["template"], row["need"]) for g in gate)


def test_line_dedup(spark):
    block = "\n".join(f"line {words(6, 100 + i)}" for i in range(12))
    texts = [block, f"intro here\n{block}\noutro there", f"{words(8, 1)}\n{words(8, 2)}", None, "", "only\n", "same\nsame"]
    report = {r.doc_id: r for r in line_dedup.line_dedup_report(spark, docs(spark, texts)).collect()}
    assert len(report) == 7 and report[0].n_removed_lines == 0 and report[1].n_removed_lines >= 6 and report[2].n_removed_lines == 0
    out = {r.doc_id: r.text for r in line_dedup.line_dedup(spark, docs(spark, texts)).collect()}
    assert out[0] == block and out[1].startswith("intro here") and out[1].endswith("outro there") and len(out[1]) < len(texts[1])
    assert all(line in texts[1].split("\n") for line in out[1].split("\n"))
    assert line_dedup.line_dedup_report(spark, docs(spark, ["a"]).limit(0)).count() == 0


def removed_lines_by_force(texts):
    """(removed lines, runs of them) of each text: lines of runs of two lines with a word or more that stand before, without a shared line."""
    lines = [(t or "").split("\n") for t in texts]
    seen, out = {}, {}
    for d, ls in enumerate(lines):
        at = [i for i, x in enumerate(ls) if x.strip(" \t\n\v\f\r")]
        gone = set()
        for a, b in zip(at, at[1:], strict=False):
            where = seen.setdefault(tuple(ls[a : b + 1]), (d, b))
            if where[0] != d or where[1] < a:
                gone.update(range(a, b + 1))
        out[d] = (len(gone), sum(i - 1 not in gone for i in gone), "\n".join(x for i, x in enumerate(ls) if i not in gone))
    return out


def test_line_dedup_finds_every_repeated_run(spark):
    rng = random.Random(8)
    passages = [[words(12, 400 + 10 * p + i, 5000) for i in range(2 + p % 3)] for p in range(12)]
    texts = ["a\na\na", "b\nb\nb\nb\nb", "c\nd\nc\nd\nc", "u v\n\nw x\n\n", "u v\n\nw x\n\n", "u v\n\n\nw x", "u v\nw x", None, ""]
    for i in range(60):
        parts = [[words(9, 9000 + 10 * i + j, 5000)] for j in range(3)]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(4), rng.choice(passages))
        texts.append("\n".join(x for part in parts for x in part))
    texts += texts[9:14]
    expected = removed_lines_by_force(texts)
    report = {r.doc_id: (r.n_removed_lines, r.n_removed_chunks) for r in line_dedup.line_dedup_report(spark, docs(spark, texts)).collect()}
    assert report == {d: e[:2] for d, e in expected.items()} and sum(n for n, _ in report.values()) > 60
    clashing = docs(spark, texts)
    for name in ("word", "slot", "bitmap", "removed", "key", "raw", "_key"):
        clashing = clashing.withColumn(name, F.lit(7))
    changed = line_dedup.line_dedup(spark, clashing)
    assert changed.columns == clashing.columns and changed.where("word <> 7 or removed <> 7").count() == 0
    out = {r.doc_id: r.text for r in changed.collect()}
    assert out == {d: texts[d] if not n else t for d, (n, _, t) in expected.items() if not n or t.strip()}


def test_line_dedup_repeated_and_null_rows(spark):
    block = "\n".join(words(9, 50 + i, 5000) for i in range(30))
    d = docs(spark, [block, f"{words(9, 1, 5000)}\n{block}", None])
    rows = d.unionAll(d.where("doc_id = 1")).unionAll(d.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long")))
    got = sorted(((r.doc_id, r.n_removed_lines) for r in line_dedup.line_dedup_report(spark, rows).collect()), key=str)
    assert got == [(0, 30), (1, 31), (1, 31), (2, 0), (None, 0)]  # the row without an id comes first


def test_line_chunks_are_shift_resistant():
    lines = [words(7, 700 + i, 5000) for i in range(200)]
    kinds = []
    for text in ("\n".join(lines), "\n".join(["one more", "and one", *lines])):
        raw = np.frombuffer(text.encode(), np.uint8)
        _, kind, h, *_ = line_dedup.chunk_slice(raw, np.array([0, len(raw)]))
        kinds.append(set(h[kind == 0].tolist()))
    assert len(kinds[0]) > 20 and len(kinds[0] - kinds[1]) <= 1


def test_suffix_dedup_splits_a_hot_core(spark, monkeypatch, tmp_path):
    passage, sort_shards = words(150, 31, 5000), suffix_dedup._sort_shards
    texts = [f"{words(40, 100 + i, 5000)} {passage} {words(40, 300 + i, 5000)}" for i in range(80)]
    sizes = str(tmp_path / "sizes")

    def noting(length):
        inner = sort_shards(length)

        def work(batches):
            def seen():
                for batch in batches:
                    with open(sizes, "a") as f:
                        f.writelines(f"{s} {len(x)}\n" for s, x in zip(batch.column(0).to_pylist(), batch.column(4).to_pylist(), strict=True))
                    yield batch

            yield from inner(seen())

        return work

    monkeypatch.setattr(suffix_dedup, "_sort_shards", noting)
    report = suffix_dedup.suffix_dedup_report(spark, docs(spark, texts), 400, shard_bytes=4000)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in report.collect()}
    assert got == removed_by_force(texts, 400)
    total = Counter()
    with open(sizes) as f:
        for line in f:
            shard, size = line.split()
            total[shard] += int(size)
    assert max(total.values(), default=0) <= 3 * 4000


def test_long_sets_are_parted_by_fine_histograms():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 20000).astype(np.uint64)
    near = np.concatenate((base[:18500], rng.integers(0, 1 << 63, 1500).astype(np.uint64)))
    sets = [np.unique(s) for s in (base, near, *(rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (19500, 20000, 2900)))]
    n, packed = np.array([len(s) for s in sets]), ngram_join.packed_histograms(sets)
    assert [len(b) for b in packed] == [ngram_join.FINE] * 4 + [ngram_join.BINS]
    assert (ngram_join.coarse(packed) == ngram_join.histograms(sets)).all()
    fine = {i: np.frombuffer(b, dtype=np.uint8) for i, b in enumerate(packed) if len(b) == ngram_join.FINE}
    assert len(ngram_join.possible_forest(list(range(5)), n, ngram_join.coarse(packed), 17, 20)) > 1  # coarse ones leave unlinked sets together
    assert ngram_join.possible_forest(list(range(5)), n, ngram_join.coarse(packed), 17, 20, fine) == [(0, 1)] == ngram_join.linked_forest(list(range(5)), sets, 17, 20)


def test_a_signature_ties_neighbouring_size_bands_only(spark):
    classes = spark.createDataFrame([(5, 100, [1, 2]), (3, 100, [1]), (7, 110, [1]), (1, 400, [1]), (2, 410, [1, 2]), (9, 5000, [3])], "node long, n long, sigs array<long>")
    stars = {tuple(r) for r in ngram_join.signature_stars(classes, 17, 20).collect()}
    bands = [ngram_join.band_of(n, 17, 20) for n in (100, 110, 400, 410)]
    assert bands[1] - bands[0] in (0, 1) and bands[2] - bands[1] > 1 and bands[3] - bands[2] in (0, 1)
    assert stars == {(5, 3), (7, 3), (2, 1)}
