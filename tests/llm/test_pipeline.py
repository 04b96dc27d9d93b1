"""The corpus pipeline, stage by stage against brute force, on a small fixture with every awkward kind of row."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F
from test_llm import components_by_force, near, removed_lines_by_force, words

import corpus_pipeline
from netexp.llm import mixing, quality, spm

EXTRA = ["word", "bitmap", "removed", "row", "key", "label", "cluster", "h", "copies", "_nx_row2"]


def prose(n, seed):
    """Words of which each has three possible successors."""
    rng, at, out = random.Random(seed), seed % 60, []
    for _ in range(n):
        at = (7 * at + rng.randrange(1, 4)) % 60
        out.append(f"w{at}")
    return " ".join(out)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """(sf_dir, rows of documents): good and bad texts, near copies, shared passages, nulls, repeated rows."""
    rng = random.Random(12)
    passage = "\n".join(words(11, 900 + i, 4000) for i in range(3))
    texts = [prose(80, i) for i in range(40)]
    texts += [near(texts[i], 2, 70 + i) for i in range(6)] + texts[:3]
    texts += [f"{prose(40, 200 + i)}\n{passage}\n{prose(40, 300 + i)}" for i in range(5)]
    texts += [" ".join(f"{w}!!" for w in prose(60, 500 + i).upper().split()) for i in range(14)]
    texts += [None, "", "  \n ", "one", "x" * 3000, prose(2500, 4)]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["web", "news", None]), len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[7], "en", "web", 5), (9, texts[20], "en", "web", 5)]
    folder = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < 54), 0) for i in range(68)] + [(70, None, None), (None, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows


@pytest.fixture(scope="module")
def stages(spark, table, tmp_path_factory):
    """What each stage returns, written and read again, from documents with extra columns."""
    out, folder = [], tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{table[0]}/documents.parquet")
    for c in EXTRA:
        docs = docs.withColumn(c, F.lit(7))
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, table[0]).write.parquet(f"file://{folder}/{name}")
        docs = spark.read.parquet(f"file://{folder}/{name}")
        out.append(docs)
    return out


def pairs(df):
    return Counter((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_columns_stay(stages):
    for before, after in zip(stages[:-2], stages[1:-1], strict=True):
        assert after.columns == before.columns
        assert after.where(" or ".join(f"{c} <> 7" for c in EXTRA)).count() == 0


def test_quality_stage(spark, table, stages):
    labels = spark.read.parquet(f"{table[0]}/labels.parquet")
    verdict = quality.quality_resampling(spark, stages[0], labels)
    kept = Counter(r.doc_id for r in verdict.where("kept").collect())
    assert Counter(r.doc_id for r in stages[1].select("doc_id").collect()) == kept
    assert verdict.where("doc_id >= 54 and doc_id < 68 and kept").count() <= 3 and verdict.where("doc_id < 54 and not kept").count() <= 6


def test_line_stage(stages):
    rows = sorted(pairs(stages[1]), key=lambda r: (r[0] is not None, r[0] or 0))
    where = {i: r for i, r in enumerate(rows)}
    expected = Counter()
    for i, (n, _, t) in removed_lines_by_force([t for _, t in rows]).items():
        d, text = where[i]
        if not n or t.strip():
            expected[d, t if n else text] += pairs(stages[1])[d, text]
    assert pairs(stages[2]) == expected
    assert stages[2].where("text is not null and n_chars > 5 and n_chars <> length(text)").count() == 0


def test_near_duplicate_stage(stages):
    rows = list(pairs(stages[2]))
    known = [(i, t) for i, (_, t) in enumerate(rows)]
    group = {i: c for i, (_, c, _) in components_by_force(known, 5, 8, 10).items()}
    for i, (d, _) in enumerate(rows):  # rows of one id are one document
        for j, (e, _) in enumerate(rows):
            if d is not None and d == e:
                group = {x: group[i] if g == group[j] else g for x, g in group.items()}
    empty = {i for i, (n, _, _) in components_by_force(known, 5, 8, 10).items() if n == 0}
    left = pairs(stages[3])
    for g in set(group.values()):
        own = [rows[i] for i in group if group[i] == g and i not in empty]
        if own:
            best = min(own, key=lambda r: (r[0] is None, r[0] or 0))
            assert sum(left[r] for r in own) == 1 and any(left[r] for r in own if r[0] == best[0])
    assert all(left[rows[i]] == pairs(stages[2])[rows[i]] for i in empty)


def test_mixing_stage(stages):
    documents = stages[3].select("doc_id", "text", "source").toArrow()
    with duckdb.connect() as db:
        db.register("documents", documents)
        taken = db.sql(mixing.ORACLE_SQL).fetchall()
        names = [c[0] for c in db.sql(mixing.ORACLE_SQL).description]
    wanted = Counter()
    for r in (dict(zip(names, row, strict=True)) for row in taken):
        wanted[r["doc_id"]] += r["taken"]
    got = Counter()
    for (d, t), n in pairs(stages[4]).items():
        got[d] += n * len((t or "").split())
    assert got == Counter({d: n for d, n in wanted.items() if n})


def test_encoding_stage(stages):
    with open(corpus_pipeline.SPM_MODEL, "rb") as f:
        codec = spm.SentencePieceCodec(f.read())
    want = Counter((d, tuple(codec.encode(t or "").tolist())) for (d, t), n in pairs(stages[4]).items() for _ in range(n))
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in stages[5].collect()) == want
    assert stages[5].where("not round_trip").count() == 0


def test_run_is_the_stages(spark, table, stages):
    out = corpus_pipeline.run(spark, table[0])
    count = lambda df: Counter((r.doc_id, tuple(r.token_ids)) for r in df.collect())
    assert count(out) == count(stages[5])


def test_empty_table(spark, table, tmp_path):
    folder = f"file://{tmp_path}"
    spark.read.parquet(f"{table[0]}/documents.parquet").limit(0).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{table[0]}/labels.parquet").limit(0).write.parquet(f"{folder}/labels.parquet")
    assert corpus_pipeline.run(spark, folder).count() == 0
