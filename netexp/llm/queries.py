"""The queries of this subpackage: op1 to op13 over whole tables, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from netexp.llm import decontaminate, filter_audit, licenses, line_dedup, mixing, ngram_join, quality, rules, spm, suffix_dedup, target_resampling, topk, toxicity

#: The tokenizer file is a parameter: set this variable, or pass model_path to the operator.
SPM_MODEL = os.environ.get("NETEXP_SPM_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def _read(spark, sf_dir, table):
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1(spark, sf_dir):
    return ngram_join.ngram_jaccard_components(spark, _read(spark, sf_dir, "documents"), k=4, threshold="0.85").select("doc_id", "n_shingles", "component_id", "n_links")


def op2(spark, sf_dir):
    return spm.sentencepiece_encode(spark, _read(spark, sf_dir, "documents"), SPM_MODEL)


def op3(spark, sf_dir):
    return suffix_dedup.suffix_dedup_report(spark, _read(spark, sf_dir, "documents"))


def op4(spark, sf_dir):
    codes = topk.sign_codes(_read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return topk.hamming_topk(spark, codes, codes.where("id % 50 = 0"), k=10)


def op5(spark, sf_dir):
    return quality.quality_resampling(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")).select("doc_id", "n_grams", "log_weight", "sample_key", "kept")


def op6(spark, sf_dir):
    labels = _read(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("unfit"), "toxic")
    return toxicity.toxicity_chain(spark, _read(spark, sf_dir, "documents"), labels, ["unfit", "toxic"])


def op7(spark, sf_dir):
    book = rules.apply_policy(rules.ledger(_read(spark, sf_dir, "documents")), "v1")
    base = F.lit(rules.BIT["too_few_words"] | rules.BIT["repeated_words"]).cast("long")
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("fail_bits").bitwiseAND(base) != 0).alias("base_failed"), "kept", "n_lines", "fail_bits")


def op8(spark, sf_dir):
    return mixing.mix_documents(spark, _read(spark, sf_dir, "documents"))


def op9(spark, sf_dir):
    return licenses.licence_scan(spark, _read(spark, sf_dir, "documents"))


def op10(spark, sf_dir):
    return line_dedup.line_dedup_report(spark, _read(spark, sf_dir, "documents"))


def op11(spark, sf_dir):
    return filter_audit.filter_audit(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12(spark, sf_dir):
    report = decontaminate.contamination_report(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")
    digest = F.sha2(F.concat_ws(",", F.array_sort("items")), 256)
    return report.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op13(spark, sf_dir):
    return target_resampling.target_resampling(spark, _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_ngram_jaccard_join": op1,
    "op2_sentencepiece": op2,
    "op3_suffix_dedup": op3,
    "op4_hamming_topk": op4,
    "op5_quality_resampling": op5,
    "op6_toxicity_chain": op6,
    "op7_quality_rules": op7,
    "op8_source_mix": op8,
    "op9_licence_scan": op9,
    "op10_line_dedup": op10,
    "op11_filter_audit": op11,
    "op12_decontamination": op12,
    "op13_target_resampling": op13,
    "pipeline": pipeline,
}

OP4_SQL = """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
u AS (SELECT id, unnest(bits) AS bit, unnest(range(1, len(bits) + 1)) AS i FROM v),
p AS (SELECT q.id AS query_id, e.id AS id, sum(CASE WHEN q.bit <> e.bit THEN 1 ELSE 0 END)::INTEGER AS distance
      FROM u q JOIN u e ON q.i = e.i AND q.id <> e.id WHERE q.id % 50 = 0 GROUP BY 1, 2),
r AS (SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY distance, id))::INTEGER AS rank, id, distance FROM p)
SELECT query_id, rank, id, distance FROM r WHERE rank <= 10
"""

OP7_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
p AS (SELECT r, unnest(ws) AS a, unnest(range(1, len(ws) + 1)) AS i FROM w),
t AS (SELECT r, i, a, lead(a) OVER x AS b, lead(a, 2) OVER x AS c FROM p WINDOW x AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM t WHERE c IS NOT NULL),
h AS (SELECT r, count(DISTINCT j)::BIGINT AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM g WHERE n > 1) GROUP BY r),
l AS (SELECT r, unnest(ls) AS line FROM w),
k AS (SELECT r, (sum(n) - count(*))::BIGINT AS n_dup_lines FROM (SELECT r, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r, line) GROUP BY r),
m AS (SELECT w.r, doc_id, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
             len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(k.n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(h.n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines
      FROM w LEFT JOIN h ON w.r = h.r LEFT JOIN k ON w.r = k.r),
f AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
      + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 16 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 32 ELSE 0 END)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, fail_bits FROM f
"""

OP1_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
      ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] || ' ' || ws[i + 3])) END AS sh FROM d),
n AS (SELECT doc_id, len(sh)::BIGINT AS n_shingles FROM s),
u AS (SELECT doc_id, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM u a JOIN u b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n_shingles + nb.n_shingles - c)),
g AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS s, doc_id AS t FROM n UNION SELECT r.s, g.b FROM reach r JOIN g ON r.t = g.a)
SELECT n.doc_id, n.n_shingles, m.component_id, (SELECT count(*) FROM g WHERE g.a = n.doc_id)::BIGINT AS n_links FROM n JOIN (SELECT s, min(t) AS component_id FROM reach GROUP BY s) m ON m.s = n.doc_id
"""

ORACLES = {"op1_ngram_jaccard_join": OP1_SQL, "op4_hamming_topk": OP4_SQL, "op7_quality_rules": OP7_SQL, "op8_source_mix": mixing.ORACLE_SQL, "op11_filter_audit": filter_audit.ORACLE_SQL, "op12_decontamination": decontaminate.ORACLE_SQL, "op13_target_resampling": target_resampling.ORACLE_SQL}
