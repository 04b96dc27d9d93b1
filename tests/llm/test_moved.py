"""What the text operators move between tasks: rows off a filter stay where they are."""

from pyspark.sql import functions as F
from test_llm import docs, words

from netexp.llm import cluster, line_dedup


def shuffled(df) -> int:
    """Rows that the plan of ``df`` moves."""
    df.collect()

    def rows(plan):
        below = plan.children()
        own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
        return own + sum(rows(below.apply(i)) for i in range(below.size()))

    return rows(df._jdf.queryExecution().executedPlan())


def test_rows_off_the_filter_are_not_moved(spark, tmp_path, monkeypatch):
    """Tables of keys that are too large to be broadcast themselves move the rows that pass their filter only, also where it is at its bound."""
    spark.range(20000).selectExpr("if(id % 1000 = 0, null, id) AS id", "'x' AS v").write.parquet(f"file://{tmp_path}/rows")
    spark.range(100).selectExpr("id * 7 AS k").unionAll(spark.range(3).selectExpr("id * 7 AS k")).write.parquet(f"file://{tmp_path}/gone")
    rows, gone = (spark.read.parquet(f"file://{tmp_path}/{t}") for t in ("rows", "gone"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for bits, most in ((24, 1000), (8, 12000)):
            monkeypatch.setattr(cluster, "FILTER_BITS", bits)
            left = cluster.other_rows(rows, gone, "id")
            assert sorted(r.id for r in left.where("id is not null").collect()) == [i for i in range(20000) if i % 1000 and not (i % 7 == 0 and i < 700)]
            assert left.count() == 20000 - 99 and shuffled(left) < most
            hit = cluster.some_rows(rows, gone, "id").join(gone.distinct(), F.col("id") == F.col("k"))
            assert hit.count() == 99 and shuffled(hit) < most
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_line_hashes_are_counted_without_places(spark, tmp_path, monkeypatch):
    """Chunks whose hash occurs once are not moved with their places: later_copies joins those of its table of repeated hashes only."""
    texts = [f"{words(9, i, 500)}\n{words(9, 100 + i, 500)}" for i in range(60)]
    keyed = docs(spark, texts + texts[:2]).selectExpr("doc_id AS key", "doc_id", "text")
    asked, some = [], line_dedup.some_rows
    monkeypatch.setattr(line_dedup, "some_rows", lambda t, wanted, key: (asked.append(key), some(t, wanted, key))[1])
    chunks = keyed.mapInArrow(line_dedup._chunks, line_dedup._CHUNK).where("kind = 0").drop("pairs", "number")
    got = line_dedup.later_copies(chunks, keyed, cluster.Scratch(spark, "t")).collect()
    assert asked[0] == "hash" and sorted((r.key, r.keep_key) for r in got) == [(60, 0), (61, 1)]
