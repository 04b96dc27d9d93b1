"""Line dedup by content-defined line chunks.

A rolling hash over the hashes of WINDOW neighbouring lines (with a word) cuts a
text where it is less than beside it, so boundaries depend on the lines around
them and survive shifts; chunks have two lines or more, three on average, and two
in a row of equal lines. Chunks of MIN_LINES lines or more that stand
before, by hash and then by bytes, go.

A repeated run goes on beyond its whole chunks: its first and last lines are in
chunks with lines that differ. So a match of two chunks is extended on both
sides, line by line, as far as the chunks beside them agree, which their bytes
confirm, too.

What is left are runs too short to hold a whole chunk. Each two neighbouring
lines that are not in a chunk that goes, nor in its extension, are compared in
the same way, by hash and then by bytes. Together they take every run of
MIN_LINES lines or more that begins and ends in a line with a word and stands
before (smaller doc_id, then place in the text, no line shared); each line's
first place stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netexp.llm.cluster import Scratch, other_rows, some_rows
from netexp.llm.textkit import Prefix, U, mix, signed, slices, words

WINDOW, MIN_LINES = 2, 2


def line_bounds(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (without the newline) of every line, and its text; a text of no bytes has one empty line."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(buf == 10)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)))
    ends = np.sort(np.concatenate((offsets[1:], breaks)))
    doc = np.sort(np.concatenate((np.arange(n), np.searchsorted(offsets, breaks, "right") - 1)))
    return starts, ends, doc


def chunk_slice(buf: np.ndarray, offsets: np.ndarray):
    """Chunks: text, kind (0, or 2 for one line alone, which is no repeat of its own), hash, start byte and end byte in the text, first and last line in the text, number in the text; then the pairs of lines (a line and the next with a word) that begin in each chunk: their bounds by chunk, and hash, start byte, end byte, first and last line of each."""
    starts, ends, doc = line_bounds(buf, offsets)
    s, _, _ = words(buf, offsets)
    worded = np.flatnonzero(np.searchsorted(s, ends) > np.searchsorted(s, starts))
    prefix, owner = Prefix(buf), doc[worded]
    h = prefix.hashes(starts[worded], ends[worded])
    # the rolling hash at a line is of the WINDOW lines that end there
    m = len(worded)
    roll = np.zeros(m, dtype=U)
    for j in range(min(WINDOW, m)):
        roll[WINDOW - 1 :] = mix(roll[WINDOW - 1 :] * U(0xA0761D6478BD642F) + h[j : m - WINDOW + 1 + j])
    whole = np.zeros(m, dtype=bool)
    whole[WINDOW - 1 :] = owner[WINDOW - 1 :] == owner[: m - WINDOW + 1]
    cut = np.zeros(m, dtype=bool)
    cut[1:] = whole[1:] & whole[:-1] & (roll[1:] < roll[:-1])
    cut[:-1] &= ~whole[1:] | (roll[:-1] < roll[1:])
    # a row of equal lines is cut by twos from its start
    same = np.zeros(m, dtype=bool)
    same[1:] = whole[1:] & whole[:-1] & (roll[1:] == roll[:-1])
    place = np.arange(m)
    cut |= same & ((place - np.maximum.accumulate(np.where(same, 0, place))) % 2 == 1)
    cut |= np.append(owner[1:] != owner[:-1], True) if m else cut
    last = np.flatnonzero(cut)
    first = np.concatenate(([0], last[:-1] + 1)).astype(np.int64) if m else last
    top = np.searchsorted(doc, np.arange(len(offsets)))  # first line of each text

    def spans(a, b):
        a, b = worded[a], worded[b]
        at = offsets[doc[a]]
        return prefix.hashes(starts[a], ends[b]), starts[a] - at, ends[b] - at, a - top[doc[a]], b - top[doc[b]]

    text = owner[first]
    number = np.arange(len(text)) - np.searchsorted(text, text)
    pair = np.flatnonzero(owner[1:] == owner[:-1]) if m else last
    kind = np.where(last - first + 1 >= MIN_LINES, 0, 2).astype(np.int32)
    return text, kind, *spans(first, last), number, np.searchsorted(pair, np.append(first, m)), *spans(pair, pair + 1)


_PAIR = ["hash", "begin", "end", "first", "last"]
_CHUNK = "key long, doc_id long, kind int, hash long, begin long, end long, first long, last long, number long, pairs array<struct<hash:long,begin:long,end:long,first:long,last:long>>"


def _chunks(batches):
    for batch in batches:
        keys, ids = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        for at, _, buf, offsets in slices(batch.column(2)):
            if not len(buf):
                continue
            owner, kind, h, begin, end, first, last, number, bounds, ph, *place = chunk_slice(buf, offsets)
            pairs = pa.StructArray.from_arrays([pa.array(signed(ph)), *[pa.array(x) for x in place]], _PAIR)
            yield pa.record_batch(
                [pa.array(keys[at + owner]), ids.take(pa.array(at + owner)), pa.array(kind), pa.array(signed(h)), *[pa.array(x) for x in (begin, end, first, last, number)], pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs)],
                names=["key", "doc_id", "kind", "hash", "begin", "end", "first", "last", "number", "pairs"],
            )


_SPAN = ["key", "begin", "end", "first", "last"]
#: A span that goes and the place of the one that stays.
_COPY = [*_SPAN, "keep_key", "keep_begin"]


def later_copies(chunks: DataFrame, keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, begin, end, first, last, keep_key, keep_begin) of the chunks whose bytes stand before, and where. ``chunks`` is (key, doc_id, hash, begin, end, first, last)."""
    again = scratch.write(chunks.groupBy("hash").agg(F.count("*").alias("times")).where("times > 1").select("hash"), "again")
    found = scratch.write(some_rows(chunks, again, "hash").join(again, "hash").select("hash", "key", "doc_id", "begin", "end", "first", "last").distinct(), "found")
    # byte comparison: the chunks of a hash, from the texts that hold one of them
    per_text = found.groupBy("key").agg(F.collect_list(F.struct("hash", "doc_id", "begin", "end", "first", "last")).alias("parts"))
    texts = some_rows(keyed, found.select("key"), "key").select("key", "text").dropDuplicates(["key"]).join(per_text, "key")
    cut = texts.select("key", F.encode("text", "utf-8").alias("raw"), F.explode("parts").alias("p"))
    raw = F.expr("substring(raw, cast(p.begin + 1 as int), cast(p.end - p.begin as int))")
    spelled = cut.select("p.hash", raw.alias("raw"), F.struct(F.col("p.doc_id"), F.col("key"), F.col("p.begin")).alias("place"))
    classes = spelled.groupBy("hash", "raw").agg(F.min("place").alias("keep"), F.max("place").alias("top"))
    verdict = scratch.write(classes.groupBy("hash").agg(F.count("*").alias("classes"), F.min("keep").alias("keep")), "verdict")
    # the first of its class stays, and what shares a line with it in its own text
    later = F.expr("not (doc_id <=> keep.doc_id and key = keep.key and begin <= keep.begin + end - begin)")
    stays = lambda t: t.where(later).select(*_SPAN, F.col("keep.key").alias("keep_key"), F.col("keep.begin").alias("keep_begin"))
    plain = stays(found.join(verdict.where("classes = 1").select("hash", "keep"), "hash"))
    # different chunks under one hash: told apart by their bytes
    mixed = verdict.where("classes > 1").select("hash")
    twins = classes.join(mixed, "hash").where("keep <> top").select("hash", "raw", "keep")
    collided = stays(cut.select("p.*", "key", raw.alias("raw")).join(twins, ["hash", "raw"]))
    return plain if mixed.isEmpty() else plain.unionAll(collided).distinct()


def _place(*columns: str):
    """A key for a place in a text."""
    return F.xxhash64(*columns)


def extensions(chunks: DataFrame, copies: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, doc_id, hash, begin, end, first, last): the pairs of lines beside each copy of a chunk that the chunk that stays has beside it, too, and those beside that one.

    Only the ends of rows of chunks that go are looked at. To the right these are the pair that leaves the chunk and the first ones of
    the next two chunks, to the left the last ones of the two chunks before, as
    far as they agree by hash: a run ends within them, as a longer one would
    hold one of these chunks, too, unless its neighbours moved a boundary.
    """
    near = Window.partitionBy("key").orderBy("number")
    numbers = some_rows(chunks.select("key", "begin", "number", _place("key", "begin").alias("place")), scratch.write(copies.select(_place("key", "begin").alias("place")).distinct(), "copies"), "place")
    numbered = copies.select("key", "begin", "keep_key", "keep_begin").join(numbers.select("key", "begin", "number"), ["key", "begin"])
    apart = lambda f, step: F.coalesce(f("number").over(near) != F.col("number") + step, F.lit(True))
    copies = numbered.withColumn("to_right", apart(F.lead, 1)).withColumn("to_left", apart(F.lag, -1)).where("to_right or to_left")
    copies = scratch.write(copies.drop("number"), "ends")
    places = copies.select("key", "begin").unionAll(copies.select(F.col("keep_key"), F.col("keep_begin"))).distinct()
    places = scratch.write(places.select("key", _place("key", "begin").alias("place")), "places")
    some = some_rows(chunks, places.select("key").distinct(), "key").select("key", "doc_id", "begin", "number", "last", "pairs")
    none = F.array().cast("array<struct<hash:long,begin:long,end:long,first:long,last:long>>")
    ahead, behind = ([F.coalesce(f("pairs", i).over(near), none) for i in (1, 2)] for f in (F.lead, F.lag))
    leaving = F.filter("pairs", lambda p: p["last"] > F.col("last"))
    beside = some.select("key", "doc_id", "begin", _place("key", "begin").alias("place"), F.concat(leaving, *ahead).alias("right"), F.reverse(F.concat(*behind[::-1])).alias("left"))
    # only the chunks that matched keep their surroundings
    beside = scratch.write(some_rows(beside, places.select("place"), "place").drop("place"), "beside")
    kept = beside.select(F.col("key").alias("keep_key"), F.col("doc_id").alias("keep_doc"), F.col("begin").alias("keep_begin"), F.col("right").alias("keep_right"), F.col("left").alias("keep_left"))
    both = copies.join(beside, ["key", "begin"]).join(kept, ["keep_key", "keep_begin"])

    def agree(side):
        """How many pairs agree before the first that doesn't."""
        same = F.zip_with(F.slice(side, 1, F.least(F.size(side), F.size(f"keep_{side}"))), F.slice(f"keep_{side}", 1, F.least(F.size(side), F.size(f"keep_{side}"))), lambda a, b: a["hash"] == b["hash"])
        return F.coalesce(F.nullif(F.array_position(same, False), F.lit(0)) - 1, F.size(same)).cast("int")

    sized = both.withColumn("nr", F.when(F.col("to_right"), agree("right")).otherwise(0)).withColumn("nl", F.when(F.col("to_left"), agree("left")).otherwise(0)).where("nr + nl > 0")
    # both sides from one pass over the joined rows
    of = lambda key, doc, right, left: F.transform(F.concat(F.slice(right, 1, F.col("nr")), F.slice(left, 1, F.col("nl"))), lambda p: F.struct(F.col(key).alias("key"), F.col(doc).alias("doc_id"), p.alias("p")))
    both = sized.select(F.explode(F.concat(of("key", "doc_id", "right", "left"), of("keep_key", "keep_doc", "keep_right", "keep_left"))).alias("t"))
    return both.select("t.key", "t.doc_id", "t.p.*").distinct()


def runs_of(spans: DataFrame) -> DataFrame:
    """(key, begin, end, lines) of the runs that spans (key, begin, end, first, last) make together: a run starts where a span doesn't touch those before."""
    order = Window.partitionBy("key").orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.withColumn("fresh", F.coalesce(F.col("begin") > before + 1, F.lit(True)).cast("int"))
    numbered = fresh.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("key", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), (F.max("last") - F.min("first") + 1).alias("lines"))


def removed_chunks(spark: SparkSession, keyed: DataFrame) -> DataFrame:
    """(key, removed array<struct<begin, end, lines>>, by_chunks) of the texts that lose lines, one struct a run, and how many of the lines chunks and their extensions tell; ``keyed`` is (key long, doc_id long, text)."""
    scratch = Scratch(spark, "line-dedup")
    chunks = scratch.write(keyed.select("key", "doc_id", "text").mapInArrow(_chunks, _CHUNK), "chunks")
    whole = scratch.write(later_copies(chunks.where("kind = 0").drop("pairs", "number"), keyed, scratch), "whole")
    grown = scratch.write(extensions(chunks, whole, scratch), "extensions")
    # pairs in a chunk that goes are told by it, but for the one that leaves it
    gone_chunks = scratch.write(whole.select(_place("key", "begin").alias("place")).distinct(), "gone")
    placed = chunks.select("key", "doc_id", "last", "pairs", _place("key", "begin").alias("place"))
    leaving = some_rows(placed, gone_chunks, "place").select("key", "doc_id", "place", F.explode(F.filter("pairs", lambda p: p["last"] > F.col("last"))).alias("p")).join(gone_chunks, "place")
    leaving = scratch.write(leaving.select("key", "doc_id", "p.*"), "leaving")
    each = other_rows(placed, gone_chunks, "place").select("key", "doc_id", F.explode("pairs").alias("p")).select("key", "doc_id", "p.*").unionAll(leaving).withColumn("place", _place("key", "begin"))
    told_pairs = scratch.write(grown.select(_place("key", "begin").alias("place")).distinct(), "told")
    pairs = other_rows(each, told_pairs, "place").drop("place")
    # the bytes of extensions and of the pairs that are left are compared at once: texts move once for both
    found = scratch.write(later_copies(grown.select(*pairs.columns).unionAll(pairs), keyed, scratch).select(*_SPAN, _place("key", "begin").alias("place")), "found")
    told = whole.select(*_SPAN).unionAll(found.join(told_pairs, "place", "left_semi").select(*_SPAN))
    gone = whole.select(*_SPAN).unionAll(found.select(*_SPAN))
    by_chunks = runs_of(told).groupBy("key").agg(F.sum("lines").alias("by_chunks"))
    all_runs = runs_of(gone).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("begin", "end", "lines"))).alias("removed"))
    removed = scratch.write(all_runs.join(by_chunks, "key", "left").select("key", "removed", F.coalesce("by_chunks", F.lit(0)).cast("long").alias("by_chunks")), "removed")
    scratch.finish(removed)
    return removed


def row_key():
    """Rows equal in doc_id and text are one document."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text").cast("string"))


def line_dedup_report(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed_chunks (runs of lines that go), n_removed_lines, n_removed_bytes (with the newline of each run), n_chunk_lines (the lines of n_removed_lines that chunks and their extensions tell; runs without a whole chunk have the others).

    Null and empty texts lose nothing. A null doc_id comes before all others.
    Rows equal in doc_id and text are one document and lose the same; rows that
    share a doc_id only are told apart by their texts. Other columns are
    ignored; an empty table gives an empty result.
    """
    keyed = docs.select(row_key().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gone = removed_chunks(spark, keyed)
    count = gone.select("key", "by_chunks", F.size("removed").alias("c"), F.expr("aggregate(removed, 0L, (a, r) -> a + r.lines)").alias("l"), F.expr("aggregate(removed, 0L, (a, r) -> a + r.end - r.begin + 1)").alias("b"))
    slim = keyed.select("key", "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    out = slim.join(count, "key", "left")
    return out.select("doc_id", "n_bytes", zero("c").alias("n_removed_chunks"), zero("l").alias("n_removed_lines"), F.least(zero("b"), F.col("n_bytes")).alias("n_removed_bytes"), zero("by_chunks").alias("n_chunk_lines"))


def line_dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """``docs`` with the removed runs cut out of ``text``; a document of which no word is left goes. n_chars, if there, follows the text.

    Nulls, repeated rows and empty tables are as in line_dedup_report; other
    columns, whatever their names, stay as they are.
    """
    keyed = docs.withColumn("_nx_row", row_key())
    gone = removed_chunks(spark, keyed.select(F.col("_nx_row").alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    spans = gone.select(F.col("key").alias("_nx_gone"), F.col("removed").alias("_nx_removed"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hit = some_rows(keyed, gone.select("key"), "_nx_row").join(spans, F.col("_nx_row") == F.col("_nx_gone")).select(*columns, "_nx_removed")

    def cut(batches):
        for batch in batches:
            at, n = batch.schema.get_field_index("text"), batch.num_columns - 1
            texts = [kept_text(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(n).to_pylist(), strict=True)]
            yield pa.record_batch([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(n)], names=[batch.schema.field(i).name for i in range(n)])

    changed = hit.mapInArrow(cut, docs.withColumn("text", F.col("text").cast("string")).schema).where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return other_rows(keyed, gone.select("key"), "_nx_row").select(*columns).unionByName(changed.select(*columns))


def kept_text(text: str, spans: list[dict]) -> str:
    """The text without the spans (bytes, whole lines) and their newlines."""
    raw, out, at = text.encode(), [], 0
    for s in spans:
        if s["begin"] > at:
            out.append(raw[at : s["begin"]])
        at = s["end"] + 1
    out.append(raw[at:] if at <= len(raw) else b"")
    whole = b"".join(out)
    if at > len(raw) and whole.endswith(b"\n"):
        whole = whole[:-1]
    return whole.decode()
