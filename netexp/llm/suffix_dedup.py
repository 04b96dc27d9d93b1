"""Exact removal of repeated byte strings, by induced suffix sorting of bounded shards.

Wanted: every byte covered by a string of LENGTH bytes that also starts
anywhere else. A suffix array of the whole corpus would sort every byte; almost
all of it can be shown to be unique, or repeated, beforehand, so that only the
places where a repeat begins or ends are sorted:

1. Each window of LENGTH bytes has an anchor, the GRAM-byte string in it with
   the least hash (the last one of equals). Equal windows have equal anchors at
   the same place. Consecutive windows with one anchor are a segment.
2. Anchors that occur once: their windows are unique. Segments whose whole bytes
   occur twice: their windows are repeated.
3. The other segments are cut into cells of CELL windows. A cell's core, the
   bytes that all its windows share, must occur in another cell of the anchor.
4. Cells of a core with more than a shard's bytes are cut in halves, whose cores
   are longer, and go through step 3 again. A cell of one window is its core, so
   this ends.
5. What is still open goes to shards by core, as snippets of a cell's bytes. A
   shard's suffixes are sorted by external induction (``induced``), with common
   prefixes; neighbours with LENGTH bytes in common are repeats.

The report runs steps 1 to 3 for PASSAGE bytes first, which finds the regions
that may hold repeats and the passages, and then all steps for LENGTH bytes within
those regions.

Steps 2 and 3 compare pairs of 64-bit hashes of the same anchor; groups are only
counted, so copies and common passages cost a row each.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netexp.llm.cluster import Scratch, other_rows, some_rows
from netexp.llm.induced import suffix_order
from netexp.llm.line_dedup import row_key
from netexp.llm.mixing import WORD
from netexp.llm.textkit import U, Prefix, mix, signed, slices

LENGTH = 400
#: A passage is covered by repeated strings of about PASSAGE bytes and has over PASSAGE_WORDS words.
PASSAGE, PASSAGE_WORDS = 240, 50
SHARD_BYTES = 2 << 20


def shape(length: int) -> tuple[int, int]:
    """(bytes of an anchor, windows in a cell) for repeats of ``length`` bytes."""
    gram = max(1, round(length * 0.24))
    return gram, max(1, round((length - gram) / 8))


def segments(buf: np.ndarray, offsets: np.ndarray, length: int):
    """Segments of every text: text, anchor place, first and last window (in the text), anchor hash, hash of all bytes."""
    gram, _ = shape(length)
    none = np.zeros(0, np.int64)
    n = len(buf)
    if n < length:
        return none, none, none, none, none.view(U), none.view(U)
    prefix = Prefix(buf)
    at = np.arange(n - gram + 1)
    h = prefix.hashes(at, at + gram)
    bits = U(max(1, int(n).bit_length()))
    low = (U(1) << bits) - U(1)
    key = (h & ~low) | (low - at.astype(U))
    w = length - gram + 1
    padded = np.full(-(-len(key) // w) * w, ~U(0))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[: n - length + 1], ahead[w - 1 : w - 1 + n - length + 1])
    anchor = (low - (least & low)).astype(np.int64)
    doc_len = np.diff(offsets)
    mark = np.zeros(n + 1, np.int32)
    has = doc_len >= length
    np.add.at(mark, offsets[:-1][has], 1)
    np.add.at(mark, offsets[1:][has] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(mark[: n - length + 1]) > 0)  # windows within one text
    if not len(start):
        return none, none, none, none, none.view(U), none.view(U)
    a = anchor[start]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (start[1:] != start[:-1] + 1)))
    first = np.flatnonzero(new)
    s1, s2, p = start[first], start[np.append(first[1:], len(start)) - 1], a[first]
    doc = np.searchsorted(offsets, s1, "right") - 1
    whole = mix(prefix.hashes(s1, s2 + length) + (p - s1).astype(U) * U(0xE7037ED1A0B428DB))
    base = offsets[doc]
    return doc, p - base, s1 - base, s2 - base, h[p], whole


_SEGMENT = "key long, p long, s1 long, s2 long, ah long, ctx long"


def _segments(length: int):
    def find(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            for at, _, buf, offsets in slices(batch.column(1)):
                doc, p, s1, s2, ah, ctx = segments(buf, offsets, length)
                yield pa.record_batch([pa.array(keys[at + doc]), pa.array(p), pa.array(s1), pa.array(s2), pa.array(signed(ah)), pa.array(signed(ctx))], names=["key", "p", "s1", "s2", "ah", "ctx"])

    return find


_CELL = "key long, p long, a1 long, a2 long, ah long, cell int, core long, ext long, many boolean"


def _lists(column: pa.Array, names: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rows of the batch, columns) of an array<struct> column without nulls."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), lengths), [flat.field(flat.type.get_field_index(x)).to_numpy(zero_copy_only=False) for x in names]


def _cells(length: int, cell: int):
    """Rows (key, text, segs array<struct<p, s1, s2, ah, many>>): the cells of ``cell`` windows of the segments."""

    def cut(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            row, (p, s1, s2, ah, many) = _lists(batch.column(2), ["p", "s1", "s2", "ah", "many"])
            for at, to, buf, offsets in slices(batch.column(1)):
                pick = np.flatnonzero((row >= at) & (row < to))
                if not len(pick):
                    continue
                low, high = (p[pick] - s2[pick]) // cell, (p[pick] - s1[pick]) // cell
                count = high - low + 1
                seg = np.repeat(pick, count)
                c = np.repeat(low, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                # windows start a bytes before the anchor, a from a1 to a2
                a1, a2 = np.maximum(c * cell, p[seg] - s2[seg]), np.minimum(c * cell + cell - 1, p[seg] - s1[seg])
                place = offsets[row[seg] - at] + p[seg]
                prefix = Prefix(buf)
                core = prefix.hashes(place - c * cell, place - c * cell - cell + 1 + length)
                ext = mix(prefix.hashes(place - a2, place - a1 + length) + (a1 * 4099 + a2).astype(U) * U(0xE7037ED1A0B428DB))
                yield pa.record_batch(
                    [pa.array(keys[row[seg]]), pa.array(p[seg]), pa.array(a1), pa.array(a2), pa.array(ah[seg]), pa.array(c.astype(np.int32)), pa.array(signed(core)), pa.array(signed(ext)), pa.array(many[seg])],
                    names=["key", "p", "a1", "a2", "ah", "cell", "core", "ext", "many"],
                )

    return cut


def repeated_windows(keys: list, starts: list, many: list, snippets: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """(key, first byte, end byte) of the windows of ``snippets`` that are repeated.

    A snippet is bytes from place ``starts`` of text ``keys``; the same place may
    be in several snippets and is no repeat of itself, but a snippet that stands
    for several (``many``) is one.
    """
    sizes = np.array([len(s) for s in snippets], dtype=np.int64)
    ends = np.cumsum(sizes + 1) - 1
    begins = ends - sizes
    raw = np.frombuffer(b"\0".join(snippets) + b"\0", dtype=np.uint8)
    owner = np.repeat(np.arange(len(snippets), dtype=np.int32), sizes + 1)
    keys, starts, many = np.array(keys, dtype=np.int64), np.array(starts, dtype=np.int64), np.array(many, dtype=bool)
    mark = np.zeros(len(raw) + 1, dtype=np.int8)
    whole = sizes >= length
    mark[begins[whole]] = 1
    mark[ends[whole] - length + 1] = -1
    room = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    del mark
    base = mix(keys.view(U))

    def place_of(pos):
        o = owner[pos]
        return mix(base[o] + (starts[o] + pos - begins[o]).astype(U) * U(0x9E3779B97F4A7C15))

    hits = []
    for pos, lcp in suffix_order(raw, ends, length):
        pos = pos[pos < len(raw)] if len(pos) and pos.max() >= len(raw) else pos
        if len(pos) < len(lcp):
            lcp = lcp[:0] if not len(pos) else lcp[-len(pos) :]
        if not len(pos):
            continue
        pos = pos.astype(np.int64)
        new = lcp < length
        new[0] = True
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(pos)))
        use = np.repeat(size > 1, size) | (many[owner[pos]] & room[pos])
        if not use.any():
            continue
        v = place_of(pos)
        differs = (np.minimum.reduceat(v, first) != np.maximum.reduceat(v, first)) | np.maximum.reduceat(many[owner[pos]].astype(np.int8), first).astype(bool)
        run = np.repeat(differs, size) & room[pos]
        hits.append(pos[run])
    if not hits:
        return []
    found = np.sort(np.concatenate(hits))
    o = owner[found]
    cut = np.concatenate(([True], (found[1:] != found[:-1] + 1) | (o[1:] != o[:-1])))
    first = np.flatnonzero(cut)
    last = np.append(first[1:], len(found)) - 1
    o = o[first]
    shift = starts[o] - begins[o]
    return list(zip(keys[o].tolist(), (found[first] + shift).tolist(), (found[last] + shift + length).tolist(), strict=True))


def _snippets(length: int):
    def cut(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            texts = batch.column(1).cast(pa.binary())
            row, (p, a1, a2, shard, many) = _lists(batch.column(2), ["p", "a1", "a2", "shard", "many"])
            raw = {i: texts[i].as_py() for i in np.unique(row).tolist()}
            out = [raw[r][x - hi : x - lo + length] for r, x, lo, hi in zip(row.tolist(), p.tolist(), a1.tolist(), a2.tolist(), strict=True)]
            yield pa.record_batch([pa.array(shard), pa.array(keys[row]), pa.array(p - a2), pa.array(many), pa.array(out, pa.binary())], names=["shard", "key", "start", "many", "snippet"])

    return cut


def _sort_shards(length: int):
    def work(batches):
        shard, rows = None, ([], [], [], [])

        def flush():
            if rows[0]:
                found = repeated_windows(*rows, length)
                if found:
                    k, b, e = zip(*found, strict=True)
                    yield pa.record_batch([pa.array(k, pa.int64()), pa.array(b, pa.int64()), pa.array(e, pa.int64())], names=["key", "begin", "end"])

        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(5)]
            for s, *rest in zip(*columns, strict=True):
                if s != shard:
                    yield from flush()
                    shard, rows = s, ([], [], [], [])
                for kept, value in zip(rows, rest, strict=True):
                    kept.append(value)
        yield from flush()

    return work


KIND = ["ah", "cell", "core"]


def shared_segments(keyed: DataFrame, length: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Steps 1 and 2: (key, begin, end) of segments that are repeated as a whole, and the open ones as lists (key, segs), one of each kind of bytes."""
    seg = scratch.write(keyed.where(F.octet_length("text") >= length).mapInArrow(_segments(length), _SEGMENT), "segments")
    twice = seg.groupBy("ah").agg(F.min("ctx").alias("low"), F.max("ctx").alias("high"), F.count("*").alias("n")).where("n > 1").select("ah", (F.col("low") != F.col("high")).alias("mixed"))
    twice = scratch.write(twice, "twice")  # written, so that Spark can split the join's hot anchors
    again = scratch.write(seg.join(twice, "ah"), "again")
    scratch.drop(seg)
    counts = again.groupBy("ah", "ctx").agg(F.count("*").alias("n"), F.min(F.struct("key", "p", "s1", "s2")).alias("one"), F.first("mixed").alias("mixed"))
    counts = scratch.write(counts, "counts")
    same = again.join(counts.where("n > 1").select("ah", "ctx"), ["ah", "ctx"]).select("key", F.col("s1").alias("begin"), (F.col("s2") + length).alias("end"))
    open_ = counts.where("mixed").select("one.key", "one.p", "one.s1", "one.s2", "ah", (F.col("n") > 1).alias("many"))
    return same, scratch.write(open_.groupBy("key").agg(F.collect_list(F.struct("p", "s1", "s2", "ah", "many")).alias("segs")), "open")


def shared_cells(keyed: DataFrame, lists: DataFrame, length: int, cell: int, scratch: Scratch) -> DataFrame:
    """Step 3: the cells of ``lists`` whose core another cell of the anchor has."""
    texts = some_rows(keyed, lists.select("key"), "key").dropDuplicates(["key"])
    cells = scratch.write(texts.join(lists, "key").select("key", "text", "segs").mapInArrow(_cells(length, cell), _CELL), "cells")
    shared = cells.groupBy(KIND).agg(F.min("ext").alias("low"), F.max("ext").alias("high"), F.count("*").alias("n")).where("n > 1").select(*KIND, (F.col("low") != F.col("high")).alias("mixed"))
    shared = scratch.write(shared, "shared")
    met = scratch.write(cells.join(shared, KIND), "met")
    scratch.drop(cells)
    return met


def merged_spans(spans: DataFrame) -> DataFrame:
    """(key, spans array<struct<begin, end>>): the runs of (key, begin, end); a run starts where a span doesn't touch those before."""
    order = Window.partitionBy("key").orderBy("begin", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = spans.distinct().withColumn("fresh", F.coalesce(F.col("begin") > before, F.lit(True)).cast("int"))
    runs = fresh.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy("key", "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"))
    return runs.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("begin", "end"))).alias("spans"))


def repeated_spans(spark: SparkSession, keyed: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(key, spans array<struct<begin, end>>): the maximal runs of covered bytes of texts that have some; ``keyed`` is (key, text)."""
    scratch = Scratch(spark, "suffix-dedup")
    same, lists = shared_segments(keyed, length, scratch)
    kind = KIND
    room = F.lit(length + 1) + F.col("a2") - F.col("a1")
    _, cell = shape(length)
    equal, left = [], []
    while True:
        met = shared_cells(keyed, lists, length, cell, scratch)
        scratch.drop(lists)
        known = met.groupBy(*kind, "ext").agg(F.count("*").alias("n"), F.max("many").alias("many"), F.min(F.struct("key", "p", "a1", "a2")).alias("one"), F.first("mixed").alias("mixed"))
        known = scratch.write(known, "known")
        equal.append(met.join(known.where("n > 1").select(*kind, "ext"), [*kind, "ext"]).select("key", (F.col("p") - F.col("a2")).alias("begin"), (F.col("p") - F.col("a1") + length).alias("end")))
        open_ = known.where("mixed").select("one.*", *kind, (F.col("many") | (F.col("n") > 1)).alias("many"))
        large = scratch.write(open_.groupBy(kind).agg(F.sum(room).alias("bytes")).where(F.col("bytes") > shard_bytes).select(kind), "large")
        if cell == 1 or large.isEmpty():
            left.append(open_)
            break
        left.append(open_.join(large, kind, "left_anti").select(*open_.columns))
        halves = open_.join(large, kind).select("key", "p", (F.col("p") - F.col("a2")).alias("s1"), (F.col("p") - F.col("a1")).alias("s2"), "ah", "many")
        lists = scratch.write(halves.groupBy("key").agg(F.collect_list(F.struct("p", "s1", "s2", "ah", "many")).alias("segs")), "halves")
        cell = -(-cell // 2)
    # a core of one cell size is no core of another: each has shards of its own
    left = reduce(DataFrame.unionAll, [x.withColumn("round", F.lit(i)) for i, x in enumerate(left)])
    equal = reduce(DataFrame.unionAll, equal)
    total = left.agg(F.sum(room)).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    left = left.withColumn("shard", F.pmod(F.xxhash64("round", *kind), F.lit(shards)))
    wanted = scratch.write(left.groupBy("key").agg(F.collect_list(F.struct("p", "a1", "a2", "shard", "many")).alias("parts")), "wanted")
    texts = some_rows(keyed, wanted.select("key"), "key").dropDuplicates(["key"])
    snippets = texts.join(wanted, "key").select("key", "text", "parts").mapInArrow(_snippets(length), "shard long, key long, start long, many boolean, snippet binary")
    sorted_ = snippets.repartition(int(shards), "shard").sortWithinPartitions("shard").mapInArrow(_sort_shards(length), "key long, begin long, end long")
    every = same.unionAll(equal).unionAll(sorted_)
    spans = scratch.write(merged_spans(every), "spans")
    scratch.finish(spans)
    return spans


def _digest(batches):
    for batch in batches:
        texts, spans = batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist()
        size, removed, count, digest = [], [], [], []
        for raw, s in zip(texts, spans, strict=True):
            raw = raw or b""
            out = without(raw, s or [])
            size.append(len(raw))
            removed.append(len(raw) - len(out))
            count.append(len(s or []))
            digest.append(hashlib.sha256(out).hexdigest())
        yield pa.record_batch([batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(count, pa.int64()), pa.array(digest, pa.string()), batch.column(3)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "key"])


def without(raw: bytes, spans: list[dict]) -> bytes:
    """The bytes outside the spans."""
    out, at = [], 0
    for s in spans:
        out.append(raw[at : s["begin"]])
        at = s["end"]
    out.append(raw[at:])
    return b"".join(out)


def candidate_regions(spark: SparkSession, keyed: DataFrame, short: int) -> DataFrame:
    """(key, spans) of texts, by steps 1 to 3 for ``short`` bytes; nothing is sorted.

    Every string of ``short`` bytes that stands twice lies in the spans, which go
    at most a cell of windows less one beyond such strings.
    """
    scratch = Scratch(spark, "suffix-regions")
    same, lists = shared_segments(keyed, short, scratch)
    met = shared_cells(keyed, lists, short, shape(short)[1], scratch)
    wide = met.select("key", (F.col("p") - F.col("a2")).alias("begin"), (F.col("p") - F.col("a1") + short).alias("end"))
    found = scratch.write(merged_spans(same.unionAll(wide)), "regions")
    scratch.finish(found)
    return found


def repeated_passages(spark: SparkSession, keyed: DataFrame, length: int, short: int, most_words: int, shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(spans of repeats of ``length`` bytes as in repeated_spans, keys of the texts that hold a passage of more than ``most_words`` words).

    A string that stands twice has only substrings that do, so longer repeats
    are looked for within the regions of the shorter ones.
    """
    scratch = Scratch(spark, "suffix-passages")
    found = candidate_regions(spark, keyed, short)
    texts = some_rows(keyed, found.select("key"), "key").join(found, "key")  # rows equal in id and text each count
    part = "substring(raw, cast(s.begin + 1 as int), cast(s.end - s.begin as int))"
    cut = texts.select("key", F.encode("text", "utf-8").alias("raw"), "spans").select(
        "key",
        F.expr(f"exists(spans, s -> regexp_count(cast({part} as string), r'{WORD}') > {most_words})").alias("told"),
        F.expr(f"transform(filter(spans, s -> s.end - s.begin >= {length}), s -> named_struct('begin', s.begin, 'text', {part}))").alias("parts"),
    )
    cut = scratch.write(cut.where("told or size(parts) > 0"), "cut")
    pieces = cut.select("key", F.explode("parts").alias("s")).select(F.xxhash64("key", "s.begin").alias("piece"), "key", "s.begin", "s.text")
    long = repeated_spans(spark, pieces.select(F.col("piece").alias("key"), "text"), length, shard_bytes)
    placed = pieces.select("piece", F.col("key").alias("text_key"), "begin").join(long.withColumnRenamed("key", "piece"), "piece")
    placed = placed.select(F.col("text_key").alias("key"), F.explode(F.expr("transform(spans, s -> named_struct('begin', s.begin + begin, 'end', s.end + begin))")).alias("s"))
    return scratch.write(placed.groupBy("key").agg(F.array_sort(F.collect_set("s")).alias("spans")), "spans"), cut.where("told").select("key").distinct()


def suffix_dedup_report(spark: SparkSession, docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, passage: int = PASSAGE, passage_words: int = PASSAGE_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256, repeats.

    ``repeats``: it loses a byte, or has a run of more than ``passage_words``
    words covered by strings of ``passage`` bytes that also start elsewhere; up
    to a cell of windows (22 bytes) beyond the ends may count.

    A removed byte is in a string of ``length`` bytes that also starts anywhere
    else: in another row, equal ones included, or elsewhere in the same text;
    strings are those of the input. Null and empty texts have 0 bytes and the
    digest of nothing; texts under ``length`` bytes lose nothing. Other columns
    are ignored; an empty table gives an empty result.
    """
    keyed = docs.select(row_key().alias("key"), F.col("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = keyed.select("key", "text")
    spans, passages = repeated_passages(spark, texts, length, min(passage, length), passage_words, shard_bytes)
    spans = spans.withColumnRenamed("key", "_span_key")
    hit = some_rows(keyed, spans.select("_span_key"), "key")
    touched = hit.join(spans, F.col("key") == F.col("_span_key")).select("doc_id", "text", "spans", "key")
    kind = docs.schema["doc_id"].dataType.simpleString()
    changed = touched.mapInArrow(_digest, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, key long")
    whole = other_rows(keyed, spans.select("_span_key"), "key")
    text = F.coalesce(F.col("text"), F.lit(""))
    plain = whole.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.sha2(F.encode(text, "utf-8"), 256).alias("kept_sha256"), "key")
    every = plain.unionByName(changed).join(passages.withColumnRenamed("key", "_told"), F.col("key") == F.col("_told"), "left")
    return every.withColumn("repeats", (F.col("n_removed") > 0) | F.col("_told").isNotNull()).drop("key", "_told")
