"""Benchmark decontamination: phrases of test items are searched in an FM-index of every training shard.

``build_index`` makes one row a shard; it does not depend on a benchmark, so a
written index serves any number of them. A phrase is a window of consecutive
words of an item (all its words, if they are fewer). Phrases are broadcast in
blocks of bounded size; each shard counts them by backward search, locates
their occurrences and returns, by document, the merged spans of hit words and
the items that they come from. Nothing is shuffled but documents that are in
several shards or have several blocks.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from netexp.llm.cluster import Scratch, small_batches
from netexp.llm.fm_index import FMIndex
from netexp.llm.target_resampling import WORD_BYTES
from netexp.llm.textkit import slices

WINDOW = 10
#: Words of a shard; a longer text is in several ones, with an overlap of a window less one word.
SHARD_WORDS = 1 << 20
#: Bytes of phrases that are broadcast at once.
BLOCK_BYTES = 32 << 20
#: Occurrences that are located at once.
LOCATE = 1 << 20

SPANS = "array<struct<start:long,end:long>>"


def _words(text: bytes) -> list[bytes]:
    return text.translate(WORD_BYTES).split()


class _Shard:
    """Texts of a shard that is filled: symbols by word, and what is known of each piece."""

    def __init__(self):
        self.symbol = defaultdict(count(1).__next__)
        self.runs, self.pieces, self.size = [], [], 0

    def add(self, words: list[bytes], piece: tuple) -> None:
        self.runs.append(np.fromiter(map(self.symbol.__getitem__, words), dtype=np.int32, count=len(words)))
        self.runs.append(np.zeros(1, np.int32))
        self.pieces.append((*piece, len(words)))
        self.size += len(words)


#: Columns of an index row that hold one value a piece: its document (row, doc_id, key of the text, words), its first word there, its words.
_PIECES = ["row", "doc_id", "text_key", "n_words", "at", "length"]


def _indexer(id_type: pa.DataType, window: int, shard_words: int):
    def row_of(shard: _Shard, number: int) -> pa.RecordBatch:
        index = FMIndex.build(np.concatenate(shard.runs))
        types = [pa.int64(), id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(shard.pieces)], pa.int32()), pa.array(list(values), t)) for values, t in zip(zip(*shard.pieces, strict=True), types, strict=True)]
        blobs = [pa.array([b], pa.binary()) for b in (b" ".join(shard.symbol), *index.parts())]
        return pa.record_batch([pa.array([number]), *blobs, *lists], names=["shard", "words", "counts", "levels", "marks", "samples", *_PIECES])

    def index(batches):
        base = TaskContext.get().partitionId() << 40
        rows, shards, shard = count(base), count(base), _Shard()
        for batch in batches:
            for at, to, buf, offsets in slices(batch.column(2)):
                whole, bounds = buf.tobytes(), offsets.tolist()
                ids, keys = batch.column(0).slice(at, to - at).to_pylist(), batch.column(1).slice(at, to - at).to_pylist()
                for doc_id, key, a, b in zip(ids, keys, bounds[:-1], bounds[1:], strict=True):
                    words, row = _words(whole[a:b]), next(rows)
                    for first in range(0, max(len(words) - window + 1, 1), shard_words):
                        piece = words[first : first + shard_words + window - 1]
                        if shard.pieces and shard.size + len(piece) > shard_words:
                            yield row_of(shard, next(shards))
                            shard = _Shard()
                        shard.add(piece, (row, doc_id, key, len(words), first))
        if shard.pieces:
            yield row_of(shard, next(shards))

    return index


def build_index(docs: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """One row a shard of docs (doc_id, text): an FM-index over words, good for phrases up to ``window`` words. Every row of docs is in it; null texts have no words."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kind = docs.schema["doc_id"].dataType
    schema = f"shard long, words binary, counts binary, levels binary, marks binary, samples binary, row array<long>, doc_id array<{kind.simpleString()}>, text_key array<long>, n_words array<long>, at array<long>, length array<long>"
    return docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text")).mapInArrow(_indexer(to_arrow_type(kind), window, shard_words), schema)


def _cutter(window: int):
    def cut(batches):
        for batch in batches:
            ids, phrases = [], []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = _words((text or "").encode())
                for i in range(max(len(words) - window + 1, 1 if words else 0)):
                    ids.append(item)
                    phrases.append(b" ".join(words[i : i + window]).decode())
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(phrases, pa.string())], names=["item_id", "phrase"])

    return cut


def phrases(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id as string, phrase), distinct: the windows of each item, or all its words if they are fewer. Items without words have none."""
    small_batches(benchmark.sparkSession)
    rows = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_cutter(window), "item_id string, phrase string").distinct()


class PhraseBlock:
    """Distinct phrases of a block as rows of word numbers, and the items of each."""

    def __init__(self, pairs: list[tuple[str | None, str]], window: int):
        self.items = sorted({i for i, _ in pairs if i is not None})
        number = {item: j for j, item in enumerate(self.items)}
        of: dict[str, list[int]] = {}
        for item, phrase in pairs:
            of.setdefault(phrase, []).extend([] if item is None else [number[item]])
        word = defaultdict(count().__next__)
        self.rows, self.length = np.full((len(of), window), -1, dtype=np.int32), np.zeros(len(of), dtype=np.int32)
        for j, phrase in enumerate(of):
            w = [word[x] for x in phrase.encode().split(b" ")]
            self.rows[j, window - len(w) :] = w
            self.length[j] = len(w)
        self.words = list(word)
        self.bounds = np.concatenate(([0], np.cumsum([len(v) for v in of.values()]))).astype(np.int64)
        self.owners = np.array([i for v in of.values() for i in v], dtype=np.int64)

    def within(self, symbol: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
        """(phrase numbers, rows of a shard's symbols) of the phrases whose words all are in the shard."""
        numbers = np.array([*(symbol.get(w, -1) for w in self.words), 0], dtype=np.int64)  # the last one stands for no word
        rows = numbers[self.rows]
        there = np.flatnonzero((rows >= 0).all(axis=1))
        return there, rows[there]

    def owned(self, phrase: np.ndarray, piece: np.ndarray, n_pieces: int) -> list[list[str]]:
        """Item ids by piece, from distinct pairs of phrase and piece."""
        n = self.bounds[phrase + 1] - self.bounds[phrase]
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both = np.unique(np.repeat(piece, n) * max(len(self.items), 1) + self.owners[np.repeat(self.bounds[phrase], n) + offset])
        out: list[list[str]] = [[] for _ in range(n_pieces)]
        for p, i in zip((both // max(len(self.items), 1)).tolist(), (both % max(len(self.items), 1)).tolist(), strict=True):
            out[p].append(self.items[i])
        return out


def search_shard(index: FMIndex, symbol: dict[bytes, int], lengths: np.ndarray, block: PhraseBlock) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[str]]]:
    """(piece, start, end of each merged span, items by piece) of a shard; lengths: words of its pieces."""
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    number, rows = block.within(symbol)
    lo, hi = index.ranges(rows, block.length[number])
    found = np.flatnonzero(lo < hi)
    number, lo, hi = number[found], lo[found], hi[found]
    edges, seen = np.zeros(index.n + 1, dtype=np.int64), [np.zeros(0, np.int64)]
    n = hi - lo
    total = np.concatenate(([0], np.cumsum(n)))
    at = 0
    while at < len(number):
        to = max(at + 1, int(np.searchsorted(total, total[at] + LOCATE, "right")) - 1)
        for a in range(int(lo[at]), int(hi[at]), LOCATE) if to == at + 1 else [None]:
            # a phrase of very many occurrences is located in parts
            if a is None:
                places = np.repeat(lo[at:to] - (total[at:to] - total[at]), n[at:to]) + np.arange(total[to] - total[at])
                which = np.repeat(number[at:to], n[at:to])
            else:
                places = np.arange(a, min(a + LOCATE, int(hi[at])))
                which = np.full(len(places), number[at])
            position = index.locate(places)
            np.add.at(edges, position, 1)
            np.add.at(edges, position + block.length[which], -1)
            piece = np.searchsorted(starts, position, "right") - 1
            seen.append(np.unique(piece * len(block.length) + which))
        at = to
    covered = np.concatenate(([False], np.cumsum(edges[:-1]) > 0, [False]))
    turns = np.flatnonzero(covered[1:] != covered[:-1])
    begin, end = turns[::2], turns[1::2]
    piece = np.searchsorted(starts, begin, "right") - 1
    pairs = np.unique(np.concatenate(seen))
    items = block.owned(pairs % max(len(block.length), 1), pairs // max(len(block.length), 1), len(lengths))
    return piece, begin - starts[piece], end - starts[piece], items


def _searcher(broadcast):
    def search(batches):
        block = broadcast.value
        for batch in batches:
            for r in range(batch.num_rows):
                value = lambda name: batch.column(name)[r]  # noqa: B023, E731
                names = value("words").as_py().split(b" ")
                index = FMIndex.load(*(value(c).as_py() for c in ("counts", "levels", "marks", "samples")))
                lengths, at = (value(c).values.to_numpy(zero_copy_only=False) for c in ("length", "at"))
                piece, start, end, items = search_shard(index, dict(zip(names, range(1, len(names) + 1), strict=True)), lengths, block)
                bounds = pa.array(np.searchsorted(piece, np.arange(len(lengths) + 1)), pa.int32())
                spans = pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(start + at[piece]), pa.array(end + at[piece])], ["start", "end"]))
                kept = [value(c).values for c in ("row", "doc_id", "text_key", "n_words")]
                yield pa.record_batch([*kept, spans, pa.array(items, pa.list_(pa.string()))], names=["row", "doc_id", "text_key", "n_words", "spans", "items"])

    return search


def _merge(batches):
    for batch in batches:
        merged = []
        for spans in batch.column("spans").to_pylist():
            out: list[list[int]] = []
            for s in sorted((x["start"], x["end"]) for one in spans for x in one):
                if out and s[0] <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], s[1])
                else:
                    out.append(list(s))
            merged.append([{"start": a, "end": b} for a, b in out])
        items = [sorted({x for one in rows for x in one}) for rows in batch.column("items").to_pylist()]
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        yield pa.record_batch([*(batch.column(c) for c in ("row", "doc_id", "text_key", "n_words")), pa.array(merged, kind), pa.array(items, pa.list_(pa.string()))], names=["row", "doc_id", "text_key", "n_words", "spans", "items"])


def search_index(spark: SparkSession, index: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, doc_id, text_key, n_words, spans, items) of every document of an index: maximal runs of hit words [start, end), and the ids of the items with an occurring phrase, as strings.

    benchmark: item_id, text. An item without item_id hits words, but is not named.
    """
    cut = scratch.write(phrases(benchmark, window), "phrases")
    total = cut.agg(F.coalesce(F.sum(F.octet_length("phrase") + F.coalesce(F.octet_length("item_id"), F.lit(0))), F.lit(0))).first()[0]
    blocks = max(1, -(-total // block_bytes))
    schema = f"row long, doc_id {index.schema['doc_id'].dataType.elementType.simpleString()}, text_key long, n_words long, spans {SPANS}, items array<string>"
    found = None
    for b in range(blocks):
        pairs = cut.where(F.pmod(F.xxhash64("item_id", "phrase"), F.lit(blocks)) == b).collect()
        block = spark.sparkContext.broadcast(PhraseBlock([(r.item_id, r.phrase) for r in pairs], window))
        one = scratch.write(index.mapInArrow(_searcher(block), schema), "hits")
        block.destroy()
        found = one if found is None else found.unionAll(one)
    split = (F.col("n_words") >= shard_words + window) if blocks == 1 else F.lit(True)
    several = found.where(split).groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("text_key").alias("text_key"), F.first("n_words").alias("n_words"), F.collect_list("spans").alias("spans"), F.collect_list("items").alias("items"))
    several = several.select("row", "doc_id", "text_key", "n_words", "spans", "items").mapInArrow(_merge, schema)
    return found.where(~split).unionAll(several)


def contamination_report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, text_key, n_words, spans, items) of every row of docs (doc_id, text): see search_index. Null and empty texts have no words; an empty benchmark hits nothing."""
    scratch = Scratch(spark, "decontaminate")
    index = scratch.write(build_index(docs, window, shard_words), "index")
    out = scratch.write(search_index(spark, index, benchmark, scratch, window, shard_words, block_bytes).drop("row"), "report")
    scratch.finish(out)
    return out


_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def _cleaner(batches):
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("_nx_text").to_pylist(), batch.column("_nx_spans").to_pylist(), strict=True):
            raw = text.encode()
            at = [m.span() for m in _WORD.finditer(raw)]
            done, kept = 0, []
            for s in spans:
                kept.append(raw[done : at[s["start"]][0]])
                done = at[s["end"] - 1][1]
            out.append(b"".join([*kept, raw[done:]]).decode())
        yield batch.drop_columns(["_nx_text", "_nx_spans"]).append_column("_nx_clean", pa.array(out, pa.string()))


def remove_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **parameters) -> DataFrame:
    """docs with the hit words, and what stands between hit words of one span, cut out of their texts; texts without a hit stay as they are."""
    report = contamination_report(spark, docs, benchmark, **parameters)
    hits = report.where(F.size("spans") > 0).select(F.col("doc_id").alias("_nx_id"), F.col("text_key").alias("_nx_key"), F.col("spans").alias("_nx_spans")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("_nx_id")) & (F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))) == F.col("_nx_key"))
    clean = docs.join(hits, same, "left_anti")
    dirty = docs.join(hits, same).drop("_nx_id", "_nx_key")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    cut = dirty.withColumn("_nx_text", F.col("text").cast("string")).select(*[f"`{c}`" for c in docs.columns], "_nx_text", "_nx_spans").mapInArrow(_cleaner, f"{fields}, _nx_clean string")
    return clean.unionByName(cut.withColumn("text", F.col("_nx_clean")).select(*[f"`{c}`" for c in docs.columns]))


ORACLE_SQL = f"""
WITH b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
p AS (SELECT DISTINCT item, len(w) AS k, array_to_string(w, ' ') AS w FROM (SELECT item, unnest(CASE WHEN len(ws) < {WINDOW} THEN [ws] ELSE list_transform(range(1, len(ws) - {WINDOW - 2}), lambda i: ws[i:i + {WINDOW - 1}]) END) AS w FROM b WHERE len(ws) > 0)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
k AS (SELECT DISTINCT k FROM p),
o AS (SELECT r, k, i, array_to_string(ws[i:i + k - 1], ' ') AS w FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, k)),
h AS (SELECT r, o.k, i, item FROM o JOIN p ON p.k = o.k AND p.w = o.w),
n AS (SELECT r, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS j FROM h) GROUP BY r),
s AS (SELECT r, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON n.r = d.r LEFT JOIN s ON s.r = d.r
"""
