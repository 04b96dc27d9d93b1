"""N-gram Jaccard self-join by token-combination prefixes.

Tokens are the hashes of k-word shingles. A global order puts rare shingles
first. With ``tau`` the number of shingles a set may lack in a partner that
still reaches the threshold, a set's prefix goes on until it must share a
signature with any partner: a rare shingle is a signature of its own, frequent
shingles are dealt to hash groups and each pair within a group is one
signature, so a group of c shingles only counts c - 1 towards the tau + 1 that
the prefix needs (two sets that share no pair share at most one of the group).
Signatures group the sets of neighbouring size bands into candidate clusters. Shared passages chain many
unlinked sets into one cluster, so clusters are first split by histograms of
BINS counts (FINE for sets of LONG shingles or more): their L1 distance is at
most the size of the symmetric difference, hence linked sets are never parted. What is left is compared in blocks of
bounded size, exactly; a spanning forest of the links and each set's number of
links leave a block. Copies of one set are one class, so they never form pairs.

The order comes from counts of hash buckets over all documents, in a table sized
by the corpus up to 2 ** MOST_BITS bytes. A poor order costs time, never a link.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netexp.llm.cluster import Scratch, components, other_rows, some_rows
from netexp.llm.line_dedup import row_key
from netexp.llm.textkit import U, mix, shingle_sets, signed, slices

#: Least bits of the frequency table's size, those up to which it has a bucket for each shingle, and most; its rows hold 2 ** CHUNK_BITS buckets; partitions whose counts are added in one step.
LEAST_BITS, BUCKET_BITS, MOST_BITS, CHUNK_BITS, ADDED = 12, 24, 27, 16, 256
#: Frequency classes for each doubling of a count: where buckets hold many shingles, a common one shows only as a small part of its bucket's count.
LEVELS = 8
BLOCK, HISTOGRAM_BLOCK = 384, 1024
COLUMNS = 4096
BINS = 256
#: Sets of so many shingles have more bins: BINS would part hardly any of them.
LONG, FINE = 3000, 2048


def missing_allowed(n: int, num: int, den: int) -> int:
    """The most shingles a set of n may lack in a partner with intersection / union >= num / den."""
    return n - -(-n * num // den)


def band_of(n: int, num: int, den: int) -> int:
    """Size class: linked sets are in the same band or in neighbouring ones."""
    return int(math.log(n) / -math.log(num / den) + 1e-9)


def signatures(tokens: np.ndarray, frequency: np.ndarray, frequent: int, num: int, den: int) -> np.ndarray:
    """The signatures of one sorted set of shingles; linked, unequal sets share at least one."""
    n = len(tokens)
    tau = missing_allowed(n, num, den)
    if n * den < (n + 1) * num:  # a partner that differs has a union of n + 1 at least: only equal sets link
        return tokens[:0]
    own = mix(tokens + U(0x51ED270B))
    count = frequency[bucket_of(own, len(frequency).bit_length() - 1)]
    own = np.sort(count.astype(U) << U(56) | own >> U(8))  # the rarest first, by all but eight bits of the hash
    rare = int(np.searchsorted(own, U(min(frequent, 255)) << U(56)))
    if tau < rare:
        return own[: tau + 1]
    common = own[rare:]
    out = [own[:rare]]
    band = band_of(n, num, den)
    for scheme in (band, band + 1):  # a set and a partner one band up meet in the upper band's scheme
        groups = max(1, round(((1 - num / den) * (num / den) ** -scheme + 1) / 6))
        group = (common & U((1 << 56) - 1)) % U(groups)
        adds = np.ones(len(common), dtype=bool)
        adds[np.unique(group, return_index=True)[1]] = False
        size = int(np.searchsorted(rare + np.cumsum(adds), tau + 1)) + 1
        if size > len(common):  # can't happen for sets with room for a partner; all shingles then stand alone
            return own
        by = np.argsort(group[:size], kind="stable")
        group, value = group[by], common[by]
        times = np.searchsorted(group, group, "right") - np.arange(size) - 1
        i = np.repeat(np.arange(size), times)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(times) - times, times)
        salt = U((scheme * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        out.append(mix(value[i] * U(0xA0761D6478BD642F) + mix(value[j] + salt)))
    return np.unique(np.concatenate(out))


def bucket_of(own: np.ndarray, bits: int) -> np.ndarray:
    return (own >> U(64 - bits)).astype(np.int64)


_COUNTS = "chunk int, at binary, n binary"


def _bucket_counts(k: int, bits: int):
    """A partition's counts by bucket, a row for each chunk that has some: places in the chunk and counts up to 255, or without places all counts."""
    width = 1 << min(bits, CHUNK_BITS)

    def count(batches):
        total = np.zeros(1 << bits, dtype=np.uint8)
        for batch in batches:
            for _, _, buf, offsets in slices(batch.column(0)):
                at, n = np.unique(bucket_of(mix(np.concatenate(shingle_sets(buf, offsets, k)) + U(0x51ED270B)), bits), return_counts=True)
                total[at] = np.minimum(total[at] + n, 255)
        for c in range(len(total) // width):
            part = total[c * width : (c + 1) * width]
            at = np.flatnonzero(part)
            if len(at):
                sparse = 3 * len(at) < width
                places, values = (at.astype(np.uint16).tobytes(), part[at].tobytes()) if sparse else (b"", part.tobytes())
                yield pa.record_batch([pa.array([c], pa.int32()), pa.array([places], pa.binary()), pa.array([values], pa.binary())], names=["chunk", "at", "n"])

    return count


def _add_counts(keys: int, width: int, levels: bool, each: int = 2):
    """Rows (chunk, ..., at, n) sorted by their first ``keys`` columns, read as they come: the sums of each key's counts.

    As classes if ``levels``: 0 for none, then 1 and ``each`` more for each doubling, rounded.
    """

    def result(key, total):
        if levels:
            out = np.where(total > 0, np.rint(each * np.log2(np.maximum(total, 1))) + 1, 0).clip(0, 255).astype(np.uint8)
        else:
            out = np.minimum(total, (1 << 32) - 1).astype(np.uint32)
        return pa.record_batch([pa.array([key[0]], pa.int32()), pa.array([b""], pa.binary()), pa.array([out.tobytes()], pa.binary())], names=["chunk", "at", "n"])

    def add(batches):
        key, total = None, None
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(keys)]
            for i, here in enumerate(zip(*columns, strict=True)):
                if here != key:
                    if key is not None:
                        yield result(key, total)
                    key, total = here, np.zeros(width, dtype=np.int64)
                at, n = (np.frombuffer(batch.column(j)[i].as_buffer(), dtype=np.uint8) for j in (keys, keys + 1))
                if len(at):
                    total[at.view(np.uint16)] += n
                else:
                    total += n if len(n) == width else n.view(np.uint32)
        if key is not None:
            yield result(key, total)

    return add


def table_bits(docs: DataFrame) -> int:
    """About one bucket for every six bytes of text, within the bounds; above BUCKET_BITS one for every 64 bytes, some ten shingles."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return bits_for(size)


def bits_for(size: int) -> int:
    return min(MOST_BITS, max(LEAST_BITS, min(BUCKET_BITS, (size // 6).bit_length()), (size // 64).bit_length()))


def frequent_class(counts: np.ndarray, times: int) -> int:
    """The class from which a bucket has a common shingle: its count is over the median, which chance shares out, by times squared or by as many deviations as ``times``."""
    usual = 2.0 ** ((int(np.median(counts)) - 1) / LEVELS)
    return math.ceil(LEVELS * math.log2(usual + max(times**2, times * usual**0.5))) + 1


def frequency_table(docs: DataFrame, k: int) -> np.ndarray:
    """Frequency class of each hash bucket of shingles, over all documents: at most 2 ** MOST_BITS bytes.

    Sums go in two steps, so that no task adds more than ADDED partitions' rows
    of a chunk and then one row for each ADDED partitions.
    """
    bits = table_bits(docs)
    width = 1 << min(bits, CHUNK_BITS)
    counts = docs.select("text").mapInArrow(_bucket_counts(k, bits), _COUNTS).select("chunk", F.floor(F.spark_partition_id() / ADDED).alias("part"), "at", "n")
    some = counts.repartition("chunk", "part").sortWithinPartitions("chunk", "part").mapInArrow(_add_counts(2, width, False), _COUNTS)
    rows = some.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_add_counts(1, width, True, LEVELS), _COUNTS).select("chunk", "n").toArrow()
    table = np.zeros(((1 << bits) // width, width), dtype=np.uint8)
    for chunk, levels in zip(rows["chunk"].to_pylist(), rows["n"].to_pylist(), strict=True):
        table[chunk] = np.frombuffer(levels, dtype=np.uint8)
    return table.ravel()


def histograms(sets: list[np.ndarray]) -> np.ndarray:
    """Shingles of each set by the low byte of the hash, at most 255 a bin (a cap only lowers the distance of two sets)."""
    return _binned(sets, BINS)


def _binned(sets: list[np.ndarray], bins: int) -> np.ndarray:
    every = np.concatenate([*sets, np.zeros(0, U)])
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    count = np.bincount(row * bins + (every & U(bins - 1)).astype(np.int64), minlength=len(sets) * bins)
    return np.minimum(count, 255).astype(np.uint8).reshape(len(sets), bins)


def packed_histograms(sets: list[np.ndarray]) -> list[bytes]:
    """The histogram of each set: BINS bytes, or FINE from LONG shingles on."""
    out = [h.tobytes() for h in histograms(sets)]
    for i, s in enumerate(sets):
        if len(s) >= LONG:
            out[i] = _binned([s], FINE).tobytes()
    return out


def coarse(bins: list[bytes]) -> np.ndarray:
    """BINS counts of each packed histogram: a fine one is folded, as its bins go by more bits of the same hash."""
    return np.array([np.minimum(np.frombuffer(b, dtype=np.uint8).reshape(-1, BINS).sum(axis=0), 255) for b in bins], dtype=np.uint8).reshape(len(bins), BINS)


def _describe(k: int, num: int, den: int, table, frequent: int):
    def describe(batches):
        frequency = table.value
        for batch in batches:
            keys, ids = batch.column(0), batch.column(1)
            for at, to, buf, offsets in slices(batch.column(2)):
                sets = shingle_sets(buf, offsets, k)
                sigs = [signatures(s, frequency, frequent, num, den) if len(s) else s for s in sets]
                n = np.array([len(s) for s in sets], dtype=np.int64)
                k1 = np.array([set_key(s) for s in sets], dtype=U)
                k2 = np.array([set_key(s ^ U(0x3C79AC492BA7B653)) for s in sets], dtype=U)
                bounds = np.concatenate(([0], np.cumsum([len(s) for s in sigs]))).astype(np.int32)
                values = signed(np.concatenate(sigs)) if len(sigs) else np.zeros(0, np.int64)
                yield pa.record_batch(
                    [keys.slice(at, to - at), ids.slice(at, to - at), pa.array(n), pa.array(signed(k1)), pa.array(signed(k2)), pa.ListArray.from_arrays(pa.array(bounds), pa.array(values)), pa.array(packed_histograms(sets), pa.binary())],
                    names=["row", "doc_id", "n", "k1", "k2", "sigs", "bins"],
                )

    return describe


def set_key(tokens: np.ndarray) -> np.uint64:
    """A 64-bit key of a set of shingles; 0 for the empty set."""
    with np.errstate(over="ignore"):
        return mix(tokens).sum(dtype=U) if len(tokens) else U(0)


def links_of(sets: list[np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (i, j), i < j, of linked sets: every pair is compared by exact counts.

    The sets become rows of a 0/1 matrix over the shingles that at least two of
    them have, taken COLUMNS at a time; its product with itself has all
    intersections.
    """
    m = len(sets)
    n = np.array([len(s) for s in sets], dtype=np.int64)
    every, row = np.concatenate(sets), np.repeat(np.arange(m), n)
    if m == 2:
        both = len(every) - len(np.unique(every))
        linked = np.flatnonzero([den * both >= num * (int(n.sum()) - both)])
        return linked, linked + 1
    _, inverse, count = np.unique(every, return_inverse=True, return_counts=True)
    shared = count > 1
    column = np.cumsum(shared) - 1
    keep = shared[inverse]
    row, col = row[keep], column[inverse[keep]]
    by = np.argsort(col, kind="stable")
    row, col = row[by], col[by]
    inter = np.zeros((m, m), dtype=np.float32)
    for start in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(col, [start, start + COLUMNS])
        part = np.zeros((m, COLUMNS), dtype=np.float32)
        part[row[a:b], col[a:b] - start] = 1
        inter += part @ part.T
    inter = np.rint(inter).astype(np.int64)
    return np.nonzero(np.triu(den * inter >= num * (n[:, None] + n[None, :] - inter), 1))


def linked_forest(ids: list, sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of all links among the sets."""
    return spanning_forest(ids, *links_of(sets, num, den))


def spanning_forest(ids: list, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Edges, as ids, of a spanning forest of the pairs of rows (i, j); rows of one id are one node."""
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for x, y in zip(i.tolist(), j.tolist(), strict=True):
        a, b = root(x), root(y)
        if a != b:
            parent[b] = a
            if ids[x] != ids[y]:
                out.append((ids[x], ids[y]))
    return out


def possible_forest(ids: list, n: np.ndarray, bins: np.ndarray, num: int, den: int, fine: dict[int, np.ndarray] | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the pairs that histograms allow to be linked: all links are among these pairs.

    ``fine`` has the FINE counts of long sets, by place; two of these are compared by them, too.
    """
    wide, left, right = bins.astype(np.int16), [], []
    fine = fine or {}
    long = np.array(sorted(fine), dtype=np.int64)
    counts = np.array([fine[i] for i in long.tolist()], dtype=np.int16)
    for x in range(len(ids) - 1):
        both = n[x] + n[x + 1 :]
        # the intersection is (both - difference) / 2, and num / (num + den) of both at least in a link
        room = both - -(-2 * num * both // (num + den))
        near = np.flatnonzero(np.abs(n[x + 1 :] - n[x]) <= room)
        if len(near):
            near = near[np.abs(wide[x + 1 + near] - wide[x]).sum(axis=1, dtype=np.int64) <= room[near]]
            if x in fine and len(near):
                at = np.minimum(np.searchsorted(long, near + x + 1), len(long) - 1)
                both_long = long[at] == near + x + 1
                apart = np.zeros(len(near), dtype=bool)
                apart[both_long] = np.abs(counts[at[both_long]] - counts[np.searchsorted(long, x)]).sum(axis=1, dtype=np.int64) > room[near[both_long]]
                near = near[~apart]
            left.append(np.full(len(near), x))
            right.append(near + x + 1)
    return spanning_forest(ids, np.concatenate(left), np.concatenate(right)) if left else []


def _possible(num: int, den: int):
    """Rows (task, node, n, bins) sorted by task: the forest of each task's possible links."""

    def done(ids, n, bins):
        if len(ids) < 2:
            return []
        fine = {i: np.frombuffer(b, dtype=np.uint8) for i, b in enumerate(bins) if len(b) == FINE}
        return possible_forest(ids, np.array(n, dtype=np.int64), coarse(bins), num, den, fine)

    def compare(batches):
        task, rows = None, ([], [], [])
        for batch in batches:
            out = []
            for t, *rest in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if t != task:
                    out += done(*rows)
                    task, rows = t, ([], [], [])
                for kept, value in zip(rows, rest, strict=True):
                    kept.append(value)
            if out:
                yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])
        if out := done(*rows):
            yield pa.record_batch([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], names=["a", "b"])

    return compare


_LINKS = "a long, b long, links long"


def task_links(nodes: list, sides: list, documents: list, sets: list[np.ndarray], num: int, den: int) -> list[tuple]:
    """Rows (a, b, null), a spanning forest of a task's links, and (a, null, links), the documents that a node links with here.

    Side 0 counts all links; other sides count the links between them, as those
    within a side are counted by the side's own task.
    """
    i, j = links_of(sets, num, den)
    own, weight, links = np.array(sides), np.array(documents, dtype=np.int64), np.zeros(len(nodes), dtype=np.int64)
    mine = (own[i] != own[j]) | (own[i] == 0)
    np.add.at(links, i[mine], weight[j[mine]])
    np.add.at(links, j[mine], weight[i[mine]])
    return [(a, b, None) for a, b in spanning_forest(nodes, i, j)] + [(nodes[x], None, int(links[x])) for x in np.flatnonzero(links)]


def _compare(k: int, num: int, den: int):
    """Rows (task, node, side, documents, text) sorted by task: the links of each task. A text that is not of its node's set is left out."""

    def compare(batches):
        task, rows = None, ([], [], [], [])
        for batch in batches:
            out = []
            tasks, *kept = (batch.column(c).to_pylist() for c in range(4))
            for at, to, buf, offsets in slices(batch.column(4)):
                for i, s in zip(range(at, to), shingle_sets(buf, offsets, k), strict=True):
                    if tasks[i] != task:
                        if len(rows[0]) > 1:
                            out += task_links(*rows, num, den)
                        task, rows = tasks[i], ([], [], [], [])
                    if int(set_key(s).view(np.int64)) == kept[0][i]:
                        for have, value in zip(rows, (*(x[i] for x in kept), s), strict=True):
                            have.append(value)
            if out:
                yield _link_batch(out)
        if len(rows[0]) > 1 and (out := task_links(*rows, num, den)):
            yield _link_batch(out)

    return compare


def _link_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["a", "b", "links"])


def size_band(num: int, den: int):
    """``band_of`` of the column n."""
    return F.floor(F.log(F.col("n")) / -math.log(num / den) + 1e-9).cast("int")


def signature_stars(classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that tie classes with a common signature in the same or in neighbouring size bands, directly or by others of these.

    Linked sets are in such bands, so texts that share a passage but differ in
    size don't chain. In a band all go to the smallest node, which goes to the
    smallest one a band below; the index is moved and sorted once.
    """
    index = classes.select("node", size_band(num, den).alias("band"), F.explode("sigs").alias("sig")).repartition("sig")
    low = index.withColumn("low", F.first("node").over(Window.partitionBy("sig", "band").orderBy("node")))
    before = Window.partitionBy("sig").orderBy("band", "node")
    chained = low.select("node", "low", "band", F.lag("low").over(before).alias("below"), F.lag("band").over(before).alias("band_below"))
    down = F.when(F.col("band_below") == F.col("band") - 1, F.col("below"))
    star = F.when(F.col("node") != F.col("low"), F.col("low")).otherwise(down)
    return chained.select(F.col("node").alias("a"), star.alias("b")).where("b is not null")


def _tasks(members: DataFrame, num: int, den: int, block: int) -> DataFrame:
    """(node, task, side): clusters of at most ``block`` members are one task; larger ones are cut by size band and hash.

    Two members in the same or in neighbouring bands meet in at least one task,
    and no task has more than about two blocks. A band of s blocks sends each
    member to s tasks of its own band and to as many as the neighbours have
    blocks. A side is a block of a band, or 0 in the task that a block or a whole
    cluster has to itself.
    """
    size = members.groupBy("cluster").agg(F.count("*").alias("size"))
    joined = members.join(size, "cluster")
    small = joined.where(F.col("size") <= block).select("node", F.xxhash64("cluster").alias("task"), F.lit(0).cast("long").alias("side"))
    big = joined.where(F.col("size") > block).select("node", "cluster", size_band(num, den).alias("band"))
    blocks = big.groupBy("cluster", "band").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    above = blocks.select("cluster", (F.col("band") - 1).alias("band"), F.col("blocks").alias("above"))
    below = blocks.select("cluster", (F.col("band") + 1).alias("band"), F.col("blocks").alias("below"))
    plan = blocks.join(above, ["cluster", "band"], "left").join(below, ["cluster", "band"], "left")
    placed = big.join(plan, ["cluster", "band"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    key = lambda low, i, j, kind: F.xxhash64("cluster", low, i, j, F.lit(kind))
    side = F.xxhash64("band", "block")
    place = lambda task, own: F.struct(task.alias("task"), F.when(own, 0).otherwise(side).alias("side"))
    none = F.array().cast("array<struct<task: bigint, side: bigint>>")
    own = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: place(key(F.col("band"), F.least("block", o), F.greatest("block", o), 0), o == F.col("block")))
    up = F.when(F.col("above").isNotNull(), F.transform(F.sequence(F.lit(0), F.coalesce("above", F.lit(1)) - 1), lambda o: place(key(F.col("band"), F.col("block"), o, 1), F.lit(False)))).otherwise(none)
    down = F.when(F.col("below").isNotNull(), F.transform(F.sequence(F.lit(0), F.coalesce("below", F.lit(1)) - 1), lambda o: place(key(F.col("band") - 1, o, F.col("block"), 1), F.lit(False)))).otherwise(none)
    large = placed.select("node", F.explode(F.concat(own, up, down)).alias("t")).select("node", "t.task", "t.side")
    return small.unionAll(large)


def ngram_jaccard_components(spark: SparkSession, docs: DataFrame, k: int = 4, threshold: str = "0.85", frequent_times: int = 4) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text string; other columns are ignored).

    Columns: doc_id; n_shingles, the size of its set of k-word shingles (A-Z
    lower-cased; fewer words: the whole sequence is one shingle; none: empty);
    component_id, the smallest doc_id reachable by links of Jaccard similarity
    >= threshold, the document itself included; n_links, the number of other
    documents that it links with; set_id, equal for equal sets; group_id, equal for
    sets of one component; row, a hash of the row's id and text. The last three are
    null for empty sets, but for row.

    A null or empty text has 0 shingles and links with nothing. Rows that share
    a doc_id are one document: their sets are in one component (n_links counts
    it once for each of its sets). A row with a null doc_id takes part with its
    text; its component_id is null if no row with an id is reachable. An empty
    table gives an empty result.
    """
    num, den = Fraction(threshold).as_integer_ratio()
    scratch = Scratch(spark, "ngram-join")
    docs = docs.select(row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = frequency_table(docs, k)
    frequent = frequent_class(counts, frequent_times)
    table = spark.sparkContext.broadcast(counts)
    del counts
    schema = "row long, doc_id long, n long, k1 long, k2 long, sigs array<long>, bins binary"
    described = scratch.write(docs.mapInArrow(_describe(k, num, den, table, frequent), schema), "described")
    table.destroy()

    # a class is a set of shingles with all rows that have it; its node is k1
    rows = described.select("row", "doc_id", "n", "k1", "k2")
    per_id = rows.where("n > 0").groupBy("k1", "k2", "n", "doc_id").agg(F.when(F.col("doc_id").isNull(), F.count("*")).otherwise(1).alias("documents"), F.count("*").alias("copies"))
    sized = per_id.groupBy("k1", "k2", "n").agg(F.sum("documents").alias("documents"), F.sum("copies").alias("copies"), F.min("doc_id").alias("lowest"))
    shown = described.where("n > 0").groupBy("k1", "k2", "n").agg(F.min("row").alias("row"), F.first("sigs").alias("sigs"), F.first("bins").alias("bins"))
    classes = scratch.write(shown.join(sized, ["k1", "k2", "n"]).withColumnRenamed("k1", "node"), "classes")
    # a doc_id with several sets ties their classes together
    tied = rows.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("k1").alias("low"), F.max("k1").alias("high")).where("low <> high").select("doc_id", "low")
    tied = rows.where("n > 0").join(tied, "doc_id").where("k1 <> low").select(F.col("k1").alias("a"), F.col("low").alias("b"))

    clusters = components(signature_stars(classes, num, den), scratch)

    members = scratch.write(classes.join(clusters.withColumnRenamed("label", "cluster"), "node").select("node", "n", "cluster", "bins"), "candidates")
    possible = _tasks(members.select("node", "n", "cluster"), num, den, HISTOGRAM_BLOCK).join(members.select("node", "n", "bins"), "node").select("task", "node", "n", "bins")
    possible = components(possible.repartition("task").sortWithinPartitions("task").mapInArrow(_possible(num, den), "a long, b long"), scratch)
    scratch.drop(members)
    members = scratch.write(classes.join(possible.withColumnRenamed("label", "cluster"), "node").select("node", "n", "cluster", "row", "documents"), "members")
    tasks = _tasks(members.select("node", "n", "cluster"), num, den, BLOCK)

    # texts of the members only, one a class; they move by row, and then to their tasks
    wanted = members.select("row", "node", "documents").join(tasks.groupBy("node").agg(F.collect_list(F.struct("task", "side")).alias("tasks")), "node")
    texts = some_rows(docs.select("row", "text"), members.select("row"), "row").dropDuplicates(["row"]).join(wanted, "row")
    ready = texts.select("node", "documents", "text", F.explode("tasks").alias("t")).select("t.task", "node", "t.side", "documents", "text")
    links = scratch.write(ready.repartition("task").sortWithinPartitions("task").mapInArrow(_compare(k, num, den), _LINKS), "links")
    labels = components(links.where("b is not null").select("a", "b").unionAll(tied), scratch)

    degree = links.where("links is not null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
    joined = classes.select("node", "k2", "n", "documents", "copies", "lowest").join(labels, "node", "left").join(degree, "node", "left")
    joined = scratch.write(joined.select("node", "k2", "n", "copies", "lowest", "label", (F.coalesce("links", F.lit(0)) + F.col("documents") - 1).alias("n_links")), "joined")
    scratch.finish(described, joined)
    least = joined.where("label is not null").groupBy("label").agg(F.min("lowest").alias("component"))
    known = joined.where("copies > 1 or label is not null").join(least, "label", "left").select(F.col("node").alias("k1"), "k2", "n", F.coalesce("component", "lowest").alias("component"), "label", "n_links", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(8)).cast("int"))
    out = salted.join(known, ["k1", "k2", "n", "salt"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n") > 0, F.col("k1")).alias("set_id"), F.when(F.col("n") > 0, F.coalesce("label", "k1")).alias("group_id"), "row")


def one_of_each_group(spark: SparkSession, docs: DataFrame, k: int = 5, threshold: str = "0.8") -> DataFrame:
    """The rows of ``docs``, with their columns whatever their names, but of each group of near duplicates the one with the smallest doc_id.

    Ids that are null come last, ties go by a hash of id and text, and of rows
    equal in both one stays. Texts without words are no duplicates of anything.
    """
    scratch = Scratch(spark, "near-duplicates")
    found = scratch.write(ngram_jaccard_components(spark, docs, k, threshold).where("group_id is not null").select("doc_id", "group_id", "row"), "found")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("row"))
    kept = scratch.write(found.groupBy("group_id").agg(F.min(order).alias("first"), F.count("*").alias("rows")).where("rows > 1").select("group_id", F.col("first.row").alias("kept")), "kept")
    gone = scratch.write(found.join(kept, "group_id").where("row <> kept").select("row").distinct(), "gone")
    repeated = found.groupBy("row").agg(F.count("*").alias("rows")).where("rows > 1").select("row")
    repeated = scratch.write(repeated.join(gone, "row", "left_anti"), "repeated")
    scratch.finish(gone, repeated)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    left = other_rows(docs.withColumn("_nx_row", row_key()), gone, "_nx_row")
    once = some_rows(left, repeated, "_nx_row").join(repeated.withColumnRenamed("row", "_nx_kept"), F.col("_nx_row") == F.col("_nx_kept")).dropDuplicates(["_nx_row"])
    return other_rows(left, repeated, "_nx_row").select(*columns).unionByName(once.select(*columns))
