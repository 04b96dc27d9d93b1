"""Induced suffix sorting with common-prefix values, in disk-backed bucket queues.

The suffixes that start a left-most smaller run (LMS) are sorted first: their
substrings get names by their bytes, and the string of names is sorted by prefix
doubling. The order of all other suffixes is induced: the queue of a character
gives out its suffixes in order, and each puts the suffix one place to its left
into the queue of the character there - larger characters first left to right
(L suffixes), then smaller ones right to left (S suffixes). A queue entry is the
suffix and its common prefix with the entry before it: one more than the least
common prefix between the two suffixes that put them there. Entries come and go
in whole blocks; a queue beyond the memory budget is in a file.

Common prefixes are cut off at CAP.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

from netexp.llm.textkit import Prefix

END, GAP, SHIFT = 0, 1, 2  # bytes are stored + SHIFT; 0xFF is no byte of UTF-8, so it all fits


class BucketQueues:
    """First-in first-out queues of (suffix, common prefix) blocks, one a character, with one budget of memory."""

    def __init__(self, budget: int):
        self.budget, self.held = budget, 0
        self.blocks: list[list] = [[] for _ in range(256)]
        self.file = None

    def put(self, c: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        size = pos.nbytes + lcp.nbytes
        if self.held + size > self.budget and len(pos) > 1024:
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=os.environ.get("TMPDIR"))
            self.file.seek(0, 2)
            at = self.file.tell()
            self.file.write(pos.tobytes())
            self.file.write(lcp.tobytes())
            self.blocks[c].append((at, len(pos), lcp[0]))
        else:
            self.held += size
            self.blocks[c].append((pos, lcp))

    def get(self, c: int) -> list:
        """The blocks of a queue in order; the queue is empty then."""
        out, self.blocks[c] = [self._read(b) for b in self.blocks[c]], []
        return out

    def _read(self, block):
        if len(block) == 2:
            self.held -= block[0].nbytes + block[1].nbytes
            return block
        at, n, _ = block
        self.file.seek(at)
        return np.frombuffer(self.file.read(4 * n), np.int32), np.frombuffer(self.file.read(2 * n), np.uint16)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class RangeMin:
    """Least value of any range of an array, by doubling tables."""

    def __init__(self, values: np.ndarray):
        self.rows, width = [values], 1
        while 2 * width <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[: len(last) - width], last[width:]))
            width *= 2

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Over [a, b), a < b."""
        n = b - a
        level = np.frexp(n.astype(np.float64))[1] - 1
        out = np.empty(len(a), dtype=self.rows[0].dtype)
        for k in np.unique(level):
            pick = np.flatnonzero(level == k)
            row = self.rows[k]
            out[pick] = np.minimum(row[a[pick]], row[b[pick] - (1 << int(k))])
        return out


def _words(text: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as a big-endian number; after ``left`` bytes 0xFF."""
    out = np.zeros(len(at), dtype=np.uint64)
    n = len(text)
    for j in range(8):
        byte = np.where(left > j, text[np.minimum(at + j, n - 1)], np.uint8(255))
        out = (out << np.uint64(8)) | byte.astype(np.uint64)
    return out


def sort_lms(text: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The LMS suffixes in order. ``lms`` ascends and ends with the end mark."""
    m = len(lms)
    length = np.append(lms[1:] - lms[:-1] + 1, 1)
    # names: by the bytes up to the next LMS suffix; where one is a prefix of the other the shorter is the larger
    rank, open_, depth = np.zeros(m, np.int64), np.arange(m), 0
    while len(open_):
        key = _words(text, lms[open_] + depth, length[open_] - depth)
        order = np.lexsort((key, rank[open_]))
        idx = open_[order]
        k, r = key[order], rank[idx]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])))
        group = np.concatenate(([True], r[1:] != r[:-1]))
        place = np.arange(len(idx))
        offset = np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        rank[idx] = r + offset
        size = np.diff(np.append(np.flatnonzero(new), len(idx)))
        depth += 8
        longest = np.maximum.reduceat(length[idx], np.flatnonzero(new))
        again = np.repeat((size > 1) & (longest > depth), size)
        open_ = idx[again]
    # suffixes of the names by prefix doubling of those that are still equal
    order = np.argsort(rank, kind="stable")
    step = 1
    r = rank[order]
    new = np.concatenate(([True], r[1:] != r[:-1]))
    size = np.diff(np.append(np.flatnonzero(new), m))
    open_ = order[np.repeat(size > 1, size)]
    while len(open_):
        nxt = open_ + step
        key = np.where(nxt < m, rank[np.minimum(nxt, m - 1)], -1)
        o = np.lexsort((key, rank[open_]))
        idx = open_[o]
        k, r = key[o], rank[idx]
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (r[1:] != r[:-1])))
        group = np.concatenate(([True], r[1:] != r[:-1]))
        place = np.arange(len(idx))
        fresh = r + np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        rank[idx] = fresh
        size = np.diff(np.append(np.flatnonzero(new), len(idx)))
        open_ = idx[np.repeat(size > 1, size)]
        step *= 2
    out = np.empty(m, np.int64)
    out[rank] = lms
    return out


def common_prefix(prefix: Prefix, n: int, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Length of the common prefix of suffixes a and b, cut off at cap, by bisection on hashes."""
    low = np.zeros(len(a), np.int64)
    high = np.minimum(cap, n - np.maximum(a, b))
    while True:
        go = np.flatnonzero(low < high)
        if not len(go):
            return low
        mid = (low[go] + high[go] + 1) // 2
        x, y = a[go], b[go]
        same = prefix.hashes(x, x + mid) == prefix.hashes(y, y + mid)
        low[go] = np.where(same, mid, low[go])
        high[go] = np.where(same, high[go], mid - 1)


def suffix_order(raw: np.ndarray, gaps: np.ndarray, cap: int, budget: int = 1 << 28):
    """Blocks (suffixes, common prefix with the suffix before) of all suffixes of ``raw``, in order.

    ``raw`` are bytes; at ``gaps`` (places in raw) stands a mark that is less
    than any byte. The first block holds the end mark, place len(raw).
    """
    n = len(raw) + 1
    text = np.empty(n, dtype=np.uint8)
    text[:-1] = raw + np.uint8(SHIFT)
    text[gaps] = GAP
    text[-1] = END
    change = np.flatnonzero(text[1:] != text[:-1])  # last place of each run but the last
    run_end = np.append(change, n - 1)
    rises = np.append(text[change + 1] > text[change], True)
    small = np.repeat(rises, np.diff(np.concatenate(([-1], run_end))))  # S suffixes
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    ordered = sort_lms(text, lms)
    prefix = Prefix(text)
    seeds = np.concatenate(([0], common_prefix(prefix, n, ordered[:-1], ordered[1:], cap)))
    del prefix

    def run_length(p: int) -> int:
        return int(run_end[np.searchsorted(run_end, p)]) - int(p) + 1

    queues = BucketQueues(budget)
    firsts = text[ordered]
    seed_at = np.searchsorted(firsts, np.arange(257))

    def induce(pos, lcp, c, carry, left: bool, last):
        """Put the suffixes before ``pos`` into their queues; returns the block that stays in queue c."""
        prev = pos - 1
        ok = np.flatnonzero(pos > 0)
        prev = prev[ok]
        kind = small[prev]
        keep = ~kind if left else kind
        ok, prev = ok[keep], prev[keep]
        stay = None
        least = int(lcp.min()) if len(lcp) else cap
        if len(ok):
            to = text[prev]
            order = np.argsort(to, kind="stable")
            ok, prev, to = ok[order], prev[order], to[order]
            fresh = np.concatenate(([True], to[1:] != to[:-1]))
            value = np.empty(len(ok), np.int64)
            table = RangeMin(lcp)
            inner = np.flatnonzero(~fresh)
            value[inner] = table(ok[inner - 1] + 1, ok[inner] + 1)
            heads = np.flatnonzero(fresh)
            value[heads] = np.minimum(carry[to[heads]], table(np.zeros(len(heads), np.int64), ok[heads] + 1))
            tails = np.append(heads[1:], len(ok)) - 1
            value = np.minimum(value + 1, cap).astype(np.uint16)
            np.minimum(carry, least, out=carry)
            after = np.full(len(tails), cap, np.int64)
            more = np.flatnonzero(ok[tails] + 1 < len(lcp))
            after[more] = table(ok[tails[more]] + 1, np.full(len(more), len(lcp)))
            carry[to[tails]] = after
            prev = prev.astype(np.int32)
            for h, t in zip(heads.tolist(), tails.tolist(), strict=True):
                b = int(to[h])
                p, v = prev[h : t + 1], value[h : t + 1]
                if last[b] < 0:
                    v[0] = 0
                last[b] = p[-1]
                if b == c:
                    stay = (p, v)
                else:
                    queues.put(b, p.copy(), v.copy())
        else:
            np.minimum(carry, least, out=carry)
        return stay

    done_l: list = [None] * 256
    keepers = BucketQueues(budget)
    last = np.full(256, -1, np.int64)
    present = np.unique(text)
    for c in present.tolist():
        carry = np.zeros(256, np.int64)
        pending, kept = queues.get(c), False
        while pending:
            pos, lcp = pending.pop(0)
            keepers.put(c, pos, lcp)
            kept = True
            stay = induce(pos, lcp, c, carry, True, last)
            if stay is not None:
                pending.append(stay)
        a, b = seed_at[c], seed_at[c + 1]
        if b > a:
            pos = ordered[a:b].astype(np.int32)
            lcp = seeds[a:b].astype(np.uint16)
            lcp[0] = min(cap, run_length(last[c]), run_length(pos[0])) if kept else 0
            induce(pos, lcp, c, carry, True, last)
    del ordered, seeds, done_l
    last_l = last
    last = np.full(256, -1, np.int64)
    out = BucketQueues(budget)
    for c in present[::-1].tolist():
        carry = np.zeros(256, np.int64)
        pending, some = queues.get(c), False
        if c == END:
            pending = [(np.array([n - 1], np.int32), np.zeros(1, np.uint16))]
        while pending:
            pos, lcp = pending.pop(0)
            out.put(c, pos, lcp)
            some = True
            stay = induce(pos, lcp, c, carry, False, last) if c != END else None
            if stay is not None:
                pending.append(stay)
        blocks = keepers.get(c)
        if blocks:
            pos, lcp = np.concatenate([b[0] for b in blocks]), np.concatenate([b[1] for b in blocks])
            down = np.empty_like(lcp)
            down[1:] = lcp[:0:-1]
            down[0] = min(cap, run_length(pos[-1]), run_length(last[c])) if some else 0
            out.put(c, pos[::-1].copy(), down)
            stay = induce(pos[::-1], down, c, carry, False, last)
            assert stay is None
    for c in present.tolist():
        blocks = out.get(c)
        pos = np.concatenate([b[0] for b in blocks])[::-1]
        lcp = np.concatenate([b[1] for b in blocks])
        up = np.zeros_like(lcp)
        up[1:] = lcp[:0:-1]
        yield pos, up
    for q in (queues, keepers, out):
        q.close()
