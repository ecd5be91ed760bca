"""Removal of passages that an earlier document already has, behind a count-min prefilter.

The corpus is dealt into chunks of documents by a hash of the id. Three passes over the chunks
read one shuffled copy of the texts:

1. Every chunk counts its word windows in a count-min sketch. The sketch is as wide as the
   corpus is long, so a chunk's counters are almost all zero and only the others travel, as
   gaps of a sorted list, cut into blocks of the sketch. A block is merged over all chunks and
   tells each chunk which of its counters reach two documents.
2. A window all of whose counters reach two is estimated repeated: the estimate is never too
   low. Exactly these windows are grouped, by a 96-bit print of the word sequence and with the
   smallest id of the chunk, so a window that half of all documents share is one entry per
   chunk. The merged groups tell each chunk which windows start in a smaller document.
3. Words covered by such windows, or by windows that a smaller document of the same chunk has,
   are removed.

Chunks and blocks both hold about the square root of the windows of the corpus (times 16), so
neither their size nor the number of rows between them gets out of hand as the corpus grows.
A document that is a copy of a smaller one takes no part: all its windows are known to be
there.
"""

from __future__ import annotations

import hashlib
import math
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.llm import words
from hazardlake.session import cut_lineage

U = np.uint64
LAST = (1 << 63) - 1  # stands for a null id: no id is greater
GAP = 0xFFFF  # "add this and go on" in a list of gaps


def _gaps(cells: np.ndarray, base: int) -> bytes:
    """Sorted distinct cells from ``base`` as 16-bit gaps."""
    gap = np.diff(cells, prepend=U(base)).astype(np.int64)
    extra = gap // GAP
    out = np.full(len(gap) + int(extra.sum()), GAP, np.uint16)
    out[np.cumsum(extra + 1) - 1] = gap - extra * GAP
    return out.tobytes()


def _cells(raw: bytes, base: int) -> np.ndarray:
    gap = np.frombuffer(raw, np.uint16)
    return (np.cumsum(gap, dtype=np.uint64) + U(base))[gap != GAP]


class Plan:
    """Sizes that follow from the number of windows of the corpus."""

    def __init__(self, n_windows: int, k: int, depth: int, width_factor: int):
        self.k, self.depth = k, depth
        per_chunk = max(1 << 12, 16 * math.isqrt(max(1, n_windows)))
        self.chunks = max(1, -(-n_windows // per_chunk))
        self.blocks = self.chunks
        # Cells of one row of the sketch that belong to a block.
        self.span = max(1, width_factor * max(1, n_windows) // self.blocks)

    def cells(self, w1: np.ndarray) -> np.ndarray:
        """(depth, windows): block * (depth * span) + row * span + place, one cell per row."""
        out = np.empty((self.depth, len(w1)), U)
        for r in range(self.depth):
            h = words.mix(w1 + U(0x632BE59BD9B4E019) * U(r + 1))
            out[r] = (h % U(self.blocks)) * U(self.depth * self.span) + U(r * self.span) + (
                h >> U(20)) % U(self.span)
        return out


class _Chunk:
    """Documents of a chunk that take part, their words and windows."""

    def __init__(self, docs: pa.Table, copies: pa.Table, plan: Plan, prints: bool):
        self.ids = np.array([LAST if x is None else x for x in docs.column("doc_id").to_pylist()], np.int64)
        sha = dict(zip(copies.column("block").to_pylist(), copies.column("data").to_pylist()))
        texts = [t.as_py() or "" for t in docs.column("text")]
        raw = [t.encode() for t in texts]
        self.copy = np.array([i in sha and hashlib.sha256(r).digest() == sha[i]
                              for i, r in zip(self.ids.tolist(), raw)], bool)
        self.raw, w1, w2, doc, first, self.base = raw, [], [], [], [], np.zeros(len(raw), np.int64)
        self.words = np.zeros(len(raw), np.int64)
        done = lo = 0
        while lo < len(raw):
            hi, size = lo, 0
            while hi < len(raw) and (hi == lo or size + len(raw[hi]) <= words.SLICE_BYTES):
                size += len(raw[hi])
                hi += 1
            offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw[lo:hi]])])
            data = np.frombuffer(b"".join(raw[lo:hi]), np.uint8)
            start, end, d = words.bounds(data, offsets, words.SPACE_FREE)
            self.words[lo:hi] = words.counts(d, hi - lo)
            value, at = words.windows(words.hashes(data, start, end), d, plan.k)
            use = ~self.copy[lo + d[at]]
            w1.append(value[use])
            doc.append(lo + d[at][use])
            first.append(done + at[use])
            if prints:
                value, _ = words.windows(words.hashes(data, start, end, seed=1), d, plan.k, 1)
                w2.append((value[use] >> U(32)).astype(np.uint32))
            done += len(d)
            lo = hi
        join = lambda x, t: np.concatenate(x) if x else np.zeros(0, t)
        self.w1, self.doc, self.first = join(w1, U), join(doc, np.int64), join(first, np.int64)
        self.w2 = join(w2, np.uint32)

    def grouped(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order of the chosen windows by print, first of each group in it, smallest id per group."""
        order = which[np.lexsort((self.w2[which], self.w1[which]))]
        a, b = self.w1[order], self.w2[order]
        head = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else order
        return order, head, np.minimum.reduceat(self.ids[self.doc[order]], head) if len(a) else order


_ROW = pa.schema([("block", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary()), ("more", pa.binary())])
_ROWS = "block long, chunk long, data binary, more binary"


def _rows(block: list[int], chunk: list[int], data: list[bytes], more: list[bytes]) -> pa.Table:
    return pa.table([pa.array(block, pa.int64()), pa.array(chunk, pa.int64()), pa.array(data, pa.binary()),
                     pa.array(more, pa.binary())], schema=_ROW)


def _kind(rows: pa.Table, copies: bool) -> pa.Table:
    """Rows about copies have an empty second value, all others a longer one."""
    keep = np.array([(not m) == copies for m in rows.column("more").to_pylist()], bool)
    return rows.filter(pa.array(keep, pa.bool_()))


def _blocks(key: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, from, to) of the runs of a sorted array."""
    if not len(key):
        return []
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
    return [(int(key[a]), int(a), int(b)) for a, b in zip(at[:-1], at[1:])]


def repeated_passages(docs: DataFrame, k: int = 13, depth: int = 2, width_factor: int = 8) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row of ``docs`` (doc_id, text).

    Words are runs of anything but ASCII white space, unchanged. A word is removed if a window
    of ``k`` consecutive words that covers it also starts in a row with a smaller doc_id;
    windows are taken from the texts as given. ``kept`` joins the other words by one space. A
    null or blank text has no words and an empty ``kept``; a text of fewer than ``k`` words has
    no window. Rows that share an id do not remove each other's words, and a null id is greater
    than any other. An empty table gives no rows; other columns are not looked at.

    ``depth`` and ``width_factor`` set the sketch: rows, and counters of a row per window.
    """
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text")
    prints = cut_lineage(texts.select("doc_id", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("sha")),
                         "prints")
    total = prints.agg(F.sum(F.col("bytes").cast("long"))).first()[0] or 0
    plan = Plan(total // 6 + 1, k, depth, width_factor)
    chunk = F.pmod(F.xxhash64("doc_id"), F.lit(plan.chunks)).cast("long").alias("chunk")
    dealt = texts.select(chunk, "doc_id", "text").groupBy("chunk")
    firsts = cut_lineage(prints.groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                         .filter("first < last"), "firsts")
    copies = (prints.join(firsts, "sha").filter("doc_id > first")
              .select(F.col("doc_id").alias("block"), chunk, F.unhex("sha").alias("data"),
                      F.lit("").cast("binary").alias("more")))

    def count(left: pa.Table, right: pa.Table) -> pa.Table:
        """Pass 1: nonzero counters by block, and which of them two documents share already."""
        if not len(left):
            return _ROW.empty_table()
        own = _Chunk(left, right, plan, prints=False)
        cells = plan.cells(own.w1).ravel()
        order = np.argsort(cells, kind="stable")
        cells, doc = cells[order], np.tile(own.doc, depth)[order]
        head = np.concatenate([[True], cells[1:] != cells[:-1]]) if len(cells) else np.zeros(0, bool)
        at = np.flatnonzero(head)
        twice = np.zeros(len(at), bool)
        if len(at):
            twice = np.minimum.reduceat(doc, at) < np.maximum.reduceat(doc, at)
        cells, size = cells[at], depth * plan.span
        runs = _blocks(cells // U(size))
        name = left.column("chunk")[0].as_py()
        return _rows([b for b, _, _ in runs], [name] * len(runs), [_gaps(cells[x:y], b * size) for b, x, y in runs],
                     [np.packbits(twice[x:y]).tobytes() for _, x, y in runs])

    def merge(rows: pa.Table) -> pa.Table:
        """One block of the sketch over all chunks: each chunk's counters of two or more."""
        block, size = rows.column("block")[0].as_py(), depth * plan.span
        lists = [_cells(x, block * size) for x in rows.column("data").to_pylist()]
        twice = [np.unpackbits(np.frombuffer(m, np.uint8), count=len(c)).astype(bool)
                 for m, c in zip(rows.column("more").to_pylist(), lists)]
        value, inverse, times = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
        full = times > 1
        full[inverse[np.concatenate(twice)]] = True
        ends = np.cumsum([len(c) for c in lists])
        hit = full[inverse]
        out = [(n, c[hit[e - len(c): e]]) for n, c, e in zip(rows.column("chunk").to_pylist(), lists, ends)]
        out = [(n, c) for n, c in out if len(c)]
        return _rows([block] * len(out), [n for n, _ in out], [_gaps(c, block * size) for _, c in out], [b"s"] * len(out))

    def estimated(left: pa.Table, right: pa.Table) -> pa.Table:
        """Pass 2: prints and smallest id of the windows whose counters all reach two."""
        if not len(left):
            return _ROW.empty_table()
        sketch, size = _kind(right, False), depth * plan.span
        lists = [_cells(x, b * size) for b, x in zip(sketch.column("block").to_pylist(), sketch.column("data").to_pylist())]
        if not lists:
            return _ROW.empty_table()
        own = _Chunk(left, _kind(right, True), plan, prints=True)
        full = np.sort(np.concatenate(lists))
        hit = np.ones(len(own.w1), bool)
        for row in plan.cells(own.w1):
            hit &= full[np.minimum(np.searchsorted(full, row), len(full) - 1)] == row
        order, head, low = own.grouped(np.flatnonzero(hit))
        a, b = own.w1[order[head]], own.w2[order[head]]
        block = a % U(plan.blocks)
        by = np.argsort(block, kind="stable")
        a, b, low, runs = a[by], b[by], low[by], _blocks(block[by])
        name = left.column("chunk")[0].as_py()

        def packed(x: int, y: int) -> bytes:
            least = low[x:y].min()
            gap = low[x:y] - least
            gap = gap.astype(np.uint32) if gap.max() < 1 << 32 else gap
            return least.tobytes() + gap.tobytes()

        return _rows([n for n, _, _ in runs], [name] * len(runs),
                     [a[x:y].tobytes() + b[x:y].tobytes() for _, x, y in runs], [packed(x, y) for _, x, y in runs])

    def group(rows: pa.Table) -> pa.Table:
        """The exact groups of a block: each chunk's windows that a smaller id starts elsewhere."""
        a, b, low, size = [], [], [], []
        for data, more in zip(rows.column("data").to_pylist(), rows.column("more").to_pylist()):
            n = len(data) // 12
            a.append(np.frombuffer(data, U, n))
            b.append(np.frombuffer(data, np.uint32, n, 8 * n))
            gap = np.frombuffer(more, np.uint32 if len(more) == 8 + 4 * n else np.int64, n, 8)
            low.append(np.frombuffer(more, np.int64, 1) + gap.astype(np.int64))
            size.append(n)
        a, b, low = np.concatenate(a), np.concatenate(b), np.concatenate(low)
        order = np.lexsort((b, a))
        sa, sb = a[order], b[order]
        head = np.concatenate([[True], (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])])
        least = np.minimum.reduceat(low[order], np.flatnonzero(head))
        known = np.empty(len(a), bool)
        known[order] = least[np.cumsum(head) - 1] < low[order]
        ends, out = np.cumsum(size), []
        for name, n, e in zip(rows.column("chunk").to_pylist(), size, ends):
            x = np.flatnonzero(known[e - n: e]) + e - n
            if len(x):
                out.append((name, a[x].tobytes() + b[x].tobytes()))
        block = rows.column("block")[0].as_py()
        return _rows([block] * len(out), [n for n, _ in out], [d for _, d in out], [b"g"] * len(out))

    def remove(left: pa.Table, right: pa.Table) -> pa.Table:
        """Pass 3: what is left of every document."""
        if not len(left):
            return _KEPT.empty_table()
        own = _Chunk(left, _kind(right, True), plan, prints=True)
        known = [np.frombuffer(d, U, len(d) // 12) for d in _kind(right, False).column("data").to_pylist()]
        more = [np.frombuffer(d, np.uint32, len(d) // 12, 8 * (len(d) // 12))
                for d in _kind(right, False).column("data").to_pylist()]
        order, head, low = own.grouped(np.arange(len(own.w1)))
        gone = np.zeros(len(own.w1), bool)
        if len(order):
            sizes = np.diff(np.append(head, len(order)))
            gone[order] = np.repeat(low, sizes) < own.ids[own.doc[order]]
        if known:
            pair = np.dtype([("a", "<u8"), ("b", "<u4")])
            have = np.empty(len(head), pair)
            have["a"], have["b"] = own.w1[order[head]], own.w2[order[head]]
            want = np.empty(sum(map(len, known)), pair)
            want["a"], want["b"] = np.concatenate(known), np.concatenate(more)
            there = _member(have, want)
            gone[order] |= np.repeat(there, sizes)
        base = np.cumsum(own.words) - own.words
        cover = np.zeros(int(own.words.sum()) + 1, np.int32)
        np.add.at(cover, own.first[gone], 1)
        np.add.at(cover, own.first[gone] + k, -1)
        covered = np.cumsum(cover)[:-1] > 0
        kept, removed = [], np.zeros(len(own.ids), np.int64)
        for i, raw in enumerate(own.raw):
            if own.copy[i] and own.words[i] >= k:
                removed[i] = own.words[i]
                kept.append(b"")
                continue
            mine = covered[base[i]: base[i] + own.words[i]]
            removed[i] = int(mine.sum())
            kept.append(b" ".join(compress(raw.split(), ~mine) if removed[i] else raw.split()))
        return pa.table([left.column("doc_id"), pa.array(own.words), pa.array(removed),
                         pa.array(kept, pa.binary()).cast(pa.string())], schema=_KEPT)

    sketch = dealt.cogroup(copies.groupBy("chunk")).applyInArrow(count, _ROWS)
    full = sketch.groupBy("block").applyInArrow(merge, _ROWS)
    entries = dealt.cogroup(full.union(copies).groupBy("chunk")).applyInArrow(estimated, _ROWS)
    known = entries.groupBy("block").applyInArrow(group, _ROWS)
    out = dealt.cogroup(known.union(copies).groupBy("chunk")).applyInArrow(
        remove, "doc_id long, n_words long, n_removed long, kept string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(LAST)))


_KEPT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])


def _member(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Which of ``have`` (sorted by a, b) are in ``want``."""
    want = want[np.lexsort((want["b"], want["a"]))]
    out = np.zeros(len(have), bool)
    lo = np.searchsorted(want["a"], have["a"], "left")
    hi = np.searchsorted(want["a"], have["a"], "right")
    single = (hi - lo) == 1
    out[single] = want["b"][lo[single]] == have["b"][single]
    for i in np.flatnonzero(hi - lo > 1):
        out[i] = have["b"][i] in want["b"][lo[i]: hi[i]]
    return out
