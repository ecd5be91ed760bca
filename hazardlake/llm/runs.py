"""Periodic runs of words, by a dictionary of basic factors.

The dictionary gives equal stretches of 2^k words of a text the same name, for every k; names of
level k + 1 are ranks of the pairs of names of level k. A stretch that comes once in its text
has no name, so in common texts a few levels and few places are left.

A run of period q has, with 2^k <= q < 2^(k+1), a named stretch at its start that comes again q
words later, less than twice its own length away. Successive places of a name that are at most
half its length apart are an arithmetic progression: inside it the run has the short period,
which a lower level finds. So a place needs only be held against the first member of the later
progressions within twice the length, and the last place of a progression against their last
members: a run whose start lies inside one short period is found by one of the two (by their
starts if the short period holds up to or over the first period's end, by their ends if it
breaks before). Each distance is a proposed period. It is extended to both sides by the names,
halving the step, and kept if the run holds it twice; what is found several times, or with a
multiple of its period, is one stretch and keeps the smallest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake.functions.let import let
from hazardlake.llm import words

LEAST = 12


def _names(a: np.ndarray, b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ``at`` in the order of their pair of values, and the start of each pair that
    comes at least twice; places of the others are left out."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    head = np.ones(len(order), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    alone = head.copy()
    alone[:-1] &= head[1:]
    return at[order[~alone]], head[~alone]


class Factors:
    """Names of the stretches of 1, 2, 4, … words of several texts, and the periods they propose."""

    def __init__(self, word: np.ndarray, doc: np.ndarray):
        self.word, self.doc, self.n = word, doc, len(word)
        self.levels: list[np.ndarray] = []
        self.proposed: list[tuple[np.ndarray, np.ndarray]] = []
        at = np.arange(self.n)
        spot, head = _names(doc, word.view(np.int64), at)
        while len(spot):
            length = 1 << len(self.levels)
            name = np.full(self.n, -1, np.int32)
            name[spot] = np.cumsum(head) - 1
            self.levels.append(name)
            self._propose(spot, head, length)
            left = np.sort(spot)
            left = left[left + length < self.n]
            left = left[(name[left + length] >= 0) & (doc[left] == doc[np.minimum(left + length, self.n - 1)])]
            spot, head = _names(name[left], name[left + length], left)

    def _propose(self, spot: np.ndarray, head: np.ndarray, length: int) -> None:
        """Pairs (place, distance) with ``length`` <= distance < 2 * ``length``."""
        n = len(spot)
        far = np.ones(n + 1, bool)  # is the first of a progression
        far[1:n] = head[1:] | (2 * (spot[1:] - spot[:-1]) > length)
        firsts = np.flatnonzero(far)  # the last is the end
        chain = np.cumsum(far[:n]) - 1
        group = np.cumsum(head) - 1
        last = np.zeros(n, bool)
        last[firsts[1:] - 1] = True
        place = np.arange(n)
        for step in range(1, 5):  # progressions lie more than half the length apart
            place = place[chain[place] + step < len(firsts) - 1]
            to = chain[place] + step
            place, to = (x[group[firsts[to]] == group[place]] for x in (place, to))
            gap = spot[firsts[to]] - spot[place]
            near = gap < 2 * length
            place, to, gap = place[near], to[near], gap[near]
            fit = gap >= length
            i, d = spot[place[fit]], gap[fit]
            start = (i == 0) | (self.doc[i] != self.doc[i - 1]) | (self.word[i - 1] != self.word[i + d - 1])
            self.proposed.append((i[start], d[start]))
            end = last[place]
            gap = spot[firsts[to[end] + 1] - 1] - spot[place[end]]
            fit = (gap >= length) & (gap < 2 * length)
            self.proposed.append((spot[place[end]][fit], gap[fit]))

    def _alike(self, i: np.ndarray, j: np.ndarray, forward: bool) -> np.ndarray:
        """Words that agree from ``i`` and ``j`` on, or before them."""
        n = np.zeros(len(i), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            name, step = self.levels[k], 1 << k
            a, b = (i + n, j + n) if forward else (i - n - step, j - n - step)
            inside = (a >= 0) & (b < self.n)
            a, b = np.where(inside, a, 0), np.where(inside, b, 0)
            n += step * (inside & (name[a] >= 0) & (name[a] == name[b]))
        return n

    def runs(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and period of all runs of at least ``least`` words, by start and period."""
        if not self.proposed:
            return (np.zeros(0, np.int64),) * 3
        i, d = (np.concatenate(x) for x in zip(*self.proposed))
        after, before = self._alike(i, i + d, True), self._alike(i, i + d, False)
        start, end = i - before, i + d + after
        keep = end - start >= np.maximum(2 * d, least)
        start, end, d = start[keep], end[keep], d[keep]
        order = np.lexsort((d, end, start))
        start, end, d = start[order], end[order], d[order]
        new = np.ones(len(d), bool)
        new[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
        start, end, d = start[new], end[new], d[new]
        order = np.lexsort((d, start))
        return start[order], end[order], d[order]


def find_runs(word: np.ndarray, doc: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and period of the runs of hashed words; ``doc`` does not fall."""
    return Factors(word, doc).runs(least)


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, n: int) -> pa.LargeStringArray:
    """Each text's words with one space between them."""
    size = end - start + 1  # a space behind each word
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum())) - np.repeat(first, size)
    at = within + np.repeat(start, size)
    gap = within == np.repeat(size - 1, size)
    out = np.where(gap, np.uint8(0x20), data[np.minimum(at, max(0, len(data) - 1))]) if len(at) else np.zeros(0, np.uint8)
    edge = np.ones(len(doc), bool)
    edge[:-1] = doc[1:] != doc[:-1]
    keep = np.ones(len(out), bool)
    keep[(first + size - 1)[edge]] = False  # none behind the last
    offsets = np.zeros(n + 1, np.int64)
    np.add.at(offsets, doc + 1, size)
    offsets[np.unique(doc) + 1] -= 1
    return pa.LargeStringArray.from_buffers(n, pa.py_buffer(np.cumsum(offsets)), pa.py_buffer(np.ascontiguousarray(out[keep])))


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_SCHEMA = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


def periodic_runs(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs`` (doc_id, text).

    ``runs`` holds all stretches of words that repeat with a smallest period, at least twice and
    over at least ``least`` words, as long as they go, by start and then period. ``collapsed``
    has the words that no run contains behind its first period, with one space between them.
    A text is one row and is looked at whole; runs do not cross texts, so rows never meet. Memory
    is the text's words times the logarithm of its longest repeated stretch. A null, empty or
    wordless text has no runs and an empty result. Repeated rows and null ids are rows like
    any other; an empty table gives an empty one; other columns are not looked at. Words are
    compared by 64-bit hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id")
            for lo, hi, data, offsets in words.slices(batch):
                n = hi - lo
                start, end, doc = words.bounds(data, offsets, words.SPACE_FREE)
                size = words.counts(doc, n)
                first = np.cumsum(size) - size
                s, e, q = find_runs(words.hashes(data, start, end), doc, least)
                turn = np.zeros(len(doc) + 1, np.int64)
                np.add.at(turn, s + q, 1)
                np.add.at(turn, e, -1)
                keep = np.cumsum(turn)[:-1] == 0
                owner = doc[s] if len(s) else s
                per = np.zeros(n + 1, np.int32)
                per[1:] = np.cumsum(np.bincount(owner, minlength=n))
                found = pa.StructArray.from_arrays([pa.array(s - first[owner]), pa.array(e - s), pa.array(q)], fields=list(_RUN))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), pa.array(size), pa.ListArray.from_arrays(pa.array(per), found),
                     _joined(data, start[keep], end[keep], doc[keep], n).cast(pa.string())],
                    ["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, _SCHEMA)


def digest(found: DataFrame) -> DataFrame:
    """The longest run of each row (of equal ones the first, then that of the smallest period)
    and digests of all runs and of the collapsed text."""
    best = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"),
                    lambda a, r: F.when(a.isNull() | (r["length"] > a["length"]), r).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"))


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with runs planted by a rule of the id: the test data of the registered query.

    With h the crc32 of the decimal id and g = h div 10, texts whose h ends in 0 repeat, from
    word g mod n on, the 1 + (n - a) div (3 + g mod 8) words that stand there. A null id has no h.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("long")
        g = F.floor(F.col("h") / 10)
        return let(g % n, lambda a: let(1 + F.floor((n - a) / (3 + g % 8)), lambda p: F.array_join(F.transform(
            F.sequence(F.lit(0).cast("long"), n - 1),
            lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")))

    again = let(F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)")), lambda w: F.when(F.size(w) > 0, repeat(w)).otherwise(F.lit("")))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), h.alias("h")).select(
        "doc_id", F.when(F.col("h") % 10 == 0, again).otherwise(F.col("text")).alias("text"))
