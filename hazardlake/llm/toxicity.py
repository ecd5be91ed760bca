"""Toxicity by a support vector machine over a subsequence string kernel.

The kernel of two strings sums over all letter sequences of 3 or 4 that both contain, not
necessarily adjacent: an occurrence that spans n letters counts ``DECAY ** n``, up to three
inserted letters. Signs do not count as letters. So "mo-ron", "m.o.r.o.n", "m o r o n" and
"moxron" stay close to "moron". The
Nyström method describes a string by its kernel with a set of landmark strings, and a linear
machine with squared hinge loss is trained on these descriptions.

A trained machine is a weighted sum of kernels with the landmarks, hence linear in the counted
sequences: scoring adds one table entry per occurrence and needs no landmark any more. Strings
are words between white space, with a mark before them; a run of one-character words is one
string, and so are two words over whose border a marked run of letters goes on ("mo ron"). Longer
words than ``LONG`` bytes are cut into overlapping stretches. A document is judged by its worst
string alone, calibrated on the labelled documents: harmless text around it changes nothing.

Labels are of documents. They reach strings in two steps: letter sequences that documents
marked toxic share and others hardly have mark the strings of toxic documents' sentences; all
strings of sentences of other documents are negative, the hardest of them are added in rounds.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.llm import words
from hazardlake.llm.language import held_out

DECAY = 0.6
REACH = 3  # inserted characters within a sequence
MARK = 31  # stands before every string


def _codes() -> np.ndarray:
    """Code of every code point: letters a to z are 1 to 26 in either case, other letters and
    the marks on them 64-bit hashes of their lower case, all others 0."""
    code = np.zeros(0x32000, np.uint64)  # no letters above
    code[0x61:0x7B] = code[0x41:0x5B] = np.arange(1, 27)
    other = [(i, low) for i in range(0x80, len(code)) for c in [chr(i)] if unicodedata.category(c)[0] in "LM"
             for low in [ord(c.lower()[0])]]
    at, low = np.array(other).T
    code[at] = words.mix(low.astype(np.uint64)) | np.uint64(1 << 63)
    code[at[low < 0x80]] = code[low[low < 0x80]]
    return code


CODE = _codes()
_SHAPES = [(p, (0, *rest)) for p in (3, 4) for rest in combinations(range(1, p + REACH), p - 1)]
ASCII = 32**4 + 32**3  # sequences of 4, then of 3, each with its own place
HASHED = 1 << 22  # places of sequences with a letter outside ASCII
SIZE = ASCII + HASHED
BUCKETS = 1 << 20
#: Bytes of the longest string, and of the step from one stretch of a longer one to the next.
LONG, STRIDE = 48, 24


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # per sequence
    bias: float
    judge: tuple[float, float]  # of the worst margin, and 1
    marks: np.ndarray  # buckets of the marked runs


def units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of every string: words, and runs of one-character words as one.
    Words of more than ``LONG`` bytes are stretches of that size, each half over the one before."""
    start, end, doc = words.bounds(data, offsets, words.SPACE_FREE)
    if not len(start):
        return start, end, doc
    lead = data[start]
    single = end - start == 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
    joined = np.zeros(len(start), bool)
    joined[1:] = single[1:] & single[:-1] & (doc[1:] == doc[:-1])
    head = np.flatnonzero(~joined)
    start, end, doc = start[head], end[np.append(head[1:], len(start)) - 1], doc[head]
    parts = np.maximum(1, -(-(end - start - LONG) // STRIDE) + 1)
    if parts.max() > 1:
        nth = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        start, end, doc = np.repeat(start, parts) + nth * STRIDE, np.repeat(end, parts), np.repeat(doc, parts)
        end = np.minimum(end, start + LONG)
    return start, end, doc


def broken(data: np.ndarray, start: np.ndarray, end: np.ndarray, doc: np.ndarray, marked: np.ndarray) -> np.ndarray:
    """Strings that go on in the next one: a marked run of five codes, five letters or the mark
    and four, reaches over the border."""
    code, unit, total = _symbols(data, start, end)
    letter = code[:total] != MARK
    code, unit = np.append(code[:total][letter], np.zeros(5, np.uint64)), np.append(unit[:total][letter], np.full(5, -9))
    first = np.diff(unit, prepend=-1) != 0
    over = []
    for head, n in ((0, 5), (MARK, 4)):
        at = np.flatnonzero(unit[n - 1: len(unit) - 5 + n - 1] - unit[: len(unit) - 5] == 1)
        at = at[(doc[unit[at]] == doc[unit[at + n - 1]]) & (first[at] | (head == 0))]
        key = np.full(len(at), head, np.uint64)
        for j in range(n):
            key = key * np.uint64(32) + code[at + j]
        hit = marked[(words.mix(key * np.uint64(16) + np.uint64(5)) % np.uint64(BUCKETS)).astype(np.int64)]
        over.append(unit[at[hit]])
    return np.unique(np.concatenate(over))


def _symbols(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Codes of all strings one after the other, each behind its mark, the string of each, and
    their number. A letter is one code however many bytes it has. Signs and spaces are left
    out: they stand between letters without widening a gap."""
    length = end - start + 1
    first = np.cumsum(length) - length
    total = int(length.sum())
    at = np.maximum(np.arange(total) - np.repeat(first - start + 1, length), 0)
    byte = data[at] if total else data[:0]
    point = byte.astype(np.int64)
    for lead, last, n in ((0xC0, 0xDF, 2), (0xE0, 0xEF, 3), (0xF0, 0xFF, 4)):
        here = np.flatnonzero((byte >= lead) & (byte <= last))
        whole = point[here] & (0x7F >> n)
        for j in range(1, n):
            whole = whole * 64 + (data[np.minimum(at[here] + j, len(data) - 1)] & 0x3F)
        point[here] = whole
    point[((byte & 0xC0) == 0x80) | (point >= len(CODE))] = 0
    code, unit = CODE[point], np.repeat(np.arange(len(start)), length)
    keep = code > 0
    code[first], keep[first] = MARK, True
    total = int(keep.sum())
    return np.append(code[keep], np.zeros(8, np.uint64)), np.append(unit[keep], np.full(8, -1)), total


def runs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, string) of all runs of 4 to 8 adjacent codes, hashed into ``BUCKETS``."""
    code, unit, total = _symbols(data, start, end)
    key = code[:total] * np.uint64(32) + code[1: total + 1]
    for n in range(3, 9):
        key = key * np.uint64(32) + code[n - 1: total + n - 1]
        at = np.flatnonzero(unit[:total] == unit[n - 1: total + n - 1])
        if n > 3:
            yield (words.mix(key[at] * np.uint64(16) + np.uint64(n)) % np.uint64(BUCKETS)).astype(np.int64), unit[at]


def occurrences(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
    """Per shape: weight, sequence and string number of the occurrences in the strings."""
    code, unit, total = _symbols(data, start, end)
    for p, places in _SHAPES:
        span = places[-1]
        at = np.flatnonzero((unit[:total] == unit[span: total + span]) & (code[:total] > 0) & (code[span: total + span] > 0))
        key = code[at]
        ok = np.ones(len(at), bool)
        for x in places[1:]:
            c = code[at + x]
            ok &= c > 0
            key = key * np.uint64(32) + c
        at, key = at[ok], key[ok]
        far = np.flatnonzero(key >= 32**p)
        place = key.astype(np.int64) if p == 4 else key.astype(np.int64) + 32**4
        place[far] = ASCII + (words.mix(key[far] + np.uint64(p)) % np.uint64(HASHED)).astype(np.int64)
        yield DECAY ** (span + 1), place, unit[at]


def margins(data: np.ndarray, start: np.ndarray, end: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted sum of the sequences of each string."""
    out = np.zeros(len(start))
    for w, key, unit in occurrences(data, start, end):
        if len(unit):
            out += w * np.bincount(unit, weight[key], minlength=len(start))
    return out


def _sparse(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the weights that are not 0; a machine has those of its landmarks only."""
    at = np.flatnonzero(weight).astype(np.int32)
    return at, weight[at]


def _dense(at: np.ndarray, value: np.ndarray) -> np.ndarray:
    weight = np.zeros(SIZE, np.float32)
    weight[at] = value
    return weight


def _features(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, sequence, value) of bounded lists of strings."""
    data = np.frombuffer(b"".join(strings), np.uint8)
    end = np.cumsum([len(s) for s in strings])
    start = end - [len(s) for s in strings]
    rows = [(u, k, np.full(len(u), w)) for w, k, u in occurrences(data, start, end)]
    u, k, v = (np.concatenate([r[i] for r in rows]) for i in range(3))
    order = np.argsort(u * SIZE + k, kind="stable")
    key = (u * SIZE + k)[order]
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
    value = np.add.reduceat(v[order], head) if len(key) else v
    return u[order][head], k[order][head], value


class _Kernel:
    """Normalised kernel of strings with landmarks, and the Nyström map."""

    def __init__(self, landmarks: list[bytes]):
        u, k, v = _features(landmarks)
        norm = np.sqrt(np.bincount(u, v * v, minlength=len(landmarks)))
        self.n, self.u, self.k, self.v = len(landmarks), u, k, v / norm[u]
        order = np.argsort(self.k, kind="stable")
        self.u, self.k, self.v = self.u[order], self.k[order], self.v[order]
        value, vec = np.linalg.eigh(self.against(landmarks, True))
        keep = value > 1e-6 * value.max()
        self.whiten = vec[:, keep] / np.sqrt(value[keep])

    def against(self, strings: list[bytes], normal: bool = False) -> np.ndarray:
        """Kernel of each string with each landmark, a few hundred strings at a time."""
        if len(strings) > 500:
            return np.vstack([self.against(strings[i: i + 500], normal) for i in range(0, len(strings), 500)])
        u, k, v = _features(strings)
        lo, hi = np.searchsorted(self.k, k, "left"), np.searchsorted(self.k, k, "right")
        n = hi - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        out = np.bincount(np.repeat(u, n) * self.n + self.u[at], np.repeat(v, n) * self.v[at],
                          minlength=len(strings) * self.n).reshape(len(strings), self.n)
        if normal:
            norm = np.sqrt(np.bincount(u, v * v, minlength=len(strings)))
            out = out / np.maximum(norm, 1e-12)[:, None]
        return out

    def sequence_weights(self, w: np.ndarray) -> np.ndarray:
        alpha = self.whiten @ w
        return np.bincount(self.k, self.v * alpha[self.u], minlength=SIZE).astype(np.float32)


def _spread(strings: list[bytes], docs: list[int], n: int) -> list[bytes]:
    """Landmarks: each time the string that those taken explain least, times its documents."""
    u, k, v = _features(strings)
    norm = np.sqrt(np.bincount(u, v * v, minlength=len(strings)))
    v = v / np.maximum(norm, 1e-12)[u]
    by = np.argsort(k, kind="stable")
    ku, kk, kv = u[by], k[by], v[by]
    left, weight, columns, taken = (norm > 0).astype(float), np.array(docs, float), [], []
    while len(taken) < min(n, len(strings)):
        j = int(np.argmax(left * weight))
        if left[j] < 1e-3:
            break
        mine = slice(*np.searchsorted(u, [j, j + 1]))
        lo, hi = np.searchsorted(kk, k[mine], "left"), np.searchsorted(kk, k[mine], "right")
        size = hi - lo
        at = np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        column = np.bincount(ku[at], np.repeat(v[mine], size) * kv[at], minlength=len(strings))
        for c in columns:
            column -= c * c[j]
        column /= np.sqrt(left[j])
        columns.append(column)
        left = np.maximum(left - column**2, 0)
        taken.append(j)
    return [strings[j] for j in taken]


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, steps: int = 60) -> np.ndarray:
    """Linear machine with squared hinge loss by finite Newton steps on the rows inside the
    margin; the last column of x is 1 and its weight is free."""
    ridge = np.ones(x.shape[1])
    ridge[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        return ridge @ (w * w) / 2 + cost @ np.maximum(0, 1 - y * (x @ w)) ** 2

    w = np.zeros(x.shape[1])
    now = loss(w)
    for _ in range(steps):
        inside = y * (x @ w) < 1
        xi, ci = x[inside], cost[inside]
        best = np.linalg.solve(2 * (xi * ci[:, None]).T @ xi + np.diag(ridge), 2 * xi.T @ (ci * y[inside]))
        size, before = 1.0, now
        while size > 1e-4 and (now := loss(w + size * (best - w))) > before:
            size /= 2
        w = w + size * (best - w)
        if before - now < 1e-9 * before:
            break
    return w


def _strings(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for lo, hi, data, offsets in words.slices(batch, "text"):
        yield lo, hi, data, *units(data, offsets)


def learn(docs: DataFrame, labels: DataFrame, per_label: int = 10_000, strings: int = 3_000, landmarks: int = 300,
          rounds: int = 3, marks: int = 4096, share: float = 1 / 16) -> Model:
    """Train on docs (doc_id, text) and labels (doc_id, toxic), one label per id.

    Bounds, all documented parameters of the fit: about ``per_label`` labels of each value by a
    hash of the id; of their documents the ``marks`` most surprising letter runs, ``strings``
    strings of each kind per round (the most frequent marked ones; of the others the most
    frequent and some by hash, out of a ``share`` of them by hash) and ``landmarks`` landmarks.
    A string of less than 3 bytes has no sequence and is not learned from.
    Rows without a text or with a label other than 0 and 1 are skipped; without rows of both
    labels every document scores 0.
    """
    labels = labels.filter("toxic in (0, 1)").select(F.col("doc_id").alias("__id"), F.col("toxic").cast("int").alias("toxic"))
    total = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(total) < 2:
        return _untrained()
    drawn = F.when(F.col("toxic") == 1, per_label / total[1]).otherwise(per_label / total[0])
    chosen = labels.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) < drawn * (1 << 30))
    # At most about 2 * per_label labels, whatever the input.
    found = docs.join(F.broadcast(chosen), F.col("doc_id") == F.col("__id")).filter("text is not null").select("text", "toxic")
    rows = _without_copies(found).repartition(docs.sparkSession.sparkContext.defaultParallelism).persist()
    try:
        return _fit(rows, total, strings, landmarks, rounds, marks, share)
    finally:
        rows.unpersist()


def _without_copies(rows: DataFrame) -> DataFrame:
    """``rows`` (text, toxic) with one row of each group of copies, so that the words of a text
    that was copied often do not look like signs of its label.

    A row goes if one with a smaller hash of its text shares one of four minimum hashes of its
    three-word windows; equal texts are one row with the larger label.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha = batch.column("sha").to_numpy()
            for lo, hi, data, offsets in words.slices(batch, "text"):
                start, end, doc = words.bounds(data, offsets, words.SPACE_FREE)
                value, at = words.windows(words.hashes(data, start, end), doc, 3)
                low = np.repeat(words.mix(sha[lo:hi].astype(np.uint64))[:, None], 4, axis=1)
                head = np.flatnonzero(np.diff(doc[at], prepend=-1))
                for j in range(4 if len(head) else 0):
                    low[doc[at][head], j] = np.minimum.reduceat(words.mix(value ^ words._STEP[0][j]), head)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(sha[lo:hi], 4)), pa.array(np.tile(np.arange(4), hi - lo)), pa.array(words.signed(low.ravel()))],
                    ["sha", "j", "low"])

    one = rows.groupBy(F.xxhash64("text").alias("sha"), "text").agg(F.max("toxic").alias("toxic")).persist()
    keys = one.select("sha", "text").mapInArrow(run, "sha long, j long, low long")
    first = keys.groupBy("j", "low").agg(F.min("sha").alias("first"))
    gone = keys.join(first, ["j", "low"]).filter("sha <> first").select("sha").distinct()
    return one.join(gone, "sha", "left_anti").select("text", "toxic")


def _untrained() -> Model:
    return Model(np.zeros(SIZE, np.float32), 0.0, (0.0, -9.0), np.zeros(0, np.int64))


def _fit(rows: DataFrame, total: dict, strings: int, landmarks: int, rounds: int, marks: int, share: float) -> Model:
    spark = rows.sparkSession

    def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of each label per run of adjacent codes."""
        for batch in batches:
            label = batch.column("toxic").to_numpy()
            for lo, hi, data, start, end, doc in _strings(batch):
                if not len(start):
                    continue
                key = np.unique(np.concatenate([doc[u] * BUCKETS + k for k, u in runs(data, start, end)]))
                for x in (0, 1):
                    s, n = np.unique(key[label[lo + key // BUCKETS] == x] % BUCKETS, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(s), pa.array(np.full(len(s), x)), pa.array(n)], ["s", "x", "n"])

    seen = rows.mapInArrow(sequences, "s long, x long, n long")
    count = lambda x: F.sum(F.when(F.col("x") == x, F.col("n")).otherwise(0))
    used = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(used) < 2:
        return _untrained()
    rate = F.col("bad") / used[1] / ((F.col("good") + 0.5) / used[0])
    both = (F.col("bad") + F.col("good")) / (used[0] + used[1])
    surprise = (F.col("bad") / used[1] - F.col("good") / used[0]) / F.sqrt(
        both * (1 - both) * (1 / used[1] + 1 / used[0]) + 1e-12)
    most = (seen.groupBy("s").agg(count(1).alias("bad"), count(0).alias("good"))
             .filter((F.col("bad") >= 3) & (rate > 5) & (surprise > 5)).orderBy(surprise.desc(), "s").limit(marks).collect())
    mark = np.zeros(BUCKETS, bool)
    mark[[r["s"] for r in most]] = True

    def candidates(weight: np.ndarray | None, bias: float):
        """Strings of the documents with their documents per label; without a machine the
        marked ones and a hashed share of the others, else those the machine calls toxic."""
        shared = spark.sparkContext.broadcast((mark, None if weight is None else _sparse(weight)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            marked, table = shared.value
            table = None if table is None else _dense(*table)
            out: list = []
            for batch in batches:
                label = batch.column("toxic").to_numpy()
                for lo, hi, data, start, end, doc in _strings(batch):
                    if not len(start):
                        continue
                    h = words.hashes(data, start, end, words.LOWER)
                    _, one = np.unique(words.mix(h ^ doc.astype(np.uint64)), return_index=True)
                    start, end, doc, h = start[one], end[one], doc[one], h[one]
                    if table is None:
                        hit = np.zeros(len(start), bool)
                        for k, u in runs(data, start, end):
                            hit[u[marked[k]]] = True
                        keep = hit | (h % np.uint64(1 << 20) < share * (1 << 20))
                    else:
                        f = margins(data, start, end, table) + bias
                        hit, keep = f > -0.5, (f > -0.5) & (label[lo + doc] == 0)
                    for i in np.flatnonzero(keep):
                        out.append((bytes(words.LOWER[data[start[i]: end[i]]]), bool(hit[i]), int(label[lo + doc[i]])))
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate(
                            (pa.binary(), pa.bool_(), pa.int64()))], ["s", "hit", "x"])
                        out = []

        return (rows.mapInArrow(run, "s binary, hit boolean, x long").filter("octet_length(s) >= 3")
                .groupBy("s", "hit").agg(F.sum("x").alias("bad"), F.sum(1 - F.col("x")).alias("good")))

    found = candidates(None, 0.0).persist()
    few = lambda df, *by: {bytes(r["s"]): r["bad"] + r["good"] for r in df.orderBy(*by, "s").limit(strings).collect()}
    plus = few(found.filter(F.col("hit") & (F.col("bad") > 4 * F.col("good") * used[1] / used[0])), F.col("bad").desc())
    often = few(found.filter("good > 0 and (not hit or bad = 0)"), F.col("good").desc())
    other = few(found.filter("good > 0 and bad = 0"), F.xxhash64("s"))
    found.unpersist()
    minus = other | often
    if not plus or not minus:
        return _untrained()
    marks_of = _spread(list(plus), list(plus.values()), landmarks // 2)
    for step in range(rounds):
        kernel = _Kernel(marks_of + _spread(list(minus), list(minus.values()), landmarks - len(marks_of)))
        text = [*plus, *minus]
        x = kernel.against(text) @ kernel.whiten
        x = np.hstack([x, np.ones((len(x), 1))])
        y = np.array([1.0] * len(plus) + [-1.0] * len(minus))
        often_seen = np.sqrt([*plus.values(), *minus.values()])  # what more documents have costs more to miss
        w = _svm(x, y, 10.0 * often_seen)
        weight, bias = kernel.sequence_weights(w[:-1]), float(w[-1])
        if step + 1 < rounds:
            hard = few(candidates(weight, bias), F.col("good").desc())
            minus |= {s: n for s, n in hard.items() if s not in minus and s not in plus}
    places = np.flatnonzero(mark)
    scored = _judged(rows, weight, bias, places).select("toxic", "worst").toArrow()
    y = scored.column("toxic").to_numpy().astype(float)
    x = np.stack([scored.column("worst").to_numpy(), np.ones(len(y))], axis=1)
    weigh = np.where(y == 1, total[1] / used[1], total[0] / used[0])
    return Model(weight, bias, tuple(_logistic(x, y, weigh).tolist()), places)


def _logistic(x: np.ndarray, y: np.ndarray, weigh: np.ndarray) -> np.ndarray:
    """Weights of the log odds of label 1, by damped Newton steps with a small ridge."""
    b, ridge = np.zeros(x.shape[1]), np.full(x.shape[1], 0.1)
    ridge[-1] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (weigh * (p - y)) + ridge * b
        hess = (x * (weigh * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        b -= step * min(1.0, 2.0 / max(1e-9, np.abs(step).max()))
    return b


def _judged(rows: DataFrame, weight: np.ndarray, bias: float, marks: np.ndarray) -> DataFrame:
    """``rows`` (with text) and their worst margin; the text itself goes."""
    shared = rows.sparkSession.sparkContext.broadcast((_sparse(weight), marks))
    keep = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sparse, places = shared.value
        table, marked = _dense(*sparse), np.zeros(BUCKETS, bool)
        marked[places] = True
        for batch in batches:
            worst = np.full(len(batch), bias)
            for lo, hi, data, start, end, doc in _strings(batch):
                if not len(start):
                    continue
                _, one, same = np.unique(words.hashes(data, start, end, words.LOWER), return_index=True, return_inverse=True)
                np.maximum.at(worst, lo + doc, (margins(data, start[one], end[one], table) + bias)[same])
                two = broken(data, start, end, doc, marked)
                np.maximum.at(worst, lo + doc[two], margins(data, start[two], end[two + 1], table) + bias)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(worst)], [*keep, "worst"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text"]
    return rows.mapInArrow(run, ", ".join([*fields, "worst double"]))


def predict(rows: DataFrame, model: Model) -> DataFrame:
    """(..., score, predicted) of rows with a column ``text``; the text goes.

    ``score`` is the calibrated probability of label 1. A null or empty text has no string
    and scores as one without any known sequence.
    """
    odds = model.judge[0] * F.col("worst") + model.judge[1]
    return (_judged(rows, model.weight, model.bias, model.marks).withColumn("score", 1 / (1 + F.exp(-odds))).drop("worst")
            .withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0)))


def detect(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``.

    Learned from the labels (doc_id, toxic) of rows whose id is not held out; a null id is
    never learned from. Repeated labels of an id count once, a row with label 1 wins. An
    empty table gives no rows; repeated rows are scored each.
    """
    out = held_out(parts=5, part=0)
    known = labels.filter(~out & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", out.alias("held_out"))
    return predict(rows, learn(docs.select("doc_id", "text"), known, **how))
