"""Quality rules: base counts, and the divergence of a document from its language.

Two histograms describe a text: its characters by class, and its words by the common words of
its language (all others are one bin). The references are the same histograms over all
documents of the language that pass the base rules, whatever their number. Common are the
words that most documents of the language have. A document whose Jensen-Shannon distance to the
reference exceeds a limit fails, unless it is too short to tell.

A histogram of n samples strays from its own source by chance: the divergence of one with b
bins is about (b - 1) / (8 n ln 2) bits. That much is granted on top of the squared limit.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.llm import words
from hazardlake.session import cut_lineage

U = np.uint64
SYMBOLS = b"#*$%&|<>"
#: Character classes, by code point: the last code points of stretches and their class.
CLASSES = ("lower", "upper", "digit", "stop", "symbol", "control", "latin", "script", "cjk", "rest")
_LOWER, _UPPER, _DIGIT, _STOP, _SYMBOL, _CONTROL, _LATIN, _SCRIPT, _CJK, _REST = range(len(CLASSES))
#: Class of the character that starts with this byte; -1 inside a character. Latin is up to
#: U+02FF, script to U+1FFF, rest to U+2FFF and from U+E000 or F0 on, CJK between.
CLASS_OF = np.full(256, -1, np.int8)
CLASS_OF[:0x20] = CLASS_OF[0x7F] = _CONTROL
CLASS_OF[0x20:0x7F] = _STOP
CLASS_OF[list(SYMBOLS)] = _SYMBOL
CLASS_OF[0x30:0x3A], CLASS_OF[0x41:0x5B], CLASS_OF[0x61:0x7B] = _DIGIT, _UPPER, _LOWER
CLASS_OF[0xC0:0xCC], CLASS_OF[0xCC:0xE2], CLASS_OF[0xE2], CLASS_OF[0xE3:0xEE], CLASS_OF[0xEE:] = _LATIN, _SCRIPT, _REST, _CJK, _REST

COMMON = 64
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Distances allowed, and the words and characters from which a text is judged by them.
CLASS_LIMIT, WORD_LIMIT = 0.25, 0.3
CLASS_GUARD, WORD_GUARD = 200, 50
#: Words below which a language has no reference of its own.
REFERENCE_WORDS = 2000
#: Distinct words a task holds before it passes them on.
HELD = 1 << 20


class Counted:
    """Words and base counts of the texts of a slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n = len(offsets) - 1
        start, end, self.doc = words.bounds(data, offsets, words.SPACE_FREE)
        self.word = words.hashes(data, start, end, words.LOWER)
        self.n_words = words.counts(self.doc, n)
        owner = np.repeat(np.arange(n), np.diff(offsets))
        kind, inside = CLASS_OF[data], words.SPACE_FREE[data]
        in_word = inside & (kind >= 0)
        self.classes = np.bincount(owner[in_word] * len(CLASSES) + kind[in_word], minlength=n * len(CLASSES)).reshape(n, -1)
        self.word_chars = self.classes.sum(axis=1)
        self.n_symbols = self.classes[:, _SYMBOL]
        self.n_repeat_words = self._repeated(words.hashes(data, start, end), n)
        self.n_dup_lines = self._lines(data, offsets, inside, n)
        self.base_failed = (self.n_words < LEAST_WORDS) | (100 * self.n_repeat_words > MOST_REPEATED * self.n_words)

    def _repeated(self, exact: np.ndarray, n: int) -> np.ndarray:
        value, at = words.windows(exact, self.doc, 3)
        order = np.lexsort((value, self.doc[at]))
        v, d = value[order], self.doc[at][order]
        same = (v[1:] == v[:-1]) & (d[1:] == d[:-1])
        again = np.zeros(len(order), bool)
        again[1:] |= same
        again[:-1] |= same
        hit, spot = np.zeros(len(exact), bool), at[order[again]]
        for j in range(3):
            hit[spot + j] = True
        return np.bincount(self.doc[hit], minlength=n)

    @staticmethod
    def _lines(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, n: int) -> np.ndarray:
        body = np.ones(256, bool)
        body[0x0A] = False
        start, end, doc = words.bounds(data, offsets, body)
        total = np.concatenate([[0], np.cumsum(inside)])
        full = total[end] > total[start]
        start, end, doc = start[full], end[full], doc[full]
        value = words.hashes(data, start, end)
        order = np.lexsort((value, doc))
        v, d = value[order], doc[order]
        return np.bincount(d[1:][(v[1:] == v[:-1]) & (d[1:] == d[:-1])], minlength=n)


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.col("lang").cast("string").alias("lang"))


def _partial(common: int):
    """(lang, piece, kind, key, docs, n, top) of the texts that pass the base rules, combined over
    the task: kind 0 are classes by number and, under -1, all words; kind 1 are words by hash.
    ``top`` marks the words of a piece that most of its documents have, one more than ``common``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held: dict[str | None, list] = {}
        size, piece = 0, TaskContext.get().partitionId() << 32

        def flush():
            for lang, parts in held.items():
                kind, key, docs, n = (np.concatenate(x) for x in zip(*parts))
                order = np.lexsort((key, kind))
                kind, key = kind[order], key[order]
                head = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (kind[1:] != kind[:-1])]))
                docs, n = np.add.reduceat(docs[order], head), np.add.reduceat(n[order], head)
                rank = np.where(kind[head] == 1, -docs, 1)
                top = np.zeros(len(head), bool)
                top[np.argsort(rank, kind="stable")[: common + 1]] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(head), pa.string()), pa.array(np.full(len(head), piece)), pa.array(kind[head]), pa.array(key[head]),
                     pa.array(docs), pa.array(n), pa.array(top & (kind[head] == 1))],
                    ["lang", "piece", "kind", "key", "docs", "n", "top"])
            held.clear()

        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            codes = langs.indices.fill_null(-1).to_numpy()
            names = [*langs.dictionary.to_pylist(), None]
            for lo, hi, data, offsets in words.slices(batch):
                c = Counted(data, offsets)
                good = ~c.base_failed
                code = codes[lo:hi]
                for k in np.unique(code[good]).tolist():
                    mine = good & (code == k)
                    use = mine[c.doc] & (names[k] is not None)
                    w, d = words.signed(c.word[use]), c.doc[use]
                    order = np.lexsort((d, w))
                    w, d = w[order], d[order]
                    new = np.concatenate([[True], w[1:] != w[:-1]]) if len(w) else np.zeros(0, bool)
                    head = np.flatnonzero(new)
                    first = new.copy()
                    first[1:] |= d[1:] != d[:-1]
                    docs = np.add.reduceat(first.astype(np.int64), head) if len(head) else head
                    held.setdefault(names[k], []).append((
                        np.concatenate([np.zeros(len(CLASSES) + 1, np.int32), np.ones(len(head), np.int32)]),
                        np.concatenate([np.arange(-1, len(CLASSES)), w[head]]),
                        np.concatenate([np.full(len(CLASSES) + 1, int(mine.sum())), docs]),
                        np.concatenate([[c.n_words[mine].sum()], c.classes[mine].sum(axis=0), np.diff(head, append=len(w))])))
                    size += len(head)
                if size > HELD:
                    yield from flush()
                    size, piece = 0, piece + 1
        yield from flush()

    return run


def _common_words(part: DataFrame, common: int) -> DataFrame:
    """(lang, top): the words that most documents have, at most ``common`` of a language.

    Exact without a shuffle of all words. The sums over the pieces' own top words give a lower
    bound of the ``common + 1``-th count; a word that reaches it must, in one of the pieces,
    have the bound divided by their number. Only these words are counted over all pieces.
    """
    every = part.filter("kind = 1")
    order = Window.partitionBy("lang").orderBy(F.col("docs").desc(), "key")

    def first(counts: DataFrame) -> DataFrame:
        return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= common + 1)

    seen = first(every.filter("top").groupBy("lang", "key").agg(F.sum("docs").alias("docs")))
    bound = seen.groupBy("lang").agg(F.coalesce(F.max(F.when(F.col("place") > common, F.col("docs"))), F.lit(0)).alias("bound"))
    pieces = part.filter("kind = 0 and key = -1").groupBy("lang").agg(F.count(F.lit(1)).alias("pieces"))
    bound = cut_lineage(bound.join(pieces, "lang"), "bounds")
    few = cut_lineage(every.join(bound, "lang").filter(F.col("docs") * F.col("pieces") >= F.col("bound")).select("lang", "key").distinct(), "candidates")
    counts = every.join(few, ["lang", "key"]).groupBy("lang", "key").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
    best = first(counts).groupBy("lang").agg(
        F.collect_list(F.struct("key", "n", "docs")).alias("top"), F.max(F.when(F.col("place") > common, F.col("docs"))).alias("next"))
    return best.select("lang", F.array_sort(F.filter("top", lambda x: x["docs"] > F.coalesce("next", F.lit(0)))).alias("top"))


def references(docs: DataFrame, common: int = COMMON) -> DataFrame:
    """(lang, classes, keys, counts, n_words): a row per language with enough words and one,
    with a null ``lang`` and no words, of all documents.

    ``classes`` counts characters by class, ``keys`` are hashes of the words that most documents
    have, at most ``common`` (words that tie with the next one after these are left out), and
    ``counts`` how often they stand in them; ``n_words`` counts all words.
    """
    part = cut_lineage(_text(docs).mapInArrow(
        _partial(common), "lang string, piece long, kind int, key long, docs long, n long, top boolean"), "counts")
    sums = part.filter("kind = 0").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    of = lambda k: F.sum(F.when(F.col("key") == k, F.col("n")).otherwise(0))
    columns = [F.array(*[of(k) for k in range(len(CLASSES))]).alias("classes"), of(-1).alias("n_words")]
    one = sums.filter("lang is not null").groupBy("lang").agg(*columns).filter(F.col("n_words") >= REFERENCE_WORDS)
    none = F.lit(None).cast("array<long>")
    named = one.join(_common_words(part, common), "lang").select("lang", "classes", F.col("top.key").alias("keys"), F.col("top.n").alias("counts"), "n_words")
    return named.unionByName(sums.agg(*columns).select(
        F.lit(None).cast("string").alias("lang"), "classes", none.alias("keys"), none.alias("counts"), "n_words"))


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of counts ``p`` to the counts ``q``."""
    p = p / np.maximum(p.sum(axis=-1, keepdims=True), 1)
    q = np.broadcast_to(q / max(q.sum(), 1), p.shape)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.maximum(part.sum(axis=-1) / 2, 0))


_SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
           "kept boolean, class_distance double, word_distance double")


def judge(docs: DataFrame, reference: DataFrame, class_limit: float = CLASS_LIMIT, word_limit: float = WORD_LIMIT,
          class_guard: int = CLASS_GUARD, word_guard: int = WORD_GUARD) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    class_distance, word_distance) of every row of ``docs`` (doc_id, text, lang).

    A text is compared with the reference of its language; where that is null or has too few
    words, with that of all documents, and then by its characters alone. Below ``class_guard``
    characters or ``word_guard`` words the distance is null and fails nobody, as it is without
    any reference. A null, empty or wordless text has zeros and fails the base rules. Repeated
    rows and null ids are rows like any other; an empty table gives an empty one; other columns
    are not looked at. Texts are looked at whole, in slices of about a megabyte of rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, own = batch.column("doc_id"), batch.column("own").to_numpy(zero_copy_only=False)
            codes = batch.column("name").dictionary_encode().indices.to_numpy()
            for lo, hi, data, offsets in words.slices(batch):
                n, c = hi - lo, Counted(data, offsets)
                far = {"classes": np.full(n, np.nan), "words": np.full(n, np.nan)}
                failed = np.zeros(n, bool)
                for k in np.unique(codes[lo:hi]).tolist():
                    mine = np.flatnonzero(codes[lo:hi] == k)
                    row = {x: batch.column(x)[lo + int(mine[0])].as_py() for x in ("classes", "keys", "counts", "total")}
                    if not row["total"]:
                        continue
                    size = c.word_chars[mine]
                    js = distance(c.classes[mine], np.array(row["classes"], float))
                    js[size < class_guard] = np.nan
                    far["classes"][mine] = js
                    failed[mine] |= js**2 > class_limit**2 + (len(CLASSES) - 1) / (8 * np.log(2) * np.maximum(size, 1))
                    if not own[lo + int(mine[0])]:
                        continue
                    keys = np.array(row["keys"], np.int64)  # in ascending order
                    spot = np.zeros(n, np.int64)
                    spot[mine] = np.arange(len(mine)) + 1
                    use = spot[c.doc] > 0
                    w = words.signed(c.word[use])
                    at = np.searchsorted(keys, w)
                    at = np.where(np.append(keys, 0)[at] == w, at, len(keys))
                    bins = np.bincount((spot[c.doc[use]] - 1) * (len(keys) + 1) + at, minlength=len(mine) * (len(keys) + 1))
                    counts = np.array([*row["counts"], row["total"] - sum(row["counts"])], float)
                    js = distance(bins.reshape(len(mine), -1), counts)
                    js[c.n_words[mine] < word_guard] = np.nan
                    far["words"][mine] = js
                    failed[mine] |= js**2 > word_limit**2 + len(keys) / (8 * np.log(2) * np.maximum(c.n_words[mine], 1))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, n), *(pa.array(x.astype(np.int64)) for x in (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words)),
                     pa.array(c.base_failed), pa.array(~c.base_failed & ~failed),
                     *(pa.array(x, mask=np.isnan(x)) for x in far.values())],
                    [x.split()[0] for x in _SCHEMA.split(", ")])

    key = F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit(""))
    table = reference.select(key.alias("name"), "classes", "keys", "counts", F.col("n_words").alias("total"))
    known = table.select("name", F.lit(True).alias("own")).filter("name <> ''")
    named = _text(docs).withColumn("name", key).join(known, "name", "left")
    own = F.coalesce("own", F.lit(False))
    named = named.select("doc_id", "text", F.when(own, F.col("name")).otherwise("").alias("name"), own.alias("own"))
    return named.join(table, "name", "left").mapInArrow(run, _SCHEMA)


def filter_quality(docs: DataFrame) -> DataFrame:
    """``judge`` with references learned from the same documents."""
    return judge(docs, cut_lineage(references(docs), "references"))
