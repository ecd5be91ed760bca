"""Language proportions of documents by expectation-maximisation over n-gram likelihoods.

A language is a distribution of hashed byte n-grams of its words, learned from labelled
documents. A document is a mixture: each word comes from one of a set of languages, and the
proportions are found by expectation-maximisation. The set is the one whose likelihood, less a
penalty of half the logarithm of the words for each language, is best when languages are
dropped one by one from the smallest proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake.llm import words

#: Bytes of letters; whether a text with no ASCII letter has one is asked of its characters.
LETTER = words.ALNUM.copy()
LETTER[0x30:0x3A] = False
ASCII_LETTER = LETTER.copy()
ASCII_LETTER[0x80:] = False
NONE = "und"
U = np.uint64
#: Bytes of text worked on at once: a byte makes a dozen numbers, for each language three.
SLICE_BYTES = 1 << 18


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_p: np.ndarray  # buckets x languages
    order: int


def _grams(data: np.ndarray, start: np.ndarray, end: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram that ends at each byte of each word, and one at its end; the first
    of each word. Before a word stands a mark, so does its end."""
    length = end - start + 1
    first = np.cumsum(length) - length
    within = np.arange(int(length.sum())) - np.repeat(first, length)
    from_ = np.repeat(start, length)
    mark = np.uint32(0)
    at = within + from_
    last = within == np.repeat(length - 1, length)
    byte = np.where(last, mark, words.LOWER[data[np.minimum(at, len(data) - 1)]].astype(np.uint32) + np.uint32(1))
    key = np.zeros(len(byte), np.uint32)
    for j in range(order - 1, -1, -1):
        back = np.zeros(len(byte), np.uint32)
        back[j:] = byte[: len(byte) - j]
        back[within < j] = mark
        key = key * np.uint32(257) + back
    key *= np.uint32(0x9E3779B1)
    return (key >> np.uint32(32 - (buckets.bit_length() - 1))).astype(np.int64), first


def _words(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for lo, hi, data, offsets in words.slices(batch, "text", SLICE_BYTES):
        yield lo, hi, data, *words.bounds(data, offsets, LETTER)


def learn(rows: DataFrame, language: str = "lang", text: str = "text", order: int = 4, buckets: int = 1 << 16,
          per_language: int = 20_000, key: str = "doc_id") -> Model:
    """Distributions of the languages of ``rows``, from all rows with a language and a text.

    At most about ``per_language`` rows of a language are used, chosen by a hash of ``key``;
    ``buckets`` (a power of two, at most 2**32) bounds the model. Rows without language or
    text are skipped; no rows give a model without languages.
    """
    rows = rows.select(F.col(language).alias("language"), F.col(text).alias("text"),
                       F.pmod(F.xxhash64(key), F.lit(1 << 30)).alias("h")).filter("language is not null and text is not null")
    # The model has a column per language, so the driver may know how many rows each has.
    sizes = rows.groupBy("language").agg(F.count(F.lit(1)).alias("n")).collect()
    large = [r for r in sizes if r["n"] > per_language]
    below = F.lit(float(1 << 30))
    for r in large:
        below = F.when(F.col("language") == r["language"], per_language / r["n"] * (1 << 30)).otherwise(below)
    used = rows.filter(F.col("h") < below).select("language", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            name = batch.column("language").to_pylist()
            for lo, hi, data, start, end, doc in _words(batch):
                if not len(start):
                    continue
                bucket, first = _grams(data, start, end, order, buckets)
                of, labels = np.unique(np.array(name[lo:hi], object).astype(str), return_inverse=True)
                which = np.repeat(labels[doc], end - start + 1)
                got = np.bincount(which * buckets + bucket, minlength=len(of) * buckets).reshape(len(of), buckets)
                for x, n in zip(of.tolist(), got):
                    total[x] = total.get(x, 0) + n
        for x, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at)), pa.array(at), pa.array(n[at])],
                                             ["language", "bucket", "n"])

    counts = used.mapInArrow(run, "language string, bucket long, n long").groupBy("language", "bucket").agg(
        F.sum("n").alias("n")).toArrow()
    name, bucket, n = (counts.column(c).to_numpy(zero_copy_only=False) for c in ("language", "bucket", "n"))
    languages = sorted(set(name.tolist()))
    table = np.full((buckets, len(languages)), 0.1)
    for j, x in enumerate(languages):
        table[bucket[name == x], j] += n[name == x]
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32) if languages else table, order)


def _em(like: np.ndarray, doc: np.ndarray, first: np.ndarray, part: np.ndarray, n: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions after ``rounds`` steps from ``part`` (texts x languages), and the log likelihood."""
    for step in range(rounds + 1):
        joint = like * part[doc]
        each = joint.sum(axis=1)
        if step == rounds:
            return part, np.add.reduceat(np.log(each), first)
        joint /= each[:, None]
        part = np.add.reduceat(joint, first, axis=0) / n[:, None]
    raise AssertionError


def proportions(word_ll: np.ndarray, doc: np.ndarray, penalty: float = 1.0, rounds: int = 12) -> np.ndarray:
    """Language proportions of texts 0, 1, ... (each with a word) from word log likelihoods."""
    n_docs, n_lang = int(doc[-1]) + 1, word_ll.shape[1]
    n = np.bincount(doc, minlength=n_docs).astype(float)
    like = np.exp(word_ll - word_ll.max(axis=1, keepdims=True)) + 1e-30
    first = np.searchsorted(doc, np.arange(n_docs))
    part, ll = _em(like, doc, first, np.full((n_docs, n_lang), 1 / n_lang), n, rounds)
    out = part.copy()
    todo = np.arange(n_docs)
    while len(todo):
        active = out[todo] > 0
        todo = todo[active.sum(axis=1) > 1]
        if not len(todo):
            break
        mine = np.isin(doc, todo)
        own, own_doc = like[mine], np.searchsorted(todo, doc[mine])
        own_first = np.searchsorted(own_doc, np.arange(len(todo)))
        less = out[todo].copy()
        at = np.arange(len(todo))
        less[at, np.where(less > 0, less, 2).argmin(axis=1)] = 0
        less, less_ll = _em(own, own_doc, own_first, less / less.sum(axis=1, keepdims=True), n[todo], 4)
        drop = ll[todo] - less_ll < penalty * 0.5 * np.log(n[todo] + 1) + 1e-9
        out[todo[drop]], ll[todo[drop]] = less[drop], less_ll[drop]
        todo = todo[drop]
    return out


def predict(rows: DataFrame, model: Model, penalty: float = 1.0,
            names: tuple[str, str, str] = ("lang_pred", "score", "languages"), letters: str | None = None) -> DataFrame:
    """``rows`` (with a column ``text``) and ``lang_pred``, ``score`` and ``languages``, or ``names``.

    ``languages`` maps each language of the chosen set to its proportion of the words,
    ``lang_pred`` is the largest (of equal ones the first by name) and ``score`` its
    proportion. A null text, a text without a letter, or any text when no language was
    learned is ``und`` with score 0 and an empty map. ``letters`` names one more column: whether
    the text has a letter, whatever was learned.
    """
    known, keep = np.array([*model.languages, NONE], object), rows.columns
    shared = rows.sparkSession.sparkContext.broadcast(model.log_p)  # buckets x languages, fixed by the model
    order, schema = model.order, pa.map_(pa.string(), pa.float64())
    more = [letters] if letters else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        buckets, n_lang = table.shape
        for batch in batches:
            best, score = np.full(len(batch), n_lang), np.zeros(len(batch))
            found: list = [[] for _ in range(len(batch))]
            lettered = np.zeros(len(batch), bool)
            for lo, hi, data, start, end, doc in _words(batch):
                plain = np.zeros(hi - lo, bool)
                plain[doc[ASCII_LETTER[data[start]]]] = True
                for i in np.unique(doc[~plain[doc]]) if len(doc) else ():
                    plain[i] = any(c.isalpha() for c in batch.column("text")[lo + int(i)].as_py())
                lettered[lo:hi] = plain
                use = plain[doc]
                if not use.any() or not n_lang:
                    continue
                start, end, doc = start[use], end[use], doc[use]
                bucket, first = _grams(data, start, end, order, buckets)
                ll = np.add.reduceat(table[bucket], first, axis=0) / order
                texts, dense = np.unique(doc, return_inverse=True)
                part = proportions(ll.astype(float), dense, penalty)
                best[lo + texts], score[lo + texts] = part.argmax(axis=1), part.max(axis=1)
                for i, p in zip(texts.tolist(), part):
                    found[lo + i] = [(known[j], float(p[j])) for j in np.flatnonzero(p > 0)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), pa.array(known[best], pa.string()), pa.array(np.clip(score, 0, 1)),
                 pa.array(found, schema), *(pa.array(lettered) for _ in more)], [*keep, *names, *more])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, `{names[0]}` string, `{names[1]}` double, `{names[2]}` map<string, double>"
                           + "".join(f", `{x}` boolean" for x in more))


def held_out(doc_id: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id's text leaves ``part``; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part, F.lit(False))


def identify(docs: DataFrame, **how) -> DataFrame:
    """(doc_id, text, held_out, lang_pred, score, languages) of every row of ``docs``.

    The model is learned from the rows that are not held out and have an id, a language and
    a text. Nothing but the text goes into a prediction. An empty table gives no rows;
    repeated rows and rows that share an id are judged each.
    """
    model = learn(docs.filter(~held_out() & F.col("doc_id").isNotNull()), **how)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    return predict(rows, model)
