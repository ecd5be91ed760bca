"""A distributed positional inverted index, phrase and proximity search, decontamination.

Index rows are (part, term, posts): the places of one term in one part of the corpus. A part
is some consecutive texts of a task, about ``PART_WORDS`` words or one longer text; a place
counts words through the part, with ``GAP`` empty places after every text, so no phrase and no
proximity reaches into the next text. ``texts`` tells where the texts of the parts lie. A
frequent term has one bounded row per part, never one long list.

A phrase search starts from the rarest term of each phrase. Its places, shifted back by the
term's offset, are the candidate starts; they are intersected with the shifted list of the
second rarest term, and the few starts that are left with the lists of all other terms. Only
index rows of terms that occur in the phrases are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hazardlake.llm import words
from hazardlake.session import cut_lineage, work_dir

PART_WORDS = 1 << 21
GAP = 64
_INDEX = "part long, term long, posts array<int>, doc_ids array<long>, n_words array<long>, firsts array<int>"
_STRETCH = 1024  # places of a stretch under which texts and places meet


@dataclass(frozen=True)
class Index:
    postings: DataFrame  # part, term, posts
    texts: DataFrame  # part, first, doc_id, n_words


def _terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, doc = words.bounds(data, offsets, words.ALNUM)
    return words.hashes(data, start, end, words.LOWER), doc


def build(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Index every text of ``docs`` below ``path``.

    Words are runs of digits, ASCII letters and characters outside ASCII, A-Z lowered. Terms
    are 64-bit hashes of words. A null, empty or wordless text is in ``texts`` with 0 words.
    """

    def part_rows(part: int, held: list) -> Iterator[pa.RecordBatch]:
        ids = pa.concat_arrays([h[0] for h in held])
        per = np.concatenate([h[3] for h in held])
        term, doc, base = np.concatenate([h[1] for h in held]), [], 0
        for h in held:
            doc.append(h[2] + base)
            base += len(h[3])
        doc = np.concatenate(doc)
        firsts = (np.cumsum(per + GAP) - per - GAP).astype(np.int32)
        place = (np.arange(len(doc)) + GAP * doc).astype(np.int32)
        order = np.argsort(term, kind="stable")
        term, place = term[order], place[order]
        first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.zeros(0, np.int64)
        size = np.diff(np.concatenate([first, [len(term)]]))
        n, names = len(first), ["part", "term", "posts", "doc_ids", "n_words", "firsts"]
        none = [pa.nulls(n, pa.list_(t)) for t in (pa.int64(), pa.int64(), pa.int32())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, part)), pa.array(words.signed(term[first])), words.lists(place, size), *none], names)
        all_texts = np.array([len(ids)])
        yield pa.RecordBatch.from_arrays(
            [pa.array([part]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.list_(pa.int32())),
             pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), words.lists(per, all_texts),
             words.lists(firsts, all_texts)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for lo, hi, data, offsets in words.slices(batch, "text"):
                term, doc = _terms(data, offsets)
                held.append((batch.column("id").slice(lo, hi - lo), term, doc, words.counts(doc, hi - lo)))
                size += len(term) + GAP * (hi - lo)
                if size >= PART_WORDS:
                    yield from part_rows(part, held)
                    part, held, size = part + 1, [], 0
        if held:
            yield from part_rows(part, held)

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    rows.mapInArrow(run, _INDEX).write.option("compression", "zstd").parquet(path)
    return open_index(docs.sparkSession, path)


def open_index(spark: SparkSession, path: str) -> Index:
    rows = spark.read.schema(_INDEX).parquet(path)
    texts = (rows.filter("term is null").select("part", F.explode(F.arrays_zip("firsts", "doc_ids", "n_words")).alias("t"))
             .select("part", F.col("t.firsts").alias("first"), F.col("t.doc_ids").alias("doc_id"), F.col("t.n_words").alias("n_words")))
    return Index(rows.filter("term is not null").select("part", "term", "posts"), texts)


def located(index: Index, found: DataFrame) -> DataFrame:
    """Places (part, at, ...) with ``first``, ``doc_id`` and ``n_words`` of their text.

    Texts and places meet under stretches of places, so a place is compared with the few texts
    of its stretch.
    """
    reach = F.sequence(F.expr(f"first div {_STRETCH}"), F.expr(f"(first + n_words - 1) div {_STRETCH}"))
    texts = index.texts.filter("n_words > 0").withColumn("stretch", F.explode(reach))
    return (found.withColumn("stretch", F.expr(f"at div {_STRETCH}")).join(texts, ["part", "stretch"])
            .filter("at >= first and at < first + n_words").drop("stretch"))


def phrases(items: DataFrame, width: int, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(id, w1, w2, terms) of every window of ``width`` words, or the whole of a shorter text.

    ``w1`` and ``w2`` are a 128-bit name of the word sequence.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in words.slices(batch, "text"):
                term, doc = _terms(data, offsets)
                start, end, _ = words.bounds(data, offsets, words.ALNUM)
                other = words.hashes(data, start, end, words.LOWER, seed=1)
                per = words.counts(doc, hi - lo)
                begin = np.cumsum(per) - per
                rows = [(i, b, min(width, per[i])) for i in range(hi - lo) if per[i]
                        for b in range(begin[i], begin[i] + max(1, per[i] - width + 1))]
                ids = batch.column("id").slice(lo, hi - lo)
                if rows:
                    w1 = np.concatenate([words.sequence(term[b: b + n]) for _, b, n in rows])
                    w2 = np.concatenate([words.sequence(other[b: b + n], 1) for _, b, n in rows])
                    flat = np.concatenate([term[b: b + n] for _, b, n in rows])
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array([i for i, _, _ in rows])), pa.array(words.signed(w1)),
                         pa.array(words.signed(w2)), words.lists(words.signed(flat), np.array([n for _, _, n in rows]))],
                        ["id", "w1", "w2", "terms"])

    if not 1 <= width <= GAP:
        raise ValueError(f"phrases have 1 to {GAP} words")
    rows = items.select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, w1 long, w2 long, terms array<long>")


def _ranked(index: Index, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index rows of the phrases' terms, and (phrase, off, term, nth) with nth 1 at the rarest.

    A phrase with a term that the corpus lacks is left out.
    """
    spots = wanted.select("phrase", F.size("terms").alias("k"), F.posexplode("terms").alias("off", "term"))
    used = cut_lineage(spots.select("term").distinct(), "terms")
    lists = cut_lineage(index.postings.join(used, "term", "left_semi"), "lists")
    often = lists.groupBy("term").agg(F.sum(F.size("posts").cast("long")).alias("often"))
    by = Window.partitionBy("phrase").orderBy("often", "off")
    spots = (spots.join(often, "term").withColumn("nth", F.row_number().over(by))
             .withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("phrase"))).filter("found = k"))
    return lists, cut_lineage(spots.select("phrase", "k", "off", "term", "nth"), "spots")


def find(index: Index, wanted: DataFrame) -> DataFrame:
    """(phrase, part, at, k): every exact occurrence of the phrases (phrase, terms).

    ``at`` is the place of the first word and ``k`` the number of words. ``phrase`` must be
    unique and not null; terms are 1 to ``GAP``.
    """
    lists, spots = _ranked(index, wanted)

    def starts(nth: int) -> DataFrame:
        """Places of each phrase's nth rarest term, shifted to the phrase's start."""
        own = spots.filter(F.col("nth") == nth).select("phrase", "k", "off", "term")
        return (own.join(lists, "term").select("phrase", "k", "part", "off", F.explode("posts").alias("post"))
                .filter("post >= off").select("phrase", "k", "part", (F.col("post") - F.col("off")).alias("at")))

    rare = cut_lineage(starts(1), "rare")
    both = rare.filter("k > 1").join(starts(2).drop("k"), ["phrase", "part", "at"])
    seeds = cut_lineage(rare.filter("k = 1").unionByName(both), "seeds")
    # The places at which the remaining terms must stand, by term and part: one short list
    # against one index row.
    needs = (seeds.filter("k > 2").join(spots.filter("nth > 2").select("phrase", "off", "term"), "phrase")
             .select("part", "term", (F.col("at") + F.col("off")).alias("place"), "phrase", "at", "k"))
    asked = needs.groupBy("part", "term").agg(F.collect_set("place").alias("places"))
    there = (asked.join(lists, ["part", "term"])
             .select("part", "term", F.explode(F.array_intersect("places", "posts")).alias("place")))
    whole = (needs.join(there, ["part", "term", "place"]).groupBy("phrase", "part", "at", "k")
             .agg(F.count(F.lit(1)).alias("n")).filter("n = k - 2").drop("n"))
    return seeds.filter("k <= 2").unionByName(whole).select("phrase", "part", "at", "k")


def near(index: Index, wanted: DataFrame, span: int) -> DataFrame:
    """(phrase, part, at): places of each phrase's rarest term with all its other terms within
    ``span`` words (at most ``GAP``) before or after, in any order; a repeated term counts once.

    Places are dealt to stretches of ``span`` words, so a term is only compared with the same
    and the two neighbouring stretches.
    """
    if not 1 <= span <= GAP:
        raise ValueError(f"span must be 1..{GAP}")
    lists, spots = _ranked(index, wanted.select("phrase", F.array_distinct("terms").alias("terms")))
    seeds = spots.filter("nth = 1").join(lists, "term").select("phrase", "k", "part", F.explode("posts").alias("at"))
    asked = (seeds.join(spots.filter("nth > 1").select("phrase", "term"), "phrase")
             .withColumn("stretch", F.explode(F.expr(
                 f"sequence(greatest(at - {span}, 0) div {span}, (at + {span}) div {span})"))))
    there = lists.select("part", "term", F.explode("posts").alias("spot")).withColumn("stretch", F.expr(f"spot div {span}"))
    hit = (asked.join(there, ["part", "term", "stretch"]).filter(F.abs(F.col("spot") - F.col("at")) <= span)
           .select("phrase", "k", "part", "at", "term").distinct())
    return (hit.groupBy("phrase", "k", "part", "at").agg(F.count(F.lit(1)).alias("n")).filter("n = k - 1")
            .select("phrase", "part", "at").union(seeds.filter("k = 1").select("phrase", "part", "at")))


def _covered(spans: Column) -> Column:
    """Words covered by sorted spans (from, to)."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(s["to"] - F.greatest(s["from"], acc["end"]), F.lit(0))).alias("n"),
        F.greatest(acc["end"], s["to"]).alias("end"))
    zero = F.lit(0).cast("long")
    return F.aggregate(spans, F.struct(zero.alias("n"), zero.alias("end")), step, lambda acc: acc["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, part_of: int = 20) -> DataFrame:
    """(doc_id, n_words, n_hit, items, contaminated) of every row of ``docs``.

    A window is ``width`` consecutive words of a benchmark item, or the whole of a shorter
    item that has a word. ``n_hit`` counts the document's words inside any occurrence of a
    window, ``items`` lists the items with occurring windows as sorted strings, and a row is
    contaminated if ``n_hit > 0`` and ``part_of * n_hit >= n_words``. A null, empty or
    wordless text has no words and is clean; repeated rows are judged each; items that share
    an id are one item; a null item id adds no name. Empty tables give no rows, or clean ones.
    """
    spark = docs.sparkSession
    index = build(docs, work_dir(spark, "index"))
    asked = cut_lineage(phrases(benchmark, width), "phrases")
    name = F.concat_ws(" ", "w1", "w2")
    wanted = asked.withColumn("phrase", name).groupBy("phrase").agg(F.min("terms").alias("terms"))
    found = cut_lineage(find(index, wanted), "hits")
    # Windows that start at one place differ only in length: the longest covers the others.
    spans = located(index, found.groupBy("part", "at").agg(F.max("k").alias("k")))
    hit = (spans.groupBy("part", "first").agg(F.sort_array(F.collect_list(
        F.struct(F.col("at").cast("long").alias("from"), (F.col("at") + F.col("k")).cast("long").alias("to")))).alias("spans"))
        .select("part", "first", _covered(F.col("spans")).alias("n_hit")))
    named = asked.select(name.alias("phrase"), F.col("id").cast("string").alias("item")).distinct()
    items = (located(index, found).select("part", "first", "phrase").distinct().join(named, "phrase")
             .groupBy("part", "first").agg(F.sort_array(F.collect_set("item")).alias("items")))
    n_hit = F.coalesce("n_hit", F.lit(0))
    return (index.texts.join(hit, ["part", "first"], "left").join(items, ["part", "first"], "left")
            .select("doc_id", "n_words", n_hit.alias("n_hit"),
                    F.coalesce("items", F.array().cast("array<string>")).alias("items"),
                    ((n_hit > 0) & (part_of * n_hit >= F.col("n_words"))).alias("contaminated")))
