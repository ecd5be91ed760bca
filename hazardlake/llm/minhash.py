"""Near-duplicate documents by min-max hashing.

Every document is the set of its distinct word shingles. Each permutation is evaluated once
per shingle and gives two signature values, its minimum and its maximum, so half the
evaluations of plain minhash fill a signature. Two permutations (four values) make a band;
documents that share a band are candidates, and candidates are linked only after their full
sets were compared.

Nothing is paired that need not be. Equal sets are one class with one representative. A
candidate is first compared with the smallest representative it shares a band with; what this
already joins needs no further comparison for the components. Members of bands that still hold
several components are then paired by their rarest shingles, a filter that loses no link, and
all such pairs of different components are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.llm import words
from hazardlake.llm.graph import components
from hazardlake.session import cut_lineage

U = np.uint64


def _shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a slice."""
    start, end, doc = words.bounds(data, offsets, words.SPACE_FREE)
    word = words.hashes(data, start, end, words.LOWER)
    value, first = words.windows(word, doc, k)
    n = len(offsets) - 1
    per = words.counts(doc, n)
    cut = np.searchsorted(doc[first], np.arange(n + 1))
    begin = np.cumsum(per) - per
    out = []
    for i in range(n):
        if per[i] >= k:
            out.append(np.unique(value[cut[i]: cut[i + 1]]))
        else:
            out.append(words.sequence(word[begin[i]: begin[i] + per[i]]) if per[i] else np.zeros(0, U))
    return out


def _signature(sets: list[np.ndarray], bands: int) -> np.ndarray:
    """One key per band from minima and maxima; sets must not be empty."""
    sizes = np.array([len(s) for s in sets])
    flat, at = np.concatenate(sets), np.cumsum(sizes) - sizes
    rng = np.random.default_rng(613)
    times, plus = rng.integers(0, 2**64, 2 * bands, dtype=U) | U(1), rng.integers(0, 2**64, 2 * bands, dtype=U)
    key = np.empty((len(sets), bands), U)
    for b in range(bands):
        got = np.full(len(sets), b + 1, U)
        for p in (2 * b, 2 * b + 1):
            x = flat * times[p]
            x ^= plus[p]
            x *= U(0x9E3779B97F4A7C15)
            for ends in (np.minimum, np.maximum):
                got = words.mix(got * U(0x9FB21C651E98DF25) + ends.reduceat(x, at))
        key[:, b] = got
    return key


def signatures(docs: DataFrame, k: int = 4, bands: int = 32, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, f1, f2, bands) of every row; f1 and f2 are a 128-bit print of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in words.slices(batch, "text"):
                sets = _shingles(data, offsets, k)
                n = np.array([len(s) for s in sets])
                some = [s for s in sets if len(s)]
                prints, keys = np.zeros((len(sets), 2), U), np.zeros(0, U)
                if some:
                    at = np.cumsum(n[n > 0]) - n[n > 0]
                    flat = np.concatenate(some)
                    prints[n > 0, 0] = np.add.reduceat(flat, at)
                    prints[n > 0, 1] = np.add.reduceat(words.mix(flat ^ U(0x5851F42D4C957F2D)), at)
                    keys = _signature(some, bands).ravel()
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo), pa.array(n, pa.int64()),
                     pa.array(words.signed(prints[:, 0].copy())), pa.array(words.signed(prints[:, 1].copy())),
                     words.lists(words.signed(keys), np.where(n > 0, bands, 0))],
                    ["id", "n_shingles", "f1", "f2", "bands"])

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, f1 long, f2 long, bands array<long>")


def shingle_sets(docs: DataFrame, k: int = 4) -> DataFrame:
    """(id, shingles) of rows (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in words.slices(batch, "text"):
                sets = _shingles(data, offsets, k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(lo, hi - lo),
                     words.lists(words.signed(np.concatenate(sets)), np.array([len(s) for s in sets]))],
                    ["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles array<long>")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    return (pairs.join(left, "a").join(right, "b")
            .filter(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b"))


def _unjoined(nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can be similar enough; none that is gets lost.

    Of two similar sets, the rarest ``n - ceil(percent * n / 100) + 1`` shingles share one, in
    any order that all sets use. At the first they share, what is left of either set bounds
    the intersection. A set whose rare shingles are its own meets nobody here, so copies with
    many changes are not paired with all members of a large group.
    """
    size = F.size("shingles")
    mine = sets.join(nodes, "id").select("id", "c", size.alias("n"), F.explode("shingles").alias("s"))
    often = mine.groupBy("s").agg(F.count(F.lit(1)).alias("often"))
    ranked = mine.join(often, "s").groupBy("id", "c", "n").agg(F.sort_array(F.collect_list(F.struct("often", "s"))).alias("x"))
    prefix = F.slice("x", 1, (F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1).cast("int"))
    rare = cut_lineage(ranked.select("id", "c", "n", F.posexplode(prefix).alias("p", "y"))
                       .filter("y.often > 1").select("id", "c", "n", "p", F.col("y.s").alias("s")), "rare")
    a = rare.select("s", *[F.col(x).alias(x + "a") for x in ("id", "c", "n", "p")])
    b = rare.select("s", *[F.col(x).alias(x + "b") for x in ("id", "c", "n", "p")])
    most = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    fits = (100 + percent) * most >= percent * (F.col("na") + F.col("nb"))
    return (a.join(b, "s").filter((F.col("ida") > F.col("idb")) & (F.col("ca") != F.col("cb")) & fits)
            .select(F.col("ida").alias("a"), F.col("idb").alias("b")).distinct())


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 80, bands: int = 32, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row of ``docs``.

    Words are runs of anything but ASCII white space, A-Z lowered. A row with fewer than
    ``k`` words has its whole sequence as one shingle; a null, empty or blank text has none,
    links with nothing and is kept. Rows are linked when ``100 * shared >= percent * united``;
    ``component_id`` is the smallest id reachable over links and ``kept`` marks that row.
    Ids should be unique; repeated rows get equal results, rows with
    one id and several texts are one node, and a row without id is kept with a null component. At similarity 0.8 a pair is missed by all 32 bands with a
    probability below 1e-6. An empty table gives no rows; other columns are not looked at.
    """
    rows = cut_lineage(signatures(docs, k, bands, doc_id, text), "signatures")
    classes = cut_lineage(rows.filter("n_shingles > 0 and id is not null").groupBy("f1", "f2", "n_shingles")
                          .agg(F.min("id").alias("rep")), "classes")
    reps = rows.join(classes.select("rep", F.col("f1").alias("g1")), (F.col("id") == F.col("rep")) & (F.col("f1") == F.col("g1")))
    keys = reps.select("id", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last")).filter("hub < last")
    members = cut_lineage(keys.join(shared.select("key", "hub"), "key"), "members")

    # Every member with the smallest row that shares one of its bands.
    first = members.filter("id > hub").groupBy(F.col("id").alias("a")).agg(F.min("hub").alias("b"))
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    wanted = members.select(F.col("id").alias("wanted")).distinct()
    sets = cut_lineage(shingle_sets(texts.join(wanted, F.col("id") == F.col("wanted"), "left_semi"), k)
                       .groupBy("id").agg(F.min("shingles").alias("shingles")), "sets")
    links = cut_lineage(_confirmed(first, sets, percent), "confirmed")
    label = components(links, "a", "b")

    # Members of bands that still hold more than one component.
    named = (members.join(label, members["id"] == label["node"], "left")
             .select("key", "id", F.coalesce("component", "id").alias("c")))
    mixed = named.groupBy("key").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).filter("c1 < c2").select("key")
    named = cut_lineage(named.join(mixed, "key", "left_semi").select("id", "c").distinct(), "mixed")
    left = _unjoined(named, sets, percent).join(first, ["a", "b"], "left_anti")
    more = cut_lineage(_confirmed(left, sets, percent), "confirmed")
    label = components(links.union(more), "a", "b")

    class_of = rows.select("id", "n_shingles", "f1", "f2").join(
        classes, ["f1", "f2", "n_shingles"], "left")
    out = class_of.join(label, F.col("rep") == F.col("node"), "left")
    return (out.select("id", "n_shingles", F.coalesce("component", "rep", "id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))))
