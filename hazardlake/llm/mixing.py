"""Mixing sources to target weights with a low-discrepancy schedule.

The mix is a sequence of slots, each one block of equally many words. Slot i looks at point
frac(i * golden ratio), which the cumulated targets map to a source; the r-th slot of a source
takes that source's r-th block. A source's blocks cut its documents, laid end to end in a
keyed shuffle, and start again from the first when the source is used up. So every stretch of
the mix is close to the target weights, and each source gives its target to the word.

Nothing is ordered in one task: running sums and ranks are taken inside pieces whose number
is about the square root of the rows, and then over the pieces.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
GOLDEN = (math.sqrt(5) - 1) / 2
_ROWS = (Window.unboundedPreceding, -1)


def _before(value: str | Column, *, by: list[str], order: list) -> Column:
    return F.coalesce(F.sum(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(*_ROWS)), F.lit(0))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, key, size): words of every row; ``key`` is never null."""
    return docs.select("doc_id", "source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("key"),
                       F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5,
            cap: float = 2.0) -> DataFrame:
    """(key, source_size, rows, weight, target, low, high) of every source.

    Sources by code point, null last, weigh ``weights`` in turn and share ``share`` of all
    words. No target exceeds ``cap`` times its source; the excess goes to the others by
    weight. Both hold for ``least(cap * size, level * weight)`` at one common level, found
    over the sources in the order in which they reach their cap. ``low`` and ``high`` bound
    the source's part of the unit interval.
    """
    one = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    by_cap = [F.col("full") / F.col("weight"), "key"]
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    t = (sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
         .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1))
         .withColumn("full", cap * F.col("source_size"))
         .withColumn("all", F.sum("source_size").over(one) * share)
         .withColumn("capped", _before("full", by=[], order=by_cap))
         .withColumn("open", F.sum("weight").over(one) - _before("weight", by=[], order=by_cap))
         .withColumn("level", (F.col("all") - F.col("capped")) / F.col("open"))
         .withColumn("level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("full"), F.col("level"))).over(one))
         .withColumn("target", F.least("full", F.coalesce(F.col("level") * F.col("weight"), F.col("full"))))
         .withColumn("sum", F.sum("target").over(one)))
    low = _before("target", by=[], order=["key"])
    return t.select("key", "source_size", "rows", "weight", "target",
                    F.when(F.col("sum") > 0, low / F.col("sum")).otherwise(0.0).alias("low"),
                    F.when(F.col("sum") > 0, (low + F.col("target")) / F.col("sum")).otherwise(0.0).alias("high"))


def placed(sizes: DataFrame, sources: DataFrame, seed: int = 17) -> DataFrame:
    """Each row with ``row`` (distinct in its source and piece) and ``at``, its first word's
    place in the shuffled source."""
    spread = F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1))
    bits = F.ceil(F.log2(F.greatest(F.col("rows"), F.lit(1))) / 2).cast("int")
    rows = (sizes.join(sources.select("key", "rows", "source_size", "target"), "key")
            .withColumn("h", spread).withColumn("bits", bits)
            .withColumn("piece", F.expr("shiftright(h, 62 - bits)")))
    order = ["h", "doc_id", "size"]
    inner = Window.partitionBy("key", "piece").orderBy(*order)
    totals = rows.groupBy("key", "piece").agg(F.sum("size").alias("n"))
    totals = totals.select("key", "piece", _before("n", by=["key"], order=["piece"]).alias("base"))
    return (rows.withColumn("row", F.row_number().over(inner))
            .withColumn("at", F.sum("size").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
            .join(totals, ["key", "piece"]).withColumn("at", F.col("at") + F.col("base"))
            .select("doc_id", "key", "piece", "row", "size", "at", "source_size", "target"))


def schedule(sources: DataFrame, block_words: int = 4096) -> DataFrame:
    """(slot, key, rank, epoch, block, first, last): words [first, last) of a source per slot.

    Slots beyond a source's target are left out, its last one is cut to the word, and the few
    blocks that the points fall short of are appended with the slots after all others.
    """
    spark = sources.sparkSession
    n_sources, words = sources.agg(F.count(F.lit(1)), F.coalesce(F.sum("target"), F.lit(0.0))).first()
    slots, cells = max(0, math.ceil(words / block_words)), max(1, 4 * n_sources)
    run = max(1, math.isqrt(slots))
    half = 1 << 20  # i * ratio in two parts, so the fraction keeps its digits
    i = F.col("id")
    point = ((i / half).cast("long") * math.fmod(half * GOLDEN, 1.0)) % 1.0 + (i % half) * GOLDEN
    points = spark.range(slots).select(i.alias("slot"), (point % 1.0).alias("p"))
    need = sources.select(
        "key", "low", "high", "source_size", F.floor("target").alias("words"),
        F.ceil(F.col("source_size") / block_words).alias("per_epoch")).filter("words > 0")
    need = need.withColumn("full", F.expr("words div source_size")).withColumn(
        "rest", F.col("words") - F.col("full") * F.col("source_size")).withColumn(
        "need", F.col("full") * F.col("per_epoch") + F.ceil(F.col("rest") / block_words))
    cell = lambda c: F.least(F.floor(F.col(c) * cells), F.lit(cells - 1))
    spans = need.select("key", "low", "high", F.explode(F.sequence(cell("low"), cell("high"))).alias("cell"))
    hit = (points.withColumn("cell", cell("p")).join(spans, "cell").filter("p >= low and p < high")
           .select("slot", "key", F.expr(f"slot div {run}").alias("run")))
    counts = hit.groupBy("key", "run").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("key", "run", _before("n", by=["key"], order=["run"]).alias("base"))
    ranked = (hit.withColumn("r", F.row_number().over(Window.partitionBy("key", "run").orderBy("slot")))
              .join(base, ["key", "run"]).select("slot", "key", (F.col("base") + F.col("r") - 1).alias("rank")))
    have = counts.groupBy("key").agg(F.sum("n").alias("have"))
    short = (need.join(have, "key", "left").withColumn("have", F.coalesce("have", F.lit(0))).filter("have < need")
             .select("key", F.explode(F.expr("sequence(have, need - 1)")).alias("rank"))
             .select(F.lit(slots).cast("long").alias("slot"), "key", "rank"))
    block, epoch = F.pmod("rank", "per_epoch"), F.expr("rank div per_epoch")
    first = block * block_words
    end = F.when(epoch < F.col("full"), F.col("source_size")).otherwise(F.col("rest"))
    return (ranked.unionByName(short).join(need, "key").filter("rank < need")
            .select("slot", "key", "rank", epoch.alias("epoch"), block.alias("block"), first.alias("first"),
                    F.least(first + block_words, end).alias("last")))


def taken(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0,
          block_words: int = 4096) -> DataFrame:
    """(doc_id, size, source_size, target, taken, first_slot, n_slots) of every row of ``docs``.

    ``taken`` counts the words the mix takes of the row over all slots, ``first_slot`` is the
    first slot that takes a word of it (null if none does) and ``n_slots`` their number. A null or blank text
    has size 0 and gives nothing; a null source is a source of its own, a null id an ordinary
    value, and repeated rows are separate rows. ``share`` must be below ``cap``. An empty
    table gives no rows; other columns are not looked at.
    """
    sizes = cut_lineage(sized(docs), "sizes")
    sources = cut_lineage(targets(sizes, weights, share, cap), "sources")
    used = (schedule(sources, block_words).groupBy("key", "block", "first", "last")
            .agg(F.count(F.lit(1)).alias("times"), F.min("slot").alias("slot")))
    rows = placed(sizes, sources)
    b = block_words
    span = F.when(F.col("size") > 0, F.expr(f"sequence(at div {b}, (at + size - 1) div {b})"))
    cut = rows.withColumn("block", F.explode_outer(span))
    words = F.least(F.col("at") + F.col("size"), F.col("last")) - F.greatest("at", "first")
    hit = words > 0
    return (cut.join(used, ["key", "block"], "left")
            .groupBy("key", "piece", "row", "doc_id", "size", "source_size", "target")
            .agg(F.coalesce(F.sum(F.greatest(words, F.lit(0)) * F.col("times")), F.lit(0)).alias("taken"),
                 F.min(F.when(hit, F.col("slot"))).alias("first_slot"), F.coalesce(F.sum(F.when(hit, F.col("times"))), F.lit(0)).alias("n_slots"))
            .select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"), "first_slot", "n_slots"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them: ``taken / size``, rounded.

    Only the document in which a source's last slot ends is taken in part, so rounding moves
    a source by less than one document. Rows that share an id are repeated alike.
    """
    times = (taken(docs, **how).groupBy("doc_id").agg(F.sum("taken").alias("t"), F.sum("size").alias("s"))
             .filter("t > 0")
             .select(F.col("doc_id").alias("__id"), F.round(F.col("t") / F.col("s")).cast("int").alias("__times"))
             .filter("__times > 0"))
    return (docs.join(times, docs["doc_id"].eqNullSafe(times["__id"]))
            .withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(*docs.columns))
