"""Dated scenes of grid cells and daily images of fires: ids, pairs, triplets, windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlake import skew
from hazardlake.functions.text import non_empty

SCENE_ID = r"HLS\.S30\.(T\w+)\.(\d{4})(\d{3})\."
EVENT_ID = r"^FIRE_(T\w+)_(\d{4})"


def parse_scene_id(col: Column) -> Column:
    """Cell, year, day of year and event of a scene id; null when it does not match."""
    cell = non_empty(F.regexp_extract(col, SCENE_ID, 1))
    year = non_empty(F.regexp_extract(col, SCENE_ID, 2)).cast("int")
    doy = non_empty(F.regexp_extract(col, SCENE_ID, 3)).cast("int")
    return F.when(cell.isNotNull(), F.struct(
        cell.alias("cell"), year.alias("year"), doy.alias("doy"),
        F.concat(F.lit("FIRE_"), cell, F.lit("_"), year.cast("string")).alias("event")))


def parse_event_id(col: Column) -> Column:
    """Title, description, cell and year of an event id; plain defaults otherwise."""
    cell = F.regexp_extract(col, EVENT_ID, 1)
    year = F.regexp_extract(col, EVENT_ID, 2)
    known = cell != ""
    return F.struct(
        F.when(known, F.concat(F.lit("Wildfire Event — "), cell, F.lit(" ("), year, F.lit(")"))).otherwise(col).alias("title"),
        F.when(known, F.concat(F.lit("Burn-scar observations at MGRS grid cell "), cell, F.lit(" during "), year))
        .otherwise(F.lit("")).alias("description"),
        F.lit("Wildfire / Burn Scar").alias("event_type"), cell.alias("mgrs"),
        F.coalesce(non_empty(year).cast("int"), F.lit(0)).alias("year"), F.lit("complete").alias("status"))


def doy_date(year: Column, doy: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), doy.cast("int") - 1)


# limits on the earlier and the later burn of a pair, by kind
PAIR_KINDS = {
    "good": (None, None, 5.0),
    "both_burnt": (2.0, None, 10.0),
    "clean_before": (None, 5.0, 5.0),
}


def top_pairs(df: DataFrame, k: int, kind: str = "good") -> DataFrame:
    """The ``k`` pairs of a cell's scenes with the largest rise in burn, earlier to later date.

    Every pair among the best ``k`` has a later scene whose best rise is among the best
    ``k`` such rises. So the best rise per scene comes from a running minimum, the top
    ``k`` later scenes (that many rows) are broadcast, and only their pairs are formed.
    """
    above, below, later = PAIR_KINDS[kind]
    ok = F.lit(True)
    if above is not None:
        ok = ok & (F.col("burn_pct") > above)
    if below is not None:
        ok = ok & (F.col("burn_pct") < below)
    base = df.select("cell", "scene", "day", "burn_pct")
    ranked = skew.best_before(base.withColumn("low", F.when(ok, F.col("burn_pct"))), ["cell"], "day", "low")
    heads = (ranked.filter((F.col("burn_pct") > F.col("best")) & (F.col("burn_pct") > later))
             .orderBy((F.col("burn_pct") - F.col("best")).desc(), "cell", "day", "scene").limit(k)
             .select("cell", F.col("scene").alias("scene2"), F.col("day").alias("day2"),
                     F.col("burn_pct").alias("burn2")))
    pairs = (base.filter(ok).join(F.broadcast(heads), "cell")
             .filter((F.col("day") < F.col("day2")) & (F.col("burn2") > F.col("burn_pct")))
             .withColumn("delta", F.col("burn2") - F.col("burn_pct")))
    return (pairs.orderBy(F.col("delta").desc(), "cell", "day2", "scene2", "day", "scene").limit(k)
            .select("cell", F.col("scene").alias("scene1"), F.col("day").alias("day1"),
                    F.col("burn_pct").alias("burn1"), "scene2", "day2", "burn2", "delta"))


def best_rise(df: DataFrame) -> DataFrame:
    """For each scene the lowest earlier burn of its cell and the rise from it, if any."""
    ranked = skew.best_before(df.select("cell", "scene", "day", "burn_pct"), ["cell"], "day", "burn_pct")
    return (ranked.filter((F.col("burn_pct") > F.col("best")) & (F.col("burn_pct") > 5))
            .withColumn("delta", F.col("burn_pct") - F.col("best")))


def fire_triplets(df: DataFrame) -> DataFrame:
    """Before, during and after scene per cell with at least two scenes.

    During has the largest burn (at least 5). Before has the smallest burn among earlier
    scenes or, when there is none, among all others, which may be a later scene
    (``before_is_later``). After has the smallest burn among the later scenes that are not
    the before scene. Equal burns go to the earliest scene.
    """
    s = F.struct("burn_pct", "day", "scene")
    late = F.struct(F.col("burn_pct"), -F.unix_date("day"), -F.col("scene"))
    peak = df.groupBy("cell").agg(F.max_by(s, late).alias("during"), F.count(F.lit(1)).alias("n_dates"))
    peak = peak.filter((F.col("n_dates") >= 2) & (F.col("during.burn_pct") >= 5))
    others = (skew.lookup(df.select("cell", "scene", "day", "burn_pct"),
                          peak.select("cell", F.col("during.day").alias("pday"),
                                      F.col("during.scene").alias("pscene")),
                          ["cell"], "inner")
              .filter(F.col("scene") != F.col("pscene"))
              .withColumn("side", F.when(F.col("day") < F.col("pday"), "earlier")
                          .when(F.col("day") > F.col("pday"), "later").otherwise("same")))
    low = skew.top_per_key(others, ["cell", "side"], [F.col("burn_pct"), F.col("day"), F.col("scene")], 2)

    def pick(side: str, rank: int) -> Column:
        return F.min(F.when((F.col("side") == side) & (F.col("rank") == rank), s))

    sides = low.groupBy("cell").agg(pick("earlier", 1).alias("e1"), pick("same", 1).alias("s1"),
                                    pick("later", 1).alias("l1"), pick("later", 2).alias("l2"))
    before = F.coalesce("e1", F.least("s1", "l1"))
    out = peak.join(sides, "cell").withColumn("before", before)
    return (out.withColumn("after", F.when(F.col("l1.scene") != F.col("before.scene"), F.col("l1")).otherwise(F.col("l2")))
            .select("cell", "before", "during", "after", "n_dates",
                    (F.col("during.burn_pct") - F.col("before.burn_pct")).alias("burn_delta"),
                    (F.col("before.day") > F.col("during.day")).alias("before_is_later")))


def order_locations(triplets: DataFrame, n: int) -> DataFrame:
    return triplets.orderBy(F.col("burn_delta").desc(), "cell").limit(n)


def progressing_cells(df: DataFrame) -> DataFrame:
    """Cells with three or more scenes, a burn above 30 and one below 10."""
    return (df.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("burn_pct").alias("max_burn"),
                                   F.min("burn_pct").alias("min_burn"))
            .filter("n >= 3 and max_burn > 30 and min_burn < 10"))


def cell_dates(df: DataFrame) -> DataFrame:
    """Scenes per cell with the list of dates, ``year-doy(split initial)``.

    Equal dates are counted first (``×n``), so a list has at most one entry per date and
    split however many scenes a cell has.
    """
    per = df.groupBy("cell", "year", "doy", "split").agg(F.count(F.lit(1)).alias("n"))
    text = F.concat(F.col("year").cast("string"), F.lit("-"), F.lpad(F.col("doy").cast("string"), 3, "0"), F.lit("("),
                    F.substring("split", 1, 1), F.lit(")"),
                    F.when(F.col("n") > 1, F.concat(F.lit("×"), F.col("n").cast("string"))).otherwise(F.lit("")))
    return per.groupBy("cell").agg(F.sum("n").alias("n"), F.concat_ws(
        ", ", F.array_sort(F.collect_list(text))).alias("dates"))


def fire_events(df: DataFrame) -> DataFrame:
    """Events by cell and year."""
    event = F.concat(F.lit("FIRE_"), F.col("cell"), F.lit("_"), F.col("year").cast("string"))
    return df.groupBy(event.alias("event")).agg(
        F.count(F.lit(1)).alias("n_tiles"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def order_tiles(df: DataFrame) -> DataFrame:
    """Chronological position of each tile in its event.

    Numbered by date and, inside a date, by ranges of 65,536 scene numbers: a piece holds at
    most that many scenes, however many an event or a date has.
    """
    cut = df.withColumn("__range", F.shiftright("scene", 16))
    return skew.rank_in_segments(cut, ["event"], ["day", "__range"], ["scene"], "position").drop("__range")


def tile_split(df: DataFrame, index: DataFrame) -> DataFrame:
    """Source split of each tile, 'training' when the index does not know it."""
    return df.join(index.select("scene", "source_split"), "scene", "left").fillna("training", ["source_split"])


def phase_summary(df: DataFrame) -> DataFrame:
    """Mean scores before and during, after only where positive, and burn deltas."""
    return df.agg(F.count(F.lit(1)).alias("n"),
                  F.avg("before_f1").alias("avg_before"), F.avg("during_f1").alias("avg_during"),
                  F.coalesce(F.avg(F.when(F.col("after_f1") > 0, F.col("after_f1"))), F.lit(0.0)).alias("avg_after"),
                  F.count_if(F.col("after_f1") > 0).alias("n_with_after"),
                  F.avg("burn_delta").alias("avg_delta"), F.max("burn_delta").alias("max_delta"))


# --- days of a fire -----------------------------------------------------------------------

def fire_days(df: DataFrame) -> DataFrame:
    """Distinct days per fire. A fire then has at most one row per calendar day."""
    return df.select("fire", "day").distinct()


def day_pairs(df: DataFrame) -> DataFrame:
    """Each day with the next image day of the same fire."""
    w = Window.partitionBy("fire").orderBy("day")
    return fire_days(df).withColumn("next_day", F.lead("day").over(w)).filter(F.col("next_day").isNotNull())


def day_windows(df: DataFrame, n: int = 4) -> DataFrame:
    """``n`` consecutive image days and the day after as label."""
    w = Window.partitionBy("fire").orderBy("day")
    leads = [F.lead("day", i).over(w) for i in range(n)]
    return (fire_days(df).select("fire", F.array(*leads).alias("days"), F.lead("day", n).over(w).alias("label_day"))
            .filter(F.col("label_day").isNotNull()))


def trailing_windows(df: DataFrame, n: int = 4) -> DataFrame:
    """``n`` consecutive image days named by the last one."""
    w = Window.partitionBy("fire").orderBy("day")
    lags = [F.lag("day", i).over(w) for i in range(n - 1, -1, -1)]
    return (fire_days(df).select("fire", F.array(*lags).alias("days"), F.col("day").alias("last_day"))
            .filter(F.col("days")[0].isNotNull()))


def fire_listing(df: DataFrame, size: str) -> DataFrame:
    """Days and bytes per fire, per year and in total, in one pass."""
    per_day = df.groupBy(F.year("day").alias("year"), "fire", "day").agg(F.sum(size).alias("bytes"))
    c = F.col
    return per_day.groupingSets(
        [[c("year"), c("fire")], [c("year")], []], c("year"), c("fire")
    ).agg(F.count(F.lit(1)).alias("n_days"), F.sum("bytes").alias("bytes"), F.grouping_id().alias("level"))


def select_fires(listing: DataFrame, n: int, ids: list | None = None, year: int | None = None) -> DataFrame:
    """Fires by id, else the first ``n`` of a year by id, else the ``n`` longest."""
    fires = listing.filter(F.col("fire").isNotNull())
    if ids:
        return fires.filter(F.col("fire").isin(ids))
    if year is not None:
        return fires.filter(F.col("year") == year).orderBy("fire").limit(n)
    return fires.orderBy(F.col("n_days").desc(), "year", "fire").limit(n)


def draw(keys: list[str], seed: int) -> Column:
    """A 60-bit number that depends on the keys and the seed only, the same on any engine:
    the first 15 digits of the md5 of ``seed:key:key``."""
    name = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def sample_n(df: DataFrame, n: int, seed: int, key: list[str]) -> DataFrame:
    """Seeded sample without replacement, given back in key order."""
    lucky = df.orderBy(draw(key, seed), *key).limit(n)
    return lucky.orderBy(*key)


def split_fires(df: DataFrame, seed: int, share: float = 0.8, key: str = "fire") -> DataFrame:
    """Whole fires to 'train' or 'val' by seeded hash order; at least one trains."""
    fires = df.select(key).distinct().withColumn("__h", draw([key], seed))
    ranked = skew.global_rank(fires, "__h", "rank", (key,))
    total = fires.agg(F.count(F.lit(1))).scalar()
    ranked = ranked.withColumn("total", total)
    cut = F.greatest(F.lit(1), F.floor(F.col("total") * share))
    return ranked.select(key, F.when(F.col("total") < 2, "both").when(F.col("rank") <= cut, "train")
                         .otherwise("val").alias("split"))


def split_windows(windows: DataFrame, assignment: DataFrame, key: str = "fire") -> DataFrame:
    """Windows with the split of their fire."""
    return skew.lookup(windows, assignment, [key], "inner")


def pair_with_other(df: DataFrame, seed: int, key: str) -> DataFrame:
    """Give every sample another one as its reference: the next in seeded hash order."""
    ranked = skew.global_rank(df.select(key).withColumn("__h", draw([key], seed)), "__h", "rank", (key,))
    total = df.agg(F.count(F.lit(1))).scalar()
    nxt = ranked.withColumn("total", total).withColumn("rank", F.pmod(F.col("rank"), F.col("total")) + 1)
    return (nxt.select(key, "rank")
            .join(ranked.select(F.col(key).alias(f"ref_{key}"), "rank"), "rank").drop("rank"))
