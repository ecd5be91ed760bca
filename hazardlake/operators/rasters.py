"""Tiles as rows of band arrays, and pixels as rows.

A tile is one row (event, tile, phase, height, width, row-major band arrays). Tiles are
what gets stored, joined and shuffled; pixels exist only inside a task, between an
explode and a partial aggregate. The two images of a pair meet as tiles, so no pixel key
is ever shuffled, and a tile has a fixed pixel count, which bounds every group below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake.functions import spectral as P
from hazardlake.functions.let import let

TILE = ["event", "tile"]


def explode_pixels(tiles: DataFrame, bands: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row per pixel with position, row, column and band values."""
    keep = TILE + ["phase"] if keep is None else keep
    zipped = F.arrays_zip(*[F.col(b) for b in bands])
    # the array length of the tile, not a scan of it, sizes the explode
    out = tiles.select(*keep, "width", F.posexplode(zipped).alias("pos", "px"))
    return out.select(*keep, "pos", (F.col("pos") / F.col("width")).cast("int").alias("row"),
                      (F.col("pos") % F.col("width")).alias("col"),
                      *[F.col("px")[b].alias(b) for b in bands])


def collect_tile(pixels: DataFrame, value: str, keys: list[str] | None = None, zero_to_null: bool = False) -> DataFrame:
    """Pixels back to one array per tile; a mask writer turns 0 into nodata."""
    keys = TILE if keys is None else keys
    v = F.nullif(F.col(value), F.lit(0)) if zero_to_null else F.col(value)
    got = pixels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", v.alias("v")))).alias("x"))
    return got.select(*keys, F.transform("x", lambda p: p["v"]).alias(value))


def pair_phases(tiles: DataFrame, bands: list[str], a: str = "before", b: str = "during") -> DataFrame:
    """Before and during of the same tile in one row; tiles with one phase drop out."""
    left = tiles.filter(F.col("phase") == a).select(*TILE, "height", "width", *[F.col(c).alias(f"{a}_{c}") for c in bands])
    right = tiles.filter(F.col("phase") == b).select(*TILE, *[F.col(c).alias(f"{b}_{c}") for c in bands])
    return left.join(right, TILE)


def align_pixels(tiles: DataFrame, band: str = "v") -> DataFrame:
    """Pixel pairs of the two phases: b before, d during."""
    pair = pair_phases(tiles, [band]).withColumnsRenamed({f"before_{band}": "b", f"during_{band}": "d"})
    return explode_pixels(pair, ["b", "d"], TILE)


def common_tiles(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*TILE).intersect(b.select(*TILE))


def attach(df: DataFrame, side: DataFrame, keys: list[str] | None = None, defaults: dict | None = None) -> DataFrame:
    """Left join of a per-tile table; absent values stay null or take their default."""
    out = df.join(side, TILE if keys is None else keys, "left")
    for name, value in (defaults or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def prefer_water(optical: DataFrame, radar: DataFrame, mask: str = "mask") -> DataFrame:
    """Optical water mask where there is one, else the radar mask, per tile and phase."""
    keys = TILE + ["phase"]
    r = radar.select(*keys, F.col(mask).alias("__r"))
    out = optical.join(r, keys, "full_outer")
    return out.select(*keys, F.coalesce(F.col(mask), F.col("__r")).alias(mask),
                      F.when(F.col(mask).isNotNull(), "optical").otherwise("radar").alias("source"))


# --- change -------------------------------------------------------------------------------

def change_stats(px: DataFrame, before: Column, during: Column, res_m: float, on_zero: str = "inf") -> DataFrame:
    """Pixels and areas before, during, new and receded per tile, and percent increase."""
    got = px.groupBy(*TILE).agg(
        F.count_if(before).alias("before_px"), F.count_if(during).alias("during_px"),
        F.count_if(during & ~before).alias("new_px"), F.count_if(before & ~during).alias("receded_px"))
    return with_areas(got, res_m, on_zero)


def with_areas(counts: DataFrame, res_m: float, on_zero: str) -> DataFrame:
    out = counts
    for name in ("before", "during", "new", "receded"):
        if f"{name}_px" in counts.columns:
            out = out.withColumn(f"{name}_km2", P.area(F.col(f"{name}_px"), res_m))
    return out.withColumn("pct_increase", P.pct_increase(F.col("new_px"), F.col("before_px"), on_zero))


def change_stats_or(px: DataFrame, before: Column, during: Column, pred: Column, res_m: float) -> DataFrame:
    """Change with a second predictor: during is water or predicted; no before means all new."""
    b = F.coalesce(before, F.lit(False))
    total = F.coalesce(during, F.lit(False)) | pred
    got = px.groupBy(*TILE).agg(
        F.count_if(b).alias("before_px"), F.count_if(total).alias("during_px"),
        F.count_if(total & ~b).alias("new_px"), F.count_if(pred).alias("flood_pred_pixels"))
    return with_areas(got, res_m, "zero").withColumn("pred_km2", P.area(F.col("flood_pred_pixels"), res_m))


def extent_metrics(px: DataFrame, mask: Column, res_m: float, pre: Column | None = None) -> DataFrame:
    """Flood extent of one mask and, with a pre-event mask, its change."""
    aggs = [F.count_if(mask).alias("flood_pixels"), F.count(F.lit(1)).alias("total_pixels")]
    if pre is not None:
        aggs += [F.count_if(pre).alias("pre_pixels"), F.count_if(mask & ~pre).alias("new_pixels"),
                 F.count_if(~mask & pre).alias("receded_pixels")]
    out = px.groupBy(*TILE).agg(*aggs)
    out = out.withColumns({
        "flood_fraction": F.col("flood_pixels") / F.greatest(F.col("total_pixels"), F.lit(1)),
        "area_m2": P.area(F.col("flood_pixels"), res_m, "m2"), "area_km2": P.area(F.col("flood_pixels"), res_m)})
    if pre is not None:
        out = out.withColumns({
            **{f"{n}_km2": P.area(F.col(f"{n}_pixels"), res_m) for n in ("pre", "new", "receded")},
            "change_pct": P.pct_increase(F.col("new_pixels"), F.col("pre_pixels"), "one")})
    return out


def category_area(px: DataFrame, before: Column, during: Column, res_m: float, unit: str = "km2") -> DataFrame:
    """Area per tile and change category."""
    got = px.groupBy(*TILE, P.change_class(before, during).alias("category")).agg(F.count(F.lit(1)).alias("n"))
    return got.withColumn("area", P.area(F.col("n"), res_m, unit))


def mask_algebra(a: DataFrame, b: DataFrame, op: str, mask: str = "mask") -> DataFrame:
    """Set algebra of two masks per tile: new = b - a, receded = a - b, permanent, total.

    The masks of a tile are zipped where its two rows meet, so no pixel is shuffled. A tile
    that only one side has counts as empty on the other.
    """
    rules = {"new": lambda x, y: y & ~x, "receded": lambda x, y: x & ~y, "permanent": lambda x, y: x & y, "total": lambda x, y: x | y}
    on = lambda v: F.coalesce(v == 1, F.lit(False))
    left = a.select(*TILE, "width", F.col(mask).alias("__a"))
    right = b.select(*TILE, F.col("width").alias("__w"), F.col(mask).alias("__b"))
    pair = left.join(right, TILE, "full_outer").withColumn("width", F.coalesce("width", "__w"))
    empty = lambda c: F.coalesce(F.col(c), F.array().cast("array<int>"))
    hits = F.zip_with(empty("__a"), empty("__b"), lambda x, y: rules[op](on(x), on(y)).cast("int"))
    px = pair.select(*TILE, "width", F.posexplode(hits).alias("pos", "m")).filter("m = 1")
    return px.select(*TILE, "pos")


def positive_pct(px: DataFrame, mask: Column, keys: list[str] | None = None) -> DataFrame:
    got = px.groupBy(*(TILE if keys is None else keys)).agg(
        F.count_if(mask).alias("n_pos"), F.count(F.lit(1)).alias("n"))
    return got.withColumn("pct", F.col("n_pos") * 100.0 / F.col("n"))


def scene_quality(px: DataFrame, cloud_b: Column, cloud_d: Column, water_b: Column, water_d: Column) -> DataFrame:
    """Cloud and water share before and during, and the increase of water, in percent."""
    pct = lambda c: F.count_if(c) * 100.0 / F.count(F.lit(1))
    got = px.groupBy(*TILE).agg(pct(cloud_b).alias("b_cloud"), pct(cloud_d).alias("d_cloud"),
                                pct(water_b).alias("b_water"), pct(water_d).alias("d_water"))
    return got.withColumn("water_incr", F.col("d_water") - F.col("b_water"))


def best_pairs(quality: DataFrame, cloud: float = 15, rise: float = 2, fallback: int = 10) -> DataFrame:
    """Cloud-free tiles with more water; if there is none, the largest increases."""
    good = quality.filter((F.col("b_cloud") < cloud) & (F.col("d_cloud") < cloud) & (F.col("water_incr") > rise))
    n_good = good.agg(F.count(F.lit(1))).scalar()
    top = quality.orderBy(F.col("water_incr").desc(), *TILE).limit(fallback)
    spare = top.filter(n_good == 0)
    return good.withColumn("choice", F.lit("good")).unionByName(spare.withColumn("choice", F.lit("fallback")))


def band_stats(px: DataFrame, bands: list[str]) -> DataFrame:
    """Min, max and mean per band without NaN; a maximum above 1.1 warns of scaling."""
    long = px.select(F.explode(F.array(*[F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v"))
                                         for b in bands])).alias("x"))
    v = F.when(~F.isnan("x.v"), F.col("x.v"))
    got = long.groupBy("x.band").agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"))
    return got.withColumn("integer_scaled", F.col("max") > 1.1)


# --- per-tile normalisation ----------------------------------------------------------------

def _quantile(ordered: Column, q: float) -> Column:
    """Linearly interpolated quantile of a sorted array, null when it is empty."""
    at = F.lit(q) * (F.size(ordered) - 1)
    low = F.floor(at).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, F.size(ordered) - 1))
    return F.when(F.size(ordered) > 0, a + (b - a) * (at - low))


def stretch(tiles: DataFrame, band: str, lo: float, hi: float, valid: str = "x > 0", eps: float = 1e-6,
            floor: float | None = None) -> DataFrame:
    """Percentile clip and min-max per tile; a flat tile becomes 0.

    Percentiles interpolate linearly over the valid values; ``floor`` fixes the lower
    limit instead. In the rule "x <> 0" NaN and infinity count as 0. Everything a tile needs is in its row, so nothing is grouped or moved.
    """
    def limits(v: Column) -> Column:
        return let(F.sort_array(F.filter(v, lambda x: _rule(valid, x))), lambda ok: F.struct(
            (F.coalesce(_quantile(ok, lo), F.lit(0.0)) if floor is None else F.lit(floor)).alias("lo"),
            F.coalesce(_quantile(ok, hi), F.lit(1.0)).alias("hi"), F.array_min(v).alias("mn"), F.array_max(v).alias("mx")))

    def clipped(x: Column, q: Column) -> Column:
        return F.greatest(q["lo"], F.least(q["hi"], x))

    def scaled(v: Column, q: Column) -> Column:
        # the extremes of a clipped band are the clipped extremes
        return let(F.struct(clipped(q["mn"], q).alias("a"), clipped(q["mx"], q).alias("z")), lambda e: F.transform(
            v, lambda x: F.when(e["z"] - e["a"] < eps, F.lit(0.0)).otherwise(
                (clipped(x, q) - e["a"]) / F.greatest(e["z"] - e["a"], F.lit(eps)))))

    def number(x: Column) -> Column:
        x = x.cast("double")
        if valid != "x <> 0":
            return x
        return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)

    values = F.transform(band, number)
    return tiles.withColumn(band, let(values, lambda v: let(limits(v), lambda q: scaled(v, q))))


def _rule(valid: str, x: Column) -> Column:
    return {"x > 0": P.above(x, 0), "x <> 0": (x != 0) & ~F.isnan(x), "all": F.lit(True)}[valid]


def _valid(x: Column, skip_zero: bool) -> Column:
    ok = x.isNotNull() & ~F.isnan(x)
    return ok & (x != 0) if skip_zero else ok


def zscore_tile(tiles: DataFrame, band: str, skip_zero: bool = False) -> DataFrame:
    """(x - mean) / (population std + 1e-8) over the valid values of each tile row, else 0.

    Valid means a number and, with ``skip_zero``, not 0. Map-only.
    """
    def mean(a: Column) -> Column:
        return F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))

    def stats(ok: Column) -> Column:
        return let(mean(ok), lambda m: F.struct(
            m.alias("mu"), F.sqrt(mean(F.transform(ok, lambda x: (x - m) * (x - m)))).alias("sd")))

    def scaled(v: Column) -> Column:
        return let(stats(F.filter(v, lambda x: _valid(x, skip_zero))), lambda t: F.transform(
            v, lambda x: F.when(_valid(x, skip_zero), (x - t["mu"]) / (t["sd"] + 1e-8)).otherwise(F.lit(0.0))))

    return tiles.withColumn(band, let(F.transform(band, lambda x: x.cast("double")), scaled))


def zscore_window(tiles: DataFrame, band: str, keys: list[str], skip_zero: bool = True) -> DataFrame:
    """The same with statistics shared by all tile rows of a key, such as the days of a window.

    Three sums per tile row are folded to one row per key, which joins back.
    """
    def sums(v: Column) -> Column:
        ok = F.filter(v, lambda x: _valid(x, skip_zero))
        return let(ok, lambda o: F.struct(
            F.size(o).alias("n"), F.aggregate(o, F.lit(0.0), lambda s, x: s + x).alias("s"),
            F.aggregate(o, F.lit(0.0), lambda s, x: s + x * x).alias("q")))

    values = F.transform(band, lambda x: x.cast("double"))
    per = tiles.select(*keys, let(values, sums).alias("t"))
    stats = per.groupBy(*keys).agg(F.sum("t.n").alias("n"), F.sum("t.s").alias("s"), F.sum("t.q").alias("q"))
    mu = F.try_divide(F.col("s"), F.col("n"))
    var = F.try_divide(F.col("q"), F.col("n")) - mu * mu
    stats = stats.select(*keys, mu.alias("mu"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("sd"))
    out = F.transform(band, lambda x: F.when(_valid(x.cast("double"), skip_zero),
                                             (x.cast("double") - F.col("mu")) / (F.col("sd") + 1e-8)).otherwise(F.lit(0.0)))
    return tiles.join(stats, keys).withColumn(band, out).drop("mu", "sd")


def masked_mean(df: DataFrame, keys: list[str], error: str, mask: str) -> DataFrame:
    """Sum of errors over sum of masks (at least 1e-8) per pixel over repeats."""
    return df.groupBy(*keys).agg(
        (F.sum(error) / F.greatest(F.sum(mask), F.lit(1e-8))).alias("anomaly"))


# --- roll-ups -------------------------------------------------------------------------------

def event_summary(tiles: DataFrame) -> DataFrame:
    """Per event: tiles, bounding box, centre of the first tile, area sums and mean F1."""
    return tiles.groupBy("event").agg(
        F.count(F.lit(1)).alias("tile_count"), F.min("west").alias("west"), F.min("south").alias("south"),
        F.max("east").alias("east"), F.max("north").alias("north"),
        F.min_by(F.struct("center_lat", "center_lng"), "tile").alias("center"),
        F.sum("new_km2").alias("total_new_km2"), F.sum("during_km2").alias("total_flooded_km2"),
        F.coalesce(F.avg("f1"), F.lit(0.0)).alias("avg_f1"))


def global_summary(tiles: DataFrame) -> DataFrame:
    """Event rows and the grand total (event null) of one rollup, with the number of events."""
    got = tiles.rollup("event").agg(
        F.count(F.lit(1)).alias("total_tiles"), F.sum("new_km2").alias("total_new_km2"),
        F.sum("during_km2").alias("total_flooded_km2"), F.avg("f1").alias("avg_f1"),
        F.grouping("event").alias("grand"))
    return got.withColumn("total_events", tiles.agg(F.count_distinct("event")).scalar())


def event_meta(df: DataFrame, dim: DataFrame) -> DataFrame:
    """Event details with a generated title where none is known."""
    from hazardlake.skew import lookup

    out = lookup(df, dim, ["event"])
    return out.withColumns({
        "title": F.coalesce("title", F.concat(F.lit("Flood Event "), F.col("event"))),
        "country": F.coalesce("country", F.lit("Unknown"))})


def tile_detail(catalogue: DataFrame, bounds: DataFrame, stats: DataFrame, scores: DataFrame) -> DataFrame:
    """Bounds, centre, statistics and scores of a tile, with flags for what exists."""
    out = catalogue.join(bounds, TILE, "left").join(stats, TILE, "left").join(scores, TILE, "left")
    return out.withColumns({"has_bounds": F.col("west").isNotNull(), "has_stats": F.col("new_px").isNotNull(),
                            "has_scores": F.col("f1").isNotNull()})
