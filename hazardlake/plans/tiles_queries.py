"""Registered queries over tiles and pixels: change, indices, quality, roll-ups."""

from pyspark.sql import functions as F

from hazardlake.functions import geo as G
from hazardlake.functions import lexicons as L
from hazardlake.functions import spectral as P
from hazardlake.operators import rasters as R
from hazardlake.plans import fixtures as A
from hazardlake.plans.common import joined, r
from hazardlake.registry import query

KEY = "event, tile, pos"


def _px(spark, sf):
    px = R.explode_pixels(A.tiles(spark, sf), ["v"])
    return px.withColumn("v", F.col("v").cast("double"))


def _pair(spark, sf):
    px = R.align_pixels(A.tiles(spark, sf))
    return px.withColumns({"b": F.col("b").cast("double"), "d": F.col("d").cast("double")})


def wet_before():
    return F.col("b") > 0


def wet_during():
    return F.col("d") > 0


@query("explode_pixels", "S-10", 'select event, tile, phase, pos::int as pos, "row", col, v from px', ("tiles", "px"))
def _(spark, sf):
    return _px(spark, sf)


@query("collect_tile", "S-11",
       "select event, tile, phase, string_agg(coalesce(nullif((v > 0)::int, 0)::varchar, 'x'), '' order by pos) as mask from px group by all", ("tiles", "px"))
def _(spark, sf):
    px = _px(spark, sf).withColumn("m", (F.col("v") > 0).cast("int"))
    t = R.collect_tile(px, "m", ["event", "tile", "phase"], zero_to_null=True)
    return t.select("event", "tile", "phase", F.array_join("m", "", "x").alias("mask"))


@query("pair_phases", "J-1",
       """select b.event, b.tile, round(b.v[1]::double, 6) as b0, round(d.v[64]::double, 6) as d63 from tiles b join tiles d using (event, tile)
       where b.phase = 'before' and d.phase = 'during'""", ("tiles",))
def _(spark, sf):
    p = R.pair_phases(A.tiles(spark, sf), ["v"])
    return p.select("event", "tile", r(F.col("before_v")[0].cast("double")).alias("b0"), r(F.col("during_v")[63].cast("double")).alias("d63"))


@query("align_pixels", "J-2", 'select event, tile, "row", col, b, d from pair', ("tiles", "px", "pair"))
def _(spark, sf):
    return _pair(spark, sf).select("event", "tile", "row", "col", "b", "d")


@query("common_tiles", "U-1",
       "select event, tile from tiles where phase = 'before' and label % 2 = 0 intersect select event, tile from tiles where phase = 'during' and label % 3 <> 0", ("tiles",))
def _(spark, sf):
    t = A.tiles(spark, sf)
    return R.common_tiles(t.filter("phase = 'before' and label % 2 = 0"), t.filter("phase = 'during' and label % 3 <> 0"))


MASKS = {"new": "d > 0 and not b > 0", "receded": "b > 0 and not d > 0", "permanent": "b > 0 and d > 0", "total": "b > 0 or d > 0"}
for _op, _cond in MASKS.items():
    @query(f"mask_{_op}", "U-3", f"select event, tile, pos::int as pos from pair where {_cond}", ("tiles", "px", "pair"))
    def _(spark, sf, op=_op):
        t = A.tiles(spark, sf).withColumn("mask", F.expr("transform(v, x -> cast(x > 0 as int))"))
        side = lambda p: t.filter(F.col("phase") == p)
        return R.mask_algebra(side("before"), side("during"), op)


STATS = """select event, tile, count(*) filter (b > 0) as before_px, count(*) filter (d > 0) as during_px,
 count(*) filter (d > 0 and not b > 0) as new_px, count(*) filter (b > 0 and not d > 0) as receded_px from pair group by all"""
PCT = {"inf": "case when before_px > 0 then new_px * 100.0 / before_px else 'infinity'::double end",
       "zero": "case when before_px > 0 then new_px * 100.0 / before_px else 0 end",
       "one": "new_px * 100.0 / greatest(before_px, 1)"}

for _mode in ("inf", "zero", "one"):
    @query(f"change_stats_{_mode}", "A-9 X-17 X-18",
           f""", s as ({STATS}) select *, round(before_px * 100.0::double / 1e6, 8) as before_km2, round(during_px * 100.0::double / 1e6, 8) as during_km2,
           round(new_px * 100.0::double / 1e6, 8) as new_km2, round(receded_px * 100.0::double / 1e6, 8) as receded_km2, round(({PCT[_mode]})::double, 6) as pct_increase from s""",
           ("tiles", "px", "pair"))
    def _(spark, sf, mode=_mode):
        out = R.change_stats(_pair(spark, sf), wet_before(), wet_during(), L.FLOOD_RES_M, mode)
        return out.withColumns({**{c: r(c, 8) for c in ("before_km2", "during_km2", "new_km2", "receded_km2")}, "pct_increase": r("pct_increase")})


@query("change_stats_or", "A-10",
       """, q as (select *, d > 0.1 as p, d > 0 as w, tile in (select tile from tiles where phase = 'before' and label <> 3) as has_b from pair),
       s as (select event, tile, count(*) filter (has_b and b > 0) as before_px, count(*) filter (w or p) as during_px,
       count(*) filter ((w or p) and not (has_b and b > 0)) as new_px, count(*) filter (p) as flood_pred_pixels from q group by all)
       select event, tile, before_px, during_px, new_px, flood_pred_pixels, round(new_px / 10000.0, 6) as new_km2,
       round((case when before_px > 0 then new_px * 100.0 / before_px else 0 end)::double, 6) as pct_increase from s""", ("tiles", "px", "pair"))
def _(spark, sf):
    t = A.tiles(spark, sf)
    known = t.filter("phase = 'before' and label <> 3").select("event", "tile", F.lit(True).alias("has_b"))
    px = R.attach(_pair(spark, sf), known)
    out = R.change_stats_or(px, F.when(F.col("has_b"), wet_before()), wet_during(), F.col("d") > 0.1, L.FLOOD_RES_M)
    return out.select("event", "tile", "before_px", "during_px", "new_px", "flood_pred_pixels", r("new_km2").alias("new_km2"), r("pct_increase").alias("pct_increase"))


@query("extent_metrics", "A-11",
       f""", s as ({STATS}) select event, tile, during_px as flood_pixels, 64::bigint as total_pixels, before_px as pre_pixels, new_px as new_pixels, receded_px as receded_pixels,
       round(during_px / 64.0, 6) as flood_fraction, during_px * 100.0::double as area_m2, round(new_px * 100.0 / greatest(before_px, 1), 6)::double as change_pct from s""",
       ("tiles", "px", "pair"))
def _(spark, sf):
    out = R.extent_metrics(_pair(spark, sf), wet_during(), L.FLOOD_RES_M, wet_before())
    return out.select("event", "tile", "flood_pixels", "total_pixels", "pre_pixels", "new_pixels", "receded_pixels",
                      r("flood_fraction").alias("flood_fraction"), "area_m2", r("change_pct").alias("change_pct"))


@query("category_area", "A-29 X-29",
       """select event, tile, case when b > 0 and d > 0 then 'existing' when d > 0 then 'new' when b > 0 then 'receded' else 'none' end as category,
       count(*) as n, round(count(*) * 900.0 / 1e4, 6)::double as area from pair group by all""", ("tiles", "px", "pair"))
def _(spark, sf):
    return R.category_area(_pair(spark, sf), wet_before(), wet_during(), L.FIRE_RES_M, "ha").withColumn("area", r("area"))


@query("positive_pct", "A-18", "select event, tile, count(*) filter (d > 0) as n_pos, count(*) as n, round(100.0 * count(*) filter (d > 0) / count(*), 6)::double as pct from pair group by all", ("tiles", "px", "pair"))
def _(spark, sf):
    return R.positive_pct(_pair(spark, sf), wet_during()).withColumn("pct", r("pct"))


# vv and vh like signals around the limits of the radar rule
RADAR = "b * 100 + 100 as vv0, b * 80 + 95 as vh0, d * 100 + 95 as vv1, d * 80 + 85 as vh1"
DROP = "({p1} < {t} and {p0} > {t} and {p0} - {p1} > 10)"
WEAK = "(vv1 < 75 or vv0 < 75 or vh1 < 70 or vh0 < 70)"


@query("radar_change", "X-23 R-13",
       f""", q as (select event, tile, pos::int as pos, {RADAR} from pair), z as (select event, tile, pos, {DROP.format(p0='vv0', p1='vv1', t=100)} and not {WEAK} as vv,
       {DROP.format(p0='vh0', p1='vh1', t=90)} and not {WEAK} as vh from q)
       select *, case when vv or vh then pos % 2 else 0 end as pred from z""", ("tiles", "px", "pair"))
def _(spark, sf):
    px = _pair(spark, sf).selectExpr("event", "tile", "pos", *RADAR.split(", "))
    c = px.select("event", "tile", "pos", P.radar_change(F.col("vv0"), F.col("vh0"), F.col("vv1"), F.col("vh1")).alias("x"))
    c = c.select("event", "tile", "pos", "x.vv", "x.vh")
    return c.withColumn("pred", P.veto_no_change(F.col("pos") % 2, F.col("vv"), F.col("vh")))


@query("spectral_indices", "X-19 X-20 X-21 X-22",
       """, q as (select event, tile, pos::int as pos, floor(b * 10) as g, floor(d * 10) as n, b, d from pair),
       z as (select *, least(1, greatest(-1, (g - n) / case when g + n = 0 then 1e-10 else g + n end)) as nb, least(255, greatest(0, b * 200 + 135)) as db from q)
       select event, tile, pos, round((g - n) / case when g + n = 0 then 1e-10::double else g + n end, 4) as ndwi_tiny,
       round((g - n) / (g + n + 1e-6::double), 4) as ndwi_shift, round(case when g + n > 0 then (g - n) / (g + n + 1e-6::double) else 0 end, 6)::double as ndwi_null,
       round(nb, 6)::double as nbr, round(db, 6)::double as db, round(case when b > 0 then least(255, greatest(0, 20 * log10(b) + 135)) else 0 end, 6)::double as lin,
       (case when b - d < -0.25 then -2 when b - d < -0.1 then -1 when b - d < 0.1 then 0 when b - d < 0.27 then 1 when b - d < 0.44 then 2 when b - d < 0.66 then 3 else 4 end)::int as severity from z""",
       ("tiles", "px", "pair"))
def _(spark, sf):
    px = _pair(spark, sf).selectExpr("event", "tile", "pos", "b", "d", "cast(floor(b * 10) as double) as g", "cast(floor(d * 10) as double) as n")
    g, n, b, d = (F.col(c) for c in "gnbd")
    return px.select("event", "tile", "pos", r(P.ndwi(g, n, "tiny"), 4).alias("ndwi_tiny"), r(P.ndwi(g, n, "shift"), 4).alias("ndwi_shift"),
                     r(P.ndwi(g, n, "null")).alias("ndwi_null"), r(P.nbr(g, n)).alias("nbr"), r(P.db_scale(b * 100)).alias("db"),
                     r(P.linear_scale(b)).alias("lin"), P.burn_severity(P.dnbr(b, d)).alias("severity"))


@query("nodata_bands", "X-24 X-25",
       """, q as (select event, tile, pos::int as pos, case when floor(b * 20) = 0 then -9999.0::double else b end as x, case when floor(d * 20) = 0 then 'nan'::double else d end as y from pair)
       select event, tile, pos, isnan(y) or abs(x + 9999) <= 0.1 as nodata, round((case when abs(x + 9999) <= 0.1 then 0 else x end - 0.1) / (0.5 + 1e-10), 6)::double as zx,
       round((case when isnan(y) then 0 else y end - 0.2) / (0.25 + 1e-10), 6)::double as zy from q""", ("tiles", "px", "pair"))
def _(spark, sf):
    px = _pair(spark, sf).selectExpr("event", "tile", "pos", "array(if(floor(b * 20) = 0, -9999.0D, b), if(floor(d * 20) = 0, double('NaN'), d)) as bands")
    z = px.select("event", "tile", "pos", P.nodata_mask(F.col("bands")).alias("nodata"),
                  P.band_zscore(P.fill_nodata(F.col("bands")), [0.1, 0.2], [0.5, 0.25]).alias("z"))
    return z.select("event", "tile", "pos", "nodata", r(F.col("z")[0]).alias("zx"), r(F.col("z")[1]).alias("zy"))


@query("select_bands", "F-16",
       "select vec_id, " + ", ".join(f"embedding[{i}]::double as b{i}" for i in L.SIX_OF_THIRTEEN) + " from embeddings")
def _(spark, sf):
    e = A.table(spark, sf, "embeddings").select("vec_id", P.select_bands(F.col("embedding"), L.SIX_OF_THIRTEEN).alias("s"))
    return e.select("vec_id", *[F.col("s")[k].cast("double").alias(f"b{i}") for k, i in enumerate(L.SIX_OF_THIRTEEN)])


@query("reflectance_display", "X-26",
       "select event, tile, pos::int as pos, round(b * 5000 / 10000, 8)::double as refl, round(least(1, greatest(0, d * 9000 / 3000)), 8)::double as shown from pair", ("tiles", "px", "pair"))
def _(spark, sf):
    return _pair(spark, sf).select("event", "tile", "pos", r(P.reflectance(F.col("b") * 5000), 8).alias("refl"), r(P.display(F.col("d") * 9000), 8).alias("shown"))


@query("binarise_labels", "X-27",
       """, q as (select event, tile, pos::int as pos, (abs(floor(d * 20)) % 3)::int as l, case when b > 0 then b else 'nan'::double end as f from pair)
       select event, tile, pos, l = 1 as one, l > 0 as positive, l * 255 = 255 as max, not isnan(f) as valid, l in (1, 2) as water from q""", ("tiles", "px", "pair"))
def _(spark, sf):
    px = _pair(spark, sf).selectExpr("event", "tile", "pos", "cast(abs(floor(d * 20)) % 3 as int) as l", "if(b > 0, b, double('NaN')) as f")
    x = F.col("l")
    return px.select("event", "tile", "pos", P.binarise(x, "one").alias("one"), P.binarise(x, "positive").alias("positive"),
                     P.binarise(x * 255, "max").alias("max"), P.binarise(F.col("f"), "valid").alias("valid"), P.binarise(x, "water").alias("water"))


@query("area_units", "X-17",
       f""", s as ({STATS}) select event, tile, during_px * 100.0::double as m2, round(during_px * 100.0 / 1e6, 6)::double as km2, round(during_px * 100.0 / 1e4, 6)::double as ha from s""",
       ("tiles", "px", "pair"))
def _(spark, sf):
    s = R.change_stats(_pair(spark, sf), wet_before(), wet_during(), L.FLOOD_RES_M)
    n = F.col("during_px")
    return s.select("event", "tile", P.area(n, 10, "m2").alias("m2"), r(P.area(n, 10)).alias("km2"), r(P.area(n, 10, "ha")).alias("ha"))


QUALITY = """, q as (select event, tile, 100.0::double * count(*) filter (b > 0.12) / count(*) as b_cloud, 100.0::double * count(*) filter (d > 0.12) / count(*) as d_cloud,
  100.0::double * count(*) filter (b < -0.1) / count(*) as b_water, 100.0::double * count(*) filter (d < -0.1) / count(*) as d_water from pair group by all),
  w as (select *, d_water - b_water as water_incr from q)"""


def _quality(spark, sf):
    return R.scene_quality(_pair(spark, sf), F.col("b") > 0.12, F.col("d") > 0.12, F.col("b") < -0.1, F.col("d") < -0.1)


def _round_quality(df):
    return df.withColumns({c: r(c) for c in ("b_cloud", "d_cloud", "b_water", "d_water", "water_incr")})


RQ = "event, tile, round(b_cloud, 6) as b_cloud, round(d_cloud, 6) as d_cloud, round(b_water, 6) as b_water, round(d_water, 6) as d_water, round(water_incr, 6) as water_incr"


@query("scene_quality", "A-19", QUALITY + f" select {RQ} from w", ("tiles", "px", "pair"))
def _(spark, sf):
    return _round_quality(_quality(spark, sf))


@query("best_pairs", "F-11", QUALITY + f" select {RQ}, 'good' as choice from w where b_cloud < 15 and d_cloud < 15 and water_incr > 2", ("tiles", "px", "pair"))
def _(spark, sf):
    return _round_quality(R.best_pairs(_quality(spark, sf)))


@query("best_pairs_fallback", "F-11", QUALITY + f" select {RQ}, 'fallback' as choice from w order by w.water_incr desc, event, tile limit 10", ("tiles", "px", "pair"))
def _(spark, sf):
    """No tile is that clear, so the largest increases are given."""
    return _round_quality(R.best_pairs(_quality(spark, sf), cloud=0))


@query("band_stats", "A-20",
       """, q as (select 'b' as band, case when floor(b * 20) = 0 then null else b * 4 end as v from pair union all select 'd', d from pair)
       select band, round(min(v), 6) as min, round(max(v), 6) as max, round(avg(v), 6) as mean, max(v) > 1.1 as integer_scaled from q group by 1""", ("tiles", "px", "pair"))
def _(spark, sf):
    px = _pair(spark, sf).selectExpr("if(floor(b * 20) = 0, double('NaN'), b * 4) as b", "d")
    return R.band_stats(px, ["b", "d"]).withColumns({c: r(c) for c in ("min", "max", "mean")})


_V = {"positive": ("x > 0", 0.02, 0.98, 1e-6, None), "nonzero": ("x <> 0", 0.01, 0.99, 1e-8, None), "floor": ("all", 0.02, 0.98, 1e-6, 0.0)}
for _n, (_rule, _lo, _hi, _eps, _floor) in _V.items():
    _ok = _rule.replace("x", "v") if _rule != "all" else "true"
    _low = f"quantile_cont(v, {_lo}) filter ({_ok})" if _floor is None else f"{_floor}::double"

    @query(f"stretch_{_n}", "W-10",
           f""", l as (select event, tile, phase, coalesce({_low}, 0) as lo, coalesce(quantile_cont(v, {_hi}) filter ({_ok}), 1) as hi from px group by all),
           c as (select *, least(hi, v) as t from px join l using (event, tile, phase)), c2 as (select *, greatest(lo, t) as k from c),
           m as (select event, tile, phase, min(k) as a, max(k) as z from c2 group by all)
           select event, tile, phase, pos::int as pos, round(case when z - a < {_eps} then 0 else (k - a) / (z - a) end, 6)::double as v from c2 join m using (event, tile, phase)""", ("tiles", "px"))
    def _(spark, sf, ok=_rule, lo=_lo, hi=_hi, eps=_eps, fl=_floor):
        t = R.stretch(A.tiles(spark, sf), "v", lo, hi, ok, eps, floor=fl)
        return R.explode_pixels(t, ["v"]).select("event", "tile", "phase", "pos", r("v").alias("v"))


for _n, _keys, _skip in (("zscore_tile", "event, tile, phase", False), ("zscore_window", "event, tile", True)):
    @query(_n, "W-11",
           f""", q as (select event, tile, phase, pos, case when floor(v * 20) = 0 then {"0" if _skip else "null"} else v end as v from px),
           s as (select {_keys}, avg(v) {"filter (v <> 0)" if _skip else ""} as mu, stddev_pop(v) {"filter (v <> 0)" if _skip else ""} as sd from q group by all)
           select event, tile, phase, pos::int as pos, round(case when v is null or ({_skip} and v = 0) then 0 else (v - mu) / (sd + 1e-8) end, 5)::double as v from q join s using ({_keys})""", ("tiles", "px"))
    def _(spark, sf, keys=_keys, skip=_skip):
        blank = "0.0D" if skip else "double('NaN')"
        t = A.tiles(spark, sf).withColumn("v", F.expr(f"transform(v, x -> if(floor(x * 20) = 0, {blank}, cast(x as double)))"))
        z = R.zscore_window(t, "v", keys.split(", ")) if skip else R.zscore_tile(t, "v")
        return R.explode_pixels(z, ["v"]).select("event", "tile", "phase", "pos", r("v", 5).alias("v"))


@query("masked_mean", "A-27",
       "select event, pos::int as pos, round(sum(case when d > 0 then abs(b) else 0 end) / greatest(sum((d > 0)::int), 1e-8), 6) as anomaly from pair group by all", ("tiles", "px", "pair"))
def _(spark, sf):
    px = _pair(spark, sf).withColumns({"m": wet_during().cast("int"), "e": F.when(wet_during(), F.abs("b")).otherwise(0.0)})
    return R.masked_mean(px, ["event", "pos"], "e", "m").withColumn("anomaly", r("anomaly"))


# --- bounds and roll-ups ----------------------------------------------------------------------

UTM = ("300000.0{d} + (tile % 10) * 40000 as \"left\"", "1500000.0{d} + {div} * 90000 as bottom", "43 + tile % 4 as zone", "tile % 7 = 0 as south")


def _bounds(spark, sf):
    t = A.tiles(spark, sf).select("event", "tile").distinct().selectExpr(
        "event", "tile", "300000.0D + (tile % 10) * 40000 as left", "1500000.0D + (tile div 10) % 40 * 90000 as bottom",
        "cast(43 + tile % 4 as int) as zone", "tile % 7 = 0 as south")
    t = t.withColumns({"right": F.col("left") + 5120.0, "top": F.col("bottom") + 5120.0})
    return G.tile_bounds(t, ["event", "tile"])


BOUNDS = f""", t0 as (select distinct event, tile, 300000.0::double + (tile % 10) * 40000 as l, 1500000.0::double + (tile // 10) % 40 * 90000 as bt,
   43 + tile % 4 as zone, tile % 7 = 0 as south from tiles),
 pts as (select t0.*, l + 5120.0 * case when s = 0 or s = 1 then i / 22.0::double when s = 2 then 0 else 1 end as x,
   bt + 5120.0 * case when s >= 2 then i / 22.0::double when s = 0 then 0 else 1 end as y
   from t0, (select unnest(range(23)) as i), (select unnest(range(4)) as s)),
 u1 as (select *, (y - case when south then 1e7 else 0 end) / {G.K0 * G.M1!r}::double as mu from pts),
 u2 as (select *, mu + {G.S2!r}::double * sin(2 * mu) + {G.S4!r}::double * sin(4 * mu) + {G.S6!r}::double * sin(6 * mu) + {G.S8!r}::double * sin(8 * mu) as phi from u1),
 u3 as (select *, tan(phi) ** 2 as t, {G.EP2!r}::double * cos(phi) ** 2 as c, {G.A!r}::double / sqrt(1 - {G.E2!r}::double * sin(phi) ** 2) as n,
   {G.A * (1 - G.E2)!r}::double / (1 - {G.E2!r}::double * sin(phi) ** 2) ** 1.5 as rr from u2),
 u4 as (select *, (x - 500000) / (n * {G.K0!r}::double) as d from u3),
 u5 as (select event, tile, degrees(phi - n * tan(phi) / rr * (d ** 2 / 2 - (5 + 3 * t + 10 * c - 4 * c ** 2 - 9 * {G.EP2!r}::double) * d ** 4 / 24
   + (61 + 90 * t + 298 * c + 45 * t ** 2 - 252 * {G.EP2!r}::double - 3 * c ** 2) * d ** 6 / 720)) as lat,
   degrees((d - (1 + 2 * t + c) * d ** 3 / 6 + (5 - 2 * c + 28 * t - 3 * c ** 2 + 8 * {G.EP2!r}::double + 24 * t ** 2) * d ** 5 / 120) / cos(phi)) + zone * 6 - 183 as lng from u4),
 bnd as (select event, tile, min(lng) as west, min(lat) as south, max(lng) as east, max(lat) as north, (min(lat) + max(lat)) / 2 as center_lat,
   (min(lng) + max(lng)) / 2 as center_lng from u5 group by all)"""


#: Steps from points (pts: x, y, zone, south) to u5 with lng and lat.
PROJECTED = BOUNDS[BOUNDS.index(" u1 as"):BOUNDS.index(",\n bnd as")].replace("select event, tile, degrees", "select *, degrees")


@query("tile_bounds", "X-32", BOUNDS + " select event, tile, " + ", ".join(f"round({c}, 7) as {c}" for c in ("west", "south", "east", "north", "center_lat", "center_lng")) + " from bnd", ("tiles",))
def _(spark, sf):
    return _bounds(spark, sf).withColumns({c: r(c, 7) for c in ("west", "south", "east", "north", "center_lat", "center_lng")})


def _detail(spark, sf):
    """Per tile: bounds, change areas and a score that some tiles lack."""
    px = _pair(spark, sf)
    stats = R.change_stats(px, wet_before(), wet_during(), L.FLOOD_RES_M, "zero")
    f1 = F.count_if(wet_before() & wet_during()) * 2.0 / (F.count_if(wet_before()) + F.count_if(wet_during()))
    scores = px.groupBy("event", "tile").agg(f1.alias("f1"), F.count_if(wet_before()).alias("wet")).filter("wet >= 30").drop("wet")
    return _bounds(spark, sf), stats, scores


ROLL = BOUNDS + f""", s as ({STATS}), st as (select *, new_px / 10000.0::double as new_km2, during_px / 10000.0::double as during_km2 from s),
  f as (select event, tile, 2.0::double * count(*) filter (b > 0 and d > 0) / (count(*) filter (b > 0) + count(*) filter (d > 0)) as f1 from pair group by all having count(*) filter (b > 0) >= 30),
  j as (select * from bnd join st using (event, tile) left join f using (event, tile))"""
NEED = ("tiles", "px", "pair")


@query("event_summary", "A-16 X-32",
       ROLL + """ select event, count(*) as tile_count, round(min(west), 6) as west, round(min(south), 6) as south, round(max(east), 6) as east, round(max(north), 6) as north,
       round(arg_min(center_lat, tile), 6) as center_lat, round(sum(new_km2), 6) as total_new_km2, round(sum(during_km2), 6) as total_flooded_km2,
       round(coalesce(avg(f1), 0), 6) as avg_f1 from j group by event""", NEED)
def _(spark, sf):
    bounds, stats, scores = _detail(spark, sf)
    e = R.event_summary(R.attach(bounds.join(stats, ["event", "tile"]), scores))
    return e.select("event", "tile_count", *[r(c).alias(c) for c in ("west", "south", "east", "north", "total_new_km2", "total_flooded_km2", "avg_f1")],
                    r("center.center_lat").alias("center_lat"))


@query("global_summary", "A-17",
       ROLL + """ select event, count(*) as total_tiles, round(sum(new_km2), 6) as total_new_km2, round(sum(during_km2), 6) as total_flooded_km2,
       round(avg(f1), 6) as avg_f1, grouping(event)::int as grand, (select count(distinct event) from tiles) as total_events from j group by rollup (event)""", NEED)
def _(spark, sf):
    _, stats, scores = _detail(spark, sf)
    g = R.global_summary(R.attach(stats, scores))
    return g.select("event", "total_tiles", *[r(c).alias(c) for c in ("total_new_km2", "total_flooded_km2", "avg_f1")],
                    F.col("grand").cast("int").alias("grand"), "total_events")


@query("tile_detail", "J-19 J-4",
       ROLL + """ select t.event, t.tile, round(j.center_lat, 6) as center_lat, j.new_px, round(j.f1, 6) as f1, j.west is not null as has_bounds, j.new_px is not null as has_stats,
       j.f1 is not null as has_scores from (select distinct event, tile from tiles) t left join j using (event, tile)""", NEED)
def _(spark, sf):
    bounds, stats, scores = _detail(spark, sf)
    d = R.tile_detail(A.tiles(spark, sf).select("event", "tile").distinct(), bounds, stats, scores)
    return d.select("event", "tile", r("center_lat").alias("center_lat"), "new_px", r("f1").alias("f1"), "has_bounds", "has_stats", "has_scores")


@query("event_meta", "J-15",
       """select event, coalesce(r_name, 'Flood Event ' || event) as title, coalesce(r_name, 'Unknown') as country, n from
       (select event, count(*) as n from tiles group by 1) left join region on event = 'EV' || (r_regionkey * 3)""", ("tiles",))
def _(spark, sf):
    dim = A.table(spark, sf, "region").selectExpr("concat('EV', r_regionkey * 3) as event", "r_name as title", "r_name as country")
    e = A.tiles(spark, sf).groupBy("event").agg(F.count(F.lit(1)).alias("n"))
    return R.event_meta(e, dim).select("event", "title", "country", "n")


@query("prefer_water", "J-18",
       """select event, tile, phase, coalesce(o.v[1] > 0, s.v[64] > 0) as first_wet, case when o.v is null then 'radar' else 'optical' end as source
       from (select * from tiles where label % 2 = 0) o full join (select * from tiles where label % 3 <> 0) s using (event, tile, phase)""", ("tiles",))
def _(spark, sf):
    t = A.tiles(spark, sf)
    opt = t.filter("label % 2 = 0").select("event", "tile", "phase", F.expr("transform(v, x -> x > 0)").alias("mask"))
    sar = t.filter("label % 3 <> 0").select("event", "tile", "phase", F.expr("reverse(transform(v, x -> x > 0))").alias("mask"))
    return R.prefer_water(opt, sar).select("event", "tile", "phase", F.col("mask")[0].alias("first_wet"), "source")
