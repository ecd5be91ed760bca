"""Registered queries over neighbourhood operators, chips, layers and patches."""

from pyspark.sql import functions as F

from hazardlake.functions import lexicons as L
from hazardlake.operators import morphology as M
from hazardlake.operators import outlines as O
from hazardlake.operators import rasters as R
from hazardlake.operators import subtiles as U
from hazardlake.plans import fixtures as A
from hazardlake.plans.common import r
from hazardlake.plans.tiles_queries import PROJECTED
from hazardlake.registry import query

K3 = ["event", "tile", "phase"]
NEED = ("tiles", "px")


def _masks(spark, sf):
    return A.tiles(spark, sf).withColumn("mask", F.expr("transform(v, x -> cast(x > 0 as int))"))


def _text(df):
    return df.select(*K3, F.array_join(F.transform("mask", lambda m: m.cast("string")), "").alias("mask"))


M0 = ', m0 as (select event, tile, phase, pos, "row", col, (v > 0)::int as m from px)'
TEXT = " select event, tile, phase, string_agg(m::varchar, '' order by pos) as mask from {src} group by all"


def box(src, name, radius, test):
    """SQL twin of one square pass: count positives in the window by a self-join."""
    full = (2 * radius + 1) ** 2
    cond = f"count(b.pos) = {full}" if test == "erode" else "count(b.pos) > 0"
    return f""", {name} as (select a.event, a.tile, a.phase, a.pos, a."row", a.col, ({cond})::int as m from {src} a
      left join (select * from {src} where m = 1) b on a.event = b.event and a.tile = b.tile and a.phase = b.phase
      and abs(a."row" - b."row") <= {radius} and abs(a.col - b.col) <= {radius} group by all)"""


_CASES = {
    "erode": ("R-1", lambda t: M.erode(t, "mask", 3), [(1, "erode")]),
    "dilate": ("R-1", lambda t: M.dilate(t, "mask", 3), [(1, "dilate")]),
    "erode_twice": ("R-1", lambda t: M.erode(t, "mask", 3, 2), [(1, "erode"), (1, "erode")]),
    "dilate_twice": ("R-1", lambda t: M.dilate(t, "mask", 3, 2), [(1, "dilate"), (1, "dilate")]),
    "opening": ("R-2", lambda t: M.opening(t, "mask", 3), [(1, "erode"), (1, "dilate")]),
    "closing_3": ("R-3", lambda t: M.closing(t, "mask", 3), [(1, "dilate"), (1, "erode")]),
    "closing_5x2": ("R-3", lambda t: M.closing(t, "mask", 5, 2), [(2, "dilate"), (2, "dilate"), (2, "erode"), (2, "erode")]),
    "closing_7x3": ("R-3", lambda t: M.closing(t, "mask", 7, 3), [(3, "dilate")] * 3 + [(3, "erode")] * 3),
    "buffer": ("R-4", lambda t: M.buffer(t, "mask", 4), [(4, "dilate")]),
}
for _name, (_id, _fn, _steps) in _CASES.items():
    _sql, _src = M0, "m0"
    for _i, (_rad, _test) in enumerate(_steps):
        _sql += box(_src, f"s{_i}", _rad, _test)
        _src = f"s{_i}"

    @query(f"mask_{_name}", _id, _sql + TEXT.format(src=_src), NEED)
    def _(spark, sf, fn=_fn):
        return _text(fn(_masks(spark, sf)))


def gauss_sql(sigma, src="px", out="g2"):
    kernel = ", ".join(f"({d}, {w!r}::double)" for d, w in M.gaussian_kernel(sigma))
    mir = "least((({j}) % 16 + 16) % 16, 15 - (({j}) % 16 + 16) % 16)"
    return f""", k{out}(d, w) as (values {kernel}),
    {out}1 as (select a.event, a.tile, a.phase, a.pos, a."row", a.col, sum(k.w * b.v) as v from {src} a, k{out} k join {src} b
      on a.event = b.event and a.tile = b.tile and a.phase = b.phase and a."row" = b."row" and b.col = {mir.format(j='a.col + k.d')} group by all),
    {out} as (select a.event, a.tile, a.phase, a.pos, a."row", a.col, sum(k.w * b.v) as v from {out}1 a, k{out} k join {out}1 b
      on a.event = b.event and a.tile = b.tile and a.phase = b.phase and a.col = b.col and b."row" = {mir.format(j='a."row" + k.d')} group by all)"""


for _sigma in (1.5, 2.0):
    @query(f"gaussian_{str(_sigma).replace('.', '_')}", "R-5", gauss_sql(_sigma) + " select event, tile, phase, pos::int as pos, round(v, 7) as v from g2", NEED)
    def _(spark, sf, sigma=_sigma):
        return R.explode_pixels(M.gaussian(A.tiles(spark, sf), "v", sigma), ["v"]).select(*K3, "pos", r("v", 7).alias("v"))


OTSU = """, l as (select event, tile, phase, min(v) as lo, max(v) as hi from vpx group by all),
  h as (select event, tile, phase, lo, hi, case when hi = lo then 0 else least(255, floor((v - lo) / (hi - lo) * 256)) end as bin, count(*) as n
    from vpx join l using (event, tile, phase) group by all),
  c as (select *, lo + (bin + 0.5) * (hi - lo) / 256 as center from h),
  w as (select *, sum(n) over up as w1, sum(n * center) over up as s1, sum(n) over al as w, sum(n * center) over al as s from c
    window up as (partition by event, tile, phase order by bin), al as (partition by event, tile, phase)),
  b as (select *, w1 * (w - w1) * (s1 / w1 - (s - s1) / (w - w1)) ** 2 as var from w where w > w1)
  select event, tile, phase, round(arg_max(center, row(var, -bin)), 6) as threshold from b group by all"""


@query("otsu", "R-6", ", vpx as (select * from px)" + OTSU, NEED)
def _(spark, sf):
    return M.otsu(A.tiles(spark, sf).withColumn("v", F.expr("transform(v, x -> cast(x as double))")), "v").withColumn("threshold", r("threshold"))


@query("otsu_valid", "R-6", ", vpx as (select * from px where v > 0)" + OTSU, NEED)
def _(spark, sf):
    t = _masks(spark, sf).withColumn("v", F.expr("transform(v, x -> cast(x as double))"))
    return M.otsu(t, "v", "mask").withColumn("threshold", r("threshold"))


@query("percentile_threshold", "R-6", "select event, tile, phase, round(quantile_cont(v, 0.3), 6) as threshold from px where v > 0 group by all", NEED)
def _(spark, sf):
    t = _masks(spark, sf).withColumn("v", F.expr("transform(v, x -> cast(x as double))"))
    return M.percentile_threshold(t, "v", "mask").withColumn("threshold", r("threshold"))


@query("water_optical", "R-7",
       ", g as (select a.event, a.tile, a.phase, a.pos, a.\"row\", a.col, (a.v - b.v) / case when a.v + b.v = 0 then 1e-10 else a.v + b.v end as v "
       "from px a join px b on a.event = b.event and a.tile = b.tile and a.phase = b.phase and b.pos = 63 - a.pos)"
       + gauss_sql(1.5, "g") + ', m0 as (select event, tile, phase, pos, "row", col, (v > 0)::int as m from g2)'
       + box("m0", "s0", 2, "dilate") + box("s0", "s1", 2, "dilate") + box("s1", "s2", 2, "erode") + box("s2", "s3", 2, "erode")
       + box("s3", "s4", 1, "erode") + box("s4", "s5", 1, "dilate") + TEXT.format(src="s5"), NEED)
def _(spark, sf):
    t = A.tiles(spark, sf).withColumn("n", F.reverse("v"))
    return _text(M.water_optical(t, "v", "n"))


def threshold_sql(src, out):
    """Otsu threshold per tile of a smoothed band, as in OTSU."""
    body = OTSU.strip().lstrip(",").strip().replace("vpx", src)
    return f", {out} as (with {body.replace('round(arg_max(center, row(var, -bin)), 6) as threshold', 'arg_max(center, row(var, -bin)) as t')})"


@query("water_radar", "R-8",
       """, vv as (select event, tile, phase, pos, "row", col, v * 100 + 100 as v from px),
       vh as (select a.event, a.tile, a.phase, a.pos, a."row", a.col, b.v * 80 + 90 as v from px a join px b on a.event = b.event and a.tile = b.tile and a.phase = b.phase and b.pos = 63 - a.pos)"""
       + gauss_sql(2.0, "vv", "gv") + gauss_sql(2.0, "vh", "gh") + threshold_sql("gv", "tv") + threshold_sql("gh", "th")
       + """, m0 as (select gv.event, gv.tile, gv.phase, gv.pos, gv."row", gv.col, (gv.v < tv.t and gh.v < th.t)::int as m from gv join gh using (event, tile, phase, pos)
         join tv using (event, tile, phase) join th using (event, tile, phase))"""
       + box("m0", "s0", 9, "dilate") + box("s0", "s1", 9, "erode") + box("s1", "s2", 1, "erode") + box("s2", "s3", 1, "dilate") + TEXT.format(src="s3"), NEED)
def _(spark, sf):
    t = A.tiles(spark, sf).withColumns({"vv": F.expr("transform(v, x -> x * 100D + 100D)"), "vh": F.expr("reverse(transform(v, x -> x * 80D + 90D))")})
    return _text(M.water_radar(t, "vv", "vh"))


@query("components", "R-9",
       """, m as (select event, tile, phase, pos::int as pos, "row", col from px where v > 0),
       e as (select a.event, a.tile, a.phase, a.pos as u, b.pos as v from m a join m b on a.event = b.event and a.tile = b.tile and a.phase = b.phase
         and abs(a."row" - b."row") + abs(a.col - b.col) = 1),
       walk(event, tile, phase, pos, lab) as (select event, tile, phase, pos, pos from m union
         select w.event, w.tile, w.phase, e.v, w.lab from walk w join e on e.event = w.event and e.tile = w.tile and e.phase = w.phase and e.u = w.pos),
       lab as (select event, tile, phase, pos, min(lab) as component from walk group by all)
       select event, tile, phase, component, count(*) as pixels, min("row") as row0, max("row") as row1, min(col) as col0, max(col) as col1,
       round(avg("row"), 6) as center_row, round(avg(col), 6) as center_col from lab join m using (event, tile, phase, pos) group by event, tile, phase, component""", NEED)
def _(spark, sf):
    return M.components(_masks(spark, sf), "mask", K3).withColumns({"center_row": r("center_row"), "center_col": r("center_col")})


@query("components_subtiles", "R-9",
       """, m as (select event, tile, phase, pos::int as pos, "row", col from px where v > 0),
       e as (select a.event, a.tile, a.phase, a.pos as u, b.pos as v from m a join m b on a.event = b.event and a.tile = b.tile and a.phase = b.phase
         and abs(a."row" - b."row") + abs(a.col - b.col) = 1),
       walk(event, tile, phase, pos, lab) as (select event, tile, phase, pos, pos from m union
         select w.event, w.tile, w.phase, e.v, w.lab from walk w join e on e.event = w.event and e.tile = w.tile and e.phase = w.phase and e.u = w.pos),
       lab as (select event, tile, phase, pos, min(lab) as component from walk group by all)
       select event, tile, phase, component, count(*) as pixels from lab group by all""", NEED)
def _(spark, sf):
    """Tiles in sub-tiles of 3 pixels a side: labels meet at the borders."""
    return U.patches(U.split_tiles(_masks(spark, sf), ["mask"], 3, K3), "mask", K3).select(*K3, "component", "pixels")


@query("closing_subtiles", "R-2 R-3",
       M0 + box("m0", "s0", 1, "dilate") + box("s0", "s1", 1, "erode") + box("s1", "s2", 1, "erode") + box("s2", "s3", 1, "dilate") + TEXT.format(src="s3"), NEED)
def _(spark, sf):
    """Closed and opened 3x3 on sub-tiles of 4 pixels a side with a halo of 4."""
    t = U.split_tiles(_masks(spark, sf), ["mask"], 4, K3)
    return _text(U.join_subtiles(U.near(t, "mask", 4, lambda x: M.opening(M.closing(x, "mask", 3), "mask", 3), K3), ["mask"], K3))


@query("gaussian_subtiles", "R-5", gauss_sql(0.7) + " select event, tile, phase, pos::int as pos, round(v, 7) as v from g2", NEED)
def _(spark, sf):
    """Smoothed on sub-tiles of 4 pixels a side with a halo of the kernel's radius."""
    t = U.split_tiles(A.tiles(spark, sf), ["v"], 4, K3)
    whole = U.join_subtiles(U.near(t, "v", 3, lambda x: M.gaussian(x, "v", 0.7), K3), ["v"], K3)
    return R.explode_pixels(whole, ["v"]).select(*K3, "pos", r("v", 7).alias("v"))


@query("boundary_edges", "R-10",
       """, m as (select * from px where v > 0),
       s as (select a.*, dr, dc from m a, (values (-1, 0), (0, 1), (1, 0), (0, -1)) d(dr, dc)
         where not exists (select 1 from m b where b.event = a.event and b.tile = a.tile and b.phase = a.phase and b."row" = a."row" + dr and b.col = a.col + dc))
       select event, tile, phase, case when dr = -1 then col when dc = 1 then col + 1 when dr = 1 then col + 1 else col end as x0,
       case when dr = -1 then "row" when dc = 1 then "row" when dr = 1 then "row" + 1 else "row" + 1 end as y0,
       case when dr = -1 then col + 1 when dc = 1 then col + 1 when dr = 1 then col else col end as x1,
       case when dr = -1 then "row" when dc = 1 then "row" + 1 when dr = 1 then "row" + 1 else "row" end as y1 from s""", NEED)
def _(spark, sf):
    return O.boundary_edges(_masks(spark, sf), "mask", K3)


@query("outline_area", "R-10", "select event, tile, phase, count(*)::double as area from px where v > 0 group by all", NEED)
def _(spark, sf):
    """Ring areas of a tile, holes negative, add up to its positive pixels."""
    return O.outline(_masks(spark, sf), "mask", K3).groupBy(*K3).agg(F.sum("area").alias("area"))


#: Patch of every positive pixel, and the corners that its outline turns at.
PATCHES = """, m as (select event, tile, phase, pos::int as pos, "row", col from px where v > 0),
  e as (select a.event, a.tile, a.phase, a.pos as u, b.pos as v from m a join m b on a.event = b.event and a.tile = b.tile and a.phase = b.phase
    and abs(a."row" - b."row") + abs(a.col - b.col) = 1),
  walk(event, tile, phase, pos, lab) as (select event, tile, phase, pos, pos from m union
    select w.event, w.tile, w.phase, e.v, w.lab from walk w join e on e.event = w.event and e.tile = w.tile and e.phase = w.phase and e.u = w.pos),
  lab as (select event, tile, phase, pos, min(lab) as component from walk group by all),
  q as (select m.*, dr, dc, exists (select 1 from m a where a.event = m.event and a.tile = m.tile and a.phase = m.phase and a."row" = m."row" + dr and a.col = m.col) as side1,
      exists (select 1 from m a where a.event = m.event and a.tile = m.tile and a.phase = m.phase and a."row" = m."row" and a.col = m.col + dc) as side2,
      exists (select 1 from m a where a.event = m.event and a.tile = m.tile and a.phase = m.phase and a."row" = m."row" + dr and a.col = m.col + dc) as across
    from m, (values (-1, -1), (-1, 1), (1, -1), (1, 1)) d(dr, dc)),
  turns as (select event, tile, phase, pos, count(*) filter (not side1 and not side2 or side1 and side2 and not across) as corners from q group by all)"""


@query("outline", "R-10",
       PATCHES + " select event, tile, phase, component, count(*)::double as area, sum(corners)::bigint as corners from lab join turns using (event, tile, phase, pos) group by all", NEED)
def _(spark, sf):
    """Polygons with their holes: each is one patch, which its first corner names."""
    rings = O.outline(_masks(spark, sf), "mask", K3)
    first = (F.shiftright("outer", 33) * 8 + F.shiftright("outer", 2).bitwiseAND(F.lit(7))).cast("int")
    return rings.groupBy(*K3, first.alias("component")).agg(F.sum("area").alias("area"), F.sum("corners").alias("corners"))


@query("outline_rings", "R-10",
       PATCHES + """, f as (select t.event, t.tile, t.phase, y, x, y * 10 + x as pos from (select distinct event, tile, phase from px) t, (select unnest(range(-1, 9)) as y), (select unnest(range(-1, 9)) as x)
         where not exists (select 1 from m where m.event = t.event and m.tile = t.tile and m.phase = t.phase and m."row" = y and m.col = x)),
       fe as (select a.event, a.tile, a.phase, a.pos as u, b.pos as v from f a join f b on a.event = b.event and a.tile = b.tile and a.phase = b.phase
         and greatest(abs(a.y - b.y), abs(a.x - b.x)) = 1),
       fw(event, tile, phase, pos, lab) as (select event, tile, phase, pos, pos from f union
         select w.event, w.tile, w.phase, fe.v, w.lab from fw w join fe on fe.event = w.event and fe.tile = w.tile and fe.phase = w.phase and fe.u = w.pos),
       fl as (select event, tile, phase, pos, min(lab) as component from fw group by all)
       select event, tile, phase, n_outer, n_holes from (select event, tile, phase, count(distinct component) as n_outer from lab group by all)
       join (select event, tile, phase, count(distinct component) - 1 as n_holes from fl group by all) using (event, tile, phase)""", NEED)
def _(spark, sf):
    """Outer rings are patches of pixels that share sides, holes are gaps that share corners."""
    return O.outline(_masks(spark, sf), "mask", K3).groupBy(*K3).agg(
        F.count_if(F.col("ring") == F.col("outer")).alias("n_outer"), F.count_if(F.col("ring") != F.col("outer")).alias("n_holes"))


def _opened(spark, sf):
    return M.opening(A.tiles(spark, sf).withColumn("mask", F.expr("transform(v, x -> cast(x > -0.1 as int))")), "mask", 3)


OPENED = ', m0 as (select event, tile, phase, pos, "row", col, (v > -0.1)::int as m from px)' + box("m0", "s0", 1, "erode") + box("s0", "s1", 1, "dilate")


@query("feature_lines", "S-13",
       OPENED + """, n as (select event, tile, phase, sum(m) as pixels from s1 group by all)
       select event, tile, phase, pixels::bigint as pixels, case when pixels > 0 then 1 else 0 end as n_features from n""", NEED)
def _(spark, sf):
    """Documents of opened masks, put together from their pieces and parsed again: features,
    and the pixels inside the outer rings less those inside the holes."""
    t = _opened(spark, sf)
    pieces = O.feature_pieces(O.outline(t, "mask", K3), t.select(*K3), K3)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "ring", "piece"))), lambda x: x["piece"]), "")
    shape = "struct<type:string,features:array<struct<geometry:struct<coordinates:array<array<array<array<double>>>>>>>>"
    doc = pieces.groupBy(*K3).agg(F.from_json(text, shape).alias("d"))
    area = """aggregate(flatten(flatten(transform(d.features, f -> f.geometry.coordinates))), 0.0D, (s, ring) ->
              s + aggregate(sequence(0, size(ring) - 2), 0.0D, (a, i) -> a + ring[i][0] * ring[i + 1][1] - ring[i + 1][0] * ring[i][1]) / 2)"""
    return doc.select(*K3, F.expr(f"cast({area} as bigint)").alias("pixels"), F.size("d.features").alias("n_features"))


def _placed(spark, sf):
    """Tiles on the map: 10 m pixels in zones of the northern hemisphere, by number."""
    return A.tiles(spark, sf).select(*K3, (F.lit(400000.0) + F.col("tile") % 100 * 80).alias("left"), (F.lit(3000000.0) + F.col("tile") % 7 * 80).alias("top"),
                                     F.lit(10.0).alias("res"), (F.lit(40) + F.col("tile") % 5).alias("zone"), F.lit(False).alias("south"))


@query("tile_collections", "S-13",
       OPENED + f""", pts as (select event, tile, phase, 400000.0::double + tile % 100 * 80 + (col + dx) * 10 as x, 3000000.0::double + tile % 7 * 80 - ("row" + dy) * 10 as y,
         40 + tile % 5 as zone, false as south from s1, (select unnest([0, 1]) as dx), (select unnest([0, 1]) as dy) where m = 1), {PROJECTED}
       select event, tile, phase, round(min(lng), 7) as west, round(min(lat), 7) as south, round(max(lng), 7) as east, round(max(lat), 7) as north from u5 group by all""", NEED)
def _(spark, sf):
    """Bounds of the outlines of opened masks in longitude and latitude."""
    rings = O.outline(_opened(spark, sf), "mask", K3, _placed(spark, sf))
    p = rings.select(*K3, F.explode("points").alias("p"))
    return p.groupBy(*K3).agg(r(F.min("p.x"), 7).alias("west"), r(F.min("p.y"), 7).alias("south"), r(F.max("p.x"), 7).alias("east"), r(F.max("p.y"), 7).alias("north"))


GRID = """, g as (select distinct event, tile, phase, y * 3 as y0, x * 3 as x0 from tiles, (select unnest(range({n})) as y), (select unnest(range({n})) as x))"""


@query("chip_grid", "R-11", GRID.format(n=2) + " select event, tile, phase, y0::int as y0, x0::int as x0, 8 as pad_h, 8 as pad_w from g", ("tiles",))
def _(spark, sf):
    return M.chip_grid(A.tiles(spark, sf), 5, 3).select("event", "tile", "phase", "y0", "x0", "pad_h", "pad_w")


@query("chip_grid_stride", "R-11", GRID.format(n=2) + " select event, tile, phase, y0::int as y0, x0::int as x0, 9 as pad_h, 9 as pad_w from g", ("tiles",))
def _(spark, sf):
    """Padding to a multiple of the stride."""
    return M.chip_grid(A.tiles(spark, sf), 5, 3, "stride").select("event", "tile", "phase", "y0", "x0", "pad_h", "pad_w")


PHASED = [*M.TILE, "phase"]
REF = "least({j} % 14, 14 - {j} % 14)"


@query("merge_chips", "R-12 R-11",
       f""", c as (select p.event, p.tile, p.phase, y0, x0, i, (y0 + i // 6) as yy, (x0 + i % 6) as xx, v * (1 + y0 + 2 * x0) as s
         from (select unnest([0, 4]) as y0), (select unnest([0, 4]) as x0), (select unnest(range(36)) as i), px p
         where p."row" = {REF.format(j='(y0 + i // 6)')} and p.col = {REF.format(j='(x0 + i % 6)')})
       select event, tile, phase, yy::int as "row", xx::int as col, round(avg(s), 6) as score, count(*) as n_chips, (avg(s) > 0.1)::int as pred from c where yy < 8 and xx < 8 group by all""", NEED)
def _(spark, sf):
    chips = U.chips(A.tiles(spark, sf), ["v"], 6, 4, keep=PHASED)
    scored = chips.withColumn("s", F.expr("transform(chip_v, x -> cast(x as double) * (1 + y0 + 2 * x0))"))
    return M.decide(M.merge_chips(scored, "s", 6, PHASED), 0.1).withColumn("score", r("score")).drop("height", "width")


@query("merged_tiles", "R-12",
       "select event, tile, phase, round(sum(v), 5) as total, round(sum(v * pos), 4) as moment from px group by all", NEED)
def _(spark, sf):
    """Unchanged chips merge back to the tile they were cut from."""
    chips = U.chips(A.tiles(spark, sf), ["v"], 5, 2, keep=PHASED)
    chips = chips.withColumn("chip_v", F.expr("transform(chip_v, x -> cast(x as double))"))
    m = M.merged_tiles(M.merge_chips(chips, "chip_v", 5, PHASED), PHASED)
    total = F.aggregate("score", F.lit(0.0), lambda a, x: a + x)
    moment = F.aggregate(F.transform("score", lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return m.select("event", "tile", "phase", r(total, 5).alias("total"), r(moment, 4).alias("moment"))


@query("arg_max_class", "R-12",
       """, s as (select event, tile, pos, 0 as cls, avg(v) as m from px group by all union all select event, tile, pos, 1, avg(abs(v)) / 2 from px group by all)
       select event, tile, pos::int as pos, arg_max(cls, row(m, -cls)) as pred from s group by all""", NEED)
def _(spark, sf):
    px = R.explode_pixels(A.tiles(spark, sf), ["v"]).withColumn("v", F.col("v").cast("double"))
    both = px.withColumn("cls", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("score", F.expr("if(cls = 0, v, abs(v) / 2)"))
    return M.arg_max_class(both, ["event", "tile", "pos"])


@query("center_crop", "R-14", 'select event, tile, phase, (("row" - 2) * 4 + col - 2)::int as pos, v from px where "row" between 2 and 5 and col between 2 and 5', NEED)
def _(spark, sf):
    t = M.center_crop(A.tiles(spark, sf), "v", 4)
    return R.explode_pixels(t, ["v"]).select(*K3, "pos", F.col("v").cast("double").alias("v"))


@query("pad_to", "R-14",
       f'select event, tile, phase, (y * 11 + x)::int as pos, v from px join (select unnest(range(11)) as y) on "row" = {REF.format(j="y")} join (select unnest(range(11)) as x) on col = {REF.format(j="x")}', NEED)
def _(spark, sf):
    t = M.pad_to(A.tiles(spark, sf), "v", 11)
    return R.explode_pixels(t, ["v"]).select(*K3, "pos", F.col("v").cast("double").alias("v"))


@query("augment", "R-15",
       """, h as (select event, tile, ('0x' || md5('7:' || event || ':' || tile)[:15])::bigint as h from tiles group by all),
       t as (select px.*, h % 2 as flip_h, (h >> 8) % 2 as flip_v, (h >> 16) % 4 as turns from px join h using (event, tile)),
       s as (select event, tile, phase, i as pos, turns, flip_h, flip_v, i // 8 as r, i % 8 as c from (select distinct event, tile, phase, turns, flip_h, flip_v from t), (select unnest(range(64)) as i)),
       w as (select *, case turns when 0 then r when 1 then c when 2 then 7 - r else 7 - c end as tr,
         case turns when 0 then c when 1 then 7 - r when 2 then 7 - c else r end as tc from s),
       x as (select event, tile, phase, pos, r, c, case when flip_v = 1 then 7 - tr else tr end * 8 + case when flip_h = 1 then 7 - tc else tc end as src from w)
       select x.event, x.tile, x.phase, x.pos::int as pos, x.r::int as "row", x.c::int as col, px.v from x join px on px.event = x.event and px.tile = x.tile and px.phase = x.phase and px.pos = x.src""", NEED)
def _(spark, sf):
    t = M.augment(A.tiles(spark, sf), ["v"], 7)
    return R.explode_pixels(t, ["v"]).withColumn("v", F.col("v").cast("double"))


def _layer_tiles(spark, sf):
    """Prediction, optional before and during masks and optional truth in one tile row."""
    t = _masks(spark, sf)
    side = lambda p, n, cond="true": t.filter(f"phase = '{p}' and {cond}").select("event", "tile", F.col("mask").alias(n))
    out = t.filter("phase = 'during'").select("event", "tile", "height", "width", F.expr("transform(v, x -> cast(x > -0.1 as int))").alias("pred"))
    return R.attach(R.attach(R.attach(out, side("before", "before", "label <> 3")), side("during", "during", "label <> 5")), side("before", "truth", "label <> 7"))


LAYER = """, q as (select p.event, p.tile, p.pos, p."row", p.col, p.v > -0.1 as pred, b.v > 0 as bef, d.v > 0 as dur, t.v > 0 as truth
   from px p left join (select * from px join tiles using (event, tile, phase) where label <> 3) b on b.event = p.event and b.tile = p.tile and b.pos = p.pos and b.phase = 'before'
   left join (select * from px join tiles using (event, tile, phase) where label <> 5) d on d.event = p.event and d.tile = p.tile and d.pos = p.pos and d.phase = 'during'
   left join (select * from px join tiles using (event, tile, phase) where label <> 7) t on t.event = p.event and t.tile = p.tile and t.pos = p.pos and t.phase = 'before'
   where p.phase = 'during'), lay as ({rows}), m0 as (select event, tile, layer as phase, pos, "row", col, m::int as m from lay)"""
LAYER = LAYER.replace("select * from px join tiles using (event, tile, phase)", "select px.*, label from px join tiles using (event, tile, phase)")
_ROWS = {
    "flood": "select *, 'flood' as layer, pred as m from q",
    "existing": "select *, 'existing_water' as layer, bef as m from q where bef is not null",
    "new_flood": "select *, 'new_flood' as layer, pred and not coalesce(bef, false) as m from q",
    "change": "select *, 'existing_water' as layer, bef and (coalesce(dur, false) or pred) as m from q where bef is not null "
              "union all select *, 'new_flood', pred and not coalesce(bef, false) from q",
    "burn": "select *, 'burn_scar' as layer, pred as m from q",
    "gt": "select *, 'ground_truth' as layer, truth as m from q where truth is not null",
    "accuracy": "select *, 'true_positive' as layer, pred and truth as m from q where truth is not null union all "
                "select *, 'false_positive', pred and not truth from q where truth is not null union all "
                "select *, 'false_negative', not pred and truth from q where truth is not null union all select *, 'burn_scar', pred from q where truth is null",
}
_COLOR = "case phase " + " ".join(f"when '{k}' then '{v}'" for k, v in L.LAYER_COLOURS.items()) + " else '' end"
for _layer, _rows in _ROWS.items():
    @query(f"layer_{_layer}", "R-20",
           LAYER.replace("{rows}", _rows) + box("m0", "s0", 1, "erode") + box("s0", "s1", 1, "dilate")
           + f' select event, tile, phase as layer, {_COLOR} as color, "row", col from s1 where m = 1', NEED)
    def _(spark, sf, layer=_layer):
        masks = M.layer_masks(layer, "pred", "before", "during", "truth")
        return M.layers(_layer_tiles(spark, sf), masks, L.LAYER_COLOURS)
