"""Registered queries for model hooks, training data and whole jobs."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from hazardlake.operators import hooks as K
from hazardlake.operators import morphology as M
from hazardlake.operators import rasters as R
from hazardlake.operators import scenes as S
from hazardlake.operators import subtiles as U
from hazardlake.plans import fixtures as A
from hazardlake.plans import jobs
from hazardlake.plans.common import joined, r
from hazardlake.plans.masks_queries import box, gauss_sql, threshold_sql
from hazardlake.plans.scenes_queries import TRIPLET
from hazardlake.plans.texts_queries import COASTAL, HUMOUR, PLACES, SERIOUS, STOP
from hazardlake.registry import query
from hazardlake.session import work_dir
from hazardlake.sources import catalogue as C

NEED = ("tiles", "px")
PAIR = ("tiles", "px", "pair")


@query("score_chips", "K-1 R-11 R-12",
       'select event, tile, "row", col, round((b + d) / 2 + 0.25, 6) as score from pair', PAIR)
def _(spark, sf):
    """A user scorer on overlapping chips; equal scores of a pixel average to themselves."""
    pair = R.pair_phases(A.tiles(spark, sf), ["v"])
    chips = U.chips(pair, ["before_v", "during_v"], 4, 2)
    scored = K.score_chips(chips, ["chip_before_v", "chip_during_v"], lambda x: (x["chip_before_v"] + x["chip_during_v"]) / 2 + 0.25)
    return M.merge_chips(scored, "score", 4).select("event", "tile", "row", "col", r("score").alias("score"))


def _upper_share(texts: pd.Series) -> pd.DataFrame:
    share = texts.map(lambda t: sum(c.isupper() for c in t) / max(len(t), 1))
    return pd.DataFrame({"is_serious": share < 0.02, "confidence": 1.0 - share})


@query("verdict_hook", "K-3",
       r"""select doc_id, u / greatest(length(text), 1)::double < 0.02 as is_serious, round(1 - u / greatest(length(text), 1)::double, 6) as confidence
       from (select doc_id, text, length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) as u from documents)""")
def _(spark, sf):
    """A caller's vectorised classifier in the place of the default score."""
    d = K.with_verdict(A.table(spark, sf, "documents"), "text", _upper_share)
    return d.select("doc_id", "verdict.is_serious", r("verdict.confidence").alias("confidence"))


@query("verdict_default", "K-3")
def _(spark, sf):
    d = K.with_verdict(A.table(spark, sf, "documents"), "text", humour=HUMOUR, serious=SERIOUS, coastal=COASTAL)
    d = K.with_extraction(d, "text", SERIOUS, PLACES, STOP)
    return d.select("doc_id", "verdict.is_serious", r("verdict.confidence").alias("confidence"),
                    F.col("extracted.total_tag_count").alias("tags"), joined("extracted.location_mentions").alias("places"))


@query("training_pixels", "K-4",
       """, n as (select event as fire, tile, lead(tile) over (partition by event order by tile) as next_tile from (select distinct event, tile from tiles)),
       s as (select event, tile, avg(v) as mu, stddev_pop(v) as sd from px where phase = 'before' group by all)
       select p.event as fire, p.tile, n.next_tile, p.pos::int as pos, round((p.v - mu) / (sd + 1e-8), 5) as v, (q.v > 0)::int as label
       from n join px p on p.event = n.fire and p.tile = n.tile and p.phase = 'before' join s on s.event = n.fire and s.tile = n.tile
       join px q on q.event = n.fire and q.tile = n.next_tile and q.phase = 'during' and q.pos = p.pos""", NEED)
def _(spark, sf):
    """Tiles of an event stand for the days of a fire."""
    pair = R.pair_phases(A.tiles(spark, sf), ["v"])
    img = pair.select(F.col("event").alias("fire"), F.col("tile").alias("day"), "width", F.col("before_v").alias("v"),
                      F.expr("transform(during_v, x -> if(x > 0, cast(x as double), double('NaN')))").alias("fire_band"))
    out = K.training_pixels(img, S.day_pairs(img), ["v"], "fire_band")
    return out.select("fire", F.col("day").alias("tile"), F.col("next_day").alias("next_tile"), "pos", r("v", 5).alias("v"), "label")


@query("pca3", "R-19")
def _(spark, sf):
    out = K.pca3(A.table(spark, sf, "embeddings"), "embedding", "vec_id")
    return out.select("vec_id", *[r(f"c{i}").alias(f"c{i}") for i in range(3)])


for _kind, _label in (("forest", "quality"), ("boosting", "quality"), ("svm", "toxic")):
    @query(f"text_classifier_{_kind}", "K-6")
    def _(spark, sf, kind=_kind, label=_label):
        d = A.table(spark, sf, "documents").select("doc_id", "text")
        known = d.join(A.table(spark, sf, "labels"), "doc_id").withColumn("label", F.col(label).cast("double"))
        model = K.fit_text_classifier(known, "text", "label", kind)
        return model.transform(d).select("doc_id", F.col("prediction").cast("int").alias("prediction"))


FLOOD = """, q as (select event, tile, pos, "row", col, b * 100 + 105 as vv0, b * 80 + 95 as vh0, d * 100 + 95 as vv1, d * 80 + 85 as vh1, d from pair),
  m0 as (select event, tile, 'x' as phase, pos, "row", col, ((vv1 < 100 and vv0 > 100 and vv0 - vv1 > 10 or vh1 < 90 and vh0 > 90 and vh0 - vh1 > 10)
    and not (vv1 < 75 or vv0 < 75 or vh1 < 70 or vh0 < 70))::int as m from q)""" + box("m0", "s0", 1, "dilate")

#: Water of both phases: optical where the tile has an optical image, else radar.
WATER = (""", wvv as (select event, tile, phase, pos, "row", col, v * 100 + case when phase = 'before' then 105 else 95 end as v from px),
  wvh as (select event, tile, phase, pos, "row", col, v * 80 + case when phase = 'before' then 95 else 85 end as v from px)"""
         + gauss_sql(2.0, "wvv", "gv") + gauss_sql(2.0, "wvh", "gh") + threshold_sql("gv", "tv") + threshold_sql("gh", "th")
         + """, r0 as (select gv.event, gv.tile, gv.phase, gv.pos, gv."row", gv.col, (gv.v < tv.t and gh.v < th.t)::int as m from gv join gh using (event, tile, phase, pos)
           join tv using (event, tile, phase) join th using (event, tile, phase))"""
         + box("r0", "r1", 9, "dilate") + box("r1", "r2", 9, "erode") + box("r2", "r3", 1, "erode") + box("r3", "r4", 1, "dilate")
         + """, og as (select a.event, a.tile, a.phase, a.pos, a."row", a.col, (a.v - b.v) / case when a.v + b.v = 0 then 1e-10 else a.v + b.v end as v
           from px a join px b on a.event = b.event and a.tile = b.tile and a.phase = b.phase and b.pos = 63 - a.pos)"""
         + gauss_sql(1.5, "og", "o2") + ', o0 as (select event, tile, phase, pos, "row", col, (v > 0)::int as m from o2)'
         + box("o0", "oa", 4, "dilate") + box("oa", "ob", 4, "erode") + box("ob", "oc", 1, "erode") + box("oc", "od", 1, "dilate")
         + """, seen as (select od.* from od join (select event, tile, phase from tiles where label % 3 <> 0) using (event, tile, phase)),
  water as (select r4.event, r4.tile, r4.phase, r4.pos, coalesce(seen.m, r4.m) = 1 as w from r4 left join seen using (event, tile, phase, pos))""")


def _flood(spark, sf, scorer=None):
    tiles = A.tiles(spark, sf)
    t = tiles.withColumns({
        "vv": F.expr("transform(v, x -> cast(x as double) * 100 + if(phase = 'before', 105, 95))"),
        "vh": F.expr("transform(v, x -> cast(x as double) * 80 + if(phase = 'before', 95, 85))")})
    gt = tiles.filter("phase = 'during'").select(
        "event", "tile", F.expr("transform(v, x -> case when cast(x as double) > 0.15D then 2 when x < 0 then 1 else 0 end)").alias("gt"))
    optical = tiles.filter("label % 3 <> 0").select("event", "tile", "phase", "height", "width", F.col("v").alias("green"), F.reverse("v").alias("nir"))
    return jobs.flood_job(t, gt, chip=4, grow=1, scorer=scorer, optical=optical)


@query("flood_job_scores", "R-16 A-12 A-13 S-6 S-7",
       FLOOD + """, z as (select s.event, s.tile, s.m = 1 as p, (case when q.d > 0.15 then 2 when q.d < 0 then 1 else 0 end) = 1 as t from s0 s join q using (event, tile, pos))
       select event as event_id, tile::varchar as tile_id, count(*) filter (p and t)::double as tp, count(*) filter (p and not t)::double as fp,
       count(*) filter (not p and t)::double as fn, count(*) filter (not p and not t)::double as tn,
       round(count(*) filter (p) * 100.0::double / 1e6, 8) as pred_km2, round(count(*) filter (t) * 100.0::double / 1e6, 8) as gt_km2 from z group by all""", PAIR)
def _(spark, sf):
    """The metrics file of the job, written and read again."""
    path = work_dir(spark, "metrics")
    jobs.write_metrics(_flood(spark, sf).scores, path)
    rows = C.type_report(spark.read.option("header", True).csv(path))
    return rows.select("event_id", "tile_id", "tp", "fp", "fn", "tn", r("pred_km2", 8).alias("pred_km2"), r("gt_km2", 8).alias("gt_km2"))


@query("flood_job_changes", "R-16 A-10 J-18 R-7 R-8",
       FLOOD + WATER + """, z as (select s.event, s.tile, s.m = 1 as p, a.w as w0, b.w as w1 from s0 s
         join (select * from water where phase = 'before') a using (event, tile, pos) join (select * from water where phase = 'during') b using (event, tile, pos))
       select event, tile, count(*) filter (w0) as before_px, count(*) filter (w1 or p) as during_px, count(*) filter ((w1 or p) and not w0) as new_px,
       count(*) filter (p) as flood_pred_pixels from z group by all""", PAIR)
def _(spark, sf):
    """With a scorer of the caller that agrees with the rule wherever the rule fires."""
    res = _flood(spark, sf, lambda x: x["chip_before_vv"] * 0 + 1.0)
    return res.changes.select("event", "tile", "before_px", "during_px", "new_px", "flood_pred_pixels")


MEANS, STDS = [0.01, 0.02, 0.03, 0.0, -0.01, 0.05], [0.2, 0.3, 0.25, 0.2, 0.4, 0.3]
_BANDS = ("b", "d", "b * 2", "d * 2", "b + d", "b - d")
_Z = [f"(({x}) - {m!r}::double) / ({s!r}::double + 1e-10)" for x, m, s in zip(_BANDS, MEANS, STDS)]
FIRE = f""", q as (select event, tile, pos, "row", col, b, d, floor(b * 20) = 0 as nd from pair),
  m0 as (select event, tile, 'x' as phase, pos, "row", col, (not nd and ({" + ".join(_Z[:3])}) / 3 - ({" + ".join(_Z[3:])}) / 3 > 0)::int as m from q)""" + \
    box("m0", "s0", 1, "erode") + box("s0", "s1", 1, "dilate") + box("s1", "s2", 1, "dilate") + box("s2", "s3", 1, "erode")


def _fire(spark, sf, scorer=None, classes=2):
    """Six bands made of the two phases; nodata where the first one is."""
    pair = R.pair_phases(A.tiles(spark, sf), ["v"])
    t = pair.select("event", "tile", "height", "width", F.expr(
        "transform(zip_with(before_v, during_v, (x, y) -> named_struct('b', cast(x as double), 'd', cast(y as double))), z -> "
        "array(if(floor(z.b * 20) = 0, -9999D, z.b), z.d, z.b * 2, z.d * 2, z.b + z.d, z.b - z.d))").alias("bands"))
    gt = pair.select("event", "tile", F.expr("transform(during_v, x -> cast(x > 0 as int))").alias("gt"))
    cat = pair.selectExpr("event", "tile", "concat('S', tile) as tile_id", "if(tile % 3 = 0, 'validation', 'training') as source_split",
                          "concat('T', tile % 7) as mgrs", "cast(2018 + tile % 4 as int) as year", "cast(tile % 365 as int) as doy")
    return jobs.fire_job(t, gt, 4, 2, MEANS, STDS, scorer, classes, cat)


@query("fire_job_scores", "R-17 X-24 X-25",
       FIRE + """ select s.event, s.tile, count(*) filter (s.m = 1 and q.d > 0) as tp, count(*) filter (s.m = 1 and not q.d > 0) as fp,
       count(*) filter (s.m = 0 and q.d > 0) as fn, count(*) filter (s.m = 0 and not q.d > 0) as tn from s3 s join q using (event, tile, pos) group by all""", PAIR)
def _(spark, sf):
    return _fire(spark, sf).scores.select("event", "tile", "tp", "fp", "fn", "tn")


@query("fire_job_classes", "R-17 R-12 K-1",
       """, q as (select event, tile, pos, "row", col, b, d, floor(b * 20) = 0 as nd from pair),
       c as (select event, tile, 'x' as phase, pos, "row", col, case when nd then 0 when greatest(0.1, abs(b)) >= abs(d) and greatest(0.1, abs(b)) = 0.1 then 0
         when abs(b) >= abs(d) then 1 else 2 end as cls from q),
       m0 as (select event, tile, phase, pos, "row", col, (cls > 0)::int as m from c)"""
       + box("m0", "s0", 1, "erode") + box("s0", "s1", 1, "dilate") + box("s1", "s2", 1, "dilate") + box("s2", "s3", 1, "erode")
       + " select event, tile, string_agg(m::varchar, '' order by pos) as mask from s3 group by all", PAIR)
def _(spark, sf):
    """A caller's scorer of three classes on all six bands of overlapping chips."""
    b = lambda x, i: np.abs(x[f"chip_z{i}"] * (STDS[i] + 1e-10) + MEANS[i])
    score = lambda x: np.concatenate([np.full_like(x["chip_z0"], 0.1), b(x, 2) / 2, b(x, 3) / 2], axis=1)
    res = _fire(spark, sf, score, 3)
    return res.masks.select("event", "tile", F.array_join(F.transform("pred", lambda m: m.cast("string")), "").alias("mask"))


@query("fire_job_index", "R-17 S-12",
       """select distinct event, 'S' || tile as tile_id, case when tile % 3 = 0 then 'validation' else 'training' end as source_split, 'T' || tile % 7 as mgrs,
       (2018 + tile % 4)::int as year, (tile % 365)::int as doy from tiles""", ("tiles",))
def _(spark, sf):
    """The event index of the job, written nested and read again."""
    path = work_dir(spark, "index")
    C.write_nested_index(_fire(spark, sf).index, path)
    return C.read_nested_index(spark, path)


_IMAGE = """{out} as (select cell, delta, i, x + 0.6 as nir, y + 0.6 as sw, x * 200 < burn_pct - 30 as burn, x * 200 < burn_pct - 25 as gt
         from trip join scenes using (cell) join e on vec_id = scene % (select n from n) where scene = {scene})"""
TEMPORAL = TRIPLET + """, n as (select count(*) as n from embeddings), e as (select vec_id, i, embedding[i + 1]::double as x, embedding[64 - i]::double as y
         from embeddings, (select unnest(range(64)) as i)), """ + ", ".join(
    _IMAGE.format(out=o, scene=c) for o, c in (("s0", "bscene"), ("s1", "dscene"), ("s2", "ascene"))) + """,
       pp as (select cell, delta, s0.burn as b0, s1.burn as b1, greatest(-1, least(1, (s0.nir - s0.sw) / case when s0.nir + s0.sw = 0 then 1e-10 else s0.nir + s0.sw end))
         - greatest(-1, least(1, (s1.nir - s1.sw) / case when s1.nir + s1.sw = 0 then 1e-10 else s1.nir + s1.sw end)) as d from s0 join s1 using (cell, delta, i)),
       ph as (select 'before' as phase, cell, burn, gt from s0 union all select 'during', cell, burn, gt from s1 union all select 'after', cell, burn, gt from s2),
       sc as (select cell, phase, case when count(*) filter (burn or gt) > 0 then 2.0::double * count(*) filter (burn and gt) / (count(*) filter (burn) + count(*) filter (gt)) else 0 end as f1,
         case when count(*) filter (burn or gt) > 0 then count(*) filter (burn and gt)::double / count(*) filter (burn or gt) else 0 end as iou,
         count(*) filter (gt) * 900.0::double / 1e6 as gt_km2, count(*) filter (burn) * 900.0::double / 1e6 as pred_km2 from ph group by all),
       job as (select cell, delta, count(*) filter (b1 and not b0) as new_px, count(*) filter (b1 and b0) as existing_px, count(*) filter (b0 and not b1) as recovered_px,
         count(*) filter (d >= 0.27) as moderate_or_worse, count(*) filter (b1 and not b0) * 900.0::double / 1e6 as new_km2 from pp group by cell, delta),
       sb as (select * from sc where phase = 'before'), su as (select * from sc where phase = 'during'), sa as (select * from sc where phase = 'after')"""


def _temporal(spark, sf):
    """Scenes are orders; a scene's image is the embedding its key points to."""
    e = A.table(spark, sf, "embeddings")
    n = e.agg(F.count(F.lit(1))).scalar()
    s = A.scenes(spark, sf)
    img = s.withColumn("vec_id", F.col("scene") % n).join(e.select("vec_id", "embedding"), "vec_id")
    burnt = lambda less: F.expr(f"transform(embedding, x -> cast(cast(x as double) * 200 < burn_pct - {less} as int))")
    img = img.select("scene", F.lit(8).alias("width"), F.expr("transform(embedding, x -> cast(x as double) + 0.6)").alias("nir"),
                     F.expr("reverse(transform(embedding, x -> cast(x as double) + 0.6))").alias("swir2"), burnt(30).alias("burn"), burnt(25).alias("gt"))
    return jobs.fire_temporal_job(s, img)


@query("fire_temporal_job", "R-18 X-21 X-22 X-29 W-4",
       TEMPORAL + " select cell, round(job.delta, 6) as burn_delta, new_px, existing_px, recovered_px, moderate_or_worse, round(new_km2, 6) as new_km2, "
       + ", ".join(f"round({t}.{c}, 6) as {p}_{c}" for t, p in (("sb", "before"), ("su", "during"), ("sa", "after")) for c in ("f1", "iou", "gt_km2", "pred_km2"))
       + " from job left join sb using (cell) left join su using (cell) left join sa using (cell)", ("scenes",))
def _(spark, sf):
    out = _temporal(spark, sf)
    return out.select("cell", r("burn_delta").alias("burn_delta"), "new_px", "existing_px", "recovered_px", "moderate_or_worse", r("new_km2").alias("new_km2"),
                      *[r(c).alias(c) for p in jobs.PHASES for c in (f"{p}_f1", f"{p}_iou", f"{p}_gt_km2", f"{p}_pred_km2")])


@query("fire_temporal_summary", "R-18 A-26",
       TEMPORAL + """ select count(*) as n, round(avg(sb.f1), 6) as avg_before, round(avg(su.f1), 6) as avg_during,
       round(coalesce(avg(sa.f1) filter (sa.f1 > 0), 0), 6) as avg_after, count(*) filter (sa.f1 > 0) as n_with_after, round(avg(job.delta), 6) as avg_delta, round(max(job.delta), 6) as max_delta
       from job left join sb using (cell) left join su using (cell) left join sa using (cell)""", ("scenes",))
def _(spark, sf):
    out = jobs.summary(_temporal(spark, sf))
    return out.select("n", *[r(c).alias(c) for c in ("avg_before", "avg_during", "avg_after")], "n_with_after", r("avg_delta").alias("avg_delta"), r("max_delta").alias("max_delta"))
