"""Registered queries over scenes and fire days."""

from pyspark.sql import functions as F

from hazardlake.operators import scenes as S
from hazardlake.plans import fixtures as A
from hazardlake.plans.common import joined, r
from hazardlake.registry import query

ID = "case when o_orderkey % 7 = 0 then {j} else {c} end"


def _ids(spark, sf):
    return A.scenes(spark, sf).selectExpr(
        "scene", "case when scene % 7 = 0 then concat('plain_', scene) else concat('subsetted_512x512_HLS.S30.', cell, '.', year, "
        "lpad(cast(doy as string), 3, '0'), '.v1.4') end as tile_id")


@query("parse_scene_id", "X-13",
       """select scene, case when scene % 7 <> 0 then cell end as cell, case when scene % 7 <> 0 then year end as year,
       case when scene % 7 <> 0 then doy end as doy, case when scene % 7 <> 0 then 'FIRE_' || cell || '_' || year end as event from scenes""", ("scenes",))
def _(spark, sf):
    return _ids(spark, sf).select("scene", S.parse_scene_id(F.col("tile_id")).alias("p")).select("scene", "p.cell", "p.year", "p.doy", "p.event")


@query("parse_event_id", "X-14",
       """select scene, case when scene % 5 = 0 then 'OTHER_' || cell else 'Wildfire Event — ' || cell || ' (' || year || ')' end as title,
       case when scene % 5 = 0 then '' else 'Burn-scar observations at MGRS grid cell ' || cell || ' during ' || year end as description,
       case when scene % 5 = 0 then 0 else year end as year from scenes""", ("scenes",))
def _(spark, sf):
    s = A.scenes(spark, sf).selectExpr("scene", "case when scene % 5 = 0 then concat('OTHER_', cell) else concat('FIRE_', cell, '_', year) end as e")
    return s.select("scene", S.parse_event_id(F.col("e")).alias("p")).select("scene", "p.title", "p.description", "p.year")


@query("doy_date", "X-15", "select scene, strftime(day, '%Y-%m-%d') as day from scenes", ("scenes",))
def _(spark, sf):
    return A.scenes(spark, sf).select("scene", S.doy_date(F.col("year"), F.col("doy")).cast("string").alias("day"))


_LIM = {"good": "b.burn_pct > 5", "both_burnt": "a.burn_pct > 2 and b.burn_pct > 10", "clean_before": "a.burn_pct < 5 and b.burn_pct > 5"}
for _kind, _k in (("good", 15), ("both_burnt", 10), ("clean_before", 10)):
    @query(f"top_pairs_{_kind}", "J-9 J-10 T-3",
           f"""select a.cell, a.scene as scene1, a.day::varchar as day1, a.burn_pct as burn1, b.scene as scene2, b.day::varchar as day2, b.burn_pct as burn2,
           round(b.burn_pct - a.burn_pct, 6) as delta from scenes a join scenes b on a.cell = b.cell and a.day < b.day
           and b.burn_pct > a.burn_pct and {_LIM[_kind]}
           order by b.burn_pct - a.burn_pct desc, a.cell, b.day, b.scene, a.day, a.scene limit {_k}""", ("scenes",))
    def _(spark, sf, kind=_kind, k=_k):
        out = S.top_pairs(A.scenes(spark, sf), k, kind)
        return out.withColumns({"day1": F.col("day1").cast("string"), "day2": F.col("day2").cast("string"), "delta": r("delta")})


@query("best_rise", "J-9",
       """select b.cell, b.scene, min(a.burn_pct) as best, round(b.burn_pct - min(a.burn_pct), 6) as delta
       from scenes a join scenes b on a.cell = b.cell and a.day < b.day where b.burn_pct > 5
       group by b.cell, b.scene, b.burn_pct having b.burn_pct > min(a.burn_pct)""", ("scenes",))
def _(spark, sf):
    return S.best_rise(A.scenes(spark, sf)).select("cell", "scene", "best", r("delta").alias("delta"))


TRIPLET = """, pk as (select cell, arg_max(row(burn_pct, day, scene), row(burn_pct, -(epoch(day)::bigint), -scene)) as d, count(*) as n_dates
   from scenes group by 1 having count(*) >= 2 and max(burn_pct) >= 5),
 p as (select cell, n_dates, (d)[1] as dburn, (d)[2] as dday, (d)[3] as dscene from pk),
 o as (select s.cell, s.scene, s.day, s.burn_pct, dday, dscene, dburn, n_dates from scenes s join p using (cell) where s.scene <> dscene),
 b as (select cell, any_value(n_dates) as n_dates, any_value(dscene) as dscene, any_value(dday) as dday, any_value(dburn) as dburn,
   coalesce(arg_min(scene, row(burn_pct, day, scene)) filter (day < dday), arg_min(scene, row(burn_pct, day, scene))) as bscene from o group by cell),
 bb as (select b.*, s.burn_pct as bburn, s.day as bday from b join scenes s on s.cell = b.cell and s.scene = bscene),
 a as (select o.cell, arg_min(o.scene, row(o.burn_pct, o.day, o.scene)) as ascene from o join bb on o.cell = bb.cell and o.scene <> bb.bscene
   where o.day > o.dday group by 1),
 trip as (select bb.cell, bscene, dscene, ascene, n_dates, dburn - bburn as delta, bday > dday as before_is_later from bb left join a using (cell))"""


def _trip(df):
    return df.select("cell", F.col("before.scene").alias("bscene"), F.col("during.scene").alias("dscene"),
                     F.col("after.scene").alias("ascene"), "n_dates", r("burn_delta").alias("delta"), "before_is_later")


@query("fire_triplets", "W-4 J-11 R-18",
       TRIPLET + " select cell, bscene, dscene, ascene, n_dates, round(delta, 6) as delta, before_is_later from trip", ("scenes",))
def _(spark, sf):
    return _trip(S.fire_triplets(A.scenes(spark, sf)))


@query("order_locations", "T-4",
       TRIPLET + " select cell, bscene, dscene, ascene, n_dates, round(delta, 6) as delta, before_is_later from trip order by trip.delta desc, cell limit 20", ("scenes",))
def _(spark, sf):
    return _trip(S.order_locations(S.fire_triplets(A.scenes(spark, sf)), 20))


@query("progressing_cells", "F-12",
       "select cell, count(*) as n, max(burn_pct) as max_burn, min(burn_pct) as min_burn from scenes group by 1 having n >= 3 and max_burn > 30 and min_burn < 10", ("scenes",))
def _(spark, sf):
    return S.progressing_cells(A.scenes(spark, sf))


@query("cell_dates", "A-23",
       """select cell, sum(n)::bigint as n, string_agg(year || '-' || lpad(doy::varchar, 3, '0') || '(' || split[1] || ')' || case when n > 1 then '×' || n else '' end, ', '
       order by year || '-' || lpad(doy::varchar, 3, '0') || '(' || split[1] || ')') as dates
       from (select cell, year, doy, split, count(*) as n from scenes group by all) group by 1""", ("scenes",))
def _(spark, sf):
    return S.cell_dates(A.scenes(spark, sf))


@query("fire_events", "A-24",
       "select 'FIRE_' || cell || '_' || year as event, count(*) as n_tiles, min(day)::varchar as first_day, max(day)::varchar as last_day from scenes group by 1", ("scenes",))
def _(spark, sf):
    e = S.fire_events(A.scenes(spark, sf))
    return e.withColumns({c: F.col(c).cast("string") for c in ("first_day", "last_day")})


@query("order_tiles", "W-9",
       "select cell as event, scene, row_number() over (partition by cell order by day, scene) as position from scenes", ("scenes",))
def _(spark, sf):
    s = A.scenes(spark, sf).select(F.col("cell").alias("event"), "scene", "day")
    return S.order_tiles(s).select("event", "scene", F.col("position").cast("bigint").alias("position"))


@query("tile_split", "J-16",
       "select s.scene, coalesce(o.o_orderpriority, 'training') as source_split from scenes s left join orders o on s.scene = o.o_orderkey * 2", ("scenes",))
def _(spark, sf):
    idx = A.table(spark, sf, "orders").selectExpr("o_orderkey * 2 as scene", "o_orderpriority as source_split")
    return S.tile_split(A.scenes(spark, sf).select("scene"), idx)


@query("phase_summary", "A-26",
       TRIPLET + """, f as (select (bscene % 100) / 100.0::double as b, (dscene % 90) / 90.0::double as d, coalesce((ascene % 80) / 80.0::double, 0) as a, delta from trip)
       select count(*) as n, round(avg(b), 6) as avg_before, round(avg(d), 6) as avg_during, round(avg(a) filter (a > 0), 6) as avg_after,
       count(*) filter (a > 0) as n_with_after, round(avg(delta), 6) as avg_delta, round(max(delta), 6) as max_delta from f""", ("scenes",))
def _(spark, sf):
    t = S.fire_triplets(A.scenes(spark, sf)).selectExpr(
        "(before.scene % 100) / 100.0D as before_f1", "(during.scene % 90) / 90.0D as during_f1",
        "coalesce((after.scene % 80) / 80.0D, 0.0D) as after_f1", "burn_delta")
    out = S.phase_summary(t)
    return out.withColumns({c: r(c) for c in ("avg_before", "avg_during", "avg_after", "avg_delta", "max_delta")})


DD = ", dd as (select distinct fire, day from days)"


@query("day_pairs", "W-1",
       DD + """ select fire, day::varchar as day, next_day::varchar as next_day from (select fire, day, lead(day) over (partition by fire order by day) as next_day from dd)
       where next_day is not null""", ("days",))
def _(spark, sf):
    d = S.day_pairs(A.days(spark, sf))
    return d.select("fire", F.col("day").cast("string").alias("day"), F.col("next_day").cast("string").alias("next_day"))


def _days_text(arr):
    return joined(F.transform(arr, lambda d: d.cast("string")), ",")


@query("day_windows", "W-2",
       DD + """, n as (select fire, day, row_number() over (partition by fire order by day) as i from dd)
       select a.fire, string_agg(b.day::varchar, ',' order by b.day) as days, any_value(l.day)::varchar as label_day
       from n a join n b on a.fire = b.fire and b.i between a.i and a.i + 3 join n l on l.fire = a.fire and l.i = a.i + 4 group by a.fire, a.i""", ("days",))
def _(spark, sf):
    d = S.day_windows(A.days(spark, sf), 4)
    return d.select("fire", _days_text("days").alias("days"), F.col("label_day").cast("string").alias("label_day"))


@query("trailing_windows", "W-3",
       DD + """, n as (select fire, day, row_number() over (partition by fire order by day) as i from dd)
       select a.fire, string_agg(b.day::varchar, ',' order by b.day) as days, a.day::varchar as last_day
       from n a join n b on a.fire = b.fire and b.i between a.i - 3 and a.i where a.i >= 4 group by a.fire, a.day""", ("days",))
def _(spark, sf):
    d = S.trailing_windows(A.days(spark, sf), 4)
    return d.select("fire", _days_text("days").alias("days"), F.col("last_day").cast("string").alias("last_day"))


LISTING = ", pd as (select year(day)::int as year, fire, day, sum(value) as bytes from days group by all)"


@query("fire_listing", "A-21",
       LISTING + """ select year, fire, count(*) as n_days, round(sum(bytes), 3) as bytes, (case when fire is null then 1 else 0 end + case when year is null then 2 else 0 end)::bigint as level
       from pd group by grouping sets ((year, fire), (year), ())""", ("days",))
def _(spark, sf):
    out = S.fire_listing(A.days(spark, sf), "value")
    return out.select("year", "fire", "n_days", r("bytes", 3).alias("bytes"), "level")


def _listing(spark, sf):
    return S.fire_listing(A.days(spark, sf), "value").select("year", "fire", "n_days")


@query("longest_fires", "F-7 T-5", LISTING + " select year, fire, count(*) as n_days from pd group by all order by n_days desc, year, fire limit 5", ("days",))
def _(spark, sf):
    return S.select_fires(_listing(spark, sf), 5)


@query("fires_of_year", "F-7", LISTING + " select year, fire, count(*) as n_days from pd where year = 2024 group by all order by fire limit 5", ("days",))
def _(spark, sf):
    return S.select_fires(_listing(spark, sf), 5, year=2024)


@query("fires_by_id", "F-7", LISTING + " select year, fire, count(*) as n_days from pd where fire in (3, 7, 11) group by all", ("days",))
def _(spark, sf):
    return S.select_fires(_listing(spark, sf), 5, ids=[3, 7, 11])


DRAW = "md5(concat_ws(':', '{seed}', {keys}))[:15]"


@query("sample_days", "T-6",
       DD + f""", p as (select *, lead(day) over (partition by fire order by day) as next_day from dd),
       s as (select * from p where next_day is not null order by {DRAW.format(seed=42, keys='fire, day')}, fire, day limit 200) select * from s""", ("days",))
def _(spark, sf):
    d = S.day_pairs(A.days(spark, sf))
    return S.sample_n(d, 200, 42, ["fire", "day"])


@query("split_fires", "K-5",
       f""", f as (select distinct fire from days),
       n as (select fire, row_number() over (order by {DRAW.format(seed=42, keys='fire')}, fire) as place, count(*) over () as total from f)
       select fire, case when total < 2 then 'both' when place <= greatest(1, floor(total * 0.8::double)) then 'train' else 'val' end as split from n""", ("days",))
def _(spark, sf):
    return S.split_fires(A.days(spark, sf), 42)


@query("split_windows", "J-17",
       DD + """ select split, count(*) as n from (select d.fire, case when d.fire % 5 = 0 then 'val' else 'train' end as split,
       lead(day, 4) over (partition by d.fire order by day) as l from dd d) where l is not null group by 1""", ("days",))
def _(spark, sf):
    days = A.days(spark, sf)
    assignment = days.select("fire").distinct().selectExpr("fire", "case when fire % 5 = 0 then 'val' else 'train' end as split")
    return S.split_windows(S.day_windows(days), assignment).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("reference_pairing", "K-8",
       f""", n as (select scene, row_number() over (order by {DRAW.format(seed=42, keys='scene')}, scene) as place, count(*) over () as total from scenes)
       select a.scene, b.scene as ref_scene from n a join n b on b.place = a.place % a.total + 1""", ("scenes",))
def _(spark, sf):
    return S.pair_with_other(A.scenes(spark, sf).select("scene"), 42, "scene")
