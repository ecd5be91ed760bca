"""Registered queries over map reports."""

from pyspark.sql import functions as F

from hazardlake.functions import lexicons as L
from hazardlake.functions import text as X
from hazardlake.operators import maps as M
from hazardlake.plans import fixtures as A
from hazardlake.plans.common import iso, joined, r, sql_iso
from hazardlake.registry import query

RANK = "case severity when 'critical' then 0 when 'high' then 1 when 'medium' then 2 when 'low' then 3 else 4 end"


def _cluster_sql(zoom):
    size = 180.0 / 2 ** zoom
    return f""", c as (select *, trunc(lat / {size!r}::double)::int as cy, trunc(lng / {size!r}::double)::int as cx, {RANK} as rk from reports),
    t as (select cy, cx, disaster_type, count(*) as k, min(id) as seen from c group by all),
    d as (select cy, cx, arg_max(disaster_type, row(k, -seen)) as dominant_type from t group by all)
    select cy, cx, round(avg(lat), 6) as lat, round(avg(lng), 6) as lng, count(*) as n, dominant_type,
      arg_min(severity, row(rk, id)) as severity
    from c join d using (cy, cx) group by cy, cx, dominant_type"""


def _clusters(zoom):
    def run(spark, sf):
        out = M.grid_clusters(A.reports(spark, sf), zoom)
        return out.select("cy", "cx", r("lat").alias("lat"), r("lng").alias("lng"), "n", "dominant_type", "severity")
    return run


for _name, _z in (("grid_clusters", 5), ("grid_clusters_world", 1), ("grid_clusters_city", 10)):
    query(_name, "A-7 X-30 X-31", _cluster_sql(_z), ("reports",))(_clusters(_z))


@query("cluster_members", "A-7",
       f"select id, trunc(lat / {180 / 2 ** 5!r}::double)::int as cy, trunc(lng / {180 / 2 ** 5!r}::double)::int as cx from reports",
       ("reports",))
def _(spark, sf):
    return M.cluster_members(A.reports(spark, sf), 5)


@query("heat_points", "A-8 X-30",
       """select id, lat, lng, case severity when 'critical' then 1.0::double when 'high' then 0.7 when 'medium' then 0.4 else 0.2 end as intensity
       from reports""", ("reports",))
def _(spark, sf):
    return M.heat_points(A.reports(spark, sf))


@query("severity_rank", "X-30", f"select id, {RANK} as rank from reports", ("reports",))
def _(spark, sf):
    return A.reports(spark, sf).select("id", M.severity_rank(F.col("severity")).alias("rank"))


@query("grid_cell", "X-31", "select id, trunc(lat / 11.25::double)::int as cy, trunc(lng / 11.25::double)::int as cx from reports", ("reports",))
def _(spark, sf):
    return A.reports(spark, sf).select("id", M.cell_index(F.col("lat"), 11.25).alias("cy"), M.cell_index(F.col("lng"), 11.25).alias("cx"))


@query("state_summary", "A-6",
       f""", t as (select state, string_agg(disaster_type || '=' || n, '|' order by disaster_type) as types from
         (select state, disaster_type, count(*) as n from reports group by all) group by 1),
       l as (select state, string_agg(severity || '=' || n, '|' order by severity) as levels from
         (select state, severity, count(*) as n from reports group by all) group by 1)
       select state, count(*) as total_reports, count(*) as active_reports, types, levels, {sql_iso('max(created_at)')} as latest
       from reports join t using (state) join l using (state) group by state, types, levels""", ("reports",))
def _(spark, sf):
    text = lambda m: joined(F.transform(F.array_sort(F.map_entries(m)),
                                        lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    s = M.state_summary(A.reports(spark, sf))
    return s.select("state", "total_reports", "active_reports", text(F.col("disaster_types")).alias("types"),
                    text(F.col("severity_breakdown")).alias("levels"), iso("latest_report_at").alias("latest"))


@query("report_query", "F-6",
       f"select id, severity, {sql_iso('created_at')} as at from reports where disaster_type = 'BUILDING' and severity = 'high' and lower(state) = 'nation_7' and status = 'verified'",
       ("reports",))
def _(spark, sf):
    return M.report_query(A.reports(spark, sf), "BUILDING", "high", "Nation_7").select("id", "severity", iso("created_at").alias("at"))


@query("reports_unverified_too", "F-6", "select id, status from reports where lower(state) = 'nation_3'", ("reports",))
def _(spark, sf):
    return M.report_query(A.reports(spark, sf), state="NATION_3", verified_only=False).select("id", "status")


@query("map_pins", "F-13",
       f"select id, lat, lng, disaster_type, severity, title, state as location_name, source_count, {sql_iso('created_at')} as created_at from reports",
       ("reports",))
def _(spark, sf):
    pins = M.to_pins(M.nest_report(A.reports(spark, sf)))
    return pins.withColumn("created_at", iso("created_at"))


@query("geocode", "J-5",
       """select c_custkey as id, coalesce(nullif(case when c_custkey % 4 = 0 then 1.5 when c_custkey % 4 = 1 then 0 end, 0), g.n_nationkey + 0.25, 20.5)::double as lat,
       coalesce(g.n_regionkey + 0.5, 78.9)::double as lng, coalesce(g.n_name, 'Unknown') as state
       from customer left join nation g on 'NATION_' || (c_nationkey * 2) = g.n_name""")
def _(spark, sf):
    c = A.table(spark, sf, "customer").selectExpr(
        "c_custkey as id", "concat('NATION_', c_nationkey * 2) as location_name",
        "cast(case when c_custkey % 4 = 0 then 1.5 when c_custkey % 4 = 1 then 0 end as double) as lat",
        "0.0D as lng", "'' as state")
    gaz = A.table(spark, sf, "nation").selectExpr("n_name as name", "n_nationkey + 0.25D as g_lat", "n_regionkey + 0.5D as g_lng", "n_name as g_state")
    return M.geocode(c, gaz).select("id", "lat", "lng", "state")


@query("geocode_gazetteer", "J-5",
       """, g(name, glat, glng, gstate) as (values """
       + ", ".join(f"('{n}', {la!r}::double, {ln!r}::double, '{s}')" for n, la, ln, s in L.GAZETTEER)
       + """) select id, coalesce(glat, 20.5) as lat, coalesce(glng, 78.9) as lng, coalesce(gstate, 'Unknown') as state
       from (select doc_id as id, (['Mumbai','Goa','Wayanad','Nowhere'])[doc_id % 4 + 1] as n from documents) left join g on n = name""")
def _(spark, sf):
    d = A.table(spark, sf, "documents").selectExpr(
        "doc_id as id", "element_at(array('Mumbai','Goa','Wayanad','Nowhere'), cast(doc_id % 4 as int) + 1) as location_name",
        "cast(null as double) as lat", "cast(null as double) as lng", "cast(null as string) as state")
    return M.geocode(d, M.gazetteer(spark)).select("id", "lat", "lng", "state")


@query("link_sources", "J-7 X-9",
       """, p as (select place, id as post_id, platform, left(coalesce(nullif(body, ''), ''), 120) as snippet,
         row_number() over (partition by place order by id) as rank from posts where is_disaster)
       select r.id, count(post_id) as n, string_agg(post_id || ':' || platform, '|' order by rank) as sources,
       sum(length(snippet))::bigint as chars from reports r left join p on r.state = p.place and rank <= 5 group by r.id""", ("reports", "posts"))
def _(spark, sf):
    p = A.posts(spark, sf).select("is_disaster", F.col("place").alias("state"), F.col("id").alias("post_id"), "platform",
                                  X.snippet(F.col("body"), F.col("headline")).alias("snippet"),
                                  F.col("user").alias("author"), F.col("ts").alias("posted_at"))
    out = M.link_sources(A.reports(spark, sf).select("id", "state"), p, "state", ["post_id"])
    s = F.col("sources")
    return out.select("id", F.coalesce(F.size(s), F.lit(0)).cast("bigint").alias("n"),
                      joined(F.transform(s, lambda x: F.concat_ws(":", x["post_id"].cast("string"), x["platform"]))).alias("sources"),
                      F.aggregate(F.transform(s, lambda x: F.length(x["snippet"])), F.lit(0), lambda a, x: a + x).cast("bigint").alias("chars"))


@query("link_by_ids", "J-8",
       """, w as (select id, unnest([id, id * 3 + 1, id * 7 + 2]) as post_id, unnest([0, 1, 2]) as pos from reports)
       select w.id, count(*) as source_count, string_agg(p.id::varchar, '|' order by pos) as sources,
       array_to_string(list_sort(list(distinct p.platform)), '|') as platforms from w join posts p on p.id = w.post_id group by w.id""",
       ("reports", "posts"))
def _(spark, sf):
    rep = A.reports(spark, sf).select("id", F.array(F.col("id"), F.col("id") * 3 + 1, F.col("id") * 7 + 2).alias("post_ids"))
    p = A.posts(spark, sf).select(F.col("id").alias("post_id"), "platform", X.snippet(F.col("body"), F.col("headline")).alias("snippet"))
    out = M.link_by_ids(rep, p)
    return out.select("id", "source_count", joined(F.transform("sources", lambda s: s["post_id"].cast("string"))).alias("sources"),
                      joined("platforms").alias("platforms"))


@query("verification_rollup", "A-30",
       """select place, count(*) as source_count, array_to_string(list_sort(list(distinct platform)), '|') as platforms from posts group by 1""", ("posts",))
def _(spark, sf):
    out = M.verification_rollup(A.posts(spark, sf), "place")
    return out.withColumn("platforms", joined("platforms"))


@query("join_authors", "J-6",
       """select o_orderkey as id, coalesce(c_name, 'unknown') as "user", n_name as place from orders
       left join customer on o_custkey * 2 = c_custkey left join nation on o_custkey % 40 = n_nationkey""")
def _(spark, sf):
    t = A.table(spark, sf, "orders").selectExpr("o_orderkey as id", "o_custkey * 2 as author_id", "cast(o_custkey % 40 as int) as place_id")
    u = A.table(spark, sf, "customer").selectExpr("c_custkey as author_id", "c_name as username")
    p = A.table(spark, sf, "nation").selectExpr("n_nationkey as place_id", "n_name as place")
    return M.join_authors(t, u, p).select("id", "user", "place")
