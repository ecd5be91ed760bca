"""Registered queries over sources and sinks: files written from the tables and read back."""

from pyspark.sql import functions as F

from hazardlake.plans import fixtures as A
from hazardlake.plans.common import iso, r, sql_iso
from hazardlake.registry import query
from hazardlake.session import work_dir
from hazardlake.sources import catalogue as C
from hazardlake.sources.posts import append_jsonl, read_posts


@query("read_posts", "S-1",
       """select id::varchar as id, platform, lang, length(coalesce(text, article_content, description, caption, content)) as n,
       comments as comment_count from posts""", ("posts",))
def _(spark, sf):
    """Posts written as a mixed log, then read with the declared schema."""
    path = work_dir(spark, "post-log")
    cols = ["id", "platform", "lang", "text", "headline", "article_content", "title", "description", "content",
            "caption", "likes", "shares", "retweets", "replies", "comments"]
    p = A.posts(spark, sf).select(*cols).withColumn("id", F.col("id").cast("string"))
    append_jsonl(p, path)
    got = read_posts(spark, path)
    body = F.coalesce("text", "article_content", "description", "caption", "content")
    return got.select("id", "platform", "lang", F.length(body).cast("bigint").alias("n"), "comment_count")


@query("append_jsonl", "S-3", "select source, count(*) * 2 as n from documents group by 1")
def _(spark, sf):
    path = work_dir(spark, "news")
    d = A.table(spark, sf, "documents").select("doc_id", "source", F.col("text").alias("content"))
    append_jsonl(d, path)
    append_jsonl(d, path)
    return spark.read.schema("source string").json(path).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("report_csv", "S-6 S-7",
       """select event as event_id, tile::varchar as tile_id, count(*)::double as n_pred, case when tile % 3 = 0 then null else round(avg(score), 6) end as f1
       from eval group by event, tile""", ("eval",))
def _(spark, sf):
    path = work_dir(spark, "metrics")
    rows = (A.evaluation(spark, sf).groupBy(F.col("event").alias("event_id"), F.col("tile").cast("string").alias("tile_id"))
            .agg(F.count(F.lit(1)).alias("n_pred"), r(F.avg("score")).cast("string").alias("f1")))
    rows = rows.withColumn("f1", F.when(F.col("tile_id").cast("int") % 3 == 0, "n/a").otherwise(F.col("f1")))
    C.write_report_csv(rows, path)
    return C.read_report_csv(spark, path, "event_id string, tile_id string, n_pred string, f1 string")


@query("report_without_average", "S-7",
       "select tile::varchar as tile_id, round(avg(score), 6) as f1 from eval group by tile", ("eval",))
def _(spark, sf):
    """Rows as the reports store them, with the average row that readers must drop."""
    e = A.evaluation(spark, sf)
    rows = e.groupBy(F.col("tile").cast("string").alias("tile_id")).agg(r(F.avg("score")).cast("string").alias("f1"))
    avg = e.agg(r(F.avg("score")).cast("string").alias("f1")).select(F.lit("AVERAGE").alias("tile_id"), "f1")
    raw = rows.unionByName(avg).withColumn("event_id", F.lit("E"))
    return C.type_report(raw).select("tile_id", "f1")


@query("read_manifest", "S-8 J-13",
       """select 's1_' || scene || '.tif' as s1, 'lb_' || scene || '.tif' as label from scenes where burn_pct >= 10
       and scene in (select o_custkey * 2 from orders) and scene in (select o_custkey * 3 from orders)""", ("scenes",))
def _(spark, sf):
    path = work_dir(spark, "manifest")
    lines = A.scenes(spark, sf).selectExpr(
        "case when burn_pct < 10 then concat('s1_', scene, '.tif') else concat(' s1_', scene, '.tif , lb_', scene, '.tif') end as value")
    lines.write.text(path)
    o = A.table(spark, sf, "orders")
    files = o.selectExpr("concat('s1_', o_custkey * 2, '.tif') as name").unionByName(o.selectExpr("concat('lb_', o_custkey * 3, '.tif') as name"))
    return C.existing_samples(C.read_manifest(spark, path), files)


@query("site_catalogue", "S-9",
       r"""select url, nullif(regexp_extract(url, '^https?://([^/]+)/([a-z]{2})/(\d+)', 1), '') as event,
       nullif(regexp_extract(url, '^https?://([^/]+)/([a-z]{2})/(\d+)', 2), '') as phase,
       nullif(regexp_extract(url, '^https?://([^/]+)/([a-z]{2})/(\d+)', 3), '') as tile from pages""")
def _(spark, sf):
    return C.site_catalogue(A.table(spark, sf, "pages").select("url"))


def _paths(spark, sf):
    return A.tiles(spark, sf).selectExpr(
        "concat('/data/', event, case when label % 5 = 0 then '/flood_mask/' when label % 2 = 0 then concat('/s1_', phase, '_flood/') "
        "else concat('/s2_', phase, '_flood/') end, lpad(cast(tile as string), 6, '0'), '_x.tif') as path")


@query("tile_catalogue", "S-9",
       """select event, case when label % 5 = 0 then null when label % 2 = 0 then 's1' else 's2' end as sensor,
       case when label % 5 = 0 then 'mask' else phase end as phase, lpad(tile::varchar, 6, '0') as tile from tiles""", ("tiles",))
def _(spark, sf):
    return C.tile_catalogue(_paths(spark, sf)).select("event", "sensor", "phase", "tile")


@query("filter_events", "F-8",
       """select event, phase, lpad(tile::varchar, 6, '0') as tile from tiles where label % 5 <> 0 and event in ('EV1', 'EV4', 'EV7')
       and event in (select event from tiles where label % 5 <> 0 and phase = 'before') and event in (select event from tiles where label % 5 <> 0 and phase = 'during')""", ("tiles",))
def _(spark, sf):
    cat = C.tile_catalogue(_paths(spark, sf)).filter("phase <> 'mask'")
    return C.filter_events(cat, ["EV1", "EV4", "EV7"]).select("event", "phase", "tile")


@query("event_index", "S-12",
       "select 'FIRE_' || cell || '_' || year as event, scene::varchar as tile_id, split as source_split, cell as mgrs, year, doy from scenes", ("scenes",))
def _(spark, sf):
    """Event index written as JSON lines and read back."""
    path = work_dir(spark, "event-index")
    s = A.scenes(spark, sf).selectExpr(
        "concat('FIRE_', cell, '_', year) as event", "cast(scene as string) as tile_id", "split as source_split", "cell as mgrs", "year", "doy")
    C.write_event_index(s, path)
    return C.read_event_index(spark, path)
