"""Adapters: the given tables seen as posts, reports, scenes, tiles, ... (whole tables).

Each adapter exists twice, as a DataFrame and as the text of a SQL common table
expression, so that a query and its SQL twin start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


PLATFORM = "element_at(array('twitter','facebook','youtube','news','instagram'), cast({k} % 5 as int) + 1)"
TYPE = ("element_at(array('flood','cyclone','earthquake','landslide','tsunami','drought','fire',"
        "'heavy_rain'), cast({k} % 8 as int) + 1)")
LEVEL = "element_at(array('critical','high','medium','low','unrated'), cast({k} % 5 as int) + 1)"

CTES: dict[str, str] = {}


def posts(spark: SparkSession, sf: str) -> DataFrame:
    """documents as posts of five platforms; prose fills the platform's own text field."""
    d = table(spark, sf, "documents")
    d = d.selectExpr(
        "doc_id as id", f"{PLATFORM.format(k='doc_id')} as platform", "lang", "source as user",
        "doc_id % 3 = 0 as verified", "text as body", "n_chars",
        "timestamp_seconds(1704067200 + (doc_id * 13709) % 2592000) as ts",
        f"{TYPE.format(k='doc_id')} as disaster_type",
        "element_at(array('critical','high','medium','low'), cast(n_chars % 4 as int) + 1) as urgency",
        "n_chars > 500 as is_disaster",
        "concat('NATION_', doc_id % 25) as place",
        "n_chars % 1000 as likes")
    return d.selectExpr(
        "*",
        "case when platform = 'twitter' then body end as text",
        "case when platform in ('news', 'youtube') then user end as headline",
        "case when platform = 'news' then body end as article_content",
        "case when platform = 'youtube' then user end as title",
        "case when platform = 'youtube' then body end as description",
        "case platform when 'facebook' then body when 'instagram' then '' end as content",
        "case when platform = 'instagram' then body end as caption",
        "case when platform in ('facebook', 'news') then id % 7 end as shares",
        "case when platform = 'twitter' then n_chars % 50 end as retweets",
        "case when platform in ('facebook', 'instagram') then id % 11 end as comments",
        "case when platform = 'twitter' then n_chars % 13 end as replies")


CTES["posts"] = """
select *, case when platform = 'twitter' then body end as text,
  case when platform in ('news', 'youtube') then "user" end as headline,
  case when platform = 'news' then body end as article_content,
  case when platform = 'youtube' then "user" end as title,
  case when platform = 'youtube' then body end as description,
  case platform when 'facebook' then body when 'instagram' then '' end as content,
  case when platform = 'instagram' then body end as caption,
  case when platform in ('facebook', 'news') then id % 7 end as shares,
  case when platform = 'twitter' then n_chars % 50 end as retweets,
  case when platform in ('facebook', 'instagram') then id % 11 end as comments,
  case when platform = 'twitter' then n_chars % 13 end as replies
from (select doc_id as id, (['twitter','facebook','youtube','news','instagram'])[doc_id % 5 + 1] as platform,
  lang, source as "user", doc_id % 3 = 0 as verified, text as body, n_chars,
  timestamp '2024-01-01' + to_seconds((doc_id * 13709) % 2592000) as ts,
  (['flood','cyclone','earthquake','landslide','tsunami','drought','fire','heavy_rain'])[doc_id % 8 + 1] as disaster_type,
  (['critical','high','medium','low'])[n_chars % 4 + 1] as urgency,
  n_chars > 500 as is_disaster, 'NATION_' || (doc_id % 25) as place, n_chars % 1000 as likes
  from documents)"""


def reports(spark: SparkSession, sf: str) -> DataFrame:
    """customer with nation and region as verified or unverified map reports."""
    c = table(spark, sf, "customer").selectExpr(
        "c_custkey as id", "c_name as title", "c_nationkey", "c_mktsegment as disaster_type",
        f"{LEVEL.format(k='c_custkey')} as severity",
        "((c_custkey * 7919) % 18000) / 100.0D - 90.0D as lat",
        "((c_custkey * 104729) % 36000) / 100.0D - 180.0D as lng",
        "case when c_custkey % 3 = 0 then 'unverified' else 'verified' end as status",
        "c_custkey % 6 as source_count", "c_acctbal as area_km2",
        "timestamp_seconds(1704067200 + (c_custkey * 3607) % 5000000) as created_at")
    n = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.expr("n_regionkey = r_regionkey"))
    n = n.selectExpr("n_nationkey as c_nationkey", "n_name as state", "r_name as region")
    from hazardlake.skew import lookup

    return lookup(c, n, ["c_nationkey"], "inner").drop("c_nationkey")


CTES["reports"] = """
select c_custkey as id, c_name as title, c_mktsegment as disaster_type,
  (['critical','high','medium','low','unrated'])[c_custkey % 5 + 1] as severity,
  ((c_custkey * 7919) % 18000) / 100.0::double - 90.0::double as lat,
  ((c_custkey * 104729) % 36000) / 100.0::double - 180.0::double as lng,
  case when c_custkey % 3 = 0 then 'unverified' else 'verified' end as status,
  c_custkey % 6 as source_count, c_acctbal as area_km2,
  timestamp '2024-01-01' + to_seconds((c_custkey * 3607) % 5000000) as created_at,
  n_name as state, r_name as region
from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey"""


def stream(spark: SparkSession, sf: str) -> DataFrame:
    """events as the post stream."""
    return table(spark, sf, "events").selectExpr(
        "event_id as id", "cast(ts as timestamp) as ts", "user_id as author",
        f"{PLATFORM.format(k='user_id')} as platform", "event_type as post_type", "value", "props")


CTES["stream"] = """
select event_id as id, ts, user_id as author,
  (['twitter','facebook','youtube','news','instagram'])[user_id % 5 + 1] as platform,
  event_type as post_type, value, props from events"""


def scenes(spark: SparkSession, sf: str) -> DataFrame:
    """orders as dated scenes of a grid cell with a burn percentage."""
    return table(spark, sf, "orders").selectExpr(
        "concat('T', o_custkey) as cell", "o_orderkey as scene", "cast(o_orderdate as date) as day",
        "year(o_orderdate) as year", "dayofyear(o_orderdate) as doy",
        "case when o_orderstatus = 'F' then 'training' else 'validation' end as split",
        "floor((o_totalprice % 10000.0D) / 10.0D) / 10.0D as burn_pct", "o_totalprice")


CTES["scenes"] = """
select 'T' || o_custkey as cell, o_orderkey as scene, o_orderdate::date as day,
  year(o_orderdate)::int as year, dayofyear(o_orderdate)::int as doy,
  case when o_orderstatus = 'F' then 'training' else 'validation' end as split,
  floor((o_totalprice % 10000.0::double) / 10.0::double) / 10.0::double as burn_pct, o_totalprice
from orders"""


def days(spark: SparkSession, sf: str) -> DataFrame:
    """events as the daily images of a fire."""
    return table(spark, sf, "events").selectExpr("user_id as fire", "cast(ts as date) as day",
                                                 "event_id", "value")


CTES["days"] = "select user_id as fire, ts::date as day, event_id, value from events"


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    """embeddings as 8x8 tiles: two phases per tile, ten events."""
    return table(spark, sf, "embeddings").selectExpr(
        "concat('EV', (vec_id div 2) % 10) as event", "vec_id div 2 as tile",
        "case when vec_id % 2 = 0 then 'before' else 'during' end as phase",
        "8 as height", "8 as width", "embedding as v", "label")


CTES["tiles"] = """
select 'EV' || ((vec_id // 2) % 10) as event, vec_id // 2 as tile,
  case when vec_id % 2 = 0 then 'before' else 'during' end as phase,
  8 as height, 8 as width, embedding as v, label from embeddings"""

# one row per pixel of every tile and phase
CTES["px"] = """
select event, tile, phase, i as pos, (i // 8)::int as "row", (i % 8)::int as col, v[i + 1]::double as v
from tiles, (select unnest(range(64)) as i)"""

# before and during side by side, one row per pixel
CTES["pair"] = """
select event, tile, i as pos, (i // 8)::int as "row", (i % 8)::int as col, x[i + 1]::double as b, y[i + 1]::double as d
from (select b.event, b.tile, b.v as x, d.v as y, unnest(range(64)) as i from tiles b join tiles d using (event, tile)
  where b.phase = 'before' and d.phase = 'during')"""


def evaluation(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as scored pixels: prediction, truth and score per image."""
    return table(spark, sf, "lineitem").selectExpr(
        "concat(l_returnflag, l_linestatus) as event", "l_suppkey as tile",
        "l_discount > 0.05D as pred", "l_tax > 0.04D as truth", "l_discount * 10.0D as score",
        "l_quantity", "l_orderkey", "l_linenumber")


CTES["eval"] = """
select l_returnflag || l_linestatus as event, l_suppkey as tile, l_discount > 0.05::double as pred,
  l_tax > 0.04::double as truth, l_discount * 10.0::double as score, l_quantity, l_orderkey, l_linenumber
from lineitem"""


def comments(spark: SparkSession, sf: str) -> DataFrame:
    """conversations as threads: turn 0 is the record, later turns are comments."""
    return table(spark, sf, "conversations").selectExpr(
        "conv_id as video", "turn", "role as author", "text",
        "length(text) % 100 as likes",
        "case when turn = 0 then 'video' when role = 'assistant' then 'reply' "
        "else 'main_comment' end as type")


CTES["videos"] = """
select conv_id as video, turn, role as author, text, length(text) % 100 as likes,
  case when turn = 0 then 'video' when role = 'assistant' then 'reply' else 'main_comment' end as type
from conversations"""
