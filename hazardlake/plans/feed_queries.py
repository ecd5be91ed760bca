"""Registered queries over posts, comments and the post stream."""

from pyspark.sql import functions as F

from hazardlake import skew
from hazardlake.functions import text as X
from hazardlake.operators import feed as O
from hazardlake.plans import fixtures as A
from hazardlake.plans.common import iso, joined, r, sql_iso
from hazardlake.registry import query

CONTENT = """case platform when 'twitter' then coalesce(text, '')
 when 'news' then 'Headline: ' || coalesce(headline, '') || chr(10) || 'Content: ' || coalesce(article_content, '')
 when 'youtube' then 'Title: ' || coalesce(title, '') || chr(10) || 'Description: ' || coalesce(description, '')
 else coalesce(nullif(content, ''), caption, '') end"""


@query("post_content", "F-1", f"select id, md5({CONTENT}) as digest, length({CONTENT}) as n from posts", ("posts",))
def _(spark, sf):
    c = O.post_content()
    return A.posts(spark, sf).select("id", F.md5(c.cast("binary")).alias("digest"), F.length(c).cast("bigint").alias("n"))


@query("feed_query", "F-2",
       """select id, platform, urgency from posts where platform = 'news' and disaster_type = 'drought'
       and is_disaster and lower(lang) = 'en' and contains(lower(concat_ws(chr(10), headline, article_content)), 'tion')""",
       ("posts",))
def _(spark, sf):
    return O.feed_query(A.posts(spark, sf), platform="news", disaster_type="drought", is_disaster=True,
                        language="EN", search="TION", content=["headline", "article_content"]
                        ).select("id", "platform", "urgency")


@query("feed_by_urgency", "F-2", "select id from posts where urgency = 'critical' and not is_disaster", ("posts",))
def _(spark, sf):
    return O.feed_query(A.posts(spark, sf), urgency="critical", is_disaster=False).select("id")


@query("feed_page", "T-1",
       f"select id, {sql_iso('ts')} as at from posts order by ts desc, id desc limit 50 offset 100", ("posts",))
def _(spark, sf):
    return O.page(A.posts(spark, sf).select("id", "ts"), 50, 100).select("id", iso("ts").alias("at"))


@query("stream_page_after", "T-1",
       f"select id, {sql_iso('ts')} as at from stream where ts < timestamp '2024-01-15' "
       "order by ts desc, id desc limit 200", ("stream",))
def _(spark, sf):
    s = A.stream(spark, sf).select("id", "ts")
    return O.page_after(s, F.lit("2024-01-15").cast("timestamp"), -1, 200).select("id", iso("ts").alias("at"))


@query("post_by_id", "F-18", "select id, platform, lang from posts where id = 77", ("posts",))
def _(spark, sf):
    return O.by_id(A.posts(spark, sf), 77).select("id", "platform", "lang")


@query("platform_share", "A-1",
       "select platform, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6)::double as pct from stream group by 1",
       ("stream",))
def _(spark, sf):
    return O.share_by(A.stream(spark, sf), "platform").withColumn("pct", r("pct"))


@query("type_share", "A-1",
       "select post_type, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (), 6)::double as pct from stream group by 1",
       ("stream",))
def _(spark, sf):
    return O.share_by(A.stream(spark, sf), "post_type").withColumn("pct", r("pct"))


@query("gate_rates", "A-2",
       """select count(*) as processed, count(*) filter (value > 10) as verified, count(*) filter (not value > 10) as discarded,
       count(*) filter (value > 10 and post_type <> 'error') as stored,
       round(count(*) filter (value > 10) / count(*), 6) as verification_rate,
       round(count(*) filter (value > 10 and post_type <> 'error') / count(*) filter (value > 10), 6) as storage_success_rate
       from stream""", ("stream",))
def _(spark, sf):
    out = O.gate_rates(A.stream(spark, sf), F.col("value") > 10, F.col("post_type") != "error")
    return out.withColumns({c: r(c) for c in ("verification_rate", "storage_success_rate")})


@query("global_stats", "A-3",
       """select (select count(*) from posts) as total_posts, (select count(*) from posts where is_disaster) as disaster_posts,
       (select string_agg(platform || '=' || n, '|' order by platform) from (select platform, count(*) as n from posts where platform is not null group by 1)) as platforms,
       (select count(*) from reports) as verified_reports, (select count(*) from reports where severity = 'critical') as critical_reports""",
       ("posts", "reports"))
def _(spark, sf):
    platforms = joined(F.transform(F.map_entries("platforms"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return O.global_stats(A.posts(spark, sf), A.reports(spark, sf)).withColumn("platforms", platforms)


@query("trending_hashtags", "T-2",
       """select lower(w) as hashtag, count(*) as n from (select unnest(regexp_extract_all(text, '[A-Z][a-z]+')) as w from documents)
       group by 1 order by n desc, hashtag limit 15""")
def _(spark, sf):
    d = A.table(spark, sf, "documents").select(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)")).alias("tags"))
    return O.trending(d, "tags", 15)


@query("comment_stats", "A-4",
       """select video, count(*) as total_comments, count(*) filter (type = 'main_comment') as main_comments,
       count(*) filter (type = 'reply') as replies, sum(likes)::bigint as total_likes, count(distinct author) as unique_authors
       from videos where turn > 0 group by 1""", ("videos",))
def _(spark, sf):
    return O.comment_stats(A.comments(spark, sf).filter("turn > 0"))


@query("collect_tags", "A-5 U-4",
       r""", t as (select video, regexp_replace(text, '([A-Z])', '#\1', 'g') as t from videos),
       x as (select video, 'hashtag' as kind, unnest(list_distinct(regexp_extract_all(t, '#[\p{L}\p{N}_]+'))) as value from t
       union all select video, 'mention', unnest(list_distinct(regexp_extract_all(t, '@[\p{L}\p{N}_]+'))) from t
       union all select video, 'url', unnest(regexp_extract_all(t, 'http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+')) from t)
       select video, kind, value, count(*) as n from x group by all""", ("videos",))
def _(spark, sf):
    c = A.comments(spark, sf).withColumn("t", F.regexp_replace("text", "([A-Z])", r"#$1"))
    return O.collect_tags(c, "video", "t")


@query("cycle_stats", "A-22 F-10",
       """select count(*) filter (not dup and serious) as processed, count(*) filter (dup) as duplicates,
       count(*) filter (not dup and not serious) as non_serious, count(*) filter (not dup and serious and urgency = 'high') as coastal,
       count(*) filter (not dup and serious and likes / 1000.0 > 0.8) as high_confidence,
       round(count(*) filter (not dup and serious) / count(*), 6) as serious_ratio,
       round(count(*) filter (dup) / count(*), 6) as duplicate_ratio
       from (select *, retweets is not null as dup, is_disaster as serious from posts)""", ("posts",))
def _(spark, sf):
    out = O.cycle_stats(A.posts(spark, sf), F.col("is_disaster"), F.col("retweets").isNotNull(),
                        F.col("urgency") == "high", F.col("likes") / F.lit(1000.0))
    return out.withColumns({c: r(c) for c in ("serious_ratio", "duplicate_ratio")})


RAW = {
    "spark": """case post_type when 'view' then props
      when 'click' then concat('Sure: {"is_genuine": true, "verification_score": ', cast(value as string), '} thanks')
      when 'error' then 'no verdict here'
      when 'signup' then '{"is_genuine": tru}' else '{"is_genuine": false, "verification_score": 0.05}' end""",
    "duck": """case post_type when 'view' then props
      when 'click' then 'Sure: {"is_genuine": true, "verification_score": ' || value || '} thanks'
      when 'error' then 'no verdict here'
      when 'signup' then '{"is_genuine": tru}' else '{"is_genuine": false, "verification_score": 0.05}' end""",
}
VERDICT_SQL = f""", raw as (select id, value, regexp_extract({RAW['duck']}, '(?s)\\{{.*\\}}') as t from stream),
  v as (select id, value, t = '' as none, t <> '' and not json_valid(t) as broken,
    case when json_valid(t) then t end as j from raw),
  verdicts as (select id, value, coalesce(json_extract_string(j, '$.is_genuine') = 'true', false) as is_genuine,
    case when broken then null else coalesce(json_extract_string(j, '$.verification_score')::double, 0.0) end as score,
    case when none then 'Invalid response format' when broken then 'broken JSON' end as error from v)"""


@query("parse_verdict", "X-11", VERDICT_SQL + " select id, is_genuine, round(score, 6) as score, error from verdicts", ("stream",))
def _(spark, sf):
    s = A.stream(spark, sf).selectExpr("id", f"{RAW['spark']} as raw")
    v = s.select("id", X.parse_verdict(F.col("raw")).alias("v"))
    return v.select("id", "v.is_genuine", r("v.verification_score").alias("score"), "v.error")


@query("route_posts", "F-9", VERDICT_SQL + """ select id, case when is_genuine then 'kept' else 'discarded' end as route,
   case when is_genuine and not value > 20 then 'Information extraction failed' end as error from verdicts""", ("stream",))
def _(spark, sf):
    s = A.stream(spark, sf).selectExpr("id", "value", f"{RAW['spark']} as raw")
    v = s.withColumn("verdict", X.parse_verdict(F.col("raw"))).withColumn(
        "extracted", F.when(F.col("value") > 20, F.col("id")))
    kept, dropped = O.route_posts(v)
    return (kept.select("id", F.lit("kept").alias("route"), "error")
            .unionByName(dropped.select("id", F.lit("discarded").alias("route"), F.lit(None).cast("string").alias("error"))))


@query("stamp_metadata", "F-15",
       f"""select id, platform as source_platform, "user" as source_user, verified as source_verified,
       {sql_iso('ts')} as original_timestamp, lang as original_language, likes as e_likes,
       coalesce(nullif(shares, 0), retweets, 0) as e_shares, coalesce(nullif(comments, 0), replies, 0) as e_comments from posts""",
       ("posts",))
def _(spark, sf):
    m = O.stamp_metadata(A.posts(spark, sf), F.current_timestamp())
    return m.select("id", "source_platform", "source_user", "source_verified",
                    iso("original_timestamp").alias("original_timestamp"), "original_language",
                    F.col("engagement_metrics.likes").alias("e_likes"),
                    F.col("engagement_metrics.shares").alias("e_shares"),
                    F.col("engagement_metrics.comments").alias("e_comments"))


@query("assemble_record", "F-14",
       """, s as (select video, count(*) as n, count(*) filter (type = 'reply') as rep, sum(likes)::bigint as lk from videos where turn > 0 group by 1)
       select v.video, v.author, md5(v.text) as digest, coalesce(n, 0) as total_comments, coalesce(rep, 0) as replies,
       coalesce(lk, 0) as total_likes, v.likes from videos v left join s on v.video = s.video where v.turn = 0""", ("videos",))
def _(spark, sf):
    c = A.comments(spark, sf)
    rec = O.assemble_record(c.filter("turn = 0"), O.comment_stats(c.filter("turn > 0")))
    return rec.select("video", F.col("video_data.author").alias("author"),
                      F.md5(F.col("video_data.text").cast("binary")).alias("digest"),
                      F.col("comment_statistics.total_comments").alias("total_comments"),
                      F.col("comment_statistics.replies").alias("replies"),
                      F.col("comment_statistics.total_likes").alias("total_likes"),
                      F.col("engagement_metrics.likes").cast("bigint").alias("likes"))


@query("quality_gate", "F-19",
       """select id from stream where value >= 30 and date_diff('second', ts, timestamp '2024-01-31') / 3600.0 <= 168
       and author >= 10 and value / 20 >= 3 and nullif(post_type, 'error') is not null""", ("stream",))
def _(spark, sf):
    now = F.lit("2024-01-31").cast("timestamp")
    age = (F.unix_seconds(now) - F.unix_seconds("ts")) / F.lit(3600.0)
    return O.quality_gate(A.stream(spark, sf), F.col("value"), age, F.col("author"),
                          F.col("value") / 20, F.nullif(F.col("post_type"), F.lit("error"))).select("id")


AT = "case post_type when 'error' then 'not a time' when 'signup' then null else {t} end"


@query("recent", "F-5 X-16",
       f"""select id, round(age, 6) as age_hours from (select id, case when post_type in ('error', 'signup') then null
       else date_diff('microsecond', date_trunc('second', ts), timestamp '2024-01-31') / 3.6e9::double end as age from stream)
       where age is null or age <= 48""", ("stream",))
def _(spark, sf):
    at = F.expr(AT.format(t="date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")"))
    now = F.lit("2024-01-31").cast("timestamp")
    return (A.stream(spark, sf).withColumn("at", at).filter(O.recent(F.col("at"), now))
            .select("id", r(O.age_hours(F.col("at"), now)).alias("age_hours")))


@query("drop_seen", "J-12", "select id, post_type from stream where id not in (select o_orderkey * 3 from orders)", ("stream",))
def _(spark, sf):
    seen = A.table(spark, sf, "orders").select((F.col("o_orderkey") * 3).alias("id"))
    return O.drop_seen(A.stream(spark, sf), seen).select("id", "post_type")


@query("first_by_id", "W-6",
       "select md5(text) as digest, min(doc_id) as doc_id, arg_min(source, doc_id) as source from documents group by text")
def _(spark, sf):
    d = A.table(spark, sf, "documents").select(F.md5(F.col("text").cast("binary")).alias("digest"), "doc_id", "source")
    return O.first_by_id(d, "digest", ["doc_id"])


@query("latest_by_id", "W-8",
       f"""select o_custkey as id, arg_max(o_orderkey, row(o_orderdate, o_orderkey)) as version,
       {sql_iso('max(o_orderdate)')} as updated_at from orders group by 1""")
def _(spark, sf):
    o = A.table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), "o_orderdate")
    return O.latest_by_id(o, "id", ["o_orderdate", "version"]).select("id", "version", iso("o_orderdate").alias("updated_at"))


@query("retain_newest", "W-7", "select id, platform from stream order by ts desc, id desc limit 10000", ("stream",))
def _(spark, sf):
    return O.retain_newest(A.stream(spark, sf).select("id", "platform", "ts")).select("id", "platform")


for _k in (5, 10, 15, 20):
    @query(f"top_{_k}_per_source", "W-5 T-7",
           f"select id, author, rank from (select id, author, row_number() over (partition by author order by ts, id)::int as rank from stream) where rank <= {_k}",
           ("stream",))
    def _(spark, sf, k=_k):
        return O.top_k_per(A.stream(spark, sf).select("id", "author", "ts"), "author", k, ["ts", "id"]).select("id", "author", "rank")


@query("pick_track", "T-8",
       """select video, arg_min(turn, row(case when lang = 'en' then 0 when not auto then 1 else 2 end, turn)) as turn
       from (select video, turn, case when likes % 5 = 0 then 'en' else 'fr' end as lang, author = 'assistant' as auto from videos) group by 1""",
       ("videos",))
def _(spark, sf):
    t = A.comments(spark, sf).select("video", "turn", F.expr("case when likes % 5 = 0 then 'en' else 'fr' end").alias("lang"),
                                     (F.col("author") == "assistant").alias("auto"))
    return O.pick_track(t, "video", "lang", "auto", "turn").select("video", "turn")


@query("union_sources", "U-2",
       """select source, count(*) as n, count(lang) as with_lang, sum(length(content))::bigint as chars from (
       select source, lang, text as content from documents union all select role, null, text from conversations) group by 1""")
def _(spark, sf):
    a = A.table(spark, sf, "documents").select("source", "lang", F.col("text").alias("content"))
    b = A.table(spark, sf, "conversations").select(F.col("role").alias("source"), F.col("text").alias("content"))
    return O.union_sources(a, b).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("lang").alias("with_lang"), F.sum(F.length("content")).alias("chars"))


@query("incremental_append", "U-5 S-3",
       "select id, value from stream", ("stream",))
def _(spark, sf):
    """Two cycles over the same rows: the second appends only what the first did not."""
    from hazardlake.session import work_dir
    from hazardlake.sources.posts import append_jsonl, incremental_append

    target = work_dir(spark, "cycle")
    s = A.stream(spark, sf).select("id", "value", "post_type")
    schema = "id long, value double, post_type string"
    append_jsonl(s.filter("post_type <> 'error'"), target)
    incremental_append(s.unionByName(s), target, schema, "id", ["id", "value"])
    return spark.read.schema(schema).json(target).select("id", "value")


@query("credibility", "K-7",
       """select id, round(least(1.0, greatest(0.0, likes / 2000.0 + case when platform = 'twitter' and verified then 0.2 else 0 end
       + case when platform = 'twitter' and retweets >= 100 then 0.15 else 0 end
       + case when platform = 'twitter' and n_chars % 3 > 0 then 0.15 else 0 end
       + case when platform = 'facebook' and verified then 0.1 else 0 end + case when platform = 'facebook' then 0.25 else 0 end
       + case when platform = 'facebook' and shares >= 50 then 0.1 else 0 end
       + case when platform = 'news' and verified then 0.3 else 0 end
       + case when platform = 'news' and regexp_matches(lower("user" || ' Times'), 'times|express|hindu|ndtv') then 0.2 else 0 end))::double, 6) as credibility
       from posts""", ("posts",))
def _(spark, sf):
    p = A.posts(spark, sf).withColumns({
        "base": F.col("likes") / F.lit(2000.0), "hashtag_count": F.col("n_chars") % 3, "community": F.col("verified"),
        "has_place": F.col("place").isNotNull(), "outlet": F.concat("user", F.lit(" Times")), "has_byline": F.col("verified")})
    return p.select("id", r(O.credibility(p)).alias("credibility"))


@query("trend_by_day", "A-31",
       f"""select platform, post_type, {sql_iso("date_trunc('day', ts)")} as bucket, count(*) as n from stream
       group by cube(platform, post_type), date_trunc('day', ts)""", ("stream",))
def _(spark, sf):
    return O.trend(A.stream(spark, sf), "day").select("platform", "post_type", iso("bucket").alias("bucket"), "n")


@query("correlate", "A-32",
       f"""select author, post_type, {sql_iso("time_bucket(interval '6 hours', ts)")} as span_start,
       count(distinct plat) as platforms, count(*) as posts
       from (select *, case when id % 2 = 0 then platform else 'news' end as plat from stream)
       group by author, post_type, time_bucket(interval '6 hours', ts) having count(distinct plat) > 1""", ("stream",))
def _(spark, sf):
    s = A.stream(spark, sf).withColumn("plat", F.expr("case when id % 2 = 0 then platform else 'news' end"))
    return O.correlate(s, "6 hours", "author", "post_type", "plat").select(
        "author", "post_type", iso("w.start").alias("span_start"), "platforms", "posts")


for _s in (30, 60):
    @query(f"throughput_{_s}s", "W-12",
           f"""select {sql_iso('start')} as start, n, round(n / {_s}.0::double, 6) as rate, (sum(n) over (order by start))::bigint as total
           from (select time_bucket(interval '{_s} seconds', ts) as start, count(*) as n from stream group by 1)""", ("stream",))
    def _(spark, sf, s=_s):
        return O.throughput(A.stream(spark, sf), s).select(iso("start").alias("start"), "n", r("rate").alias("rate"), "total")
