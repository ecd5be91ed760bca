"""Registered queries that run as Structured Streaming jobs over the events table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlake.functions import text as X
from hazardlake.plans import fixtures as A
from hazardlake.plans.common import iso, r, sql_iso
from hazardlake.plans.feed_queries import RAW, VERDICT_SQL
from hazardlake.registry import query
from hazardlake.session import work_dir
from hazardlake.sources.posts import decode_envelope, read_post_stream
from hazardlake.streaming import jobs as J

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def _stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events file as a stream with the columns of the stream adapter."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").parquet(sf)
    return raw.selectExpr("event_id as id", "cast(ts as timestamp) as ts", "user_id as author",
                          f"{A.PLATFORM.format(k='user_id')} as platform", "event_type as post_type", "value", "props")


def _in_slices(spark: SparkSession, sf: str, label: str, job, n: int = 4) -> str:
    """Run a job over the events in ``n`` slices of time, one after the other: the slice arrives,
    the job starts from its checkpoint, works off what is new and stops. Returns the table."""
    target, checkpoint = _paths(spark, label)
    events = A.table(spark, sf, "events")
    low, high = events.agg(F.min("ts"), F.max("ts")).first()
    spark.createDataFrame([], events.schema).write.parquet(f"{target}-in")
    for i in range(n):
        a, b = low + (high - low) * i / n, low + (high - low) * (i + 1) / n
        last = F.lit(i == n - 1)
        events.filter((F.col("ts") >= F.lit(a)) & ((F.col("ts") < F.lit(b)) | last)).write.mode("append").parquet(f"{target}-in")
        raw = spark.readStream.schema(EVENTS).parquet(f"{target}-in")
        job(raw.selectExpr("event_id as id", "cast(ts as timestamp) as ts", "user_id as author",
                           f"{A.PLATFORM.format(k='user_id')} as platform", "event_type as post_type", "value", "props"), target, checkpoint)
    return target


def _sliced_table(spark, sf, label, build, mode="append"):
    return _in_slices(spark, sf, label, lambda s, target, checkpoint: J.run(build(s), J.table_sink(target), checkpoint, mode))


def _paths(spark, label):
    base = work_dir(spark, label)
    return f"{base}/table", f"{base}/checkpoint"


def _table(spark, stream, label, mode="append"):
    target, checkpoint = _paths(spark, label)
    J.run(stream, J.table_sink(target), checkpoint, mode)
    return target


@query("stream_ingest", "ST-1 S-4 ST-3",
       """select id, coalesce(json_extract(props, '$.k')::bigint, -1) as k, coalesce(nullif(platform, 'news'), 'unknown') as platform, post_type from stream""", ("stream",))
def _(spark, sf):
    """Envelopes as a folder of JSON files, read two files per micro-batch; where there are more
    than sixteen, an eighth of them, so that the micro-batches do not grow with the events."""
    base = work_dir(spark, "envelopes")
    env = A.stream(spark, sf).selectExpr("props as post_data", "cast(id as string) as timestamp", "nullif(platform, 'news') as platform", "post_type")
    env.write.option("maxRecordsPerFile", max(500, -(-env.count() // 16))).json(f"{base}/in")
    files = len(spark.read.text(f"{base}/in").inputFiles())
    posts = decode_envelope(read_post_stream(spark, f"{base}/in", max(2, -(-files // 8))), "k bigint")
    out = posts.select(F.col("timestamp").cast("long").alias("id"), F.coalesce("post.k", F.lit(-1)).alias("k"), "platform", "post_type")
    J.run(out, J.table_sink(f"{base}/table"), f"{base}/checkpoint")
    return J.read_table(spark, f"{base}/table")


@query("stream_running_counts", "ST-2 ST-3", "select platform, post_type, count(*) as n from stream group by all", ("stream",))
def _(spark, sf):
    return J.read_last(spark, _table(spark, J.running_counts(_stream(spark, sf)), "counts", "complete"))


@query("stream_windows", "ST-4",
       f"""select {sql_iso('start')} as start, platform, count(*) as n, round(count(*) / 3600.0, 8)::double as rate from
       (select time_bucket(interval '1 hour', ts) as start, platform from stream) group by start, platform""", ("stream",))
def _(spark, sf):
    t = _sliced_table(spark, sf, "windows", lambda s: J.windowed_counts(s, "1 hour", "10 minutes", ["platform"]), "update")
    return J.read_updates(spark, t, ["start", "platform"]).select(iso("start").alias("start"), "platform", "n", r("rate", 8).alias("rate"))


@query("stream_sliding_trend", "ST-10",
       f""", s as (select time_bucket(interval '1 hour', ts) - to_hours(i) as start, post_type from stream, (select unnest(range(6)) as i))
       select {sql_iso('start')} as start, post_type, count(*) as n from s group by start, post_type""", ("stream",))
def _(spark, sf):
    t = _sliced_table(spark, sf, "sliding", lambda s: J.windowed_counts(s, "6 hours", "10 minutes", ["post_type"], "1 hour"), "update")
    return J.read_updates(spark, t, ["start", "post_type"]).select(iso("start").alias("start"), "post_type", "n")


@query("stream_spikes", "ST-11",
       f""", c as (select time_bucket(interval '1 hour', ts) as start, platform, count(*) as n from stream group by all),
       t as (select *, avg(n) over (partition by platform order by start rows between 6 preceding and 1 preceding) as trailing_mean from c)
       select {sql_iso('start')} as start, platform, n, round(trailing_mean, 6) as trailing_mean, n >= 10 as mass_event from t where n >= trailing_mean * 2
       and start + interval '1 hour' <= (select max(ts) - interval '10 minutes' from stream)""", ("stream",))
def _(spark, sf):
    """Alerts of the windows that the watermark has closed, out of the running query."""
    t = _sliced_table(spark, sf, "spikes", lambda s: J.spike_stream(s, ["platform"], 3600, "10 minutes", 6, 2.0))
    s = J.read_table(spark, t)
    return s.select(iso("start").alias("start"), "platform", "n", r("trailing_mean").alias("trailing_mean"), "mass_event")


@query("stream_dedup", "ST-5", "select distinct author, post_type from stream", ("stream",))
def _(spark, sf):
    t = _sliced_table(spark, sf, "dedup", lambda s: J.drop_duplicates(s, ["author", "post_type"], "60 days").select("author", "post_type"))
    return J.read_table(spark, t)


@query("stream_dedup_table", "ST-5", "select author, post_type, arg_min(id, row(ts, id)) as id from stream group by all", ("stream",))
def _(spark, sf):
    target = _in_slices(spark, sf, "dedup-table", lambda s, table, checkpoint: J.run(
        s, J.dedup_sink(table, ["author", "post_type"], ["ts", "id"]), checkpoint))
    return J.read_table(spark, target).select("author", "post_type", "id")


@query("stream_remember_ids", "ST-5", "select distinct author from stream", ("stream",))
def _(spark, sf):
    t = _sliced_table(spark, sf, "seen", lambda s: J.remember_ids(s, "author", 60 * 86_400_000))
    return J.read_table(spark, t)


@query("stream_gate", "ST-6 F-9",
       VERDICT_SQL + """ select id, case when not is_genuine then 'discarded' when value > 20 then 'kept' else 'failed' end as route from verdicts""", ("stream",))
def _(spark, sf):
    target, checkpoint = _paths(spark, "gate")
    s = _stream(spark, sf).selectExpr("id", "value", f"{RAW['spark']} as raw")
    s = s.withColumn("verdict", X.parse_verdict(F.col("raw"))).withColumn("extracted", F.when(F.col("value") > 20, F.col("id")))
    J.run(s, J.gate_sink(target), checkpoint)
    parts = [J.read_table(spark, f"{target}/{n}").select("id", F.lit(n).alias("route")) for n in ("kept", "failed", "discarded")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("stream_dead_letters", "ST-7",
       "select case when post_type = 'error' then 'dead' else 'good' end as route, count(*) as n, sum(case when post_type <> 'error' then id end)::bigint as ids from stream group by 1", ("stream",))
def _(spark, sf):
    """A log whose error lines are cut short: they go to the dead-letter table."""
    target, checkpoint = _paths(spark, "dead")
    lines = A.stream(spark, sf).selectExpr("if(post_type = 'error', concat('{\"id\": ', id), to_json(struct(id, platform))) as value")
    lines.write.text(f"{target}-log")
    s = spark.readStream.schema("id long, platform string, _corrupt_record string").option("mode", "PERMISSIVE").json(f"{target}-log")
    J.run(s, J.dead_letter_sink(target), checkpoint)
    good = J.read_table(spark, f"{target}/good").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")).select(F.lit("good").alias("route"), "n", "ids")
    dead = J.read_table(spark, f"{target}/dead").agg(F.count(F.lit(1)).alias("n")).select(F.lit("dead").alias("route"), "n", F.lit(None).cast("long").alias("ids"))
    return good.unionByName(dead)


@query("stream_serving_store", "ST-8", "select id, platform from stream order by ts desc, id desc limit 10000", ("stream",))
def _(spark, sf):
    target, checkpoint = _paths(spark, "serving")
    s = _stream(spark, sf).select("id", "platform", "ts")
    J.run(s, J.serving_sink(target), checkpoint)
    return J.read_last(spark, target).select("id", "platform")


@query("stream_late_data", "ST-9",
       "select case when ts >= timestamp '2024-01-29' then 'fresh' else 'late' end as route, count(*) as n from stream group by 1", ("stream",))
def _(spark, sf):
    target, checkpoint = _paths(spark, "late")
    now = F.lit("2024-01-31").cast("timestamp")
    J.run(_stream(spark, sf), J.late_sink(target, F.col("ts"), now, 48), checkpoint)
    count = lambda n: J.read_table(spark, f"{target}/{n}").agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("route"), "n")
    return count("fresh").unionByName(count("late"))


@query("stream_record_hook", "K-2", "select platform, round(sum(value), 3) as total from stream group by 1", ("stream",))
def _(spark, sf):
    target, checkpoint = _paths(spark, "hook")
    hook = lambda batch, batch_id: batch.groupBy("platform").agg(F.sum("value").alias("total"))
    J.run(_stream(spark, sf), J.record_hook_sink(hook, target), checkpoint)
    return J.read_table(spark, target).groupBy("platform").agg(r(F.sum("total"), 3).alias("total"))


@query("stream_upsert_reports", "S-5 W-8",
       f"select author as id, arg_max(id, row(ts, id)) as version, {sql_iso('max(ts)')} as updated_at from stream group by author", ("stream",))
def _(spark, sf):
    target = _table(spark, _stream(spark, sf).select(F.col("author").alias("id"), F.col("id").alias("version"), F.col("ts").alias("updated_at")), "reports")
    J.compact_reports(spark, target, f"{target}-compact")
    return J.read_reports(spark, f"{target}-compact").select("id", "version", iso("updated_at").alias("updated_at"))


@query("retention_tiers", "ST-12",
       """select case when age <= 24 then 'realtime' when age <= 720 then 'trend' when age <= 2160 then 'metrics' else 'expired' end as tier, count(*) as n
       from (select date_diff('microsecond', ts, timestamp '2024-04-05') / 3.6e9 as age from stream) group by 1""", ("stream",))
def _(spark, sf):
    now = F.lit("2024-04-05").cast("timestamp")
    return A.stream(spark, sf).groupBy(J.retention_tier(F.col("ts"), now).alias("tier")).agg(F.count(F.lit(1)).alias("n"))
