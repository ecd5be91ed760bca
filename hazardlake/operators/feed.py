"""Posts: content, feed search, paging, counters, routing, links and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake import skew
from hazardlake.functions import lexicons as L
from hazardlake.functions import text as X


def post_content() -> Column:
    """The text of a post, chosen by platform."""
    p = F.col("platform")
    both = lambda a, la, b, lb: F.concat(
        F.lit(la), F.coalesce(F.col(a), F.lit("")), F.lit(lb), F.coalesce(F.col(b), F.lit("")))
    return (F.when(p == "twitter", F.coalesce(F.col("text"), F.lit("")))
            .when(p == "news", both("headline", "Headline: ", "article_content", "\nContent: "))
            .when(p == "youtube", both("title", "Title: ", "description", "\nDescription: "))
            .when(p.isin("facebook", "instagram"),
                  F.coalesce(X.non_empty(F.col("content")), F.col("caption"), F.lit("")))
            .otherwise(F.lit("")))


def feed_query(df: DataFrame, platform: str | None = None, disaster_type: str | None = None,
               urgency: str | None = None, is_disaster: bool | None = None,
               language: str | None = None, search: str | None = None,
               content: list[str] | None = None) -> DataFrame:
    """Feed filter; every argument is optional and equality filters reach the scan.

    Search looks at the values of the ``content`` columns only, not at field names.
    """
    for name, value in (("platform", platform), ("disaster_type", disaster_type), ("urgency", urgency)):
        if value:
            df = df.filter(F.col(name) == value)
    if is_disaster is not None:
        df = df.filter(F.col("is_disaster") == is_disaster)
    if language:
        df = df.filter(F.lower("lang") == language.lower())
    if search:
        values = F.concat_ws("\n", *[F.col(c) for c in content or ["text"]])
        df = df.filter(F.lower(values).contains(search.lower()))
    return df


def page(df: DataFrame, limit: int = 50, offset: int = 0, ts: str = "ts", key: str = "id") -> DataFrame:
    """Newest-first page; the id breaks ties."""
    if not 1 <= limit <= 200 or offset < 0:
        raise ValueError("limit must be 1..200 and offset not negative")
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).offset(offset).limit(limit)


def page_after(df: DataFrame, last_ts, last_id, limit: int = 50, ts: str = "ts", key: str = "id") -> DataFrame:
    """The page that follows a given row: deep pages without a growing offset."""
    after = (F.col(ts) < F.lit(last_ts)) | ((F.col(ts) == F.lit(last_ts)) & (F.col(key) < F.lit(last_id)))
    return page(df.filter(after), limit, 0, ts, key)


def by_id(df: DataFrame, value, key: str = "id") -> DataFrame:
    return df.filter(F.col(key) == value)


def share_by(df: DataFrame, key: str) -> DataFrame:
    """Rows per value and percentage of all rows."""
    counts = df.groupBy(F.coalesce(F.col(key), F.lit("unknown")).alias(key)).agg(
        F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("pct", F.col("n") * 100.0 / total)


def gate_rates(df: DataFrame, verified: Column, stored: Column) -> DataFrame:
    """Counts at each gate and their ratios, 0 when nothing passed the gate before."""
    counts = df.agg(F.count(F.lit(1)).alias("processed"), F.count_if(verified).alias("verified"),
                    F.count_if(~verified).alias("discarded"),
                    F.count_if(verified & stored).alias("stored"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return (counts.withColumn("verification_rate", rate("verified", "processed"))
            .withColumn("storage_success_rate", rate("stored", "verified")))


def global_stats(posts: DataFrame, reports: DataFrame) -> DataFrame:
    """One row of dashboard counts, posts by platform among them; the report counts come in as
    a scalar subquery."""
    r = reports.agg(F.struct(F.count(F.lit(1)).alias("all"),
                             F.count_if(F.col("severity") == "critical").alias("critical"))).scalar()
    per = posts.groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_disaster")).alias("d"))
    p = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_posts"), F.coalesce(F.sum("d"), F.lit(0)).alias("disaster_posts"),
                F.map_from_entries(F.array_sort(F.collect_list(F.when(
                    F.col("platform").isNotNull(), F.struct("platform", "n"))))).alias("platforms"))
    return p.withColumn("r", r).select("total_posts", "disaster_posts", "platforms", F.col("r.all").alias("verified_reports"),
                                       F.col("r.critical").alias("critical_reports"))


def trending(df: DataFrame, tags: str, n: int = 15) -> DataFrame:
    """Most used hashtags, lower case; the tag itself breaks ties."""
    if not 1 <= n <= 50:
        raise ValueError("n must be 1..50")
    return (df.select(F.explode(tags).alias("hashtag"))
            .groupBy(F.lower("hashtag").alias("hashtag")).agg(F.count(F.lit(1)).alias("n"))
            .orderBy(F.col("n").desc(), "hashtag").limit(n))


def comment_stats(df: DataFrame, key: str = "video") -> DataFrame:
    """Comment counts, likes and distinct authors per record.

    Distinct authors are folded per (record, author) first, so a record with very many
    comments is spread over its authors.
    """
    per_author = df.groupBy(key, "author").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("type") == "main_comment").alias("main"),
        F.count_if(F.col("type") == "reply").alias("replies"), F.sum("likes").alias("likes"))
    return per_author.groupBy(key).agg(
        F.sum("n").alias("total_comments"), F.sum("main").alias("main_comments"),
        F.sum("replies").alias("replies"), F.sum("likes").alias("total_likes"),
        F.count("author").alias("unique_authors"))


def collect_tags(df: DataFrame, key: str, text: str) -> DataFrame:
    """Tags, mentions and URLs of a record and its comments, one row per value.

    Tags and mentions are a distinct union; ``n`` keeps how often each value occurred, so
    repeated URLs stay countable. Rows replace arrays: a record may have any number.
    """
    t = F.col(text)
    kinds = [("hashtag", X.hashtags(t)), ("mention", X.mentions(t)), ("url", X.urls(t))]

    def tagged(kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    values = F.concat(*[tagged(k, a) for k, a in kinds])
    return (df.select(key, F.explode(values).alias("x")).select(key, "x.*")
            .groupBy(key, "kind", "value").agg(F.count(F.lit(1)).alias("n")))


def cycle_stats(df: DataFrame, serious: Column, duplicate: Column, coastal: Column,
                confidence: Column) -> DataFrame:
    """Ratios of one collection cycle; a duplicate is counted before the serious test."""
    kept = ~duplicate & serious
    counts = df.agg(F.count_if(kept).alias("processed"), F.count_if(duplicate).alias("duplicates"),
                    F.count_if(~duplicate & ~serious).alias("non_serious"),
                    F.count_if(kept & coastal).alias("coastal"),
                    F.count_if(kept & (confidence > 0.8)).alias("high_confidence"))
    total = F.col("processed") + F.col("duplicates") + F.col("non_serious")
    return (counts.withColumn("serious_ratio", F.try_divide(F.col("processed"), total))
            .withColumn("duplicate_ratio", F.try_divide(F.col("duplicates"), total)))


def route_posts(df: DataFrame, verdict: str = "verdict", extracted: str = "extracted"
                ) -> tuple[DataFrame, DataFrame]:
    """(kept, discarded) by the genuine verdict; a kept row without extraction has an error."""
    genuine = F.coalesce(F.col(verdict)["is_genuine"], F.lit(False))
    kept = df.filter(genuine).withColumn(
        "error", F.when(F.col(extracted).isNull(), F.lit("Information extraction failed")))
    return kept, df.filter(~genuine)


def keep_serious(df: DataFrame, verdict: str = "verdict") -> DataFrame:
    return df.filter(F.col(verdict)["is_serious"])


def assemble_record(df: DataFrame, stats: DataFrame, key: str = "video") -> DataFrame:
    """Nested record: main row, comment statistics and text; missing numbers are 0."""
    joined = df.join(stats, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return joined.select(
        key,
        F.struct("author", "text").alias("video_data"),
        F.struct(*[zero(c) for c in ("total_comments", "main_comments", "replies", "total_likes",
                                     "unique_authors")]).alias("comment_statistics"),
        F.struct(zero("likes")).alias("engagement_metrics"))


def stamp_metadata(df: DataFrame, processed: Column) -> DataFrame:
    """source_* fields, processing time and engagement with its fallbacks (0 means absent)."""
    alt = lambda a, b: F.coalesce(F.nullif(F.col(a), F.lit(0)), F.col(b), F.lit(0))
    return df.withColumns({
        "source_platform": F.coalesce(F.col("platform"), F.lit("unknown")),
        "source_user": F.coalesce(F.col("user"), F.lit("unknown")),
        "source_verified": F.coalesce(F.col("verified"), F.lit(False)),
        "original_timestamp": F.col("ts"),
        "processed_timestamp": processed,
        "original_language": F.coalesce(F.col("lang"), F.lit("unknown")),
        "engagement_metrics": F.struct(
            F.coalesce(F.col("likes"), F.lit(0)).alias("likes"),
            alt("shares", "retweets").alias("shares"),
            alt("comments", "replies").alias("comments")),
    })


def quality_gate(df: DataFrame, length_s: Column, age_h: Column, engagement: Column,
                 credibility: Column, place: Column) -> DataFrame:
    """Declared thresholds: length, age, engagement, credibility and a place."""
    return df.filter((length_s >= 30) & (age_h <= 168) & (engagement >= 10)
                     & (credibility >= 3) & place.isNotNull())


def recent(ts: Column, now: Column, hours: float = 48) -> Column:
    """Age at most ``hours``; a null or unreadable time passes."""
    age = age_hours(ts, now)
    return age.isNull() | (age <= hours)


def age_hours(ts: Column, now: Column) -> Column:
    """Age in hours of an ISO-8601 text (a trailing Z is UTC) or timestamp."""
    at = F.try_to_timestamp(ts.cast("string"))
    return (F.unix_micros(now) - F.unix_micros(at)) / F.lit(3.6e9)


def drop_seen(df: DataFrame, seen: DataFrame, key: str = "id", arrival: list[str] | None = None) -> DataFrame:
    """Rows whose id was not processed before; with ``arrival`` only the first of each id."""
    if arrival:
        df = first_by_id(df, key, arrival)
    return df.join(seen.select(key).distinct(), key, "left_anti")


def first_by_id(df: DataFrame, key: str, arrival: list[str]) -> DataFrame:
    return skew.first(df, [key], arrival)


def latest_by_id(df: DataFrame, key: str, version: list[str]) -> DataFrame:
    return skew.latest(df, [key], version)


def retain_newest(df: DataFrame, n: int = 10_000, arrival: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """Newest ``n`` rows by arrival: a distributed top-n, one bounded heap per task."""
    return df.orderBy(*[F.col(c).desc() for c in arrival]).limit(n)


def top_k_per(df: DataFrame, key: str, k: int, order: list[str]) -> DataFrame:
    """First ``k`` rows per source in source order."""
    return skew.top_per_key(df, [key], [F.col(c) for c in order], k)


def pick_track(df: DataFrame, key: str, lang: str, auto: str, order: str) -> DataFrame:
    """One track per record: English first, else manual, else the first."""
    priority = (F.when(F.col(lang).isin("en", "en-US", "en-GB"), 0)
                .when(~F.col(auto), 1).otherwise(2))
    return skew.first(df.withColumn("priority", priority), [key], ["priority", order]).drop("priority")


def union_sources(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def credibility(df: DataFrame) -> Column:
    """Platform-specific boosts on a base score, clamped to [0, 1].

    Expects base, verified, retweets, hashtag_count, community, has_place, shares,
    outlet and has_byline columns.
    """
    c = F.col
    boosts = [
        ((c("platform") == "twitter") & c("verified"), 0.2),
        ((c("platform") == "twitter") & (c("retweets") >= 100), 0.15),
        ((c("platform") == "twitter") & (c("hashtag_count") > 0), 0.15),
        ((c("platform") == "facebook") & c("community"), 0.1),
        ((c("platform") == "facebook") & c("has_place"), 0.25),
        ((c("platform") == "facebook") & (c("shares") >= 50), 0.1),
        ((c("platform") == "news") & c("has_byline"), 0.3),
        ((c("platform") == "news") & X.contains_any(c("outlet"), ["times", "express", "hindu", "ndtv"]), 0.2),
    ]
    score = c("base")
    for cond, boost in boosts:
        score = score + F.when(cond, F.lit(boost)).otherwise(F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))


def trend(df: DataFrame, bucket: str, ts: str = "ts") -> DataFrame:
    """Posts per time bucket with platform/type breakdown at every level.

    Posts are counted once; the cube adds up the counts.
    """
    per = (df.groupBy("platform", "post_type", F.date_trunc(bucket, ts).alias("bucket"))
           .agg(F.count(F.lit(1)).alias("n")))
    c = F.col
    return per.groupingSets(
        [[c("platform"), c("post_type"), c("bucket")], [c("platform"), c("bucket")], [c("post_type"), c("bucket")], [c("bucket")]],
        c("platform"), c("post_type"), c("bucket")).agg(F.sum("n").alias("n"))


def correlate(df: DataFrame, span: str, place: str, kind: str, platform: str, ts: str = "ts") -> DataFrame:
    """Distinct platforms and posts per place, type and time span; more than one correlates."""
    per = df.groupBy(place, kind, F.window(ts, span).alias("w"), platform).agg(
        F.count(F.lit(1)).alias("n"))
    return (per.groupBy(place, kind, "w").agg(F.count(F.lit(1)).alias("platforms"), F.sum("n").alias("posts"))
            .filter(F.col("platforms") > 1))


def throughput(df: DataFrame, interval_s: int, ts: str = "ts") -> DataFrame:
    """Rows per second in each interval and since the start.

    The running total goes over one row per interval, not over the posts.
    """
    from pyspark.sql import Window

    per = df.groupBy(F.window(ts, f"{interval_s} seconds")["start"].alias("start")).agg(
        F.count(F.lit(1)).alias("n"))
    # by month first, so that no task holds the intervals of a whole archive
    ranked = per.withColumn("month", F.date_trunc("month", "start"))
    months = ranked.groupBy("month").agg(F.sum("n").alias("m"))
    w_all = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    months = months.withColumn("before", F.coalesce(F.sum("m").over(w_all), F.lit(0)))
    w_in = Window.partitionBy("month").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    return (ranked.withColumn("run", F.sum("n").over(w_in))
            .join(F.broadcast(months.select("month", "before")), "month")
            .select("start", "n", (F.col("n") / interval_s).alias("rate"),
                    (F.col("run") + F.col("before")).alias("total")))
