"""Reports on the map: filters, pins, clusters, heat, states, geocoding and source links."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hazardlake import skew
from hazardlake.functions import lexicons as L
from hazardlake.functions import text as X


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain(*values.items())])


def severity_rank(col: Column) -> Column:
    """0 is worst; an unknown level ranks 4."""
    return F.coalesce(F.try_element_at(_map(L.SEVERITY_RANK), col), F.lit(4))


def severity_weight(col: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(L.SEVERITY_WEIGHT), col), F.lit(0.2))


def cell_index(coord: Column, size: float) -> Column:
    """Grid index, truncated toward zero as an integer cast does."""
    return (coord / F.lit(size)).cast("int")


def grid_clusters(df: DataFrame, zoom: int, order: str = "id") -> DataFrame:
    """Clusters for a zoom level: mean point, count, dominant type and worst severity.

    Types are counted per cell first; the type seen first wins a tie. Members are listed
    by ``cluster_members``, one row per report.
    """
    if not 1 <= zoom <= 18:
        raise ValueError("zoom must be 1..18")
    size = 180.0 / 2 ** zoom
    per_type = (df.groupBy(cell_index(F.col("lat"), size).alias("cy"),
                           cell_index(F.col("lng"), size).alias("cx"), "disaster_type")
                .agg(F.count(F.lit(1)).alias("n"), F.sum("lat").alias("slat"), F.sum("lng").alias("slng"),
                     F.min(order).alias("seen"), F.min(severity_rank(F.col("severity"))).alias("rank"),
                     F.min_by("severity", F.struct(severity_rank(F.col("severity")), F.col(order))).alias("sev")))
    total = F.sum("n")
    return (per_type.groupBy("cy", "cx").agg(
        (F.sum("slat") / total).alias("lat"), (F.sum("slng") / total).alias("lng"),
        total.alias("n"),
        F.max_by("disaster_type", F.struct(F.col("n"), -F.col("seen"))).alias("dominant_type"),
        F.min_by("sev", F.struct("rank", "seen")).alias("severity")))


def cluster_members(df: DataFrame, zoom: int) -> DataFrame:
    size = 180.0 / 2 ** zoom
    return df.select(cell_index(F.col("lat"), size).alias("cy"), cell_index(F.col("lng"), size).alias("cx"), "id")


def heat_points(df: DataFrame) -> DataFrame:
    return df.select("id", "lat", "lng", severity_weight(F.col("severity")).alias("intensity"))


def state_summary(df: DataFrame) -> DataFrame:
    """Totals, counts by type and by severity, and latest time per state.

    The maps hold one entry per type or level, so they are built from pre-counted rows.
    """
    state = F.coalesce(F.col("state"), F.lit("Unknown")).alias("state")
    # each report counts once by its type and once by its severity
    kinds = F.explode(F.array(F.struct(F.lit("type").alias("kind"), F.col("disaster_type").alias("value")),
                              F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("value"))))
    counted = (df.select(state, "created_at", kinds.alias("k")).groupBy("state", "k.kind", "k.value")
               .agg(F.count(F.lit(1)).alias("n"), F.max("created_at").alias("last")))

    def counts(kind: str) -> Column:
        entry = F.when((F.col("kind") == kind) & F.col("value").isNotNull(), F.struct("value", "n"))
        return F.map_from_entries(F.array_sort(F.collect_list(entry)))

    total = F.sum(F.when(F.col("kind") == "type", F.col("n")))
    return counted.groupBy("state").agg(
        total.alias("total_reports"), F.max("last").alias("latest_report_at"), counts("type").alias("disaster_types"),
        counts("severity").alias("severity_breakdown"), total.alias("active_reports"))


def report_query(df: DataFrame, disaster_type: str | None = None, severity: str | None = None,
                 state: str | None = None, verified_only: bool = True) -> DataFrame:
    """Report filter, newest first."""
    if disaster_type:
        df = df.filter(F.col("disaster_type") == disaster_type)
    if severity:
        df = df.filter(F.col("severity") == severity)
    if state:
        df = df.filter(F.lower("state") == state.lower())
    if verified_only:
        df = df.filter(F.col("status") == "verified")
    return df.orderBy(F.col("created_at").desc(), F.col("id"))


def to_pins(df: DataFrame) -> DataFrame:
    """Nine flat columns out of the nested report."""
    return df.select("id", F.col("location.lat").alias("lat"), F.col("location.lng").alias("lng"),
                     "disaster_type", "severity", "title",
                     F.coalesce(F.col("location.name"), F.lit("")).alias("location_name"),
                     F.coalesce(F.col("verification.source_count"), F.lit(0)).alias("source_count"),
                     "created_at")


def nest_report(df: DataFrame) -> DataFrame:
    """Flat report columns to the nested report shape."""
    return df.select(
        "id", "title", "disaster_type", "severity", "created_at",
        F.struct(F.col("state").alias("name"), "state", "lat", "lng").alias("location"),
        F.struct("status", "source_count").alias("verification"),
        F.struct(F.col("area_km2").alias("affected_area_km2")).alias("impact"))


def gazetteer(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(L.GAZETTEER, "name string, g_lat double, g_lng double, g_state string")


def geocode(df: DataFrame, gaz: DataFrame, name: str = "location_name") -> DataFrame:
    """Point and state of a named place; given values win unless zero or empty."""
    lat0, lng0, state0 = L.DEFAULT_POINT
    dim = gaz.select(F.col("name").alias(name), "g_lat", "g_lng", "g_state")
    got = skew.lookup(df, dim, [name])
    given = lambda c: F.nullif(F.col(c), F.lit(0.0))
    return got.withColumns({
        "lat": F.coalesce(given("lat"), "g_lat", F.lit(lat0)),
        "lng": F.coalesce(given("lng"), "g_lng", F.lit(lng0)),
        "state": F.coalesce(X.non_empty(F.col("state")), "g_state", F.lit(state0)),
    }).drop("g_lat", "g_lng", "g_state")


def link_sources(reports: DataFrame, posts: DataFrame, place: str, order: list[str], k: int = 5) -> DataFrame:
    """Per report the first ``k`` disaster posts at its place, in feed order.

    The posts of a place are cut to ``k`` before any shuffle, so a report meets at most
    ``k`` rows however many posts or reports share the place.
    """
    early = skew.top_per_key(posts.filter("is_disaster"), [place], [F.col(c) for c in order], k)
    per_place = early.groupBy(place).agg(F.array_sort(F.collect_list(F.struct(
        "rank", "post_id", "platform", "snippet", "author", "posted_at"))).alias("sources"))
    return skew.lookup(reports, per_place, [place], "left")


def link_by_ids(reports: DataFrame, posts: DataFrame, ids: str = "post_ids", key: str = "id",
                post_key: str = "post_id") -> DataFrame:
    """Posts named by a report's id list, with distinct platforms and their number."""
    wanted = reports.select(key, F.posexplode(ids).alias("pos", post_key))
    found = skew.lookup(wanted, posts, [post_key], "inner")
    # the lists hold as many entries as the report's own id list
    return found.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("pos", post_key, "platform", "snippet"))).alias("sources"),
        F.array_sort(F.collect_set("platform")).alias("platforms"),
        F.count(F.lit(1)).alias("source_count"))


def verification_rollup(sources: DataFrame, key: str) -> DataFrame:
    """Platform list and number of sources of each report; few platforms exist."""
    per = sources.groupBy(key, "platform").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(key).agg(F.array_sort(F.collect_list("platform")).alias("platforms"),
                                F.sum("n").alias("source_count"))


def join_authors(tweets: DataFrame, users: DataFrame, places: DataFrame) -> DataFrame:
    """Tweet with user and place; an unknown user becomes 'unknown', a place null."""
    got = skew.lookup(tweets, users, ["author_id"])
    got = skew.lookup(got, places, ["place_id"])
    return got.withColumn("user", F.coalesce("username", F.lit("unknown"))).drop("username")
