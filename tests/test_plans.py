"""Physical plans: where data moves, what reaches the scan."""

from pyspark.sql import functions as F

from hazardlake.operators import feed, morphology, rasters
from hazardlake.operators import maps as M
from hazardlake.plans import fixtures as A


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbourhood_operators_do_not_shuffle(spark, sf):
    t = A.tiles(spark, sf).withColumn("mask", F.expr("transform(v, x -> cast(x > 0 as int))"))
    out = morphology.closing(morphology.opening(morphology.gaussian(t, "v", 1.5), "mask", 3), "mask", 5, 2)
    assert "Exchange" not in plan(out)
    assert "Exchange" not in plan(rasters.zscore_tile(rasters.stretch(t, "v", 0.02, 0.98), "v"))


def test_pixels_are_not_shuffled(spark, sf):
    """The pair meets as tiles; the per-tile counts need no further exchange."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(rasters.change_stats(rasters.align_pixels(A.tiles(spark, sf)), F.col("b") > 0, F.col("d") > 0, 10.0))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 2


def test_feed_filters_reach_the_scan(spark, sf):
    text = plan(feed.by_id(A.table(spark, sf, "documents"), 3, "doc_id").select("doc_id", "lang"))
    assert "EqualTo(doc_id,3)" in text and "ReadSchema: struct<doc_id:bigint,lang:string>" in text


def test_top_k_is_cut_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan(feed.top_k_per(A.stream(spark, sf), "author", 5, ["ts", "id"]))


def test_clusters_aggregate_before_the_shuffle(spark, sf):
    text = plan(M.grid_clusters(A.reports(spark, sf), 5))
    assert "partial_count" in text


def test_page_is_a_top_n(spark, sf):
    assert "TakeOrdered" in plan(feed.page(A.stream(spark, sf), 50, 10).select("id"))


def test_chips_meet_by_tile(spark, sf):
    t = A.tiles(spark, sf).filter("phase = 'before'")
    chips = morphology.cut_chips(morphology.chip_grid(t, 5, 3), ["v"], 5)
    text = plan(morphology.merge_chips(chips, "chip_v", 5))
    assert text.count("Exchange") == 1


def test_no_cross_joins(spark, sf):
    import __spark_entry__ as entry

    for name in ("platform_share", "global_stats", "best_pairs", "global_summary", "split_fires", "reference_pairing", "top_pairs_good"):
        text = plan(entry.queries()[name](spark, sf))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
