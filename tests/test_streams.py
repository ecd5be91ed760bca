"""Streaming jobs: restarts, replays, several micro-batches, late rows."""

import json
import os

from pyspark.sql import functions as F

from hazardlake.sources.posts import read_post_stream
from hazardlake.streaming import jobs as J


def drop(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows))
    # files are read in the order of their time
    at = 1_700_000_000 + 10 * len(list(folder.iterdir()))
    os.utime(folder / name, (at, at))


def env(i, platform="twitter", kind="hazard"):
    return {"post_data": json.dumps({"n": i}), "timestamp": str(i), "platform": platform, "post_type": kind}


def test_restart_goes_on_where_it_was(spark, tmp_path):
    src = tmp_path / "in"
    drop(src, "a.json", [env(1), env(2)])
    run = lambda: J.run(read_post_stream(spark, str(src)).select("timestamp"), J.table_sink(str(tmp_path / "t")), str(tmp_path / "c"))
    run()
    run()
    drop(src, "b.json", [env(3)])
    run()
    assert sorted(r[0] for r in J.read_table(spark, str(tmp_path / "t")).collect()) == ["1", "2", "3"]


def test_running_counts_over_batches(spark, tmp_path):
    src = tmp_path / "in"
    for i in range(3):
        drop(src, f"{i}.json", [env(i), env(i, "news")])
    J.run(J.running_counts(read_post_stream(spark, str(src), 1)), J.table_sink(str(tmp_path / "t")), str(tmp_path / "c"), "complete")
    got = {r["platform"]: r["n"] for r in J.read_last(spark, str(tmp_path / "t")).collect()}
    assert got == {"twitter": 3, "news": 3}


def test_timed_trigger(spark, tmp_path):
    src = tmp_path / "in"
    drop(src, "a.json", [env(1), env(2, "news")])
    q = J.start(J.running_counts(read_post_stream(spark, str(src))), J.table_sink(str(tmp_path / "t")), str(tmp_path / "c"), "complete", "1 second")
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert J.read_last(spark, str(tmp_path / "t")).count() == 2


def test_replayed_batch_replaces_itself(spark, tmp_path):
    df = spark.range(5)
    J.write_batch(df, str(tmp_path / "t"), 0)
    J.write_batch(df, str(tmp_path / "t"), 0)
    assert J.read_table(spark, str(tmp_path / "t")).count() == 5


def timed(spark, tmp_path, batches):
    src = tmp_path / "in"
    for i, rows in enumerate(batches):
        drop(src, f"{i}.json", [{"id": a, "ts": t} for a, t in rows])
    return spark.readStream.schema("id long, ts timestamp").option("maxFilesPerTrigger", 1).json(str(src))


def test_serving_store_keeps_newest_and_first(spark, tmp_path):
    s = timed(spark, tmp_path, [[(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:01:00")],
                                [(3, "2024-01-01 00:02:00"), (2, "2024-01-01 00:09:00")], [(4, "2024-01-01 00:03:00")]])
    J.run(s, J.serving_sink(str(tmp_path / "t"), 3), str(tmp_path / "c"))
    assert sorted(r["id"] for r in J.read_last(spark, str(tmp_path / "t")).collect()) == [2, 3, 4]


def test_late_rows_do_not_reopen_a_window(spark, tmp_path):
    s = timed(spark, tmp_path, [[(1, "2024-01-01 00:10:00")], [(2, "2024-01-01 05:00:00")], [(5, "2024-01-01 05:01:00")],
                                [(3, "2024-01-01 00:20:00")], [(4, "2024-01-01 09:00:00")]])
    w = J.windowed_counts(s.withColumn("platform", F.lit("x")), "1 hour", "10 minutes", ["platform"])
    J.run(w, J.table_sink(str(tmp_path / "t")), str(tmp_path / "c"))
    got = sorted((str(r["start"]), r["n"]) for r in J.read_table(spark, str(tmp_path / "t")).collect())
    assert got == [("2024-01-01 00:00:00", 1), ("2024-01-01 05:00:00", 2)]


def test_duplicates_over_batches(spark, tmp_path):
    s = timed(spark, tmp_path, [[(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:10")], [(1, "2024-01-01 00:05:00"), (2, "2024-01-01 00:05:00")]])
    J.run(J.drop_duplicates(s, ["id"], "1 hour"), J.table_sink(str(tmp_path / "t")), str(tmp_path / "c"))
    assert sorted(r["id"] for r in J.read_table(spark, str(tmp_path / "t")).collect()) == [1, 2]


def test_remembered_ids_expire(spark, tmp_path):
    s = timed(spark, tmp_path, [[(1, "2024-01-01 00:00:00")], [(1, "2024-01-01 00:30:00"), (2, "2024-01-01 04:00:00")],
                                [(3, "2024-01-01 04:10:00")], [(1, "2024-01-01 04:20:00")]])
    J.run(J.remember_ids(s, "id", 3_600_000, "0 seconds"), J.table_sink(str(tmp_path / "t")), str(tmp_path / "c"))
    assert sorted(r["id"] for r in J.read_table(spark, str(tmp_path / "t")).collect()) == [1, 1, 2, 3]


def test_reports_show_the_last_version(spark, tmp_path):
    for i, rows in enumerate([[(1, "a", "2024"), (2, "b", "2024")], [(1, "c", "2025")], [(1, "d", "2025")]]):
        J.write_batch(spark.createDataFrame(rows, "id int, title string, updated_at string"), str(tmp_path / "t"), i)
    assert {r["id"]: r["title"] for r in J.read_reports(spark, str(tmp_path / "t")).collect()} == {1: "d", 2: "b"}


def test_spikes(spark):
    rows = [("k", i, n) for i, n in enumerate([4, 4, 4, 12, 4, 7])]
    got = J.spikes(spark.createDataFrame(rows, "k string, start int, n long"), ["k"], 3, 2.0).collect()
    assert [(r["start"], r["trailing_mean"], r["mass_event"]) for r in got] == [(3, 4.0, True)]


def test_duplicates_against_the_table(spark, tmp_path):
    s = timed(spark, tmp_path, [[(1, "2024-01-01 00:00:05"), (1, "2024-01-01 00:00:01")], [(1, "2024-01-01 00:05:00"), (2, "2024-01-01 00:05:00")]])
    J.run(s, J.dedup_sink(str(tmp_path / "t"), ["id"], ["ts"]), str(tmp_path / "c"))
    got = sorted((r["id"], str(r["ts"])) for r in J.read_table(spark, str(tmp_path / "t")).collect())
    assert got == [(1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:05:00")]


def test_ingest_in_few_micro_batches(spark, tmp_path):
    """Many events do not mean many micro-batches: 30,000 of them came in 30 before."""
    from hazardlake.plans import catalogue
    from hazardlake.plans.streams_queries import EVENTS
    from hazardlake.session import recording

    rows = spark.range(30_000).selectExpr("id as event_id", "timestamp_ntz'2024-01-01' as ts", "id % 7 as user_id", "'view' as event_type",
                                          "cast(id as double) as value", "concat('{\"k\": ', id, '}') as props")
    assert rows.schema.simpleString() == spark.createDataFrame([], EVENTS).schema.simpleString()
    rows.coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    with recording() as made:
        out = catalogue()["stream_ingest"].run(spark, str(tmp_path))
    assert out.count() == 30_000 and out.filter("id = k").count() == 30_000
    batches = spark.read.parquet(f"{made[0]}/table").select("batch").distinct().count()
    assert 1 < batches <= 9
