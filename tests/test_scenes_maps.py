"""Scene choice, map clusters, links and skew helpers on hand-made rows."""

import datetime as dt
import random

from pyspark.sql import functions as F

from hazardlake import skew
from hazardlake.operators import feed
from hazardlake.operators import maps as M
from hazardlake.operators import scenes as S
from hazardlake.sources import catalogue as C


def scenes(spark, rows):
    return spark.createDataFrame([(c, s, dt.date(2020, 1, 1) + dt.timedelta(d), float(b)) for c, s, d, b in rows],
                                 "cell string, scene long, day date, burn_pct double")


def test_triplets(spark):
    df = scenes(spark, [("A", 1, 0, 10), ("A", 2, 1, 80), ("A", 3, 2, 20), ("A", 4, 3, 5),
                        ("B", 5, 0, 90), ("B", 6, 1, 7), ("B", 7, 2, 3), ("C", 8, 0, 60), ("D", 9, 0, 1), ("D", 10, 1, 2),
                        ("E", 11, 0, 40), ("E", 12, 1, 2)])
    got = {r["cell"]: (r["before"]["scene"], r["during"]["scene"], r["after"]["scene"] if r["after"] else None, r["before_is_later"])
           for r in S.fire_triplets(df).collect()}
    assert got == {"A": (1, 2, 4, False), "B": (7, 5, 6, True), "E": (12, 11, None, True)}


def brute_pairs(rows, k, above, below, later):
    out = []
    for c1, s1, d1, b1 in rows:
        for c2, s2, d2, b2 in rows:
            if c1 == c2 and d1 < d2 and b2 > b1 and b2 > later and (above is None or b1 > above) and (below is None or b1 < below):
                out.append((-(b2 - b1), c1, d2, s2, d1, s1))
    return [(x[5], x[3]) for x in sorted(out)[:k]]


def test_top_pairs_equal_brute_force(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("AAAB"), i, rnd.randrange(12), rnd.randrange(40)) for i in range(160)]
    df = scenes(spark, rows)
    for kind, lim in S.PAIR_KINDS.items():
        got = [(r["scene1"], r["scene2"]) for r in S.top_pairs(df, 15, kind).collect()]
        assert got == brute_pairs([(c, s, d, float(b)) for c, s, d, b in rows], 15, *lim)


def test_ranks(spark):
    rnd = random.Random(4)
    rows = [("hot" if rnd.random() < 0.5 else "k%d" % (i % 5), rnd.randrange(9), i) for i in range(300)]
    df = spark.createDataFrame(rows, "event string, day int, scene int")
    got = {(r["event"], r["scene"]): r["rank"] for r in skew.rank_in_segments(df, ["event"], ["day"], ["scene"]).collect()}
    for key in {r[0] for r in rows}:
        for i, r in enumerate(sorted((x for x in rows if x[0] == key), key=lambda x: (x[1], x[2])), 1):
            assert got[(key, r[2])] == i


def test_global_rank_and_pairing(spark):
    df = spark.range(500).select(F.col("id").alias("scene"))
    ranked = skew.global_rank(df.withColumn("h", F.xxhash64("scene")), "h").select("h", "rank").collect()
    assert [r["rank"] for r in sorted(ranked, key=lambda r: r["h"])] == list(range(1, 501))
    pairs = S.pair_with_other(df, 1, "scene").collect()
    assert len({r["ref_scene"] for r in pairs}) == 500 and all(r["scene"] != r["ref_scene"] for r in pairs)


def test_split_is_by_whole_fire(spark):
    df = spark.range(1000).select((F.col("id") % 50).alias("fire"))
    got = S.split_fires(df, 42).collect()
    assert len(got) == 50 and sum(r["split"] == "train" for r in got) == 40


def test_sample(spark):
    df = spark.range(100).select(F.col("id").alias("k"))
    a = [r["k"] for r in S.sample_n(df, 10, 1, ["k"]).collect()]
    assert len(set(a)) == 10 and a == sorted(a) and a == [r["k"] for r in S.sample_n(df, 10, 1, ["k"]).collect()]


def report(i, lat, lng, kind, sev):
    return (i, float(lat), float(lng), kind, sev)


def test_cells_truncate_toward_zero_and_first_type_wins(spark):
    df = spark.createDataFrame([report(1, -0.5, 0, "flood", "odd"), report(2, 0.0, 0, "fire", "low"), report(3, 0.5, 0, "fire", "high"),
                                report(4, 0.2, 0, "flood", "low")], "id int, lat double, lng double, disaster_type string, severity string")
    r = M.grid_clusters(df, 7).collect()
    assert len(r) == 1 and r[0]["n"] == 4 and r[0]["dominant_type"] == "flood" and r[0]["severity"] == "high"


def test_geocode_zero_is_missing(spark):
    df = spark.createDataFrame([("Mumbai", 0.0, 0.0, ""), ("Mumbai", 5.0, None, "X"), ("Nowhere", None, None, None)],
                               "location_name string, lat double, lng double, state string")
    rows = M.geocode(df, M.gazetteer(spark)).collect()
    got = sorted((r["location_name"], r["lat"], r["lng"], r["state"]) for r in rows)
    assert got == [("Mumbai", 5.0, 72.8777, "X"), ("Mumbai", 19.076, 72.8777, "Maharashtra"), ("Nowhere", 20.5, 78.9, "Unknown")]


def test_links_take_the_first_five(spark):
    posts = spark.createDataFrame([("P", i, "tw", "s", "a", 0, i % 2 == 0) for i in range(40)],
                                  "place string, post_id int, platform string, snippet string, author string, posted_at int, is_disaster boolean")
    reports = spark.createDataFrame([(1, "P"), (2, "P"), (3, "Q")], "id int, place string")
    got = {r["id"]: r["sources"] and [s["post_id"] for s in r["sources"]] for r in M.link_sources(reports, posts, "place", ["post_id"]).collect()}
    assert got == {1: [0, 2, 4, 6, 8], 2: [0, 2, 4, 6, 8], 3: None}


def test_lookup_with_hot_cold_and_missing_keys(spark):
    """Key 0 is hot, key 500 is hot but unknown, some rows have no key; the join is a sorted one and split."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64"}
    before = {c: spark.conf.get(c) for c in small}
    try:
        for c, v in small.items():
            spark.conf.set(c, v)
        k = F.expr("case when id < 100 then 0 when id < 160 then 500 when id < 220 then null else id - 200 end")
        big = spark.range(400).select(k.alias("k"), "id")
        side = spark.range(150).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
        want = {i: 0 if i < 100 else (i - 200) * 2 if 220 <= i < 350 else None for i in range(400)}
        got = skew.lookup(big, side, ["k"], "left").collect()
        assert len(got) == 400 and {r["id"]: r["v"] for r in got} == want
        got = skew.lookup(big, side, ["k"], "inner").collect()
        assert {r["id"]: r["v"] for r in got} == {i: v for i, v in want.items() if v is not None} and len(got) == 230
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)


def test_preferred_track(spark):
    rows = [("a", 0, "fr", True), ("a", 1, "en", True), ("b", 0, "fr", True), ("b", 1, "de", False), ("c", 0, "fr", True), ("c", 1, "de", True)]
    got = feed.pick_track(spark.createDataFrame(rows, "v string, i int, lang string, auto boolean"), "v", "lang", "auto", "i").collect()
    assert {r["v"]: r["i"] for r in got} == {"a": 1, "b": 1, "c": 0}


def test_paths(spark):
    paths = ["/d/EVT1/s1_before_flood/000006_s1_before_flood.tif", "/d/EVT1/s2_during_flood/000007_s2_during_flood.tif",
             "/d/EVT1/flood_mask/000006_flood_mask.tif", "/d/EVT1/readme.txt"]
    got = sorted((r["event"], r["phase"], r["tile"]) for r in C.tile_catalogue(spark.createDataFrame([(p,) for p in paths], "path string")).collect())
    assert got == [("EVT1", "before", "000006"), ("EVT1", "during", "000007"), ("EVT1", "mask", "000006")]


def test_nested_index(spark, tmp_path):
    p = tmp_path / "index.json"
    p.write_text('{"FIRE_T1_2018": {"tiles": [{"tile_id": "a", "source_split": "training", "mgrs": "T1", "year": 2018, "doy": 3}]}}')
    assert C.read_nested_index(spark, str(p)).first().asDict() == {
        "event": "FIRE_T1_2018", "tile_id": "a", "source_split": "training", "mgrs": "T1", "year": 2018, "doy": 3}


def test_cell_dates(spark):
    df = spark.createDataFrame([("A", 2018, 7, "training"), ("A", 2018, 7, "training"), ("A", 2017, 300, "validation")],
                               "cell string, year int, doy int, split string")
    assert S.cell_dates(df).first()["dates"] == "2017-300(v), 2018-007(t)×2"
