"""Outlines against a walk along the edges, point in polygon and flood fill; GeoJSON round trips."""

import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_rasters import MASK, SNAKE, flood_fill, tile

from hazardlake.operators import outlines as O


def walk(m):
    """Closed rings of corners with the positives on the right; right turns first."""
    h, w = m.shape
    on = lambda r, c: 0 <= r < h and 0 <= c < w and m[r, c] == 1
    ways = {}
    for r in range(h):
        for c in range(w):
            if on(r, c):
                for test, a, b in ((on(r - 1, c), (c, r), (c + 1, r)), (on(r, c + 1), (c + 1, r), (c + 1, r + 1)),
                                   (on(r + 1, c), (c + 1, r + 1), (c, r + 1)), (on(r, c - 1), (c, r + 1), (c, r))):
                    if not test:
                        ways.setdefault(a, []).append(b)
    rings = []
    while ways:
        start = min(ways, key=lambda p: (p[1], p[0]))
        ring, at, came = [], start, None
        while True:
            out = ways[at]
            right = came and (at[0] - came[1], at[1] + came[0])
            to = right if right in out else out[0]
            out.remove(to)
            if not out:
                del ways[at]
            step = (to[0] - at[0], to[1] - at[1])
            if step != came:
                ring.append(at)
            at, came = to, step
            if at == start and (start not in ways or (start[0] - came[1], start[1] + came[0]) not in ways[start]):
                break
        rings.append(ring)
    return rings


def turned(ring):
    """The ring from its first corner by row and column."""
    k = min(range(len(ring)), key=lambda i: (ring[i][1], ring[i][0]))
    return tuple(ring[k:] + ring[:k])


def shoelace(p):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1])) / 2


def inside(x, y, ring):
    hit = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
        if (y0 > y) != (y1 > y) and x < x0 + (y - y0) * (x1 - x0) / (y1 - y0):
            hit = not hit
    return hit


def nested():
    """Rings within rings, and holes side by side."""
    m = np.ones((15, 19), dtype=int)
    m[1:14, 1:18] = 0
    m[2:13, 2:17] = 1
    m[3:12, 3:9] = 0
    m[3:6, 10:13] = 0
    m[7:12, 10:16] = 0
    m[5:8, 5:7] = 1
    m[9, 12] = 1
    m[4, 11] = 1
    return m


def random_masks():
    rng = np.random.default_rng(8)
    return [(rng.random((rng.integers(1, 16), rng.integers(1, 16))) < p).astype(int) for p in (0.3, 0.5, 0.6, 0.75, 0.9)]


CASES = [MASK, SNAKE, nested(), np.eye(3, dtype=int), np.ones((5, 1), dtype=int), np.zeros((3, 3), dtype=int), *random_masks()]


@pytest.fixture(scope="module")
def outlined(spark):
    """All cases as tiles of one table."""
    rows = [("E", i, *m.shape, m.ravel().tolist()) for i, m in enumerate(CASES)]
    tiles = spark.createDataFrame(rows, "event string, tile int, height int, width int, mask array<int>")
    got = {}
    for r in O.outline(tiles, "mask").collect():
        got.setdefault(r["tile"], []).append(r)
    return got


@pytest.mark.parametrize("i", range(len(CASES)))
def test_rings_are_those_of_a_walk(outlined, i):
    rows = outlined.get(i, [])
    mine = {r["ring"]: [(int(p["x"]), int(p["y"])) for p in r["points"]] for r in rows}
    assert all(p[0] == p[-1] for p in mine.values())
    assert sorted(turned(p[:-1]) for p in mine.values()) == sorted(turned(p) for p in walk(CASES[i]))
    for r in rows:
        p = mine[r["ring"]][:-1]
        assert (r["corners"], r["area"]) == (len(p), shoelace(p)) and p[0] == turned(p)[0]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_holes_lie_in_their_outer_ring(outlined, i):
    rows = outlined.get(i, [])
    mine = {r["ring"]: [(p["x"], p["y"]) for p in r["points"]][:-1] for r in rows}
    area = {r["ring"]: r["area"] for r in rows}
    for r in rows:
        if r["area"] > 0:
            assert r["outer"] == r["ring"]
        else:
            x, y = mine[r["ring"]][0]
            around = [k for k in mine if area[k] > 0 and inside(x + 0.5, y + 0.5, mine[k])]
            assert r["outer"] == min(around, key=lambda k: area[k])
    net = {}
    for r in rows:
        net[r["outer"]] = net.get(r["outer"], 0) + r["area"]
    assert sorted(net.values()) == sorted(flood_fill(CASES[i]).values())


def test_null_pixels_are_not_positive(spark):
    t = spark.createDataFrame([("E", 1, 1, 3, [1, None, 1]), ("E", 2, 0, 0, []), ("E", 3, 1, 1, None)], "event string, tile int, height int, width int, mask array<int>")
    assert [(r["tile"], r["area"]) for r in O.outline(t, "mask").collect()] == [(1, 1.0), (1, 1.0)]


def test_no_tile_is_gathered(spark):
    """No grouping by tile alone before the ring: every exchange knows a finer key."""
    text = O._links(O._sides(O._unit_edges(tile(spark, MASK), "mask", O.TILE), O.TILE), O.TILE)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(event" in text and "Python" not in text and "Pandas" not in text
    assert not [line for line in text.split("\n") if "hashpartitioning(event" in line and line.split("hashpartitioning(")[1].count("#") <= 2]


def test_documents_written_in_pieces(spark, tmp_path):
    t = spark.createDataFrame([("E", i, *m.shape, m.ravel().tolist()) for i, m in ((1, nested()), (2, np.zeros((2, 2), dtype=int)))],
                              "event string, tile int, height int, width int, mask array<int>")
    props = t.select("event", "tile", F.lit(1.5).alias("area_km2"), F.lit('say "hi"').alias("title"))
    O.write_collections(O.feature_pieces(O.outline(t, "mask"), props), f"{tmp_path}/geo")
    docs = {}
    for folder in Path(f"{tmp_path}/geo").glob("event=E/tile=*"):
        docs[folder.name] = json.loads("".join(p.read_text().replace("\n", "") for p in sorted(folder.glob("*.txt"))))
    assert docs["tile=2"] == {"type": "FeatureCollection", "features": []}
    (feature,) = docs["tile=1"]["features"]
    assert feature["properties"] == {"area_km2": 1.5, "title": 'say "hi"'} and feature["geometry"]["type"] == "MultiPolygon"
    polygons = feature["geometry"]["coordinates"]
    assert len(polygons) == len(flood_fill(nested())) and sum(len(p) - 1 for p in polygons) == 4
    assert all(shoelace([tuple(x) for x in p[0][:-1]]) > 0 and all(shoelace([tuple(x) for x in h[:-1]]) < 0 for h in p[1:]) for p in polygons)


def test_points_on_the_map(spark):
    place = spark.createDataFrame([("E", 1, 500000.0, 0.0, 10.0, 43, False)], "event string, tile int, left double, top double, res double, zone int, south boolean")
    (row,) = O.outline(tile(spark, np.ones((2, 3), dtype=int)), "mask", place=place).collect()
    first, east = row["points"][0], row["points"][1]
    assert first["x"] == pytest.approx(75.0) and first["y"] == pytest.approx(0.0, abs=1e-9)
    assert east["x"] > first["x"] and row["area"] == 6.0 and row["corners"] == 4


def test_known_rings_leave_the_rounds(spark):
    """Lone pixels and one long ring: before, every round wrote every side, 6 times 400 here."""
    from hazardlake.session import recording

    lone = np.zeros((20, 20), dtype=int)
    lone[::2, ::2] = 1
    rows = [("E", i, *m.shape, m.ravel().tolist()) for i, m in ((1, lone), (2, SNAKE))]
    tiles = spark.createDataFrame(rows, "event string, tile int, height int, width int, mask array<int>")
    with recording() as made:
        got = O.outline(tiles, "mask").groupBy("tile").agg(F.count("ring").alias("n"), F.sum("corners").alias("c")).collect()
    assert {r["tile"]: (r["n"], r["c"]) for r in got} == {1: (100, 400), 2: (len(walk(SNAKE)), sum(map(len, walk(SNAKE))))}
    sides = sum(r["c"] for r in got)
    written = [spark.read.parquet(p).count() for p in made if "/rings-" in p]
    assert sum(written) < 3 * sides and written[-1] < sides / 4


def test_no_state_goes_through_the_driver(spark):
    """Small states were broadcast once a round."""
    place = spark.createDataFrame([("E", 1, 500000.0, 0.0, 10.0, 43, False)], "event string, tile int, left double, top double, res double, zone int, south boolean")
    out = O.outline(tile(spark, nested()), "mask", place=place)
    assert out.count() > 1
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_result_rests_on_the_order_of_the_corners(spark, monkeypatch, tmp_path):
    """Corners and area came from links without an order, and no point of a ring was gathered
    for the query: with the corners in any other order its rows were the same."""
    import __spark_entry__ as entry

    masks = [np.pad(np.ones((2, 3), dtype=int), ((1, 5), (1, 4))), nested()[2:10, 2:10]]
    rows = [(i, [float(x) for x in m.ravel()], 0) for i, m in enumerate(masks)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")

    def run():
        out = entry.queries()["outline"](spark, str(tmp_path))
        assert "collect_list" in out._jdf.queryExecution().optimizedPlan().toString()
        return sorted((r["phase"], r["component"], r["corners"], r["area"]) for r in out.collect())

    right = run()
    assert right[0] == ("before", 9, 4, 6.0) and sum(r[3] for r in right) == sum(m.sum() for m in masks)
    ranked = O._ranked
    monkeypatch.setattr(O, "_ranked", lambda *a: ranked(*a).withColumn("ahead", F.expr("if(ahead in (1, 2), 3 - ahead, ahead)")))
    # The second and the third step of the rectangle change places: two of its sides cross.
    assert run()[0] == ("before", 9, 2, 0.0)


def test_places_that_come_twice(spark):
    """Tiles that are placed twice have their corners once and their own area."""
    place = spark.createDataFrame([("E", 1, 500000.0, 0.0, 10.0, 43, False)] * 2, "event string, tile int, left double, top double, res double, zone int, south boolean")
    (row,) = O.outline(tile(spark, np.ones((2, 3), dtype=int)), "mask", place=place).collect()
    assert (row["corners"], row["area"]) == (4, 6.0)
