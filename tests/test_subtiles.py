"""Sub-tiles give what whole tiles give; chips do not carry their tile."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_plans import plan
from test_rasters import IMG, MASK, SNAKE, back, flood_fill, tile, times

from hazardlake.operators import morphology as M
from hazardlake.operators import subtiles as U

RNG = np.random.default_rng(3)
BIG = (RNG.random((37, 53)) > 0.42).astype(int)


@pytest.mark.parametrize("size", [3, 7, 20, 100])
def test_split_and_join(spark, size):
    cut = U.split_tiles(tile(spark, BIG), ["mask"], size)
    sides = cut.agg(F.min("height"), F.min("width"), F.max("height"), F.max("width")).first()
    assert min(sides[:2]) >= min(size, 37) and max(sides[2:]) < max(2 * size, 100)
    assert (back(U.join_subtiles(cut, ["mask"])) == BIG).all()


@pytest.mark.parametrize("size,halo", [(9, 1), (9, 9), (12, 5), (40, 3)])
def test_halo_is_the_neighbourhood(spark, size, halo):
    wide = U.with_halo(U.split_tiles(tile(spark, BIG), ["mask"], size), ["mask"], halo).collect()
    for r in wide:
        got = np.array(r["mask"]).reshape(r["height"], r["width"])
        r0, c0 = r["r0"] - r["top"], r["c0"] - r["left"]
        assert (got == BIG[r0:r0 + r["height"], c0:c0 + r["width"]]).all()
        assert r0 == max(0, r["r0"] - halo) and r0 + r["height"] == min(37, r["r0"] + r["inner_h"] + halo)
        assert c0 == max(0, c0) and c0 + r["width"] == min(53, r["c0"] + r["inner_w"] + halo)


@pytest.mark.parametrize("k,n", [(3, 1), (5, 2)])
def test_closing_over_borders(spark, k, n):
    halo = 2 * (k // 2) * n
    got = U.near(U.split_tiles(tile(spark, BIG), ["mask"], 9), "mask", halo, lambda t: M.closing(t, "mask", k, n))
    assert (back(U.join_subtiles(got, ["mask"])) == times(times(BIG, k, n, max), k, n, min)).all()


def test_gaussian_over_borders(spark):
    t = tile(spark, IMG, "v", "double")
    got = U.near(U.split_tiles(t, ["v"], 7), "v", 6, lambda x: M.gaussian(x, "v", 1.5))
    assert np.allclose(back(U.join_subtiles(got, ["v"]), "v"), back(M.gaussian(t, "v", 1.5), "v"))


@pytest.mark.parametrize("r", [1, 2, 3, 4, 5, 6, 7, 9, 12])
def test_every_radius(spark, r):
    t = tile(spark, MASK)
    assert (back(M.dilate(t, "mask", 2 * r + 1)) == times(MASK, 2 * r + 1, 1, max)).all()
    almost = np.ones((20, 17), dtype=int)
    almost[3, 4] = 0
    assert (back(M.erode(tile(spark, almost), "mask", 2 * r + 1)) == times(almost, 2 * r + 1, 1, min)).all()


def test_passes_grow_with_the_logarithm():
    assert [len(M._reach(r)) for r in (1, 2, 9, 100, 1000)] == [0, 1, 4, 7, 10]
    for r in range(1, 70):
        have = 1
        for at, step in M._reach(r):
            assert at == have and step <= have
            have += step
        assert have == r


@pytest.mark.parametrize("m", [MASK, SNAKE, BIG, np.ones((9, 9), dtype=int), np.zeros((4, 6), dtype=int)])
@pytest.mark.parametrize("size", [2, 5, 64])
def test_patches(spark, m, size):
    got = {r["component"]: r for r in U.patches(U.split_tiles(tile(spark, m), ["mask"], size), "mask").collect()}
    want = flood_fill(m)
    assert {k: r["pixels"] for k, r in got.items()} == want
    whole = {r["component"]: tuple(r) for r in M.components(tile(spark, m), "mask").collect()}
    for k, r in got.items():
        assert tuple(r)[:-2] == whole[k][:-2] and tuple(r)[-2:] == pytest.approx(whole[k][-2:])


def test_labels_of_runs():
    for p in (0.2, 0.5, 0.6, 0.8):
        m = (RNG.random((30, 41)) < p).astype(int)
        row, c0, c1, label = U.label_runs(m)
        sizes = np.bincount(label, c1 - c0 + 1)
        assert {row[i] * 41 + c0[i]: sizes[i] for i in np.flatnonzero(sizes)} == flood_fill(m)


def test_a_large_tile_in_subtiles(spark):
    """4,096 pixels a side, made as sub-tiles; a comb whose teeth hang together at the top."""
    side = U.SIDE
    grid = spark.range(64).select(F.lit("E").alias("event"), F.lit(1).alias("tile"), (F.col("id") / 8).cast("int").alias("sy"), (F.col("id") % 8).cast("int").alias("sx"))
    places = grid.selectExpr("event", "tile", "sy", "sx", f"sy * {side} as r0", f"sx * {side} as c0", f"{side} as height", f"{side} as width")
    comb = places.withColumn("mask", F.expr(f"transform(sequence(0, {side * side - 1}), p -> if((c0 + p % {side}) % 64 < 32 or r0 + cast(p div {side} as int) = 0, 1, 0))"))
    (one,) = U.patches(comb, "mask").collect()
    assert one["component"] == 0 and one["pixels"] == 4096 * 2048 + 2048 and one["row1"] == 4095 and one["col1"] == 4095
    closed = U.near(comb.filter("sy < 2"), "mask", 18, lambda t: M.closing(t, "mask", 7, 3))
    inner = closed.filter("sx = 1 and sy = 0").first()["mask"]
    assert sum(inner) == (side - 9) * side // 2  # outside the tile is 0, so an erosion by 9 clears the first rows


def test_chips_do_not_carry_the_tile(spark):
    """Below the one Generate there are tile arrays, above it only chips."""
    t = tile(spark, IMG, "v", "double").repartition(2)
    text = plan(U.chips(t, ["v"], 8, 5))
    assert text.count("Generate") == 1
    line = next(x for x in text.split("\n") if "Generate" in x)
    assert "v#" not in line.split("], ")[-1].replace("chip_v", "")
    a = {(r["y0"], r["x0"]): r["chip_v"] for r in U.chips(t, ["v"], 8, 5).collect()}
    b = {(r["y0"], r["x0"]): r["chip_v"] for r in M.cut_chips(M.chip_grid(t, 8, 5), ["v"], 8).collect()}
    assert a == b
    assert U.chips(t, ["v"], 8, 7, "stride").count() == M.chip_grid(t, 8, 7, "stride").count()
