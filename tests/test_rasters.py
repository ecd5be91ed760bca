"""Tile operators against NumPy written from the definitions, and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hazardlake.functions import spectral as P
from hazardlake.operators import evaluate as E
from hazardlake.operators import hooks as K
from hazardlake.operators import morphology as M
from hazardlake.operators import rasters as R

H, W = 20, 17
RNG = np.random.default_rng(5)
MASK = (RNG.random((H, W)) > 0.4).astype(int)
IMG = RNG.random((H, W))


def tile(spark, arr, name="mask", kind="int"):
    h, w = arr.shape
    return spark.createDataFrame([("E", 1, h, w, [x.item() for x in arr.ravel()])],
                                 f"event string, tile int, height int, width int, {name} array<{kind}>")


def back(df, name="mask"):
    r = df.first()
    return np.array(r[name]).reshape(r["height"], r["width"])


def square(m, k, test):
    r, out = k // 2, np.zeros_like(m)
    for i in range(m.shape[0]):
        for j in range(m.shape[1]):
            vals = [m[a, b] if 0 <= a < m.shape[0] and 0 <= b < m.shape[1] else 0
                    for a in range(i - r, i + r + 1) for b in range(j - r, j + r + 1)]
            out[i, j] = test(vals)
    return out


def times(m, k, n, test):
    for _ in range(n):
        m = square(m, k, test)
    return m


@pytest.mark.parametrize("k,n", [(3, 1), (5, 2), (7, 3)])
def test_erode_dilate_closing(spark, k, n):
    t = tile(spark, MASK)
    assert (back(M.dilate(t, "mask", k, n)) == times(MASK, k, n, max)).all()
    assert (back(M.erode(t, "mask", k, n)) == times(MASK, k, n, min)).all()
    assert (back(M.closing(t, "mask", k, n)) == times(times(MASK, k, n, max), k, n, min)).all()


def test_opening_is_inside_the_mask(spark):
    got = back(M.opening(tile(spark, MASK), "mask", 3))
    assert (got == square(square(MASK, 3, min), 3, max)).all() and (got <= MASK).all()


def test_operators_compose_in_one_expression(spark):
    t = tile(spark, IMG, "v", "double").withColumn("mask", F.expr("transform(v, x -> cast(x > 0.4 as int))"))
    got = back(M.closing(M.opening(M.buffer(t, "mask", 1), "mask", 3), "mask", 3))
    m = (IMG > 0.4).astype(int)
    want = times(times(times(times(square(m, 3, max), 3, 1, min), 3, 1, max), 3, 1, max), 3, 1, min)
    assert (got == want).all()


@pytest.mark.parametrize("sigma", [1.5, 2.0])
def test_gaussian(spark, sigma):
    got = back(M.gaussian(tile(spark, IMG, "v", "double"), "v", sigma), "v")
    k = M.gaussian_kernel(sigma)
    pad = len(k) // 2
    w = np.array([x for _, x in k])
    assert len(k) == 2 * int(4 * sigma + 0.5) + 1 and abs(w.sum() - 1) < 1e-12
    big = np.pad(IMG, pad, mode="symmetric")
    rows = np.apply_along_axis(lambda x: np.convolve(x, w, "valid"), 1, big)
    want = np.apply_along_axis(lambda x: np.convolve(x, w, "valid"), 0, rows)
    assert np.allclose(got, want)


def np_otsu(x):
    counts, edges = np.histogram(x, 256)
    mid = (edges[:-1] + edges[1:]) / 2
    w1, w2 = np.cumsum(counts), np.cumsum(counts[::-1])[::-1]
    m1 = np.cumsum(counts * mid) / w1
    m2 = (np.cumsum((counts * mid)[::-1]) / w2[::-1])[::-1]
    return mid[np.argmax(w1[:-1] * w2[1:] * (m1[:-1] - m2[1:]) ** 2)]


def test_otsu(spark):
    img = np.where(MASK == 1, IMG, IMG + 1.5)
    got = M.otsu(tile(spark, img, "v", "double"), "v", keys=["event", "tile"]).first()["threshold"]
    assert got == pytest.approx(np_otsu(img.ravel()))
    flat = M.otsu(tile(spark, np.full((3, 3), 2.0), "v", "double"), "v", keys=["event", "tile"]).first()["threshold"]
    assert flat == 2.0


def flood_fill(m):
    seen, out = np.full(m.shape, -1), {}
    for i in range(m.shape[0]):
        for j in range(m.shape[1]):
            if m[i, j] and seen[i, j] < 0:
                lab, todo, cells = i * m.shape[1] + j, [(i, j)], []
                seen[i, j] = lab
                while todo:
                    a, b = todo.pop()
                    cells.append((a, b))
                    for c, d in ((a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)):
                        if 0 <= c < m.shape[0] and 0 <= d < m.shape[1] and m[c, d] and seen[c, d] < 0:
                            seen[c, d] = lab
                            todo.append((c, d))
                out[lab] = len(cells)
    return out


SNAKE = np.zeros((9, 11), dtype=int)
for _i in range(0, 9, 2):
    SNAKE[_i, :] = 1
    if _i + 1 < 9:
        SNAKE[_i + 1, 10 if _i % 4 == 0 else 0] = 1


@pytest.mark.parametrize("m", [MASK, SNAKE, np.zeros((4, 4), dtype=int), np.ones((5, 5), dtype=int)])
def test_components(spark, m):
    got = {r["component"]: r["pixels"] for r in M.components(tile(spark, m), "mask").collect()}
    assert got == flood_fill(m)


@pytest.mark.parametrize("size,stride,n", [(600, 448, 1), (1000, 448, 4)])
def test_chip_covers(spark, size, stride, n):
    t = spark.createDataFrame([("E", 1, size, size)], "event string, tile int, height int, width int")
    whole = M.chip_grid(t, 512, stride).agg(F.max("y0")).first()[0]
    assert whole + 512 >= size
    assert M.chip_grid(t, 512, stride, "stride").count() == n


def test_merge_of_unchanged_chips_is_the_image(spark):
    t = tile(spark, IMG, "v", "double")
    got = M.merge_chips(M.cut_chips(M.chip_grid(t, 8, 5), ["v"], 8), "chip_v", 8).collect()
    assert len(got) == H * W
    for r in got:
        assert r["score"] == pytest.approx(IMG[r["row"], r["col"]])


def test_pixels_without_a_chip_score_zero(spark):
    """600 pixels, chips of 512 and a stride of 448: one chip fits, the rest stays 0 (scaled down by 64)."""
    img = np.ones((9, 9))
    t = tile(spark, img, "v", "double")
    m = M.merged_tiles(M.merge_chips(M.cut_chips(M.chip_grid(t, 8, 7, "stride"), ["v"], 8), "chip_v", 8))
    got = back(m, "score")
    assert got[:8, :8].all() and not got[8].any() and not got[:, 8].any()


def test_pad_and_crop(spark):
    t = tile(spark, IMG, "v", "double")
    padded = back(M.pad_to(t, "v", 25), "v")
    assert np.allclose(padded, np.pad(IMG, ((0, 5), (0, 8)), mode="reflect"))
    assert np.allclose(back(M.center_crop(t, "v", 8), "v"), IMG[6:14, 4:12])


def test_augment_is_a_turn_or_flip(spark):
    sq = IMG[:6, :6]
    for seed in range(12):
        got = back(M.augment(tile(spark, sq, "v", "double"), ["v"], seed), "v")
        options = [np.rot90(f, k) for f in (sq, sq[::-1], sq[:, ::-1], sq[::-1, ::-1]) for k in range(4)]
        assert any(np.allclose(got, o) for o in options)


def test_round_trip(spark):
    t = tile(spark, MASK)
    px = R.explode_pixels(t, ["mask"], ["event", "tile"])
    assert R.collect_tile(px, "mask").first()["mask"] == MASK.ravel().tolist()


def test_percent_increase_rules(spark):
    df = spark.createDataFrame([(215048, 16168), (5, 0), (0, 0)], "new long, before long")
    n, b = F.col("new"), F.col("before")
    rows = df.select(*[P.pct_increase(n, b, k) for k in ("inf", "zero", "one")]).collect()
    assert round(rows[0][0], 2) == 1330.08
    assert list(rows[1]) == [float("inf"), 0.0, 500.0] and list(rows[2]) == [float("inf"), 0.0, 0.0]


def test_total_of_event_areas(spark):
    rows = [("a", 1, 344.59), ("b", 1, 51.07), ("c", 1, 141.91)]
    df = spark.createDataFrame(rows, "event string, tile int, new_km2 double").withColumns({"during_km2": F.col("new_km2"), "f1": F.lit(0.5)})
    total = R.global_summary(df).filter("event is null").first()
    assert round(total["total_new_km2"], 2) == 537.57 and total["total_events"] == 3


def test_change_identities(spark):
    a, b = MASK, (IMG > 0.5).astype(int)
    t = tile(spark, a, "b").join(tile(spark, b, "d").select("tile", "d"), "tile")
    px = R.explode_pixels(t, ["b", "d"], ["event", "tile"])
    r = R.change_stats(px, F.col("b") == 1, F.col("d") == 1, 10.0).first()
    assert (r["new_px"], r["receded_px"]) == (((b == 1) & (a == 0)).sum(), ((a == 1) & (b == 0)).sum())
    assert r["during_px"] - r["new_px"] == r["before_px"] - r["receded_px"]


@pytest.mark.parametrize("cm,mode,f1", [((0, 0, 0, 9), "zero", 0.0), ((0, 0, 0, 9), "one", 0.0), ((2, 1, 1, 0), "zero", 4 / 6),
                                        ((2, 1, 1, 0), "running", 2 / 3), ((0, 0, 0, 9), "eps", 0.0)])
def test_score_rules(spark, cm, mode, f1):
    df = spark.createDataFrame([cm], "tp long, fp long, fn long, tn long")
    r = E.scores(df, mode).first()
    assert r["f1"] == pytest.approx(f1, abs=1e-6) and 0 <= r["accuracy"] <= 1


def test_micro_equals_macro_for_one_tile(spark):
    df = spark.createDataFrame([("e", 1, 5, 2, 3, 7)], "event string, tile int, tp long, fp long, fn long, tn long")
    macro = E.macro_avg(E.scores(df)).filter("event is not null").first()
    micro = E.micro_avg(df, ["event"], "zero").first()
    for s in E.SCORES:
        assert macro[s] == pytest.approx(micro[s])


def test_stretch_limits(spark):
    img = np.array([[0.0, 1.0], [2.0, 10.0]])
    t = tile(spark, img, "v", "double")
    got = back(R.stretch(t, "v", 0.02, 0.98), "v")
    lo, hi = np.percentile(img[img > 0], [2, 98])
    c = np.clip(img, lo, hi)
    assert (lo, hi) == (pytest.approx(1.04), pytest.approx(9.68))
    assert np.allclose(got, (c - c.min()) / (c.max() - c.min()))
    flat = tile(spark, np.full((2, 2), 3.0), "v", "double")
    assert (back(R.stretch(flat, "v", 0.02, 0.98), "v") == 0).all()


def test_nodata(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([-9999.0, 2.0],), ([1.0, float("nan")],), ([-9999.05, 0.0],)], "b array<double>")
    assert [r[0] for r in df.select(P.nodata_mask(F.col("b"))).collect()] == [False, True, True, True]
    assert df.select(P.fill_nodata(F.col("b"))).collect()[1][0] == [0.0, 2.0]


def test_scorer_gets_batches(spark):
    t = tile(spark, IMG[:8, :8], "v", "double")
    chips = M.cut_chips(M.chip_grid(t, 4, 2), ["v"], 4)
    sizes = K.score_chips(chips, ["chip_v"], lambda x: np.full_like(x["chip_v"], len(x["chip_v"])), batch=2)
    assert sizes.agg(F.max(F.get("score", F.lit(0)))).first()[0] <= 2


def test_best_pairs_falls_back(spark):
    q = spark.createDataFrame([("e", i, 50.0, 50.0, 0.0, float(i), float(i)) for i in range(20)],
                              "event string, tile int, b_cloud double, d_cloud double, b_water double, d_water double, water_incr double")
    got = R.best_pairs(q).collect()
    assert len(got) == 10 and {r["choice"] for r in got} == {"fallback"} and min(r["tile"] for r in got) == 10


def test_nan_is_not_a_large_number(spark):
    """Spark orders NaN above every number; the rules must not."""
    nan = float("nan")
    df = spark.createDataFrame([(nan, 1.0), (120.0, 80.0)], "x double, y double")
    x, y = F.col("x"), F.col("y")
    a, b = df.select(P.burn_severity(x).alias("s"), P.db_scale(x).alias("db"), P.nbr(x, y).alias("nbr"),
                     P.binarise(x, "positive").alias("pos"), P.ndwi(x, y, "null").alias("w"),
                     P.radar_change(x, x, y, y)["vv"].alias("vv")).collect()
    assert a["s"] == 0 and a["db"] == 0.0 and np.isnan(a["nbr"]) and not a["pos"] and a["w"] == 0.0 and not a["vv"]
    assert b["s"] == 4 and b["pos"] and b["vv"]


def test_training_rows_are_dealt_by_what_trees_keep(spark):
    """Rows of short texts came in as few tasks as the files had, however many they were."""
    df = spark.range(1000).coalesce(1)
    assert max(r["n"] for r in K._spread(df, 4096, 100 * 4 * 4096).groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()) <= 150
    assert K._spread(df, 4096) is df
