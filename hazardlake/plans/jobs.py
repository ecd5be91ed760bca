"""Whole jobs: flood change, burn scars, fire over time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.functions import lexicons as L
from hazardlake.functions import spectral as P
from hazardlake.operators import evaluate as E
from hazardlake.operators import hooks as K
from hazardlake.operators import morphology as M
from hazardlake.operators import rasters as R
from hazardlake.operators import scenes as S
from hazardlake.operators import subtiles as U
from hazardlake.session import cut_lineage
from hazardlake.sources import catalogue as C

TILE = ["event", "tile"]


@dataclass
class FloodResult:
    masks: DataFrame
    scores: DataFrame
    changes: DataFrame
    events: DataFrame


def water_masks(tiles: DataFrame, optical: DataFrame | None = None) -> DataFrame:
    """(event, tile, phase, mask, source): water of every radar image, from the optical image of
    the same tile and phase (``green`` and ``nir``) where there is one."""
    keys = [*TILE, "phase"]
    radar = M.water_radar(tiles.select(*keys, "height", "width", "vv", "vh"), "vv", "vh").select(*keys, "mask")
    if optical is None:
        return radar.withColumn("source", F.lit("radar"))
    seen = optical.join(tiles.select(*keys), keys, "left_semi")
    return R.prefer_water(M.water_optical(seen, "green", "nir").select(*keys, "mask"), radar)


def flood_job(tiles: DataFrame, truth: DataFrame, chip: int, grow: int = 4, scorer: K.Scorer | None = None,
              optical: DataFrame | None = None) -> FloodResult:
    """Radar pairs to flood masks, scores and change areas.

    ``tiles`` has vv and vh in the 0-255 scale for both phases; ``truth`` has gt masks
    (0 none, 1 flood, 2 permanent water). Non-overlapping chips are scored by the rule or
    by ``scorer``, which never sees a chance where nothing dropped. Water before and during is
    that of ``water_masks``. Scores have the predicted and true areas of each tile.
    """
    pair = R.pair_phases(tiles, ["vv", "vh"])
    bands = ["before_vv", "before_vh", "during_vv", "during_vh"]
    chips = U.chips(pair, bands, chip, chip)
    names = [f"chip_{b}" for b in bands]
    ruled = K.rule_score(chips, *names, out="rule").select(*TILE, "height", "width", "y0", "x0", "rule", *names)
    if scorer is None:
        scored = ruled.withColumn("score", F.col("rule"))
    else:
        scored = K.score_chips(ruled, names, scorer)
        scored = scored.withColumn("score", F.zip_with("score", "rule", lambda s, k: F.when(k > 0, s).otherwise(0.0)))
    merged = M.merged_tiles(M.merge_chips(scored, "score", chip))
    pred = merged.withColumn("pred", F.transform("score", lambda s: (s > 0.5).cast("int"))).drop("score")
    masks = cut_lineage(M.buffer(pred, "pred", grow))

    both = R.attach(masks, truth.select(*TILE, "gt"))
    px = R.explode_pixels(both.filter("gt is not null"), ["pred", "gt"], TILE)
    scores = E.scores(E.confusion(px, F.col("pred") == 1, F.col("gt") == 1, TILE), "zero")
    scores = scores.withColumns({"n_pred": F.col("tp") + F.col("fp"), "n_gt": F.col("tp") + F.col("fn")})
    scores = scores.withColumns({"pred_km2": P.area(F.col("n_pred"), L.FLOOD_RES_M), "gt_km2": P.area(F.col("n_gt"), L.FLOOD_RES_M)})

    found = cut_lineage(water_masks(tiles, optical), "water")
    sides = [found.filter(F.col("phase") == p).select(*TILE, F.col("mask").alias(f"{p}_water")) for p in ("before", "during")]
    wet = R.attach(R.attach(masks.select(*TILE, "width", "pred"), sides[0]), sides[1])
    wet = R.explode_pixels(wet, ["before_water", "during_water", "pred"], TILE)
    changes = R.change_stats_or(wet, F.col("before_water") == 1, F.col("during_water") == 1, F.col("pred") == 1, L.FLOOD_RES_M)
    events = E.macro_avg(scores)
    return FloodResult(masks, scores, changes, events)


def write_metrics(scores: DataFrame, path: str) -> None:
    """Tile scores as CSV, in the columns that the metrics reader knows."""
    C.write_report_csv(scores.select(
        F.col("event").alias("event_id"), F.col("tile").cast("string").alias("tile_id"), *E.SCORES, *E.COUNTS,
        *[c for c in ("n_pred", "n_gt", "pred_km2", "gt_km2") if c in scores.columns]), path)


@dataclass
class FireResult:
    masks: DataFrame
    scores: DataFrame
    index: DataFrame | None


def fire_job(tiles: DataFrame, truth: DataFrame, chip: int, stride: int, means: list[float], stds: list[float],
             scorer: K.Scorer | None = None, classes: int = 2, catalogue: DataFrame | None = None) -> FireResult:
    """Scenes of several bands to cleaned burn masks, their scores and the event index.

    ``tiles`` has ``bands``: per pixel an array of band values, one for each of ``means``. Nodata
    is found before the values are standardised and blanked after the chips are merged. A
    ``scorer`` gets all bands of a chip as ``chip_z0``, ``chip_z1``, … and returns the scores of
    class 0 for all pixels, then those of class 1, and so on; scores of overlapping chips are
    averaged by class, and the class with the largest mean wins, the lower one of equals.
    Without a scorer class 1 scores the mean of the first half of the bands less that of the
    second, class 0 nothing. Classes above 0 are burnt. ``catalogue`` (event, tile, tile_id,
    source_split, mgrs, year, doy) gives the index of the tiles that have a mask.
    """
    names = [f"z{i}" for i in range(len(means))]
    t = tiles.withColumns({
        "nodata": F.transform("bands", lambda p: P.nodata_mask(p).cast("int")),
        "z": F.transform("bands", lambda p: P.band_zscore(P.fill_nodata(p), means, stds))})
    flat = t.withColumns({n: F.expr(f"transform(z, p -> p[{i}])") for i, n in enumerate(names)}).drop("z", "bands")
    chips = U.chips(flat, names, chip, stride)
    if scorer is None:
        half = len(names) // 2
        mean = lambda part: " + ".join(f"z.chip_{n}" for n in part)
        rule = (f"transform(arrays_zip({', '.join(f'chip_{n}' for n in names)}), z -> ({mean(names[:half])}) / {float(half)!r}D"
                f" - ({mean(names[half:])}) / {float(len(names) - half)!r}D)")
        scored = chips.withColumn("score", F.expr(f"concat(array_repeat(0.0D, {chip * chip}), {rule})"))
    else:
        scored = K.score_chips(chips, [f"chip_{n}" for n in names], scorer)
    merged = M.merged_classes(scored, "score", chip, classes).join(flat.select(*TILE, "nodata"), TILE)
    masks = merged.withColumn("pred", F.zip_with("cls", "nodata", lambda c, n: ((c > 0) & (n == 0)).cast("int")))
    masks = cut_lineage(M.closing(M.opening(masks.drop("cls", "nodata"), "pred", 3), "pred", 3))
    px = R.explode_pixels(masks.join(truth.select(*TILE, "gt"), TILE), ["pred", "gt"], TILE)
    scores = E.scores(E.confusion(px, F.col("pred") == 1, F.col("gt") == 1, TILE), "zero")
    index = None
    if catalogue is not None:
        index = masks.select(*TILE).join(catalogue, TILE).select("event", "tile_id", "source_split", "mgrs", "year", "doy")
    return FireResult(masks, scores, index)


PHASES = ("before", "during", "after")


def fire_temporal_job(scenes: DataFrame, images: DataFrame) -> DataFrame:
    """Before, during and after of each cell: burn severity, change areas and scores by phase.

    ``scenes`` feeds the triplet choice; ``images`` has nir, swir2, burn (the prediction) and gt
    arrays per scene. A phase without an image or a truth has no scores; ``summary`` folds the
    rows to the means over all cells.
    """
    trip = cut_lineage(S.fire_triplets(scenes).select(
        "cell", *[F.col(f"{p}.scene").alias(p) for p in PHASES], "burn_delta"), "triplets")
    img = images.select("scene", "width", "nir", "swir2", "burn", "gt")
    pair = (trip.join(img.drop("gt").withColumnsRenamed({"scene": "before", "nir": "n0", "swir2": "w0", "burn": "b0"}), "before")
            .join(img.drop("width", "gt").withColumnsRenamed({"scene": "during", "nir": "n1", "swir2": "w1", "burn": "b1"}), "during"))
    px = R.explode_pixels(pair, ["n0", "w0", "b0", "n1", "w1", "b1"], ["cell", "burn_delta"])
    d = P.dnbr(P.nbr(F.col("n0"), F.col("w0")), P.nbr(F.col("n1"), F.col("w1")))
    px = px.withColumns({"severity": P.burn_severity(d), "category": P.change_class(F.col("b0") == 1, F.col("b1") == 1)})
    change = px.groupBy("cell", "burn_delta").agg(
        F.count_if(F.col("category") == "new").alias("new_px"),
        F.count_if(F.col("category") == "existing").alias("existing_px"),
        F.count_if(F.col("category") == "receded").alias("recovered_px"),
        F.count_if(F.col("severity") >= 2).alias("moderate_or_worse"),
        P.area(F.count_if(F.col("category") == "new"), L.FIRE_RES_M).alias("new_km2"))

    # one row per cell and phase, so an image is joined once for its scores
    each = trip.select("cell", F.explode(F.array(*[F.struct(F.lit(p).alias("phase"), F.col(p).alias("scene")) for p in PHASES])).alias("x"))
    each = each.select("cell", "x.*").join(img.select("scene", "width", "burn", "gt"), "scene").filter("gt is not null")
    scored = E.scores(E.confusion(R.explode_pixels(each, ["burn", "gt"], ["cell", "phase"]), F.col("burn") == 1, F.col("gt") == 1, ["cell", "phase"]), "zero")
    scored = scored.withColumns({"pred_km2": P.area(F.col("tp") + F.col("fp"), L.FIRE_RES_M), "gt_km2": P.area(F.col("tp") + F.col("fn"), L.FIRE_RES_M)})
    wide = scored.groupBy("cell").agg(*[
        F.max(F.when(F.col("phase") == p, F.col(c))).alias(f"{p}_{c}") for p in PHASES for c in ("f1", "iou", "gt_km2", "pred_km2")])
    return change.join(wide, "cell", "left")


def summary(temporal: DataFrame) -> DataFrame:
    """Means over the cells of ``fire_temporal_job``: F1 by phase (after where positive) and deltas."""
    return S.phase_summary(temporal)
