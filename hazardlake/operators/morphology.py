"""Neighbourhood operators on tile arrays.

A neighbourhood never leaves its tile, so these operators map a tile row to a tile row:
no pixel is shuffled and no key is grouped. Square windows are separable, so every pass
looks along one axis only; each pass binds the result of the one before, so it is computed once.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.functions.let import let_sql
from hazardlake.operators.scenes import draw
from hazardlake.operators.subtiles import patches, split_tiles
from hazardlake.session import cut_lineage

TILE = ["event", "tile"]
ALL = "sequence(0, height * width - 1)"


def _reach(radius: int) -> list[tuple[int, int]]:
    """(radius so far, step) of the passes that widen a window to ``radius``: it at most doubles."""
    have, passes = 1, []
    while have < radius:
        step = min(have, radius - have)
        passes.append((have, step))
        have += step
    return passes


def _axis_pass(m: str, axis: str, step: int, test: str, first: bool) -> str:
    """One pass along an axis: the extreme of the windows ``step`` before and behind a pixel.

    A window that would lie outside is the one at the edge, which is inside the wider window.
    The first pass looks at the pixel itself, too, and makes the mask 0 and 1.
    """
    at, n, unit = ("p % width", "width", "") if axis == "row" else ("cast(p div width as int)", "height", " * width")
    before, behind = f"p - least({step}, {at}){unit}", f"p + least({step}, {n} - 1 - {at}){unit}"
    if first:
        value = [f"if(get({m}, {i}) = 1, 1, 0)" for i in (before, "p", behind)]
    else:
        value = [f"get({m}, {i})" for i in (before, behind)]
    return f"transform({ALL}, p -> {test}({', '.join(value)}))"


def _edge(m: str, radius: int) -> str:
    """Nothing is left where the window of an erosion reaches outside."""
    inside = (f"p % width >= {radius} and p % width < width - {radius} and "
              f"p >= {radius} * width and p < (height - {radius}) * width")
    return f"transform({m}, (x, p) -> if({inside}, x, 0))"


def _chain(value: str, steps: list) -> str:
    """Apply steps, functions of a name to expression text, one after the other."""
    text = value
    for i, step in enumerate(steps):
        text = let_sql(text, f"m{i}", step(f"m{i}"))
    return text


def _box(tiles: DataFrame, mask: str, radius: int, test: str) -> DataFrame:
    """Square window: ``greatest`` dilates, ``least`` erodes. The passes grow with the logarithm
    of the radius, the work of a pass is two pixels a pixel."""
    if radius == 0:
        return tiles
    steps = []
    for axis in ("row", "col"):
        steps.append(lambda m, a=axis: _axis_pass(m, a, 1, test, True))
        steps += [lambda m, a=axis, s=step: _axis_pass(m, a, s, test, False) for _, step in _reach(radius)]
    if test == "least":
        steps.append(lambda m: _edge(m, radius))
    return tiles.withColumn(mask, F.expr(_chain(mask, steps)))


def dilate(tiles: DataFrame, mask: str, size: int = 3, iterations: int = 1) -> DataFrame:
    """Dilation by a size x size square; n rounds equal one with n times the radius."""
    return _box(tiles, mask, (size // 2) * iterations, "greatest")


def erode(tiles: DataFrame, mask: str, size: int = 3, iterations: int = 1) -> DataFrame:
    return _box(tiles, mask, (size // 2) * iterations, "least")


def opening(tiles: DataFrame, mask: str, size: int = 3) -> DataFrame:
    return dilate(erode(tiles, mask, size), mask, size)


def closing(tiles: DataFrame, mask: str, size: int, iterations: int = 1) -> DataFrame:
    return erode(dilate(tiles, mask, size, iterations), mask, size, iterations)


def buffer(tiles: DataFrame, mask: str, pixels: int = 4) -> DataFrame:
    """Grow positives by a number of pixels in every direction."""
    return _box(tiles, mask, pixels, "greatest")


def gaussian_kernel(sigma: float) -> list[tuple[int, float]]:
    radius = int(4 * sigma + 0.5)
    raw = {d: math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)}
    total = sum(raw.values())
    return [(d, w / total) for d, w in raw.items()]


def _mirror(j: str, n: str) -> str:
    """Index mirrored at the edges, the edge pixel repeated."""
    return f"least(pmod({j}, 2 * {n}), 2 * {n} - 1 - pmod({j}, 2 * {n}))"


def reflect(j: str, n: str) -> str:
    """Index mirrored at the edges, the edge pixel not repeated."""
    turn = f"greatest(2 * {n} - 2, 1)"  # a side of one pixel has index 0 only
    return f"least(pmod({j}, {turn}), 2 * {n} - 2 - pmod({j}, {turn}))"


def gaussian(tiles: DataFrame, band: str, sigma: float) -> DataFrame:
    """Gaussian smoothing with mirrored edges, rows then columns."""
    kernel = "array(" + ", ".join(f"named_struct('d', {d}, 'w', {w!r}D)" for d, w in gaussian_kernel(sigma)) + ")"
    row = f"(p - p % width) + {_mirror('p % width + k.d', 'width')}"
    col = f"{_mirror('cast(p div width as int) + k.d', 'height')} * width + p % width"
    steps = [lambda m, at=at: f"transform({ALL}, p -> aggregate({kernel}, 0.0D, (s, k) -> s + k.w * get({m}, {at})))"
             for at in (row, col)]
    return tiles.withColumn(band, F.expr(_chain(f"transform({band}, x -> cast(x as double))", steps)))


def otsu(tiles: DataFrame, band: str, valid: str | None = None, keys: list[str] | None = None,
         bins: int = 256) -> DataFrame:
    """Threshold with the largest between-class variance of a histogram, per tile.

    ``valid`` names a 0/1 array; only valid pixels count. Range and bins come from the tile
    row itself; what is grouped is the at most ``bins`` counts of each tile.
    """
    keys = TILE + ["phase"] if keys is None else keys
    ok = f"transform(arrays_zip({band}, {valid}), z -> if(z.{valid} = 1, z.{band}, null))" if valid else band
    vals = tiles.select(*keys, F.expr(f"filter({ok}, x -> x is not null and not isnan(x))").alias("vals"))
    vals = vals.filter(F.size("vals") > 0).select(*keys, "vals", F.array_min("vals").alias("lo"), F.array_max("vals").alias("hi"))
    binned = vals.select(*keys, "lo", "hi", F.explode("vals").alias("x"))
    index = F.when(F.col("hi") == F.col("lo"), 0).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins)))
    hist = binned.groupBy(*keys, "lo", "hi", index.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    center = F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins
    hist = hist.withColumn("center", center)
    upto = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    cum = hist.select(*keys, "lo", "hi", "bin", "center", F.sum("n").over(upto).alias("w1"),
                      F.sum(F.col("n") * F.col("center")).over(upto).alias("s1"),
                      F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("center")).over(whole).alias("s"))
    w2 = F.col("w") - F.col("w1")
    gap = F.col("s1") / F.col("w1") - F.try_divide(F.col("s") - F.col("s1"), w2)
    var = F.when(w2 > 0, F.col("w1") * w2 * gap * gap)
    best = cum.withColumn("var", var).groupBy(*keys).agg(
        F.max_by("center", F.when(F.col("var").isNotNull(), F.struct(F.col("var"), -F.col("bin")))).alias("t"),
        F.min("lo").alias("lo"))
    return best.select(*keys, F.coalesce("t", "lo").alias("threshold"))


def percentile_threshold(tiles: DataFrame, band: str, valid: str, pct: float = 0.3, keys: list[str] | None = None) -> DataFrame:
    """The fallback threshold: a percentile of the valid pixels."""
    keys = TILE + ["phase"] if keys is None else keys
    px = tiles.select(*keys, F.explode(F.arrays_zip(F.col(band).alias("x"), F.col(valid).alias("ok"))).alias("z"))
    return px.groupBy(*keys).agg(F.percentile(F.when(F.col("z.ok") == 1, F.col("z.x")), pct).alias("threshold"))


def water_optical(tiles: DataFrame, green: str, nir: str, limit: float = 0.0) -> DataFrame:
    """Optical water mask: smoothed NDWI above a limit, closed 5x5 twice, opened 3x3."""
    index = ("transform(arrays_zip({g}, {n}), z -> (cast(z.{g} as double) - z.{n}) / "
             "if(cast(z.{g} as double) + z.{n} = 0, 1e-10D, cast(z.{g} as double) + z.{n}))").format(g=green, n=nir)
    out = gaussian(tiles.withColumn("mask", F.expr(index)), "mask", 1.5)
    out = out.withColumn("mask", F.expr(f"transform(mask, x -> cast(x > {limit!r}D and not isnan(x) as int))"))
    return opening(closing(out, "mask", 5, 2), "mask", 3)


def water_radar(tiles: DataFrame, vv: str, vh: str, keys: list[str] | None = None) -> DataFrame:
    """Radar water mask: both smoothed bands below their threshold, closed 7x7 thrice, opened."""
    keys = TILE + ["phase"] if keys is None else keys
    valid = f"transform(arrays_zip({vv}, {vh}), z -> cast(z.{vv} > 0 and z.{vh} > 0 as int))"
    out = tiles.withColumn("valid", F.expr(valid))
    # read several times below: the thresholds of two bands and the mask
    out = cut_lineage(gaussian(gaussian(out, vv, 2.0), vh, 2.0))
    for band, limit in ((vv, "t_vv"), (vh, "t_vh")):
        # a tile whose histogram gives no threshold takes the 30 % percentile
        low = percentile_threshold(out, band, "valid", 0.3, keys).withColumnRenamed("threshold", "__low")
        out = (out.join(otsu(out, band, "valid", keys), keys, "left").join(low, keys, "left")
               .withColumn(limit, F.coalesce("threshold", "__low")).drop("threshold", "__low"))
    out = out.withColumn("mask", F.expr(
        f"transform(arrays_zip({vv}, {vh}), z -> cast(coalesce(z.{vv} < t_vv and z.{vh} < t_vh, false) as int))"))
    return opening(closing(out, "mask", 7, 3), "mask", 3).drop("valid", "t_vv", "t_vh")


# --- components ------------------------------------------------------------------

def components(tiles: DataFrame, mask: str, keys: list[str] | None = None) -> DataFrame:
    """4-connected patches of a mask: label (its first pixel), pixels, bounding box and centroid.

    Tiles are cut into sub-tiles, so a large one is not labelled in one piece.
    """
    keys = TILE if keys is None else keys
    return patches(split_tiles(tiles, [mask], keys=keys), mask, keys)


# --- chips -------------------------------------------------------------------------------------

def padded_sql(n: str, size: int, stride: int, cover: str) -> str:
    """Padded height or width; see ``chip_grid``."""
    if cover == "all":
        return f"if({n} > {size}, cast(ceil(({n} - {size}) / {stride}D) as int) * {stride} + {size}, {size})"
    if cover == "stride":
        return f"{n} + pmod(-{n}, {stride})"
    raise ValueError(cover)


def chip_grid(tiles: DataFrame, size: int, stride: int, cover: str = "all", keys: list[str] | None = None) -> DataFrame:
    """Chip starts per tile with the padded height and width; for chips with pixels see
    ``subtiles.chips``.

    cover='all' pads until chips reach the last pixel; cover='stride' pads to a multiple of
    the stride, which can leave the last rows without a chip.
    """
    out = tiles.withColumns({"pad_h": F.expr(padded_sql("height", size, stride, cover)), "pad_w": F.expr(padded_sql("width", size, stride, cover))})
    out = out.filter((F.col("pad_h") >= size) & (F.col("pad_w") >= size))
    starts = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - size, F.lit(stride)))
    return out.withColumn("y0", starts("pad_h")).withColumn("x0", starts("pad_w"))


def cut_chips(grid: DataFrame, bands: list[str], size: int) -> DataFrame:
    """Fill the chips of ``chip_grid``: one array per band, padding mirrored."""
    out = grid
    for b in bands:
        y = reflect(f"y0 + cast(i div {size} as int)", "height")
        x = reflect(f"x0 + i % {size}", "width")
        out = out.withColumn(f"chip_{b}", F.expr(let_sql(
            b, "m", f"transform(sequence(0, {size * size - 1}), i -> get(m, {y} * width + {x}))")))
    return out


def merge_chips(chips: DataFrame, score: str, size: int, keys: list[str] | None = None) -> DataFrame:
    """Mean score of all chips over a pixel, cropped to the tile; uncovered pixels are absent.

    Chips, not pixels, are brought together by tile, so the average needs no exchange.
    """
    keys = TILE if keys is None else keys
    px = chips.select(*keys, "height", "width", "y0", "x0", score).repartition(*keys).select(*keys, "height", "width", "y0", "x0", F.posexplode(score).alias("i", "s"))
    px = px.select(*keys, "height", "width",
                   (F.col("y0") + (F.col("i") / F.lit(size)).cast("int")).alias("row"),
                   (F.col("x0") + F.col("i") % size).alias("col"), "s").filter("row < height and col < width")
    return px.groupBy(*keys, "height", "width", "row", "col").agg(
        F.avg("s").alias("score"), F.count(F.lit(1)).alias("n_chips"))


def merged_tiles(merged: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Merged pixel scores back to one array per tile; pixels without a chip score 0.

    The pixels of a tile are still together after ``merge_chips``, so nothing is moved.
    """
    keys = TILE if keys is None else keys
    pos = F.col("row") * F.col("width") + F.col("col")
    got = merged.groupBy(*keys, "height", "width").agg(
        F.array_sort(F.collect_list(F.struct(pos.alias("pos"), F.col("score").alias("s")))).alias("x"))
    full = F.size("x") == F.col("height") * F.col("width")
    filled = F.expr(let_sql("map_from_entries(x)", "m", f"transform({ALL}, p -> coalesce(try_element_at(m, p), 0.0D))"))
    return got.select(*keys, "height", "width", F.when(full, F.transform("x", lambda e: e["s"])).otherwise(filled).alias("score"))


def merged_classes(chips: DataFrame, score: str, size: int, classes: int, keys: list[str] | None = None) -> DataFrame:
    """(keys, height, width, cls): the class with the largest mean score of each pixel of a tile.

    ``score`` holds the scores of class 0 for all pixels of a chip, then those of class 1, and
    so on. Chips are brought together by tile; scores of the same pixel and class are averaged,
    a pixel without a chip is class 0, the lower one of equal classes wins.
    """
    keys = TILE if keys is None else keys
    px = chips.select(*keys, "height", "width", "y0", "x0", score).repartition(*keys).select(*keys, "height", "width", "y0", "x0", F.posexplode(score).alias("i", "s"))
    px = px.withColumns({"cls": F.expr(f"cast(i div {size * size} as int)"), "at": F.expr(f"i % {size * size}")})
    px = px.select(*keys, "height", "width", "cls", (F.col("y0") + F.expr(f"cast(at div {size} as int)")).alias("row"),
                   (F.col("x0") + F.col("at") % size).alias("col"), "s").filter("row < height and col < width")
    mean = px.groupBy(*keys, "height", "width", "row", "col", "cls").agg(F.avg("s").alias("m"))
    best = mean.groupBy(*keys, "height", "width", "row", "col").agg(F.max_by("cls", F.struct("m", -F.col("cls"))).alias("score"))
    return merged_tiles(best, keys).withColumn("cls", F.transform("score", lambda c: c.cast("int"))).drop("score")


def decide(merged: DataFrame, threshold: float, nodata: Column | None = None) -> DataFrame:
    """Threshold a merged score; nodata pixels become 0."""
    hit = F.col("score") > threshold
    if nodata is not None:
        hit = hit & ~nodata
    return merged.withColumn("pred", hit.cast("int"))


def arg_max_class(scored: DataFrame, keys: list[str], cls: str = "cls", score: str = "score") -> DataFrame:
    """Class with the largest mean score per pixel; the lower class wins a tie."""
    per = scored.groupBy(*keys, cls).agg(F.avg(score).alias("m"))
    return per.groupBy(*keys).agg(F.max_by(cls, F.struct(F.col("m"), -F.col(cls))).alias("pred"))


def center_crop(tiles: DataFrame, band: str, size: int) -> DataFrame:
    """Middle size x size pixels, after mirrored padding where a tile is smaller."""
    out = pad_to(tiles, band, size)
    top, left = f"cast((height - {size}) div 2 as int)", f"cast((width - {size}) div 2 as int)"
    crop = (f"transform(sequence(0, {size * size - 1}), i -> get(m, "
            f"({top} + cast(i div {size} as int)) * width + {left} + i % {size}))")
    return out.withColumn(band, F.expr(let_sql(band, "m", crop))).withColumns({"height": F.lit(size), "width": F.lit(size)})


def pad_to(tiles: DataFrame, band: str, size: int) -> DataFrame:
    """Mirror the right and bottom edges until both sides have at least ``size`` pixels."""
    out = tiles.withColumns({"__h": F.greatest("height", F.lit(size)), "__w": F.greatest("width", F.lit(size))})
    y, x = reflect("cast(i div __w as int)", "height"), reflect("i % __w", "width")
    out = out.withColumn(band, F.expr(let_sql(
        band, "m", f"transform(sequence(0, __h * __w - 1), i -> get(m, cast({y} * width + {x} as int)))")))
    return out.drop("height", "width").withColumnsRenamed({"__h": "height", "__w": "width"})


def augment(tiles: DataFrame, bands: list[str], seed: int, keys: list[str] | None = None) -> DataFrame:
    """Seeded flips and quarter turns of square tiles, the same for all bands of a tile."""
    keys = TILE if keys is None else keys
    h = draw(keys, seed)
    out = tiles.withColumns({"flip_h": h % 2, "flip_v": F.shiftright(h, 8) % 2, "turns": F.shiftright(h, 16) % 4})
    r, c = "cast(p div width as int)", "(p % width)"
    # source pixel of a turn, then of the flips
    tr = f"case turns when 0 then {r} when 1 then {c} when 2 then height - 1 - {r} else height - 1 - {c} end"
    tc = f"case turns when 0 then {c} when 1 then width - 1 - {r} when 2 then width - 1 - {c} else {r} end"
    fr = f"if(flip_v = 1, height - 1 - ({tr}), {tr})"
    fc = f"if(flip_h = 1, width - 1 - ({tc}), {tc})"
    source = f"transform({ALL}, p -> cast(({fr}) * width + ({fc}) as int))"
    for b in bands:
        out = out.withColumn(b, F.expr(let_sql(b, "m", f"transform({source}, i -> get(m, i))")))
    return out


# --- map layers -----------------------------------------------------------------------------------

def layers(tiles: DataFrame, masks: dict[str, Column], colours: dict[str, str], keys: list[str] | None = None) -> DataFrame:
    """Tile masks of the given layers, opened 3x3, as pixels with layer name and colour."""
    keys = TILE if keys is None else keys
    items = [F.struct(F.lit(n).alias("layer"), F.lit(colours.get(n, "")).alias("color"), m.alias("mask"))
             for n, m in masks.items()]
    rows = tiles.select(*keys, "height", "width", F.explode(F.array(*items)).alias("x")).filter("x.mask is not null")
    rows = opening(rows.select(*keys, "height", "width", "x.*"), "mask", 3)
    px = rows.select(*keys, "layer", "color", "width", F.posexplode("mask").alias("pos", "m")).filter("m = 1")
    return px.select(*keys, "layer", "color", (F.col("pos") / F.col("width")).cast("int").alias("row"),
                     (F.col("pos") % F.col("width")).alias("col"))


def layer_masks(layer: str, pred: str, before: str | None = None, during: str | None = None, truth: str | None = None) -> dict[str, Column]:
    """Mask arrays of a named map layer; an absent optional mask is a null array."""
    def combine(rule: str, *names: str) -> Column:
        zipped = ", ".join(names)
        return F.expr(f"transform(arrays_zip({zipped}), z -> cast({rule} as int))")

    p, b, d, t = (f"coalesce(z.{n} = 1, false)" if n else "false" for n in (pred, before, during, truth))
    if layer in ("flood", "burn"):
        return {"flood" if layer == "flood" else "burn_scar": F.col(pred)}
    if layer == "existing":
        return {"existing_water": F.col(before)}
    if layer == "gt":
        return {"ground_truth": F.col(truth)}
    new = F.when(F.col(before).isNull(), F.col(pred)).otherwise(combine(f"{p} and not {b}", pred, before)) if before else None
    if layer == "new_flood":
        return {"new_flood": new}
    if layer == "change":
        wet = F.when(F.col(before).isNull(), F.lit(None)).when(
            F.col(during).isNull(), combine(f"{b} and {p}", before, pred)).otherwise(
            combine(f"{b} and ({d} or {p})", before, during, pred))
        return {"existing_water": wet, "new_flood": new}
    if layer == "accuracy":
        have = F.col(truth).isNotNull()
        return {"true_positive": F.when(have, combine(f"{p} and {t}", pred, truth)),
                "false_positive": F.when(have, combine(f"{p} and not {t}", pred, truth)),
                "false_negative": F.when(have, combine(f"not {p} and {t}", pred, truth)),
                "burn_scar": F.when(~have, F.col(pred))}
    raise ValueError(layer)
