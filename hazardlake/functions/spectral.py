"""Pixel arithmetic: indices, classes, scales, areas and rules. Plain column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardlake.functions import lexicons as L


def clip(x: Column, lo: float, hi: float) -> Column:
    """Clip to a range; NaN stays NaN (Spark orders it above every number)."""
    return F.when(F.isnan(x), x).otherwise(F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def above(x: Column, limit) -> Column:
    """x > limit, false for NaN."""
    return (x > limit) & ~F.isnan(x)


def area(n: Column, res_m: float, unit: str = "km2") -> Column:
    """Area of ``n`` pixels in km2, m2 or ha."""
    m2 = n * F.lit(float(res_m) ** 2)
    return {"m2": m2, "km2": m2 / F.lit(1e6), "ha": m2 / F.lit(1e4)}[unit]


def pct_increase(new: Column, before: Column, on_zero: str) -> Column:
    """100 * new / before; a zero before gives infinity, 0 or a division by 1."""
    pct = F.try_divide(new * F.lit(100.0), before)
    if on_zero == "inf":
        return F.when(before > 0, pct).otherwise(F.lit(float("inf")))
    if on_zero == "zero":
        return F.when(before > 0, pct).otherwise(F.lit(0.0))
    if on_zero == "one":
        return new * F.lit(100.0) / F.greatest(before, F.lit(1))
    raise ValueError(on_zero)


def db_scale(db: Column) -> Column:
    """dB to 0..255; not-a-number becomes 0 before the clip."""
    return clip(F.nanvl(db * 2.0 + 135.0, F.lit(0.0)), 0.0, 255.0)


def linear_scale(x: Column) -> Column:
    """Linear backscatter to 0..255; values without a logarithm become 0."""
    return clip(F.when(above(x, 0), F.log10(x) * 10.0 * 2.0 + 135.0).otherwise(F.lit(0.0)), 0.0, 255.0)


def ndwi(green: Column, nir: Column, zero: str) -> Column:
    """Water index; a zero sum becomes 1e-10, is shifted by 1e-6, or gives 0."""
    total, diff = green + nir, green - nir
    if zero == "tiny":
        return diff / F.when(total == 0, F.lit(1e-10)).otherwise(total)
    if zero == "shift":
        return F.try_divide(diff, total + 1e-6)
    if zero == "null":
        return F.when(above(total, 0), F.try_divide(diff, total + 1e-6)).otherwise(F.lit(0.0))
    raise ValueError(zero)


def nbr(nir: Column, swir2: Column) -> Column:
    return clip(ndwi(nir, swir2, "tiny"), -1.0, 1.0)


def dnbr(before: Column, after: Column) -> Column:
    return before - after


def burn_severity(d: Column) -> Column:
    """Seven classes, -2 (strong regrowth) to 4 (high severity)."""
    return (F.when(F.isnan(d), 0).when(d < -0.25, -2).when(d < -0.1, -1).when(d < 0.1, 0).when(d < 0.27, 1)
            .when(d < 0.44, 2).when(d < 0.66, 3).when(d >= 0.66, 4).otherwise(0))


def radar_change(vv_pre: Column, vh_pre: Column, vv_post: Column, vh_post: Column,
                 rule: dict = L.RADAR_RULE) -> Column:
    """Amplitude drop per polarisation; a weak signal in any image vetoes both."""
    def drop(pre: Column, post: Column, limit: float) -> Column:
        return (post < limit) & above(pre, limit) & above(pre - post, rule["delta"])

    weak = ((vv_post < rule["vv_min"]) | (vv_pre < rule["vv_min"])
            | (vh_post < rule["vh_min"]) | (vh_pre < rule["vh_min"]))
    return F.struct((drop(vv_pre, vv_post, rule["vv"]) & ~weak).alias("vv"),
                    (drop(vh_pre, vh_post, rule["vh"]) & ~weak).alias("vh"))


def veto_no_change(pred: Column, vv: Column, vh: Column) -> Column:
    return F.when(vv | vh, pred).otherwise(F.lit(0))


def is_nodata(x: Column, nodata: float = L.NODATA) -> Column:
    """Close to the nodata value (absolute 1e-8 plus relative 1e-5) or not a number."""
    return F.isnan(x) | (F.abs(x - nodata) <= 1e-8 + 1e-5 * abs(nodata))


def nodata_mask(bands: Column) -> Column:
    return F.exists(bands, lambda x: is_nodata(x))


def fill_nodata(bands: Column, value: float = 0.0) -> Column:
    return F.transform(bands, lambda x: F.when(is_nodata(x), F.lit(value)).otherwise(x))


def band_zscore(bands: Column, means: list[float] = L.BAND_MEANS, stds: list[float] = L.BAND_STDS) -> Column:
    """(x - mean) / (std + 1e-10) per band with fixed statistics."""
    scaled = F.zip_with(bands, F.array(*[F.lit(m) for m in means]), lambda x, m: x - m)
    return F.zip_with(scaled, F.array(*[F.lit(s + 1e-10) for s in stds]), lambda x, s: x / s)


def select_bands(bands: Column, index: list[int]) -> Column:
    """Bands by 1-based index, in the given order."""
    return F.transform(F.array(*[F.lit(i) for i in index]), lambda i: F.element_at(bands, i))


def reflectance(x: Column) -> Column:
    return x / F.lit(10000.0)


def display(x: Column) -> Column:
    return clip(x / F.lit(3000.0), 0.0, 1.0)


def binarise(x: Column, how: str) -> Column:
    """Label rules: ==1, >0, ==255, any number, or flood with permanent water {1, 2}."""
    return {"one": x == 1, "positive": above(x, 0), "max": x == 255, "valid": x.isNotNull() & ~F.isnan(x),
            "water": x.isin(1, 2)}[how]


def accuracy_class(pred: Column, truth: Column) -> Column:
    return (F.when(pred & truth, "TP").when(pred & ~truth, "FP").when(~pred & truth, "FN").otherwise("TN"))


def change_class(before: Column, during: Column) -> Column:
    return (F.when(before & during, "existing").when(~before & during, "new")
            .when(before & ~during, "receded").otherwise("none"))
