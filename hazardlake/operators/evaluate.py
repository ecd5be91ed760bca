"""Accuracy of masks and models: counts, scores, averages, losses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COUNTS = ["tp", "fp", "fn", "tn"]


def confusion(px: DataFrame, pred: Column, truth: Column, keys: list[str]) -> DataFrame:
    """tp, fp, fn, tn per key; four conditional counts, combined before the shuffle."""
    return px.groupBy(*keys).agg(
        F.count_if(pred & truth).alias("tp"), F.count_if(pred & ~truth).alias("fp"),
        F.count_if(~pred & truth).alias("fn"), F.count_if(~pred & ~truth).alias("tn"))


def scores(cm: DataFrame, zero: str = "zero") -> DataFrame:
    """Accuracy, precision, recall, F1, IoU and Dice in one of the zero conventions.

    zero: 0 where the denominator is 0; one: the denominator is at least 1; eps: the
    denominator gets 1e-8 and F1 is built from precision and recall; running: at least 1,
    F1 from precision and recall with at least 1e-8.
    """
    tp, fp, fn, tn = (F.col(c).cast("double") for c in COUNTS)
    if zero == "zero":
        div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    elif zero in ("one", "running"):
        div = lambda a, b: a / F.greatest(b, F.lit(1.0))
    elif zero == "eps":
        div = lambda a, b: a / (b + 1e-8)
    else:
        raise ValueError(zero)
    out = cm.withColumns({
        "accuracy": div(tp + tn, tp + fp + fn + tn), "precision": div(tp, tp + fp),
        "recall": div(tp, tp + fn), "iou": div(tp, tp + fp + fn), "dice": div(tp * 2, tp * 2 + fp + fn)})
    p, r = F.col("precision"), F.col("recall")
    f1 = {"zero": F.col("dice"), "one": F.col("dice"), "eps": p * r * 2 / (p + r + 1e-8),
          "running": p * r * 2 / F.greatest(p + r, F.lit(1e-8))}[zero]
    return out.withColumn("f1", f1)


SCORES = ["accuracy", "precision", "recall", "f1", "iou"]


def macro_avg(tile_scores: DataFrame) -> DataFrame:
    """Mean of tile scores per event and over all tiles (event null)."""
    return tile_scores.rollup("event").agg(*[F.avg(s).alias(s) for s in SCORES],
                                           F.count(F.lit(1)).alias("n_tiles"))


def micro_avg(cm: DataFrame, keys: list[str], zero: str = "one") -> DataFrame:
    """Counts summed first, then scored."""
    return scores(cm.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS]), zero)


def compare_models(tiles: DataFrame, truth: str, a: str, b: str, keys: list[str]) -> DataFrame:
    """F1 of two masks against the truth per tile; a missing model scores 0.

    The three masks are arrays of the same tile row (left joined before), so pixels are
    compared position by position without a pixel join.
    """
    absent = F.array_repeat(F.lit(0), F.size(truth))
    px = tiles.select(*keys, F.explode(F.arrays_zip(
        F.col(truth).alias("t"), F.coalesce(a, absent).alias("a"), F.coalesce(b, absent).alias("b"))).alias("x"))
    hit = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    t, x, y = hit("x.t"), hit("x.a"), hit("x.b")

    def f1(p: Column) -> Column:
        tp2 = F.count_if(p & t) * 2.0
        return F.coalesce(F.try_divide(tp2, tp2 + F.count_if(p & ~t) + F.count_if(~p & t)), F.lit(0.0))

    return px.groupBy(*keys).agg(f1(x).alias("f1_a"), f1(y).alias("f1_b"))


def model_wins(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if(F.col("f1_a") > F.col("f1_b")).alias("a_better"),
                  F.count_if(F.col("f1_b") > F.col("f1_a")).alias("b_better"),
                  F.avg("f1_a").alias("avg_a"), F.avg("f1_b").alias("avg_b"))


def override_scores(calc: DataFrame, reported: DataFrame, keys: list[str],
                    names: tuple[str, ...] = ("f1", "iou", "precision", "recall", "accuracy")) -> DataFrame:
    """Reported score where it is a number, else the computed one."""
    side = reported.select(*keys, *[F.col(n).alias(f"__{n}") for n in names if n in reported.columns])
    out = calc.join(side, keys, "left")
    for n in names:
        if f"__{n}" in side.columns:
            out = out.withColumn(n, F.coalesce(F.col(f"__{n}").try_cast("double"), F.col(n))).drop(f"__{n}")
    return out


# --- losses on scored pixels -----------------------------------------------------------------

def soft_dice(px: DataFrame, score: str, truth: Column, image: list[str], smooth: float = 1.0) -> DataFrame:
    """1 - mean over images of the smoothed soft Dice."""
    t = truth.cast("double")
    per = px.groupBy(*image).agg(F.sum(F.col(score) * t).alias("i"), (F.sum(score) + F.sum(t)).alias("u"))
    return per.agg((F.lit(1.0) - F.avg((F.col("i") * 2.0 + smooth) / (F.col("u") + smooth))).alias("dice_loss"))


def _clamped(score: str, eps: float) -> Column:
    return F.greatest(F.lit(eps), F.least(F.lit(1.0 - eps), F.col(score)))


def bce(px: DataFrame, score: str, truth: Column, eps: float = 1e-7) -> DataFrame:
    """Mean binary cross entropy of probabilities clamped away from 0 and 1."""
    p, t = _clamped(score, eps), truth.cast("double")
    return px.agg(F.avg(-t * F.log(p) - (F.lit(1.0) - t) * F.log(F.lit(1.0) - p)).alias("bce"))


def bce_logits(px: DataFrame, logit: str, truth: Column) -> DataFrame:
    """Mean binary cross entropy of raw logits in the stable form."""
    x, t = F.col(logit), truth.cast("double")
    return px.agg(F.avg(F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))).alias("bce"))


def focal(px: DataFrame, score: str, truth: Column, alpha: float = 0.25, gamma: float = 2.0, eps: float = 1e-7) -> DataFrame:
    p, t = _clamped(score, eps), truth.cast("double")
    ce = -t * F.log(p) - (F.lit(1.0) - t) * F.log(F.lit(1.0) - p)
    pt = t * p + (F.lit(1.0) - t) * (F.lit(1.0) - p)
    return px.agg(F.avg(F.pow(F.lit(1.0) - pt, F.lit(gamma)) * ce * alpha).alias("focal"))
