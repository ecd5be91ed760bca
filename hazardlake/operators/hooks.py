"""Places where a caller's model goes in, with rule-based defaults that need none."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hazardlake.functions import lexicons as L
from hazardlake.functions import seriousness as Z
from hazardlake.functions import spectral as P
from hazardlake.functions import text as X

Scorer = Callable[[dict[str, np.ndarray]], np.ndarray]


def score_chips(chips: DataFrame, bands: list[str], scorer: Scorer, out: str = "score", batch: int = 512) -> DataFrame:
    """Score chips with a user function on batches of band arrays.

    ``scorer`` gets {band: (n, pixels)} and returns (n, pixels). Chips reach it in Arrow
    batches, cut to at most ``batch`` chips, wherever the chip rows already are; the band
    arrays do not travel back.
    """
    kept = [f for f in chips.schema.fields if f.name not in bands]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, T.StructField(out, T.ArrayType(T.DoubleType()))])

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for at in range(0, len(pdf), batch):
                some = pdf.iloc[at:at + batch]
                stacked = {b: np.stack(some[b].to_numpy()).astype("float64") for b in bands}
                yield some[names].assign(**{out: list(np.asarray(scorer(stacked), dtype="float64"))})

    return chips.mapInPandas(score, schema)


def rule_score(chips: DataFrame, vv0: str, vh0: str, vv1: str, vh1: str, out: str = "score") -> DataFrame:
    """Default radar scorer: 1 where the drop rule holds in either polarisation, else 0."""
    zipped = F.arrays_zip(*[F.col(c).alias(n) for c, n in ((vv0, "a"), (vh0, "b"), (vv1, "c"), (vh1, "d"))])

    def hit(p: Column) -> Column:
        change = P.radar_change(p["a"], p["b"], p["c"], p["d"])
        return (change["vv"] | change["vh"]).cast("double")

    return chips.withColumn(out, F.transform(zipped, hit))


Classifier = Callable[[pd.Series], pd.DataFrame]


def with_verdict(df: DataFrame, text: str, classify: Classifier | None = None, **lexicons) -> DataFrame:
    """Verdict struct per row: the caller's vectorised classifier, else the seriousness score.

    A classifier maps a series of texts to a frame with is_serious and confidence.
    """
    if classify is None:
        return Z.score_texts(df, [text], **lexicons)
    run = F.pandas_udf(classify, "is_serious boolean, confidence double")
    return df.withColumn("verdict", run(F.col(text)))


def with_extraction(df: DataFrame, text: str, keywords: list[str] = L.HAZARD_TAGS, places: list[str] = L.PLACES,
                    stop: list[str] = L.COMMON_WORDS, extract=None, schema: str | None = None) -> DataFrame:
    """Extracted information per row: the caller's function, else lexicon tags and places."""
    if extract is not None:
        return df.withColumn("extracted", F.pandas_udf(extract, schema)(F.col(text)))
    none = F.array().cast("array<string>")
    return df.withColumn("extracted", X.comprehensive_tags(F.col(text), F.lit(""), none, keywords, places, stop))


def training_pixels(images: DataFrame, pairs: DataFrame, bands: list[str], label: str) -> DataFrame:
    """Features of one day and label of the next, per pixel.

    Images are rows (fire, day, band arrays); they meet as images, and pixels are made only
    afterwards. Features are standardised per image; NaN in the label band means no fire.
    """
    from hazardlake.operators.rasters import explode_pixels, zscore_tile

    feats = images.select("fire", "day", "width", *[F.transform(b, lambda x: F.nanvl(x.cast("double"), F.lit(0.0))).alias(b) for b in bands])
    for b in bands:
        feats = zscore_tile(feats, b)
    nxt = images.select("fire", F.col("day").alias("next_day"),
                        F.transform(label, lambda x: P.binarise(x, "valid").cast("int")).alias("label"))
    joined = feats.join(pairs, ["fire", "day"]).join(nxt, ["fire", "next_day"])
    return explode_pixels(joined, [*bands, "label"], ["fire", "day", "next_day"])


def pca3(df: DataFrame, vec: str, key: str) -> DataFrame:
    """First three principal components of a vector column, each scaled to [0, 1]."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(key, array_to_vector(F.col(vec)).alias("x"))
    model = PCA(k=3, inputCol="x", outputCol="p").fit(rows)
    parts = model.transform(rows).select(key, vector_to_array("p").alias("p"))
    parts = parts.select(key, *[F.col("p")[i].alias(f"c{i}") for i in range(3)])
    lims = parts.agg(F.struct(*[f(f"c{i}").alias(f"{n}{i}") for i in range(3) for f, n in ((F.min, "lo"), (F.max, "hi"))]))
    out = parts.withColumn("lim", lims.scalar())

    def scale(i: int) -> Column:
        lo, hi = F.col(f"lim.lo{i}"), F.col(f"lim.hi{i}")
        return F.when(hi - lo > 1e-8, (F.col(f"c{i}") - lo) / (hi - lo)).otherwise(F.col(f"c{i}"))

    return out.select(key, *[scale(i).alias(f"c{i}") for i in range(3)])


def _spread(df: DataFrame, features: int, per_task: int = 128 << 20) -> DataFrame:
    """Rows dealt so that no task holds more than ``per_task`` bytes of four a feature and row.

    That is what trees keep of a row, however short its text, and every pass reads it again. Rows
    that one task may hold stay where they are.
    """
    rows, most = df.count(), max(1, per_task // (4 * features))
    if rows <= most:
        return df
    return df.repartition(max(-(-rows // most), df.sparkSession.sparkContext.defaultParallelism))


def fit_text_classifier(df: DataFrame, text: str, label: str, kind: str, features: int = 1 << 12):
    """TF-IDF pipeline with a forest, boosted trees or a linear SVM; returns the fitted model.

    ``features`` is the number of hash buckets of the vocabulary. Trees keep statistics for
    each, so the default suits them; pass 1 << 18 or more for a linear machine on a large
    vocabulary. All rows are used; for trees, the number of tasks grows with them.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LinearSVC, RandomForestClassifier
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer

    last = {
        "forest": lambda: RandomForestClassifier(labelCol=label, featuresCol="tfidf", numTrees=10, maxDepth=4, seed=42),
        "boosting": lambda: GBTClassifier(labelCol=label, featuresCol="tfidf", maxIter=5, maxDepth=3, seed=42),
        "svm": lambda: LinearSVC(labelCol=label, featuresCol="tfidf", maxIter=10, regParam=0.01),
    }[kind]()
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="words", pattern=r"(?U)\W+"),
        HashingTF(inputCol="words", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="tfidf"), last]).fit(df if kind == "svm" else _spread(df, features))
