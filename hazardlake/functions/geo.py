"""Projected tile bounds to geographic bounds, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

A = 6378137.0
FLAT = 1 / 298.257223563
E2 = FLAT * (2 - FLAT)
EP2 = E2 / (1 - E2)
E1 = (1 - math.sqrt(1 - E2)) / (1 + math.sqrt(1 - E2))
K0 = 0.9996
M1 = A * (1 - E2 / 4 - 3 * E2 ** 2 / 64 - 5 * E2 ** 3 / 256)
S2 = 3 * E1 / 2 - 27 * E1 ** 3 / 32
S4 = 21 * E1 ** 2 / 16 - 55 * E1 ** 4 / 32
S6 = 151 * E1 ** 3 / 96
S8 = 1097 * E1 ** 4 / 512


def utm_to_wgs84(df: DataFrame, easting: str, northing: str, zone: str, south: str) -> DataFrame:
    """Add ``lat`` and ``lng`` of UTM coordinates (series inverse of transverse Mercator).

    The steps are separate columns so that every intermediate value is computed once.
    """
    c = F.col
    df = df.withColumn("_mu", (c(northing) - F.when(c(south), 1e7).otherwise(0.0)) / (K0 * M1))
    df = df.withColumn("_phi", c("_mu") + F.sin(c("_mu") * 2) * S2 + F.sin(c("_mu") * 4) * S4
                       + F.sin(c("_mu") * 6) * S6 + F.sin(c("_mu") * 8) * S8)
    df = df.withColumns({"_sin": F.sin("_phi"), "_cos": F.cos("_phi"), "_tan": F.tan("_phi")})
    df = df.withColumns({"_q": F.lit(1.0) - c("_sin") * c("_sin") * E2, "_t": c("_tan") * c("_tan"),
                         "_c": c("_cos") * c("_cos") * EP2})
    df = df.withColumns({"_n": F.lit(A) / F.sqrt("_q"), "_r": F.lit(A * (1 - E2)) / (c("_q") * F.sqrt("_q"))})
    df = df.withColumn("_d", (c(easting) - 500000.0) / (c("_n") * K0))
    df = df.withColumn("_d2", c("_d") * c("_d"))
    t, k, d, d2 = c("_t"), c("_c"), c("_d"), c("_d2")
    lat = c("_phi") - c("_n") * c("_tan") / c("_r") * (
        d2 / 2 - (t * 3 + k * 10 - k * k * 4 + (5 - 9 * EP2)) * d2 * d2 / 24
        + (t * 90 + k * 298 + t * t * 45 - k * k * 3 + (61 - 252 * EP2)) * d2 * d2 * d2 / 720)
    lng = (d - (t * 2 + k + 1) * d * d2 / 6
           + (t * 28 - k * 2 - k * k * 3 + t * t * 24 + (5 + 8 * EP2)) * d * d2 * d2 / 120) / c("_cos")
    df = df.withColumns({"lat": F.degrees(lat), "lng": F.degrees(lng) + (c(zone) * 6 - 183)})
    return df.drop("_mu", "_phi", "_sin", "_cos", "_tan", "_q", "_t", "_c", "_n", "_r", "_d", "_d2")


def tile_bounds(tiles: DataFrame, keys: list[str], between: int = 21) -> DataFrame:
    """West, south, east, north and centre of tiles given projected bounds.

    Needs left, bottom, right, top, zone and south columns. Each edge is sampled at its
    ends and ``between`` inner points, since a projected edge bends. The points of a tile
    are folded in the task that made them, so one row per tile is shuffled.
    """
    steps = between + 1
    s = F.col("s") / F.lit(float(steps))
    width, height = F.col("right") - F.col("left"), F.col("top") - F.col("bottom")
    x = (F.when(F.col("side").isin(0, 1), F.col("left") + width * s)
         .when(F.col("side") == 2, F.col("left")).otherwise(F.col("right")))
    y = (F.when(F.col("side").isin(2, 3), F.col("bottom") + height * s)
         .when(F.col("side") == 0, F.col("bottom")).otherwise(F.col("top")))
    points = (tiles.withColumn("side", F.explode(F.array(*[F.lit(i) for i in range(4)])))
              .withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(steps))))
              .select(*keys, "zone", "south", x.alias("x"), y.alias("y")))
    geo = utm_to_wgs84(points, "x", "y", "zone", "south")
    box = geo.groupBy(*keys).agg(F.min("lng").alias("west"), F.min("lat").alias("south"),
                                 F.max("lng").alias("east"), F.max("lat").alias("north"))
    return box.withColumns({"center_lat": (F.col("south") + F.col("north")) / 2,
                            "center_lng": (F.col("west") + F.col("east")) / 2})
