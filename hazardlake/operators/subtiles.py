"""Tiles of any size as sub-tiles: neighbourhoods by halo exchange, patches by border joins.

A sub-tile is a row: keys of the tile, ``sy`` and ``sx`` (its place in the grid), ``r0`` and ``c0``
(its first row and column in the tile), ``height`` and ``width``, and row-major arrays. A tile never
needs to be one row: readers can make sub-tiles directly.

Neighbourhood operators see a sub-tile widened by a halo, which eight strips from its neighbours
fill; only the strips travel. Patches are labelled inside each sub-tile in one pass, and only
labels that meet across a border are joined.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlake.functions.let import let_sql
from hazardlake.session import cut_lineage

TILE = ["event", "tile"]
SIDE = 512
PLACE = ["sy", "sx", "r0", "c0", "height", "width"]


def split_tiles(tiles: DataFrame, bands: list[str], size: int = SIDE, keys: list[str] | None = None) -> DataFrame:
    """Sub-tiles of ``size`` pixels a side; the last of a row or column takes the rest, up to
    twice the size less one, so that none is thinner than ``size`` unless the tile is.

    The sub-tiles are made in the tile row, which is not copied to them.
    """
    keys = TILE if keys is None else keys
    many = lambda n: F.greatest(F.floor(F.col(n) / size), F.lit(1)).cast("int")
    grid = F.flatten(F.transform(F.sequence(F.lit(0), many("height") - 1), lambda y: F.transform(
        F.sequence(F.lit(0), many("width") - 1), lambda x: F.struct(
            y.alias("sy"), x.alias("sx"), (y * size).alias("r0"), (x * size).alias("c0"),
            F.when(y == many("height") - 1, F.col("height") - y * size).otherwise(size).alias("height"),
            F.when(x == many("width") - 1, F.col("width") - x * size).otherwise(size).alias("width")))))
    fields = ", ".join([*(f"'{c}', s.{c}" for c in PLACE), *(f"'{b}', flatten(transform(sequence(0, s.height - 1), "
                                                              f"i -> slice({b}, (s.r0 + i) * width + s.c0 + 1, s.width)))" for b in bands)])
    some = tiles.filter((F.col("height") > 0) & (F.col("width") > 0)).withColumn("__g", grid)
    return some.select(*keys, F.explode(F.expr(f"transform(__g, s -> named_struct({fields}))")).alias("s")).select(*keys, "s.*")


def join_subtiles(subtiles: DataFrame, bands: list[str], keys: list[str] | None = None) -> DataFrame:
    """Whole tiles again, for tiles that fit into a row."""
    keys = TILE if keys is None else keys
    line = F.explode(F.sequence(F.lit(0), F.col("height") - 1))
    out = subtiles.withColumn("i", line)
    rows = [F.slice(b, F.col("i") * F.col("width") + 1, F.col("width")).alias(b) for b in bands]
    rows = out.select(*keys, (F.col("r0") + F.col("i")).alias("row"), "c0", "width", *rows)
    got = rows.groupBy(*keys).agg(
        (F.max("row") + 1).alias("height"), F.max(F.col("c0") + F.col("width")).alias("width"),
        F.array_sort(F.collect_list(F.struct("row", "c0", *bands))).alias("x"))
    return got.select(*keys, "height", "width", *[F.flatten(F.col(f"x.{b}")).alias(b) for b in bands])


def with_halo(subtiles: DataFrame, bands: list[str], halo: int, keys: list[str] | None = None) -> DataFrame:
    """Sub-tiles widened by ``halo`` pixels where they have neighbours, with ``top`` and ``left``
    (what was added in front), ``inner_h`` and ``inner_w``.

    Every sub-tile sends each neighbour the strip next to it; at most nine pieces meet. No
    sub-tile with a neighbour may be thinner than the halo.
    """
    keys = TILE if keys is None else keys

    # The neighbour above needs the first rows, the one below the last, those beside it all.
    rn, cn = f"if(d.y = 0, height, {halo})", f"if(d.x = 0, width, {halo})"
    rf, cf = f"if(d.y = 1, height - {halo}, 0)", f"if(d.x = 1, width - {halo}, 0)"
    piece = [f"flatten(transform(sequence(0, {rn} - 1), i -> slice({b}, ({rf} + i) * width + {cf} + 1, {cn}))) as {b}" for b in bands]
    ways = F.explode(F.expr("array(" + ", ".join(f"named_struct('y', {y}, 'x', {x})" for y in (-1, 0, 1) for x in (-1, 0, 1)) + ")"))
    sent = subtiles.select(*keys, *PLACE, *bands, ways.alias("d"))
    sent = sent.filter(f"(d.y = 0 or height >= {halo}) and (d.x = 0 or width >= {halo})")  # a thin one has no neighbour there
    core = "if(d.y = 0 and d.x = 0, named_struct('r0', r0, 'c0', c0, 'height', height, 'width', width), null) as place"
    sent = sent.selectExpr(*keys, "sy + d.y as sy", "sx + d.x as sx", core, "-d.y as dy", "-d.x as dx", f"{rn} as ph", f"{cn} as pw", *piece)
    met = sent.groupBy(*keys, "sy", "sx").agg(
        F.max("place").alias("place"), F.map_from_entries(F.collect_list(F.struct(
            (F.col("dy") * 3 + F.col("dx")).alias("k"), F.struct("ph", "pw", *bands).alias("v")))).alias("m"))
    met = met.filter("place is not null").select(*keys, "sy", "sx", "place.*", "m")
    met = met.withColumns({"top": F.when(F.expr("m[-3] is not null"), halo).otherwise(0), "left": F.when(F.expr("m[-1] is not null"), halo).otherwise(0)})
    pad_h = f"height + top + if(m[3] is not null, {halo}, 0)"
    pad_w = f"width + left + if(m[1] is not null, {halo}, 0)"

    def band(b: str) -> str:
        part = lambda k, i: f"coalesce(slice(m[{k}].{b}, {i} * m[{k}].pw + 1, m[{k}].pw), array())"
        rows = [f"if(m[{3 * y}] is null, array(), flatten(transform(sequence(0, m[{3 * y}].ph - 1), i -> concat("
                + ", ".join(part(3 * y + x, "i") for x in (-1, 0, 1)) + "))))" for y in (-1, 0, 1)]
        return f"concat({', '.join(rows)}) as {b}"

    return met.selectExpr(*keys, "sy", "sx", "r0", "c0", "top", "left", "height as inner_h", "width as inner_w",
                          f"cast({pad_h} as int) as height", f"cast({pad_w} as int) as width", *[band(b) for b in bands])


def without_halo(wide: DataFrame, bands: list[str], keys: list[str] | None = None) -> DataFrame:
    """The inner part of ``with_halo`` again."""
    keys = TILE if keys is None else keys
    cut = [F.expr(let_sql(b, "m", "flatten(transform(sequence(0, inner_h - 1), i -> slice(m, (top + i) * width + left + 1, inner_w)))")).alias(b) for b in bands]
    return wide.select(*keys, "sy", "sx", "r0", "c0", F.col("inner_h").alias("height"), F.col("inner_w").alias("width"), *cut)


def near(subtiles: DataFrame, band: str, halo: int, operator: Callable[[DataFrame], DataFrame], keys: list[str] | None = None) -> DataFrame:
    """A neighbourhood operator of tile rows, applied to sub-tiles.

    ``halo`` must reach as far as the operator and all its steps look: the radius of a square
    times its rounds, summed over the steps, or the radius of the Gaussian kernel. The result
    is that of the whole tile.
    """
    wide = operator(with_halo(subtiles, [band], halo, keys))
    return without_halo(wide, [band], keys)


# --- patches ------------------------------------------------------------------------------------

def _runs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of the horizontal runs of positives, in order."""
    wide = np.zeros((m.shape[0], m.shape[1] + 2), np.int8)
    wide[:, 1:-1] = m
    step = np.diff(wide, axis=1)
    row, c0 = np.nonzero(step == 1)
    return row, c0, np.nonzero(step == -1)[1] - 1


def label_runs(m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of a mask and, for each, the first run of its 4-connected patch.

    Every run meets the runs of the next row that start or end over it; the smaller number
    wins, and numbers are followed to their end, until nothing changes.
    """
    row, c0, c1 = _runs(m)
    n, width = len(row), m.shape[1] + 1
    first = np.searchsorted(row * width + c1, (row + 1) * width + c0)  # first run below that does not end before
    last = np.searchsorted(row * width + c0, (row + 1) * width + c1, "right")
    size = np.maximum(last - first, 0)
    u = np.repeat(np.arange(n), size)
    v = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)
    label = np.arange(n)
    while len(u):
        a, b = label[u], label[v]
        low, apart = np.minimum(a, b), a != b
        if not apart.any():
            break
        np.minimum.at(label, a[apart], low[apart])
        np.minimum.at(label, b[apart], low[apart])
        while not np.array_equal(label, label[label]):
            label = label[label]
    return row, c0, c1, label


def _patches(mask: str, n_keys: int):
    """Rows of patches (kind 0) and of border pixels (kind 1: left and right, 2: up and down)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, names = batch.columns[:n_keys], batch.schema.names[:n_keys]
            rows = batch.select(["r0", "c0", "height", "width", "full", "all"]).to_pylist()
            for i, place in enumerate(rows):
                m = batch.column(mask)[i].values
                if not place["height"] or not place["width"] or m is None:
                    continue
                m = (m.fill_null(0).to_numpy(zero_copy_only=False) == 1).reshape(place["height"], place["width"])
                row, c0, c1, label = label_runs(m)
                if not len(row):
                    continue
                node = (row + place["r0"]).astype(np.int64) * place["full"] + c0 + place["c0"]
                own = node[label]
                patch, at = np.unique(own, return_inverse=True)
                n, y = c1 - c0 + 1, row + place["r0"]
                low = lambda x: np.minimum.reduceat(x[order], head)
                order = np.argsort(at, kind="stable")
                head = np.searchsorted(at[order], np.arange(len(patch)))
                zero = np.zeros(len(patch), np.int64)
                cols = [zero, zero, zero, patch, np.bincount(at, n).astype(np.int64), low(y), -low(-y), low(c0 + place["c0"]), -low(-(c1 + place["c0"])),
                        np.bincount(at, n * y), np.bincount(at, n * (c0 + c1 + 2 * place["c0"]) / 2)]
                out = [np.asarray(c) for c in cols]
                border = []
                if place["full"] > place["width"] or place["all"] > place["height"]:
                    end_r, end_c = place["r0"] + place["height"], place["c0"] + place["width"]
                    for kind, line, hit in ((1, place["c0"], c0 == 0), (1, end_c, c1 == place["width"] - 1)):
                        if 0 < line < place["full"]:
                            border.append((kind, line, y[hit], own[hit]))
                    for line, edge in ((place["r0"], 0), (end_r, place["height"] - 1)):
                        if 0 < line < place["all"]:
                            k = np.flatnonzero(row == edge)
                            size = n[k]
                            pos = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(c0[k], size) + place["c0"]
                            border.append((2, line, pos, np.repeat(own[k], size)))
                for kind, line, pos, lab in border:
                    blank = np.zeros(len(pos), np.int64)
                    more = [blank + kind, blank + line, pos, lab, *[blank] * 7]
                    out = [np.concatenate([a, b]) for a, b in zip(out, more)]
                where = pa.array(np.full(len(out[0]), i))
                yield pa.RecordBatch.from_arrays(
                    [*(c.take(where) for c in keys), *(pa.array(c.astype(np.int64)) for c in out[:9]), *(pa.array(c.astype(np.float64)) for c in out[9:])],
                    [*names, "kind", "line", "pos", "label", "pixels", "row0", "row1", "col0", "col1", "sum_row", "sum_col"])

    return run


def stars(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, u, v): every node with the smallest node it is linked with, from edges u > v.

    Large-star and small-star rounds, each a minimum per node and a join, so no neighbourhood
    is gathered; they end by themselves after a number that grows with the logarithm of the
    size of a component. Lineage is cut in every round.
    """
    edges = cut_lineage(edges, "edges")
    state = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = (both.filter("v > u").join(low, [*keys, "u"])
                 .select(*keys, F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct())
        low = large.groupBy(*keys, "u").agg(F.min("v").alias("m"))
        small = large.join(low, [*keys, "u"]).filter("v > m").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut_lineage(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "edges")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v", *keys).cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges


def patches(subtiles: DataFrame, mask: str, keys: list[str] | None = None) -> DataFrame:
    """4-connected patches of tiles given as sub-tiles: ``component`` (its first pixel, counted
    by rows in the tile), pixels, bounding box and centroid.

    One pass labels each sub-tile; pixels on inner borders say which labels meet, and only
    these take part in the rounds of ``stars``. A tile that is one sub-tile has none.
    """
    keys = TILE if keys is None else keys
    size = subtiles.groupBy(*keys).agg(F.max(F.col("c0") + F.col("width")).alias("full"), F.max(F.col("r0") + F.col("height")).alias("all"))
    rows = subtiles.select(*keys, "r0", "c0", "height", "width", mask).join(size, keys)
    types = dict(subtiles.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "kind long, line long, pos long, label long, pixels long, row0 long, row1 long, col0 long, col1 long",
                        "sum_row double, sum_col double"])
    found = cut_lineage(rows.mapInArrow(_patches(mask, len(keys)), schema), "patches")
    # Two labels at most meet at a border pixel.
    met = found.filter("kind > 0").groupBy(*keys, "kind", "line", "pos").agg(F.min("label").alias("v"), F.max("label").alias("u"), F.count(F.lit(1)).alias("n"))
    links = stars(met.filter("n = 2 and u > v").select(*keys, "u", "v").distinct(), keys).withColumnsRenamed({"u": "label", "v": "__to"})
    own = found.filter("kind = 0").join(links, [*keys, "label"], "left").withColumn("component", F.coalesce("__to", "label"))
    whole = own.groupBy(*keys, "component").agg(
        F.sum("pixels").alias("pixels"), F.min("row0").alias("row0"), F.max("row1").alias("row1"), F.min("col0").alias("col0"), F.max("col1").alias("col1"),
        (F.sum("sum_row") / F.sum("pixels")).alias("center_row"), (F.sum("sum_col") / F.sum("pixels")).alias("center_col"))
    as_int = lambda c: F.col(c).cast("int").alias(c)
    return whole.select(*keys, "component", "pixels", *map(as_int, ("row0", "row1", "col0", "col1")), "center_row", "center_col")


def chips(tiles: DataFrame, bands: list[str], size: int, stride: int, cover: str = "all", keep: list[str] | None = None) -> DataFrame:
    """(keep, height, width, y0, x0, chip_<band>): all chips of each tile, padding mirrored.

    The chips are made as one list in the tile row and unnested once, so the arrays of the tile
    are not copied to its chips. Layout as in ``morphology.chip_grid``.
    """
    from hazardlake.operators.morphology import padded_sql, reflect

    keep = TILE if keep is None else keep
    y, x = reflect(f"s.y + cast(i div {size} as int)", "height"), reflect(f"s.x + i % {size}", "width")
    cut = ", ".join(f"'chip_{b}', transform(sequence(0, {size * size - 1}), i -> get(m_{b}, cast({y} * width + {x} as int)))" for b in bands)
    out = tiles.withColumns({"__h": F.expr(padded_sql("height", size, stride, cover)), "__w": F.expr(padded_sql("width", size, stride, cover))})
    out = out.filter((F.col("__h") >= size) & (F.col("__w") >= size))
    starts = (f"flatten(transform(sequence(0, __h - {size}, {stride}), y -> transform(sequence(0, __w - {size}, {stride}), x -> named_struct('y', y, 'x', x))))")
    body = f"transform({starts}, s -> named_struct('y0', s.y, 'x0', s.x, {cut}))"
    for b in bands:
        body = let_sql(b, f"m_{b}", body)
    return out.select(*keep, "height", "width", F.explode(F.expr(body)).alias("__c")).select(*keep, "height", "width", "__c.*")
