"""Outlines of masks as polygons with holes, and GeoJSON documents of them.

The outline of a mask is a set of unit edges. Edges in line are joined to sides by windows, each
side points to the one that follows it, and pointer doubling orders the sides of every ring: a
side learns the smallest side within 1, 2, 4, … steps and how far it is, so the rounds grow with
the logarithm of the longest ring, and a ring that is known takes part in none. No task sees a tile; what is gathered at the end is one ring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlake.functions.geo import utm_to_wgs84
from hazardlake.functions.let import let_sql
from hazardlake.session import cut_lineage

TILE = ["event", "tile"]
EAST, SOUTH, WEST, NORTH = range(4)


def _unit_edges(tiles: DataFrame, mask: str, keys: list[str]) -> DataFrame:
    """(keys, dir, line, t): unit edges with the interior on the right-hand side of the way.

    ``line`` is the row of corners of an edge that runs east or west, the column of one that
    runs south or north; ``t`` counts along the way. The sides of a pixel are found in the tile
    row, so that the mask is not copied to its pixels.
    """
    def open_(cond: str, at: str) -> str:
        return f"({cond} or coalesce(get(m, {at}), 0) <> 1)"

    bits = (f"transform(sequence(0, height * width - 1), p -> if(coalesce(get(m, p), 0) <> 1, 0, "
            f"if({open_('p < width', 'p - width')}, 1, 0) + if({open_('p % width = width - 1', 'p + 1')}, 2, 0) + "
            f"if({open_('p >= (height - 1) * width', 'p + width')}, 4, 0) + if({open_('p % width = 0', 'p - 1')}, 8, 0)))")
    px = tiles.filter(F.size(mask) > 0).select(*keys, "width", F.posexplode(F.expr(let_sql(mask, "m", bits))).alias("pos", "bits")).filter("bits > 0")
    px = px.select(*keys, "bits", F.expr("cast(pos div width as int)").alias("r"), (F.col("pos") % F.col("width")).alias("c"))

    def side(bit: int, direction: int, line: str, t: str) -> str:
        return f"if(bits & {bit} > 0, named_struct('dir', {direction}, 'line', {line}, 't', {t}), null)"

    sides = ", ".join([side(1, EAST, "r", "c"), side(2, SOUTH, "c + 1", "r"), side(4, WEST, "r + 1", "-(c + 1)"), side(8, NORTH, "c", "-(r + 1)")])
    return px.select(*keys, F.expr(f"explode(filter(array({sides}), e -> e is not null))").alias("e")).select(*keys, "e.*")


def _corner(direction: Column, line: Column, t: Column) -> tuple[Column, Column]:
    """x and y of the corner at ``t`` along the way."""
    along = F.when(direction.isin(EAST, SOUTH), t).otherwise(-t)
    level = direction.isin(EAST, WEST)
    return F.when(level, along).otherwise(line), F.when(level, line).otherwise(along)


def boundary_edges(tiles: DataFrame, mask: str, keys: list[str] | None = None) -> DataFrame:
    """Unit edges between positives and the rest as corner points x0, y0, x1, y1."""
    keys = TILE if keys is None else keys
    e = _unit_edges(tiles, mask, keys)
    (x0, y0), (x1, y1) = (_corner(F.col("dir"), F.col("line"), F.col("t") + i) for i in (0, 1))
    return e.select(*keys, x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def _node(x: Column, y: Column, direction: Column | int) -> Column:
    """A side by its first corner and direction, in order of row, column and direction."""
    way = direction if isinstance(direction, Column) else F.lit(direction)
    return F.shiftleft(y.cast("long"), 33).bitwiseOR(F.shiftleft(x.cast("long"), 2)).bitwiseOR(way.cast("long"))


def _x(node: str) -> Column:
    return F.shiftright(F.col(node), 2).bitwiseAND(F.lit((1 << 31) - 1))


def _y(node: str) -> Column:
    return F.shiftright(F.col(node), 33)


def _sides(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Unit edges with ``node``, the side they belong to, and ``last``, where it ends.

    Edges that follow each other straight on are never at a corner where two pixels touch, so
    this decides no way.
    """
    way = Window.partitionBy(*keys, "dir", "line").orderBy("t")
    island = edges.withColumn("island", F.col("t") - F.row_number().over(way))
    whole = Window.partitionBy(*keys, "dir", "line", "island")
    island = island.withColumns({"t0": F.min("t").over(whole), "last": F.max("t").over(whole) + 1})
    return island.withColumn("node", _node(*_corner(F.col("dir"), F.col("line"), F.col("t0")), F.col("dir"))).drop("island", "t0")


def _links(sides: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, next): the side that follows. Where two pixels touch at a corner, the way
    turns right, so they stay apart."""
    one = sides.groupBy(*keys, "node").agg(F.first("dir").alias("dir"), F.first("line").alias("line"), F.first("last").alias("last"))
    x1, y1 = _corner(F.col("dir"), F.col("line"), F.col("last"))
    ends = one.select(*keys, x1.alias("x"), y1.alias("y"), F.struct("node", "dir").alias("into"), F.lit(None).cast("int").alias("out"))
    starts = one.select(*keys, _x("node").cast("int").alias("x"), _y("node").cast("int").alias("y"),
                        F.lit(None).cast(ends.schema["into"].dataType).alias("into"), F.col("dir").alias("out"))
    # At most two sides end and two start at a corner.
    met = ends.unionByName(starts).groupBy(*keys, "x", "y").agg(F.collect_set("out").alias("outs"), F.collect_list("into").alias("ins"))
    met = met.select(*keys, "x", "y", "outs", F.explode("ins").alias("i"))
    right, left = (F.col("i.dir") + 1) % 4, (F.col("i.dir") + 3) % 4
    go = F.when(F.array_contains("outs", right), right).otherwise(left)
    return met.select(*keys, F.col("i.node").alias("node"), _node(F.col("x"), F.col("y"), go).alias("next"))


def _met(state: DataFrame, keys: list[str], span: int) -> DataFrame:
    """A round: every side meets the side ``span`` further, and doubles what it has seen.

    Once the same smallest side is met twice, ``size`` sides apart, the ring is known. All sides
    of a ring have met it twice in the first round whose ``span`` is not below the size, some
    already in the round before; they are ``done`` together, so none misses one it points to.
    The joins are merges: a state that fits a broadcast would go through the driver every round.
    """
    far = state.select(*keys, F.col("node").alias("ptr"), F.col("ptr").alias("p2"), F.col("ring").alias("r2"), F.col("ahead").alias("a2"))
    nearer, again = F.col("r2") < F.col("ring"), F.col("r2") == F.col("ring")
    size = F.coalesce("size", F.when(again, F.lit(span) + F.col("a2") - F.col("ahead")))
    return state.join(far.hint("merge"), [*keys, "ptr"]).select(
        *keys, "node", "next", "then", F.col("p2").alias("ptr"), F.least("ring", "r2").alias("ring"),
        F.when(nearer, F.lit(span) + F.col("a2")).otherwise(F.col("ahead")).alias("ahead"), size.alias("size"),
        nearer.alias("moved"), (again & (F.col("size").isNotNull() | (size <= span))).alias("done"))


def _ranked(links: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, next, ring, ahead): the smallest side of the ring and the steps to it.

    After the first step only the sides that run north or south go on, each for itself and the one
    that follows, and rings that are known leave the rounds.
    """
    none = F.lit(None).cast("long")
    state = _met(links.select(*keys, "node", "next", none.alias("then"), F.col("next").alias("ptr"), F.col("node").alias("ring"),
                              F.lit(0).cast("long").alias("ahead"), none.alias("size")), keys, 1)
    state = cut_lineage(state.filter(F.col("node").bitwiseAND(F.lit(1)) == 1).withColumn("then", F.col("ptr")), "rings")
    span, known = 2, []
    while True:
        state = cut_lineage(_met(state, keys, span), "rings")
        span *= 2
        known.append(state.filter("done"))
        state = state.filter("not done")
        if state.filter("moved").isEmpty():
            break
    for more in known:
        state = state.unionByName(more)
    own = F.struct("node", "next", "ahead")
    following = F.struct(F.col("next").alias("node"), F.col("then").alias("next"),
                         (F.when(F.col("ahead") > 0, F.col("ahead")).otherwise(F.col("size")) - 1).alias("ahead"))
    return state.select(*keys, "ring", F.explode(F.array(own, following)).alias("s")).select(*keys, "s.node", "s.next", "ring", "s.ahead")


def _owners(sides: DataFrame, ranked: DataFrame, holes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring, outer) of every hole.

    The first pixel of a hole in its first row has a run of positives on its left. The left end
    of that run is on the outer ring or on another hole of the patch that starts further up or
    to the left; following these, doubling the step, ends at the outer ring.
    """
    begun = holes.select(*keys, _y("ring").cast("int").alias("row")).distinct()
    row = F.when(F.col("dir") == SOUTH, F.col("t")).otherwise(-F.col("t") - 1)
    upright = sides.filter(F.col("dir").isin(SOUTH, NORTH)).select(*keys, row.alias("row"), F.col("line").alias("x"), "dir", "node")
    upright = upright.join(begun.hint("merge"), [*keys, "row"], "left_semi")
    before = F.lag("node").over(Window.partitionBy(*keys, "row").orderBy("x"))
    right_ends = upright.withColumn("left", before).filter(F.col("dir") == SOUTH)
    ring_of = ranked.select(*keys, "node", "ring")
    first = (ring_of.hint("merge").join(right_ends, [*keys, "node"]).join(holes.hint("merge"), [*keys, "ring"])
             .groupBy(*keys, "ring").agg(F.min_by("left", F.struct("row", "x")).alias("node")))
    up = first.hint("merge").join(ring_of.withColumnRenamed("ring", "outer"), [*keys, "node"]).select(*keys, "ring", "outer")
    up = cut_lineage(up, "holes")
    while True:
        more = up.select(*keys, F.col("ring").alias("outer"), F.col("outer").alias("o2"))
        up = cut_lineage(up.join(more.hint("merge"), [*keys, "outer"], "left").select(*keys, "ring", F.coalesce("o2", "outer").alias("outer"), F.col("o2").isNotNull().alias("moved")), "holes")
        if up.filter("moved").isEmpty():
            return up.select(*keys, "ring", "outer")


def _measured(ring: Column) -> Column:
    """x, y, corners and twice the area of a ring, along its points from the last one on. Only
    sides along one axis are counted, so both need the points in their order."""
    def on(s: Column, p: Column) -> Column:
        side = F.when((s["x"] == p["x"]) != (s["y"] == p["y"]), 1).otherwise(0)
        return F.struct(p["x"].alias("x"), p["y"].alias("y"), (s["corners"] + side).alias("corners"),
                        (s["twice"] + s["x"] * p["y"] - p["x"] * s["y"]).alias("twice"))

    last, none = F.element_at(ring, -1), F.lit(0).cast("long")
    return F.aggregate(ring, F.struct(last["x"].alias("x"), last["y"].alias("y"), none.alias("corners"), none.alias("twice")), on)


def outline(tiles: DataFrame, mask: str, keys: list[str] | None = None, place: DataFrame | None = None) -> DataFrame:
    """Rings of a mask: ring, outer, corners, area and the closed list of ``points``.

    ``ring`` is a number in order of the ring's first corner (row, then column); ``outer`` is the
    ring around a hole, an outer ring's is its own. Outer rings have their area in pixels, holes
    theirs below zero; corners and area are read off the points in their order. Pixels that
    touch at a corner only have rings of their own. Points are pixel corners; with ``place``
    (keys, left, top, res, zone and south per tile) longitude and latitude. A mask without
    positives has no ring; null pixels are not positive.
    """
    keys = TILE if keys is None else keys
    sides = cut_lineage(_sides(_unit_edges(tiles, mask, keys), keys), "sides")
    ranked = _ranked(_links(sides, keys), keys)
    # The links tell which rings are holes before their corners are in order.
    twice = _x("node") * _y("next") - _x("next") * _y("node")
    holes = cut_lineage(ranked.groupBy(*keys, "ring").agg(F.sum(twice).alias("twice")).filter("twice < 0").select(*keys, "ring"), "outlines")
    owner = _owners(sides, ranked, holes, keys)
    corners, shown = ranked.select(*keys, "ring", "ahead", _x("node").alias("x"), _y("node").alias("y")), []
    if place is not None:
        at = corners.join(place.select(*keys, "left", "top", "res", "zone", "south").hint("merge"), keys)
        at = at.withColumns({"e": F.col("left") + F.col("x") * F.col("res"), "n": F.col("top") - F.col("y") * F.col("res")})
        shown = ["lng", "lat"]
        corners = utm_to_wgs84(at, "e", "n", "zone", "south").select(*keys, "ring", "ahead", "x", "y", *shown)
    order = F.when(F.col("ahead") == 0, F.lit(-(1 << 62))).otherwise(-F.col("ahead"))
    rings = corners.groupBy(*keys, "ring").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "x", "y", *shown))).alias("c"))
    x, y = shown or ["x", "y"]
    closed = F.transform(F.concat("c", F.slice("c", 1, 1)), lambda p: F.struct(p[x].cast("double").alias("x"), p[y].cast("double").alias("y")))
    rings = rings.withColumn("m", _measured(F.col("c"))).select(*keys, "ring", F.col("m.corners").alias("corners"), (F.col("m.twice") / 2).alias("area"), closed.alias("points"))
    return (rings.join(owner.hint("merge"), [*keys, "ring"], "left")
            .select(*keys, "ring", F.coalesce("outer", "ring").alias("outer"), "corners", "area", "points"))


def feature_pieces(rings: DataFrame, properties: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """(keys, place, ring, piece): the FeatureCollection of each tile in pieces of text.

    The pieces of a tile, in order of ``place`` and ``ring`` and one after the other, are one
    document with one feature: a MultiPolygon whose holes are interior rings. A piece is a ring,
    so no document is gathered. ``properties`` has a column per property for each tile; tiles of
    it without a ring get a collection without features.
    """
    keys = TILE if keys is None else keys
    names = [c for c in properties.columns if c not in keys] if properties is not None else []
    tiles = rings.groupBy(*keys).agg(F.min("outer").alias("__first"))
    if properties is not None:
        tiles = properties.join(tiles.hint("merge"), keys, "left")
    tiles = tiles.withColumn("__p", F.to_json(F.struct(*names)) if names else F.lit("{}"))
    coords = F.to_json(F.transform("points", lambda p: F.array(p["x"], p["y"])))
    body = rings.join(tiles.select(*keys, "__first").hint("merge"), keys).select(
        *keys, F.col("outer").alias("place"), F.col("ring").alias("ring"),
        F.concat(F.when(F.col("ring") != F.col("outer"), ",").when(F.col("outer") == F.col("__first"), "[").otherwise("],["), coords).alias("piece"))
    some = F.col("__first").isNotNull()
    head = tiles.select(*keys, F.lit(-1).cast("long").alias("place"), F.lit(-1).cast("long").alias("ring"), F.concat(
        F.lit('{"type":"FeatureCollection","features":['),
        F.when(some, '{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[').otherwise("")).alias("piece"))
    tail = tiles.select(*keys, F.lit((1 << 63) - 1).alias("place"), F.lit((1 << 63) - 1).alias("ring"), F.concat(
        F.when(some, F.concat(F.lit(']]},"properties":'), "__p", F.lit("}"))).otherwise(""), F.lit("]}")).alias("piece"))
    return head.unionByName(body).unionByName(tail)


def write_collections(pieces: DataFrame, path: str, keys: list[str] | None = None) -> None:
    """Write the pieces as lines, a folder per tile; its lines in order are the document.

    Pieces are sorted on the way to the files, so a task holds one piece at a time.
    """
    keys = TILE if keys is None else keys
    rows = pieces.repartition(*keys).sortWithinPartitions(*keys, "place", "ring")
    rows.select(*keys, F.col("piece").alias("value")).write.partitionBy(*keys).text(path)
