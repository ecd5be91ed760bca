"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is rotated at random several times; the signs of each rotation are its binary
code, and the inner product of the rotated vector with its own normalised code is stored as
the correction factor. For a second vector q, <code, rotated q> / factor estimates the cosine
without bias. Where the true cosine is c, its deviation per rotation is known:
sqrt((1 - c * c) (1 - f * f) / (f * f) / (d - 1)).

Codes are written once: sign bits, factors, and the vector in steps of one byte, rounded with
a common dither so that the rounding has no bias either. Only these travel. Runs of bits, as
many as the size of a label group asks for, are keys under which near vectors meet; the number
of runs follows from the least cosine so that a pair at the threshold misses all of them with
probability ``miss``. Where two vectors meet, the estimate and its bound decide: a pair whose
estimate lies more than ``sure`` deviations below the threshold is dropped. Members with a pair
left name their partners by a bitset, and only these members fetch their raw vectors, for the
recomputation in double precision that alone links a pair.

Equal vectors are one class. Vectors that meet are compared in blocks of bounded size; blocks
return counts and a spanning set of links, never all pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlake.llm import words
from hazardlake.llm.graph import components
from hazardlake.session import cut_lineage

U = np.uint64
BLOCK = 64  # members of a block


def rotations(d: int, n: int, seed: int = 99) -> np.ndarray:
    """``n`` random orthogonal matrices (n, d, d)."""
    rng = np.random.default_rng([seed, d])
    out = np.empty((n, d, d))
    for r in range(n):
        q, t = np.linalg.qr(rng.standard_normal((d, d)))
        out[r] = q * np.sign(np.diag(t))
    return out


def shape(n: int, cosine: float, miss: float) -> tuple[int, int]:
    """Bits of a key and number of keys for ``n`` vectors that may be compared."""
    agree = 1 - math.acos(cosine) / math.pi
    bits = max(8, min(60, math.ceil(math.log2(max(2, n)))))
    return bits, math.ceil(math.log(miss) / math.log1p(-(agree**bits)))


def _codes(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs (vectors, rotations, d) and factors (vectors, rotations) of unit vectors."""
    y = np.einsum("vd,rdk->vrk", x, turn)
    return y >= 0, np.abs(y).sum(axis=2) / math.sqrt(x.shape[1])


def _offset(d: int, seed: int = 77) -> np.ndarray:
    """Dither between -1/2 and 1/2 of each component."""
    return np.random.default_rng([seed, d]).random(d) - 0.5


def _steps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in steps of one byte and the size of a step, with one dither for all vectors."""
    step = np.abs(x).max(axis=1) / 126
    return np.rint(x / step[:, None] + _offset(x.shape[1])).astype(np.int8), step


def _rebuilt(sign: np.ndarray, factor: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """Vectors whose inner product with a unit vector is the estimate of the cosine."""
    n, r, d = sign.shape
    code = np.where(sign, 1.0, -1.0) / (factor[:, :, None] * math.sqrt(d) * r)
    return code.reshape(n, r * d) @ turn.transpose(0, 2, 1).reshape(r * d, d)


def _deviation(factor: np.ndarray, d: int) -> np.ndarray:
    """Deviation of the estimates of each vector, to be multiplied by sqrt(1 - cosine ** 2)."""
    f = np.maximum(factor.astype(float) ** 2, 1e-12)
    return np.sqrt((np.maximum(0, 1 - f) / f).mean(axis=1) / max(1, d - 1) / factor.shape[1])


def _words(sign: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """The runs of bits of flat signs as numbers, one per band."""
    power = U(1) << np.arange(bits, dtype=U)
    return (sign[:, : bits * bands].reshape(len(sign), bands, bits) * power).sum(axis=2, dtype=U)


@dataclass
class Plan:
    """What all tasks agree on: bits of a key, number of keys, threshold, deviations of the bound."""

    bits: int
    bands: int
    cosine: float
    sure: float

    def turns(self, d: int) -> np.ndarray:
        return rotations(d, -(-self.bits * self.bands // d))


def _encode(plan: Plan) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for table in map(lambda b: pa.Table.from_batches([b]), batches):
            for d, part in _by_size(table):
                if d not in known:
                    known[d] = plan.turns(d)
                for lo in range(0, len(part), 256):
                    some = part.slice(lo, 256)
                    x = _matrix(some.column("v"))
                    x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
                    sign, factor = _codes(x, known[d])
                    sign = sign.reshape(len(x), -1)
                    query, step = _steps(x)
                    mark = some.column("g").to_numpy().astype(U)[:, None]
                    keys = words.mix(words.mix(_words(sign, plan.bits, plan.bands) * U(4096) + np.arange(1, plan.bands + 1, dtype=U)) ^ mark)
                    yield pa.RecordBatch.from_arrays(
                        [some.column("id").combine_chunks(), some.column("d").combine_chunks(),
                         words.lists(words.signed(keys.ravel()), np.full(len(x), plan.bands)),
                         _blobs(np.packbits(sign, axis=1)), _blobs(factor.astype(np.float32)), _blobs(query), pa.array(step)],
                        ["id", "d", "keys", "code", "factor", "query", "step"])
    return encode


CODES = "id long, d int, keys array<long>, code binary, factor binary, query binary, step double"


def _pairs(begin: np.ndarray, end: np.ndarray, most: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with begin[i] <= j < end[i], in pieces."""
    count = end - begin
    total = np.concatenate([[0], np.cumsum(count)])
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(total, total[lo] + most, "right")) - 1)
        i = np.repeat(np.arange(lo, hi), count[lo:hi])
        j = np.arange(len(i)) - np.repeat(total[lo:hi] - total[lo], count[lo:hi]) + begin[i]
        if len(i):
            yield i, j
        lo = hi


def _meet(plan: Plan) -> Callable:
    """Whole units (key, x, y) of codes to the members that have a pair the bound does not drop."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for table in _whole(batches, ("key", "x", "y")):
            for d, part in _by_size(table):
                if d not in known:
                    known[d] = plan.turns(d)
                turn = known[d]
                n, r = len(part), len(turn)
                sign = np.unpackbits(_bytes(part.column("code"), np.uint8), axis=1)[:, : r * d].astype(bool)
                factor = _bytes(part.column("factor"), np.float32).astype(float)
                step = part.column("step").to_numpy()
                query = _bytes(part.column("query"), np.int8).astype(np.float32)
                # The dither is taken off again, so that what is left of the rounding has no bias.
                query = (query - _offset(d).astype(np.float32)) * step[:, None].astype(np.float32)
                rebuilt = _rebuilt(sign.reshape(n, r, d), factor, turn).astype(np.float32)
                spread = _deviation(factor, d) ** 2 * (1 - plan.cosine**2)
                length = (rebuilt.astype(float) ** 2).sum(axis=1)
                runs = _words(sign, plan.bits, plan.bands)
                band, side, ids = (part.column(c).to_numpy() for c in ("band", "side", "id"))
                start, end = _bounds(part, ("key", "x", "y"))
                # Diagonal units pair each member with the later ones, others the left side with the right.
                lefts = np.concatenate([[0], np.cumsum(side < 0)])
                begin = np.where(side == 0, np.arange(n) + 1, np.where(side < 0, start + lefts[end] - lefts[start], end))
                found = []
                for i, j in _pairs(begin, end):
                    est = np.einsum("pd,pd->p", rebuilt[i], query[j]).astype(float)
                    bound = plan.sure * np.sqrt(spread[i] + step[j] ** 2 / 4 * length[i]) + 1e-5
                    near = np.flatnonzero(est + bound >= plan.cosine)
                    i, j = i[near], j[near]
                    # A pair counts in the first of the bands it shares.
                    now = (runs[i] == runs[j]).argmax(axis=1) == band[i]
                    found.append(np.stack([i[now], j[now]]))
                i, j = np.concatenate(found, axis=1) if found else np.empty((2, 0), int)
                if len(i):
                    place = np.arange(n) - start
                    at = np.unique(np.concatenate([i, j]))
                    mask = np.zeros((len(at), int(place[at].max()) + 1), bool)
                    mask[np.searchsorted(at, i), place[j]] = True
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array(part.column(c).to_numpy()[at]) for c in ("key", "x", "y", "id")),
                         pa.array(place[at].astype(np.int32)), _blobs(np.packbits(mask, axis=1))], ["key", "x", "y", "id", "place", "partners"])
    return meet


UNDECIDED = "key long, x int, y int, id long, place int, partners binary"


def _recompute(plan: Plan) -> Callable:
    """Whole units of undecided members with raw vectors to link counts and spanning links."""
    def recompute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole(batches, ("key", "x", "y")):
            for _, part in _by_size(table):
                i, j = _named(part)
                raw = _matrix(part.column("v"))
                norm = (raw * raw).sum(axis=1)
                hit = np.zeros(len(i), bool)
                for lo in range(0, len(i), 1 << 14):
                    a, b = i[lo: lo + (1 << 14)], j[lo: lo + (1 << 14)]
                    hit[lo: lo + (1 << 14)] = (raw[a] * raw[b]).sum(axis=1) / np.sqrt(norm[a] * norm[b]) >= plan.cosine
                i, j = i[hit], j[hit]
                if len(i):
                    ids, n = part.column("id").to_numpy(), part.column("n").to_numpy()
                    links = np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))
                    up = _spanning(i, j, len(ids))
                    at = np.flatnonzero(links)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[at]), pa.array(links[at].astype(np.int64)), pa.array(ids[up[at]])], ["id", "links", "to"])
    return recompute


def _named(part: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that the bitsets of a table of whole units name."""
    start, _ = _bounds(part, ("key", "x", "y"))
    place = part.column("place").to_numpy().astype(np.int64)
    blobs = part.column("partners").to_pylist()
    width = max(map(len, blobs))
    mask = np.unpackbits(np.frombuffer(b"".join(b.ljust(width, b"\0") for b in blobs), np.uint8).reshape(len(blobs), width), axis=1)
    i, spot = np.nonzero(mask)
    wide = mask.shape[1]
    return i, np.searchsorted(start * wide + place, start[i] * wide + spot)


def undecided(coded: DataFrame, plan: Plan) -> DataFrame:
    """(key, x, y, id, place, partners): members of units with pairs left, ``partners`` a bitset of places.

    Reads codes only. A key with more members than a block holds is compared block by block:
    each pair of blocks is a unit.
    """
    met = coded.select("id", F.posexplode("keys").alias("band", "key"))
    shared = met.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    members = met.join(shared, "key")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), blocks).cast("int")
    members = members.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    members = members.select("key", "band", "id", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"),
                             F.when(F.col("own") == F.col("other"), 0).when(F.col("own") < F.col("other"), -1).otherwise(1).alias("side"))
    full = (members.join(coded.drop("keys"), "id")
            .repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "side", "id"))
    return full.mapInArrow(_meet(plan), UNDECIDED)


def near_vectors(rows: DataFrame, cosine: float = 0.98, miss: float = 1e-7, sure: float = 5.0) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``rows`` (vec_id, embedding, label).

    Two rows are linked if their labels are equal and not null and their cosine in double
    precision is at least ``cosine``. A vector that is null, empty, zero or holds a null or a
    component that is not finite links with nothing, nor do vectors of different length.
    ``component_id`` is the smallest id reachable over links. Ids should be unique: a repeated
    row counts as another vector and gets the same result. A null id never links and has a
    null component. An empty table gives no rows; other columns are not looked at.
    """
    e = F.col("embedding").cast("array<double>")
    good = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda v: v.isNotNull()
            & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0))
    base = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("string").alias("label"),
                       e.alias("v"), F.coalesce(good, F.lit(False)).alias("good"))
    name = F.struct("label", "v")
    named = base.select("id", "good", "label", "v", F.xxhash64(name).alias("h1"),
                        F.xxhash64(F.lit(7), name).alias("h2"))
    classes = (named.filter("good").groupBy("h1", "h2").agg(
        F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    held = cut_lineage(named.select("id", "h1", "h2", "good"), "vectors")
    reps = cut_lineage(
        named.filter("good").join(classes, ["h1", "h2"]).filter("id = rep").dropDuplicates(["h1", "h2"])
        .select("id", "n", "label", "v", F.size("v").alias("d"), F.pmod(F.xxhash64("label", F.size("v")), F.lit(1 << 62)).alias("g")), "reps")
    most = reps.groupBy("g").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bits, bands = shape(most, cosine, miss)

    plan = Plan(bits, bands, cosine, sure)
    coded = cut_lineage(reps.select("id", "d", "g", "v").mapInArrow(_encode(plan), CODES), "codes")
    near = cut_lineage(undecided(coded, plan), "undecided")
    full = (near.join(reps.select("id", "d", "n", "v"), "id")
            .repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "place"))
    found = cut_lineage(full.mapInArrow(_recompute(plan), "id long, links long, to long"), "links")
    label = components(found.filter("id != to"), "id", "to")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    out = (held.join(classes, ["h1", "h2"], "left").join(links.withColumnRenamed("id", "rep"), "rep", "left")
           .join(label.withColumnRenamed("node", "rep"), "rep", "left"))
    own_links = F.when(F.col("good"), F.col("n") - 1 + F.coalesce("links", F.lit(0))).otherwise(0)
    component = F.when(F.col("good"), F.coalesce("component", "rep")).otherwise(F.col("id"))
    return (out.select(F.col("id").alias("vec_id"), own_links.alias("n_links"), component.alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def _spanning(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each member the smallest member index it is joined to by the links."""
    up = np.arange(n)
    while True:
        low = np.minimum(up[i], up[j])
        new = up.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == up).all():
            return up
        up = new


def _whole(batches: Iterator[pa.RecordBatch], by: tuple[str, ...]) -> Iterator[pa.Table]:
    """Sorted batches as tables of whole groups."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        last = int(_bounds(table, by)[0][-1]) if len(table) else 0
        if last:
            yield table.slice(0, last)
        rest = table.slice(last)
    if rest is not None and len(rest):
        yield rest


def _bounds(table: pa.Table, by: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """First row and end of each row's group in a sorted table."""
    key = np.stack([table.column(c).to_numpy().astype(np.int64) for c in by], axis=1)
    cut = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)]))
    size = np.diff(np.append(cut, len(key)))
    return np.repeat(cut, size), np.repeat(cut + size, size)


def _by_size(table: pa.Table) -> Iterator[tuple[int, pa.Table]]:
    """Rows with vectors of one length; groups never hold two."""
    size = table.column("d").to_numpy()
    for d in np.unique(size):
        yield int(d), table if (size == d).all() else table.filter(pa.array(size == d))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1).astype(float)


def _blobs(rows: np.ndarray) -> pa.Array:
    """Rows of a matrix as byte strings."""
    return pa.array([r.tobytes() for r in np.ascontiguousarray(rows)], pa.binary())


def _bytes(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)
