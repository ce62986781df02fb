"""Outlines of masks pixels(image_id, x, y): components, hulls, fitted ellipses and ordered contours, as joins and aggregates over pixels.

No operator holds an image's pixels in a group: components move runs of pixels, hulls move hull points, ellipses move 15 sums and contours move
pixels to tiles, and pieces of walks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from markwise.kernels.ellipse import POWERS, axes_of, conic
from markwise.sources.tables import scratch


#: Rows and columns of a tile, whose pixels are looked at together.
TILE = 128


def _kept(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: rounds of joins don't grow one plan."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


# Components


def touching(found: DataFrame, diagonal: bool = True) -> DataFrame:
    """(image_id, a, b): pairs of numbered runs (run, y, x0, x1) that touch, in the next row or, where a tile cuts them, in the same one."""
    reach = 1 if diagonal else 0
    a = found.select("image_id", F.col("run").alias("a"), F.col("y").alias("ya"), F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.explode(F.array(F.col("y"), F.col("y") + 1)).alias("y"))
    b = found.select("image_id", F.col("run").alias("b"), "y", F.col("x0").alias("b0"), F.col("x1").alias("b1"))
    j = a.join(b, ["image_id", "y"])
    below = (F.col("ya") < F.col("y")) & (F.col("b0") <= F.col("a1") + reach) & (F.col("b1") >= F.col("a0") - reach)
    beside = (F.col("ya") == F.col("y")) & (F.col("b0") == F.col("a1") + 1)
    return j.where(below | beside).select("image_id", "a", "b")


def _tile_runs(x: np.ndarray, y: np.ndarray, cut: np.ndarray, diagonal: bool) -> tuple[np.ndarray, ...]:
    """(y, x0, x1, place of the component's least run) of the runs of a tile's pixels, in order of (y, x0); a run ends where cut changes."""
    order = np.lexsort((x, y))
    order = order[np.append(True, (np.diff(x[order]) != 0) | (np.diff(y[order]) != 0))]  # a pixel counts once
    x, y, cut = x[order], y[order], cut[order]
    new = np.ones(len(x), bool)
    new[1:] = (y[1:] != y[:-1]) | (x[1:] > x[:-1] + 1) | (cut[1:] != cut[:-1])
    at = np.flatnonzero(new)
    ends = np.append(at[1:], len(x)) - 1
    row, x0, x1 = y[at], x[at], x[ends]
    # the runs of the next row that touch each run, and where a cut parts a row's runs
    low, reach = x.min(), 1 if diagonal else 0
    width = x.max() - low + 4
    key = lambda rows, xs: rows * width + (xs - low + 1)
    lo = np.searchsorted(key(row, x1), key(row + 1, x0 - reach))
    n = np.maximum(np.searchsorted(key(row, x0), key(row + 1, x1 + reach), side="right") - lo, 0)
    beside = np.flatnonzero((row[1:] == row[:-1]) & (x0[1:] == x1[:-1] + 1))
    i = np.concatenate([np.repeat(np.arange(len(at)), n), beside])
    j = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n), beside + 1])
    name = np.arange(len(at))
    while len(i):
        least = np.minimum(name[i], name[j])
        low_ = name.copy()
        for k in (i, j, name[i], name[j]):
            np.minimum.at(low_, k, least)
        low_ = low_[low_]
        if (low_ == name).all():
            break
        name = low_
    return row, x0, x1, name


def tile_runs(pixels: DataFrame, tile: int | None = None, diagonal: bool = True) -> DataFrame:
    """(image_id, y, x0, x1, name): runs that no multiple of tile, nor the border of a group's tile, is inside of, named by the least run (y * 2^32 + x0) that touches them inside the group's tile."""
    width = tile * max(1, TILE // tile) if tile else TILE

    def name(rows: pa.Table) -> pa.Table:
        x, y = rows["x"].to_numpy().astype(np.int64), rows["y"].to_numpy().astype(np.int64)
        row, x0, x1, place = _tile_runs(x, y, x // (tile or width), diagonal)
        image = pa.chunked_array([rows["image_id"].combine_chunks().take(pa.array(np.zeros(len(row), np.int32)))])
        return pa.table([image, pa.array(row, pa.int32()), pa.array(x0, pa.int32()), pa.array(x1, pa.int32()), pa.array((row * (1 << 32) + x0)[place])], names=["image_id", "y", "x0", "x1", "name"])

    kind = pixels.schema["image_id"].dataType.simpleString()
    own = pixels.where("image_id is not null and x is not null and y is not null").select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    dealt = own.groupBy("image_id", F.floor(F.col("x") / width), F.floor(F.col("y") / TILE))
    return dealt.applyInArrow(name, f"image_id {kind}, y int, x0 int, x1 int, name long")


def components(pixels: DataFrame, tile: int | None = None, diagonal: bool = True) -> DataFrame:
    """(image_id, y, x0, x1, component): runs with their component, named by its least run; no run crosses a multiple of tile.

    Groups name the runs of tiles by themselves. Then only runs at tiles' borders meet: names hear the least of the names that touch them and of what they are named
    after, and jump along their own names, until nothing changes: some log(tiles) rounds, each a few joins of the names that cross a border.
    """
    width = tile * max(1, TILE // tile) if tile else TILE
    found = _kept(tile_runs(pixels, tile, diagonal), "runs")
    inner = lambda c, size: F.pmod(F.col(c), F.lit(size))
    edge = inner("y", TILE).isin(0, TILE - 1) | (inner("x0", width) == 0) | (inner("x1", width) == width - 1)
    links = touching(found.where(edge).select("image_id", "y", "x0", "x1", F.col("name").alias("run")), diagonal).where("a <> b").distinct()
    both = _kept(links.union(links.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))), "touching")
    named = both.select("image_id", F.col("a").alias("run"), F.col("a").alias("name")).distinct()
    crossing = not both.isEmpty()
    while crossing:
        heard = both.join(named.select("image_id", F.col("run").alias("b"), "name"), ["image_id", "b"]).groupBy("image_id", F.col("a").alias("run")).agg(F.min("name").alias("heard"))
        least = named.join(heard, ["image_id", "run"], "left").select("image_id", "run", "name", F.least("name", F.coalesce("heard", "name")).alias("low"))
        # whoever bears a name learns the least that any bearer heard, and names jump
        told = least.groupBy("image_id", "name").agg(F.min("low").alias("told"))
        step = least.join(told, ["image_id", "name"]).select("image_id", "run", "name", F.col("told").alias("next"))
        jump = step.select("image_id", F.col("run").alias("next"), F.col("next").alias("further"))
        new = _kept(step.join(jump, ["image_id", "next"], "left").select("image_id", "run", "name", F.least("next", F.coalesce("further", "next")).alias("new")), "names")
        named = new.select("image_id", "run", F.col("new").alias("name"))
        crossing = not new.where("new <> name").isEmpty()
        if not crossing:
            found = found.join(named.select("image_id", F.col("run").alias("name"), F.col("name").alias("least")), ["image_id", "name"], "left").withColumn("name", F.coalesce("least", "name"))
    own = found.select("image_id", "y", "x0", "x1", F.col("name").alias("component"))
    return own if tile else _joined(own)


def _joined(named: DataFrame) -> DataFrame:
    """Runs that go on where another one of their row ends are one."""
    own = W.Window.partitionBy("image_id", "y").orderBy("x0")
    islands = named.withColumn("_island", F.col("x0") - F.coalesce(F.sum(F.col("x1") - F.col("x0") + 1).over(own.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
    return islands.groupBy("image_id", "y", "_island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("component").alias("component")).drop("_island")


def largest(pixels: DataFrame, tile: int | None = None) -> DataFrame:
    """The pixels of each image's largest component; of equal ones that with the first pixel by (y, x)."""
    named = components(pixels, tile)
    sizes = named.groupBy("image_id", "component").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("area"))
    best = sizes.groupBy("image_id").agg(F.min(F.struct((-F.col("area")).alias("area"), "component"))["component"].alias("component"))
    return named.join(best, ["image_id", "component"], "left_semi").select("image_id", F.explode(F.sequence("x0", "x1")).alias("x"), "y")


# Hulls

#: So few points of an image in a batch are left to the merge of its hull.
FEW = 32


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise with y upwards, from the least (x, y); points on its sides are none."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def half(row: list) -> list:
        out: list = []
        for p in row:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    rows = points.tolist()
    return np.array(half(rows) + half(rows[::-1]), points.dtype)


def farthest(corners: np.ndarray) -> tuple[float, tuple, tuple]:
    """The greatest squared distance of two hull corners and the least pair that has it, by turning two parallel lines around the hull."""
    n = len(corners)
    p = [tuple(x) for x in corners.tolist()]
    if n == 1:
        return 0.0, p[0], p[0]
    pairs, j = {(0, 1)}, 1
    area = lambda i, k: (p[(i + 1) % n][0] - p[i][0]) * (p[k % n][1] - p[i][1]) - (p[(i + 1) % n][1] - p[i][1]) * (p[k % n][0] - p[i][0])
    for i in range(n if n > 2 else 0):
        while area(i, j + 1) > area(i, j):
            j += 1
        pairs |= {(i, j % n), ((i + 1) % n, j % n)}
        if area(i, j + 1) == area(i, j):  # parallel sides
            pairs |= {(i, (j + 1) % n), ((i + 1) % n, (j + 1) % n)}
    far = lambda a, b: (a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2
    return min((-far(p[a], p[b]), *sorted((p[a], p[b]))) for a, b in pairs)


def hull_points(points: DataFrame) -> DataFrame:
    """(image_id, x, y): ends of rows, and of FEW or more of an image in a batch only the corners of their hull; the corners of all points' hull are among them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            image = batch["image_id"].dictionary_encode()
            code, xy = image.indices.to_numpy(), np.stack([batch["x"].to_numpy(), batch["y"].to_numpy()], axis=1)
            order = np.argsort(code, kind="stable")
            cuts = np.flatnonzero(np.diff(code[order], prepend=-1))
            sizes = np.diff(cuts, append=len(code))
            few = order[np.repeat(sizes < FEW, sizes)]
            found = [(code[order[a]], hull(xy[order[a : a + n]])) for a, n in zip(cuts[sizes >= FEW], sizes[sizes >= FEW], strict=True)]
            at = np.concatenate([code[few], np.repeat([c for c, _ in found], [len(h) for _, h in found]).astype(code.dtype)])
            flat = np.concatenate([xy[few], *[h for _, h in found]])
            yield pa.record_batch([image.dictionary.take(pa.array(at, pa.int32())), pa.array(flat[:, 0]), pa.array(flat[:, 1])], names=["image_id", "x", "y"])

    kind = points.schema["image_id"].dataType.simpleString()
    own = points.where("image_id is not null and x is not null and y is not null").select("image_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    ends = own.groupBy("image_id", "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    both = F.when(F.col("x0") == F.col("x1"), F.array("x0")).otherwise(F.array("x0", "x1"))
    return ends.select("image_id", F.explode(both).alias("x"), "y").mapInArrow(partial, f"image_id {kind}, x double, y double")


def convex_hull(points: DataFrame) -> DataFrame:
    """(image_id, place, x, y): hull corners in order. Images meet in their rows' ends or corners of partial hulls only."""

    def merge(rows: pa.Table) -> pa.Table:
        corners = hull(np.stack([rows["x"].to_numpy(), rows["y"].to_numpy()], axis=1))
        image = pa.chunked_array([rows["image_id"].combine_chunks().take(pa.array([0] * len(corners)))])
        return pa.table([image, pa.array(range(len(corners)), pa.int32()), pa.array(corners[:, 0]), pa.array(corners[:, 1])], names=["image_id", "place", "x", "y"])

    kind = points.schema["image_id"].dataType.simpleString()
    return hull_points(points).groupBy("image_id").applyInArrow(merge, f"image_id {kind}, place int, x double, y double")


def farthest_pair(points: DataFrame) -> DataFrame:
    """(image_id, ax, ay, bx, by, distance): the two points farthest apart; of several pairs the least, a being the lesser point."""

    def turn(rows: pa.Table) -> pa.Table:
        far, a, b = farthest(hull(np.stack([rows["x"].to_numpy(), rows["y"].to_numpy()], axis=1)))
        values = [pa.array([v], pa.float64()) for v in (*a, *b, math.sqrt(-far))]
        return pa.table([rows["image_id"].slice(0, 1), *values], names=["image_id", "ax", "ay", "bx", "by", "distance"])

    kind = points.schema["image_id"].dataType.simpleString()
    return hull_points(points).groupBy("image_id").applyInArrow(turn, f"image_id {kind}, ax double, ay double, bx double, by double, distance double")


# Ellipses


def border(pixels: DataFrame) -> DataFrame:
    """(image_id, x, y): the points halfway between a pixel and a neighbour above, below or beside it that isn't set."""
    own = pixels.select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y")).distinct()
    sides = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    beside = own.withColumn("s", F.explode(sides)).select("image_id", "x", "y", (F.col("x") + F.col("s.dx")).alias("nx"), (F.col("y") + F.col("s.dy")).alias("ny"))
    free = beside.join(own.select("image_id", F.col("x").alias("nx"), F.col("y").alias("ny")), ["image_id", "nx", "ny"], "left_anti")
    return free.select("image_id", ((F.col("x") + F.col("nx")) / 2).alias("x"), ((F.col("y") + F.col("ny")) / 2).alias("y"))


def scatter(points: DataFrame) -> DataFrame:
    """(image_id, mx, my, size, width, height, s_ij ...): sums of x^i y^j, i + j <= 4, about the middle and in units of size, so that they stay small."""
    box = points.groupBy("image_id").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), (F.max("x") - F.min("x")).alias("width"), (F.max("y") - F.min("y")).alias("height"))
    box = box.withColumn("size", F.greatest("width", "height", F.lit(1.0)) / 2)
    j = points.join(box, "image_id").withColumn("_x", (F.col("x") - F.col("mx")) / F.col("size")).withColumn("_y", (F.col("y") - F.col("my")) / F.col("size"))

    def power(c: str, k: int) -> Column:
        out = F.lit(1.0)
        for _ in range(k):
            out = out * F.col(c)
        return out

    sums = [F.sum(power("_x", a) * power("_y", b)).alias(f"s_{a}{b}") for a, b in POWERS]
    return j.groupBy("image_id", "mx", "my", "size", "width", "height").agg(*sums)


def fitted_ellipse(pixels: DataFrame) -> DataFrame:
    """(image_id, cx, cy, major, minor, angle, fitted) of the ellipse of least squares through a mask's border.

    Where none fits (a line, too few points), fitted is false, and the axes are the box's longer and shorter side.
    """

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                c = conic({(a, b): r[f"s_{a}{b}"] for a, b in POWERS})
                got = axes_of(c) if c is not None else None
                if got is None:  # the border lies half a pixel outside on both sides
                    w, h = r["width"] - 1, r["height"] - 1
                    out.append((r["mx"], r["my"], max(w, h), min(w, h), 90.0 if h > w else 0.0, False))
                else:
                    out.append((r["mx"] + got[0] * r["size"], r["my"] + got[1] * r["size"], got[2] * r["size"], got[3] * r["size"], got[4], True))
            columns = [pa.array(c) for c in zip(*out, strict=True)] or [pa.array([], pa.float64())] * 5 + [pa.array([], pa.bool_())]
            yield pa.record_batch([batch["image_id"], *columns], names=["image_id", "cx", "cy", "major", "minor", "angle", "fitted"])

    kind = pixels.schema["image_id"].dataType.simpleString()
    return scatter(border(pixels)).mapInArrow(solve, f"image_id {kind}, cx double, cy double, major double, minor double, angle double, fitted boolean")


# Contours

#: The eight neighbours (dx, dy) from east, counter-clockwise as seen.
AROUND = ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))


#: NEXT[neighbours, way]: in which way a walk that arrives by way goes on at a pixel with these neighbours set, as bits; it looks around from five ways further on.
NEXT = [[next((v for v in ((way + 5 + turn) % 8 for turn in range(8)) if bits >> v & 1), 8) for way in range(8)] for bits in range(256)]


def _tile_walks(x: np.ndarray, y: np.ndarray, inside: np.ndarray) -> list[tuple]:
    """Pieces of walks around a tile's pixels; inside: which of the pixels are its own, the others lie two around it at most.

    Each is (first pixel or None, at, to, changes, last), at being below 0 for a first pixel without neighbours: a piece starts where walks enter the tile, where they meet, or at its first pixel, and leads to the start of
    another piece, or of itself; changes are the (x, y, way) where its way changes, the first one always; last is its last way.
    """
    x0, y0 = int(x.min()) - 2, int(y.min()) - 2
    width, height = int(x.max()) - x0 + 3, int(y.max()) - y0 + 3
    cell = (y - y0) * width + (x - x0)
    grid, own = np.zeros(width * height, np.uint8), np.zeros(width * height, bool)
    grid[cell], own[cell[inside]] = 1, True
    steps = [dy * width + dx for dx, dy in AROUND]
    bits = np.zeros(width * height, np.uint8)
    middle = slice(width + 1, len(grid) - width - 1)
    for w, step in enumerate(steps):
        bits[middle] |= grid[width + 1 + step : len(grid) - width - 1 + step] << w
    first = int(cell[inside].min())
    corner = (x0 + first % width, y0 + first // width)
    if not bits[first]:
        alone = -1 - (corner[1] * (1 << 24) + corner[0])
        out, heads = [(corner, alone, alone, [(*corner, 8)], 8)], set()
    else:
        out, heads = [], {first * 8 + NEXT[bits[first]][7]}
    start = next(iter(heads), None)
    if not inside.all():
        edge = np.flatnonzero(own & (bits > 0) & (bits < 255))
        for w, step in enumerate(steps):
            for c in edge[(grid[edge - step] > 0) & ~own[edge - step]].tolist():
                heads.add(c * 8 + NEXT[bits[c]][w])
    around, held = bits.tolist(), own.tolist()

    def after(s: int) -> int:
        n = (s >> 3) + steps[s & 7]
        return n * 8 + NEXT[around[n]][s & 7]

    stops, seen = set(heads), set()
    for s in heads:
        while held[s >> 3] and s not in seen:
            seen.add(s)
            s = after(s)
        if held[s >> 3]:
            stops.add(s)
    place = lambda s: (x0 + (s >> 3) % width, y0 + (s >> 3) // width, s & 7)
    code = lambda s: ((y0 + (s >> 3) // width) * (1 << 24) + x0 + (s >> 3) % width) * 8 + (s & 7)
    for head in sorted(stops):
        changes, way, s = [place(head)], head & 7, after(head)
        while held[s >> 3] and s not in stops:
            if s & 7 != way:
                changes.append(place(s))
            way, s = s & 7, after(s)
        out.append((corner if head == start else None, code(head), code(s), changes, way))
    return out


def contour_pieces(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """(image_id, first, at, to, xs, ys, ways, last): the walks around the masks, cut into pieces at tiles of so many rows and columns; see _tile_walks().

    A group holds one tile's pixels, however large the image is.
    """

    def walks(key: tuple, rows: pa.Table) -> pa.Table:
        x, y = rows["x"].to_numpy().astype(np.int64), rows["y"].to_numpy().astype(np.int64)
        inside = (x // tile == key[1].as_py()) & (y // tile == key[2].as_py())
        found = _tile_walks(x, y, inside) if inside.any() else []
        columns = list(zip(*[(f and {"y": f[1], "x": f[0]}, a, t, *[list(v) for v in zip(*c, strict=True)], w) for f, a, t, c, w in found], strict=True)) or [()] * 7
        image = pa.chunked_array([rows["image_id"].combine_chunks().take(pa.array([0] * len(found), pa.int32()))])
        return pa.table([image, *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=names)

    several = pa.list_(pa.int32())
    kinds = (pa.struct([("y", pa.int32()), ("x", pa.int32())]), pa.int64(), pa.int64(), several, several, several, pa.int32())
    names = ["image_id", "first", "at", "to", "xs", "ys", "ways", "last"]
    kind = pixels.schema["image_id"].dataType.simpleString()
    tiles = lambda c: F.explode(F.sequence(F.floor(F.greatest(F.col(c) - 2, F.lit(0)) / tile), F.floor((F.col(c) + 2) / tile)))
    own = pixels.where("image_id is not null and x is not null and y is not null").select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"))
    dealt = own.withColumn("_i", tiles("x")).withColumn("_j", tiles("y"))
    schema = f"image_id {kind}, first struct<y: int, x: int>, at long, to long, xs array<int>, ys array<int>, ways array<int>, last int"
    return dealt.groupBy("image_id", "_i", "_j").applyInArrow(walks, schema)


def contour(pixels: DataFrame, tile: int = TILE) -> DataFrame:
    """(image_id, place, x, y): corners of the border of the component that holds an image's first pixel by (y, x), in walking order, from that pixel, downwards first.

    Each tile walks by itself. Only where a walk leaves its tile its pieces are ranked by pointer doubling: a round knows where 2^k pieces lead from everywhere and the
    first 2^k pieces of each walk, and joins twice for the double. A walk of n pieces takes log2(n) rounds. Coordinates are from 0 to 2^24 - 1.
    """
    pieces = _kept(contour_pieces(pixels, tile), "contour-pieces")
    starts = pieces.where("first is not null").groupBy("image_id").agg(F.min(F.struct("first", "at", "to")).alias("s")).select("image_id", "s.*")
    places = starts.select("image_id", "at", F.lit(0).cast("long").alias("place"))
    open_ = _kept(starts.where("at <> to").select("image_id", "at", F.lit(0).cast("long").alias("place")), "contour-places")
    reach, found = 1, open_.count()
    if found:
        jump = _kept(pieces.join(open_.select("image_id"), "image_id", "left_semi").select("image_id", "at", "to"), "contour-jump")
        known = open_
        while True:
            far = known.join(jump, ["image_id", "at"]).select("image_id", F.col("to").alias("at"), (F.col("place") + reach).alias("place"))
            known = _kept(known.union(far).groupBy("image_id", "at").agg(F.min("place").alias("place")), "contour-places")
            n = known.count()
            if n == found:
                break
            found, reach = n, 2 * reach
            on = jump.select("image_id", F.col("at").alias("to"), F.col("to").alias("further"))
            jump = _kept(jump.join(on, ["image_id", "to"]).select("image_id", "at", F.col("further").alias("to")), "contour-jump")
        places = starts.where("at = to").select("image_id", "at", F.lit(0).cast("long").alias("place")).union(known)
    walked = pieces.drop("first", "to").join(places, ["image_id", "at"])
    whole = W.Window.partitionBy("image_id")
    own = whole.orderBy("place")
    every = own.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    # a piece's first step is a corner if it turns from the last one of the piece before, which of the first piece is the last
    walked = walked.withColumn("_skip", F.when((F.col("at") >= 0) & (F.get("ways", F.lit(0)) == F.coalesce(F.lag("last").over(own), F.last("last").over(every))), 1).otherwise(0))
    walked = walked.withColumn("_from", F.coalesce(F.sum(F.size("ways") - F.col("_skip")).over(own.rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0)))
    corners = walked.select("image_id", "_skip", "_from", F.posexplode(F.arrays_zip("xs", "ys")).alias("_i", "c")).where("_i >= _skip")
    return corners.select("image_id", (F.col("_from") + F.col("_i") - F.col("_skip")).cast("long").alias("place"), F.col("c.xs").alias("x"), F.col("c.ys").alias("y"))


def contour_ends(corners: DataFrame) -> DataFrame:
    """(image_id, side, n, tip_angle, sharp, sure, mean_turn) of the first and last seventh (five corners at least) of contours of more than ten corners.

    The tip is the corner farthest from the end's middle; its angle is that to the corners two before and behind, in degrees. Without a corner on
    both sides of the tip it counts as 180. mean_turn: by how much the line turns at a corner on average, in radians.
    """
    sizes = corners.groupBy("image_id").agg(F.count("*").alias("len")).where("len > 10").withColumn("n", F.greatest(F.lit(5), F.floor(F.col("len") / 7)))
    j = corners.join(sizes, "image_id")
    sides = F.array(
        F.when(F.col("place") < F.col("n"), F.struct(F.lit("first").alias("side"), F.col("place").alias("i"))),
        F.when(F.col("place") >= F.col("len") - F.col("n"), F.struct(F.lit("last").alias("side"), (F.col("place") - F.col("len") + F.col("n")).alias("i"))),
    )
    end = j.select("image_id", "n", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), F.explode(F.array_compact(sides)).alias("s")).select("*", "s.*").drop("s")
    whole = W.Window.partitionBy("image_id", "side")
    order = whole.orderBy("i")
    every = order.rowsBetween(W.Window.unboundedPreceding, W.Window.unboundedFollowing)
    off = lambda c, k: (F.lag(c, k) if k > 0 else F.lead(c, -k)).over(order)
    clamped = lambda c, k: F.coalesce(off(c, k), (F.first(c) if k > 0 else F.last(c)).over(every))
    cosine = lambda ax, ay, bx, by: F.try_divide(ax * bx + ay * by, F.sqrt(ax * ax + ay * ay) * F.sqrt(bx * bx + by * by))
    angle_of = lambda c: F.when(c.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))
    turn = lambda *sides: angle_of(cosine(*sides))
    x, y = F.col("x"), F.col("y")
    placed = end.select(
        "image_id", "side", "n", "i",
        (F.pow(x - F.avg("x").over(whole), 2) + F.pow(y - F.avg("y").over(whole), 2)).alias("far"),
        turn(clamped("x", 2) - x, clamped("y", 2) - y, clamped("x", -2) - x, clamped("y", -2) - y).alias("at_tip"),
        turn(x - off("x", 1), y - off("y", 1), off("x", -1) - x, off("y", -1) - y).alias("turn"),
    )
    tip = F.max(F.struct("far", (-F.col("i")).alias("i"), F.degrees("at_tip").alias("angle")))
    found = placed.groupBy("image_id", "side", "n").agg(tip.alias("tip"), F.coalesce(F.avg("turn"), F.lit(0.0)).alias("mean_turn"))
    inside = (F.col("tip.i") < 0) & (-F.col("tip.i") < F.col("n") - 1) & F.col("tip.angle").isNotNull()
    angle = F.when(inside, F.col("tip.angle")).otherwise(F.lit(180.0))
    sure = F.when(~inside, F.lit(0.0)).when(angle < 60, 1 - angle / 60).when(angle > 120, (angle - 120) / 60).otherwise(F.lit(0.5))
    return found.select("image_id", "side", "n", angle.alias("tip_angle"), (angle < 90).alias("sharp"), sure.alias("sure"), "mean_turn")
