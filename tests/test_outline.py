"""Components of runs, hulls, ellipses and contours against the kernels and brute force."""

import math

import numpy as np
import pytest

from markwise.kernels import shapes
from markwise.operators import outline


def table(spark, masks):
    rows = [(name, int(x), int(y)) for name, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(rows, "image_id string, x int, y int").repartition(5)


def blobs(seed, shape=(24, 30), share=0.55):
    return np.random.default_rng(seed).random(shape) < share


def spiral(n=41):
    m = np.zeros((n, n), bool)
    y, x, dy, dx = 0, 0, 0, 1
    for _ in range(4 * n):
        m[y, x] = True
        ahead = (y + dy, x + dx)
        beyond = (y + 2 * dy, x + 2 * dx)
        if not (0 <= ahead[0] < n and 0 <= ahead[1] < n) or m[ahead] or (0 <= beyond[0] < n and 0 <= beyond[1] < n and m[beyond]):
            dy, dx = dx, -dy
            if m[min(n - 1, max(0, y + dy)), min(n - 1, max(0, x + dx))]:
                break
        y, x = y + dy, x + dx
    return m


def ellipse(angle, a=60.0, b=22.0, size=160):
    y, x = np.mgrid[0:size, 0:size] - size / 2
    t = math.radians(angle)
    u, v = x * math.cos(t) + y * math.sin(t), -x * math.sin(t) + y * math.cos(t)
    return (u / a) ** 2 + (v / b) ** 2 <= 1


@pytest.mark.parametrize("tile", [None, 4])
def test_components_are_those_of_the_kernel(spark, tile):
    masks = {f"m{k}": blobs(k, share=s) for k, s in enumerate((0.1, 0.3, 0.5, 0.9))} | {"s": spiral(), "one": np.eye(1, dtype=bool), "d": np.eye(9, dtype=bool)[:, ::-1]}
    rows = outline.largest(table(spark, masks), tile).collect()
    for name, m in masks.items():
        want = {(int(x), int(y)) for y, x in zip(*np.nonzero(shapes.largest_component(m)), strict=True)}
        assert {(r.x, r.y) for r in rows if r.image_id == name} == want, name
    assert len(rows) == len({(r.image_id, r.x, r.y) for r in rows})
    assert outline.largest(table(spark, masks).limit(0), tile).count() == 0


def test_without_diagonals(spark):
    got = outline.components(table(spark, {"d": np.eye(4, dtype=bool)}), diagonal=False)
    assert got.select("component").distinct().count() == 4


def test_hulls_and_farthest_pairs(spark):
    masks = {f"m{k}": blobs(k, share=s) for k, s in enumerate((0.02, 0.2, 0.6))}
    masks |= {"line": np.eye(12, dtype=bool), "square": np.ones((7, 7), bool), "one": np.eye(1, dtype=bool), "two": np.eye(2, dtype=bool), "row": np.ones((1, 9), bool)}
    points = table(spark, masks)
    pairs = {r.image_id: r for r in outline.farthest_pair(points).collect()}
    hulls = {}
    for r in outline.convex_hull(points).orderBy("image_id", "place").collect():
        hulls.setdefault(r.image_id, []).append((r.x, r.y))
    for name, m in masks.items():
        p = sorted((float(x), float(y)) for y, x in zip(*np.nonzero(m), strict=True))
        best = min((-((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2), a, b) for i, a in enumerate(p) for b in p[i:])
        r = pairs[name]
        assert (r.ax, r.ay, r.bx, r.by) == (*best[1], *best[2]) and r.distance == math.sqrt(-best[0]), name
        h = hulls[name]
        assert set(h) <= set(p) and len(h) == len(set(h)) and h[0] == p[0]
        for (ax, ay), (bx, by) in zip(h, h[1:] + h[:1], strict=True):
            assert all((bx - ax) * (y - ay) - (by - ay) * (x - ax) >= 0 for x, y in p), name
    assert sorted(hulls["square"]) == [(0, 0), (0, 6), (6, 0), (6, 6)]


def test_farthest_of_random_hulls():
    r = np.random.default_rng(1)
    for k in range(300):
        x = r.integers(0, int(r.integers(2, 30)), size=(int(r.integers(1, 40)), 2)).astype(float)
        p = sorted(map(tuple, x.tolist()))
        assert outline.farthest(outline.hull(x)) == min((-((a[0] - b[0]) ** 2 + (a[1] - b[1]) ** 2), a, b) for i, a in enumerate(p) for b in p[i:]), k


def test_only_hull_points_are_shuffled(spark):
    points = table(spark, {"a": np.ones((60, 60), bool)})
    assert outline.hull_points(points).count() <= 5 * 40
    plan = outline.farthest_pair(points)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("FlatMapGroupsInArrow") < plan.index("Exchange") < plan.index("MapInArrow partial")


def test_hull_points_of_scattered_pixels(spark):
    """However an image's pixels are dealt, two a row at most are left."""
    points = table(spark, {"a": np.ones((60, 60), bool)}).repartition(40, "x", "y")
    assert outline.hull_points(points).count() <= 120
    assert outline.convex_hull(points).count() == 4


def test_ellipses_within_a_pixel(spark):
    masks = {f"e{a}": ellipse(a) for a in range(0, 180, 25)} | {"disc": ellipse(0, 30, 30), "row": np.ones((1, 9), bool), "one": np.eye(1, dtype=bool)}
    got = {r.image_id: r for r in outline.fitted_ellipse(table(spark, masks)).collect()}
    for a in range(0, 180, 25):
        r = got[f"e{a}"]
        assert r.fitted and abs(r.major - 120) < 1 and abs(r.minor - 44) < 1 and abs(r.cx - 80) < 1 and abs(r.cy - 80) < 1
        assert min(abs(r.angle - a), 180 - abs(r.angle - a)) < 1
    assert abs(got["disc"].major - 60) < 1 and abs(got["disc"].minor - 60) < 1
    assert got["row"].fitted and 8 < got["row"].major < 12 and (got["one"].major, got["one"].fitted) == (0, False)


def test_contours_are_the_kernels(spark):
    masks = {f"m{k}": shapes.largest_component(blobs(k, share=s)) for k, s in enumerate((0.05, 0.3, 0.5, 0.7, 0.95))}
    masks |= {"s": spiral(), "one": np.eye(1, dtype=bool), "row": np.ones((1, 6), bool), "e": ellipse(30, 20, 8, 50), "full": np.ones((9, 9), bool)}
    corners = outline.contour(table(spark, masks)).cache()
    rows = corners.collect()
    for name, m in masks.items():
        got = [(r.x, r.y) for r in sorted((r for r in rows if r.image_id == name), key=lambda r: r.place)]
        assert got == [tuple(p) for p in shapes.outline(m).tolist()], name
    ends = {(r.image_id, r.side): r for r in outline.contour_ends(corners).collect()}
    for name, m in masks.items():
        p = shapes.outline(m).astype(float)
        if len(p) <= 10:
            assert (name, "first") not in ends
            continue
        n = max(5, len(p) // 7)
        for side, own in (("first", p[:n]), ("last", p[-n:])):
            sharp, angle, sure = shapes.tip_angle(own)
            r = ends[name, side]
            assert r.n == n and r.sharp == sharp and abs(r.tip_angle - angle) < 1e-6 and abs(r.sure - sure) < 1e-9
            assert abs(r.mean_turn - shapes.mean_turn(own)) < 1e-9


@pytest.mark.parametrize("tile", [1, 5, 16])
def test_contours_over_tiles(spark, tile):
    """Walks that leave their tiles and come back; where first pixels of tiles, and of images, stand alone."""
    masks = {f"m{k}": blobs(50 + k, (27, 31), s) for k, s in enumerate((0.02, 0.2, 0.4, 0.6, 0.97))} | {"s": spiral(), "one": np.eye(1, dtype=bool), "row": np.ones((1, 26), bool)}
    rows = outline.contour(table(spark, masks), tile).collect()
    for name, m in masks.items():
        named, _ = shapes.components(m)
        y, x = np.argwhere(m)[0]
        got = [(r.x, r.y) for r in sorted((r for r in rows if r.image_id == name), key=lambda r: r.place)]
        assert got == [tuple(p) for p in shapes.outline(named == named[y, x]).tolist()], name


def test_contours_inside_tiles_need_no_rounds(spark, monkeypatch):
    """However long a walk is, it is written once where it stays in its tile."""
    kept, write = [], outline._kept
    monkeypatch.setattr(outline, "_kept", lambda df, name: kept.append(name) or write(df, name))
    assert outline.contour(table(spark, {"s": spiral(), "full": np.ones((9, 9), bool)})).count() > 4
    assert len(kept) <= 2


@pytest.mark.parametrize(("tile", "size"), [(None, 7), (4, 7), (1, 3), (None, 128)])
def test_components_over_tiles(spark, monkeypatch, tile, size):
    """Components that lie in many tiles, at negative places too: every run as one scan of the mask finds it."""
    monkeypatch.setattr(outline, "TILE", size)
    masks = {f"m{k}": blobs(70 + k, (23, 29), s) for k, s in enumerate((0.1, 0.4, 0.6, 0.95))} | {"s": spiral()}
    pixels = table(spark, masks).selectExpr("image_id", "x - 5 as x", "y - 9 as y")
    rows = outline.components(pixels.union(pixels), tile).collect()
    for name, m in masks.items():
        label, n = shapes.components(m)
        own = [r for r in rows if r.image_id == name]
        got = {(x + 5, r.y + 9): r.component for r in own for x in range(r.x0, r.x1 + 1)}
        assert len(got) == m.sum() == sum(r.x1 - r.x0 + 1 for r in own)
        first = {int(k): (int(y) - 9) * (1 << 32) + int(x) - 5 for y, x in reversed(np.argwhere(m).tolist()) for k in [label[y, x]]}
        assert got == {(int(x), int(y)): first[int(label[y, x])] for y, x in np.argwhere(m).tolist()}
        if tile is None:
            assert len(own) == sum(len(shapes._runs(r)) for r in m)


def test_components_inside_tiles_need_no_rounds(spark, monkeypatch):
    kept, write = [], outline._kept
    monkeypatch.setattr(outline, "_kept", lambda df, name: kept.append(name) or write(df, name))
    assert outline.components(table(spark, {"s": spiral(), "m": blobs(3)}), 16).count() > 100
    assert kept == ["runs", "touching"]
