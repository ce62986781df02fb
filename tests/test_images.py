"""Kernels on shapes with known answers, image files, and whole runs."""

import numpy as np
import pytest

from markwise.kernels import png, shapes, signals
from markwise.kernels.sift import detect
from markwise.operators import images as im
from markwise.operators import orient, progress, ruler
from markwise.operators import pixels as px
from markwise.plans.matching import one_vs_many, pairwise
from markwise.sources import images, settings, tables
from markwise.sources.settings import Matching
from markwise.streaming import incremental


def ellipse(h, w, cx, cy, a, b, degrees=0.0):
    y, x = np.mgrid[0:h, 0:w]
    t = np.radians(degrees)
    u, v = (x - cx) * np.cos(t) + (y - cy) * np.sin(t), -(x - cx) * np.sin(t) + (y - cy) * np.cos(t)
    return (u / a) ** 2 + (v / b) ** 2 <= 1


def table(spark, masks):
    rows = [(k, int(x), int(y), 1.0) for k, m in masks.items() for y, x in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(rows, "image_id string, x int, y int, v double")


def spots(centers, h=160, w=160, r=5):
    out = np.zeros((h, w), np.uint8)
    y, x = np.mgrid[0:h, 0:w]
    for i, (cx, cy) in enumerate(centers):
        out[((x - cx) / (1 + i % 3 * 0.4)) ** 2 + (y - cy) ** 2 <= r * r] = 255 - 20 * (i % 4)
    return out


def test_orientation_of_ellipses(spark):
    angles = range(0, 180, 25)
    got = {r.image_id: r for r in px.moments(table(spark, {str(a): ellipse(160, 160, 80, 80, 60, 20, a) for a in angles})).collect()}
    for a in angles:
        r = got[str(a)]
        assert min(abs(r.angle - a), 180 - abs(r.angle - a)) < 0.6
        assert abs(r.cx - 80) < 1e-9 and abs(r.cy - 80) < 1e-9


def test_empty_masks_have_zeros(spark):
    found = px.with_empty(spark.createDataFrame([("none",)], "image_id string"), px.moments(table(spark, {"a": np.ones((2, 2))})))
    r = found.first()
    assert (r.area, r.cx, r.box_x) == (0, 0, 0)


def test_components():
    m = np.zeros((6, 8), bool)
    m[0, 0] = m[1, 1] = m[2, 2] = True  # touch at corners
    m[5, 5:7] = True
    assert shapes.components(m)[1] == 2
    assert shapes.largest_component(m).sum() == 3
    assert not shapes.largest_component(np.zeros((3, 3), bool)).any()


def test_largest_components_in_spark(spark):
    m = ellipse(40, 60, 30, 20, 20, 8)
    noisy = m.copy()
    noisy[1, 1] = True
    assert im.largest_components(table(spark, {"a": noisy})).count() == m.sum()


def test_lengths():
    bar = np.zeros((40, 140), bool)
    bar[15:24, 20:120] = True
    assert 88 <= shapes.medial_length(bar) <= 100
    assert shapes.box_length(bar) == 99
    assert abs(shapes.axis_length(ellipse(100, 200, 100, 50, 80, 30)) - 160) < 2
    y, x = np.mgrid[0:100, 0:100]
    arc = (np.hypot(x, y) > 75) & (np.hypot(x, y) < 85)
    assert 110 < shapes.medial_length(arc) < 140


def test_curvature_grows(spark):
    y, x = np.mgrid[0:100, 0:100]
    bar, arc = np.abs(y - 50) < 3, np.abs(np.hypot(x, y) - 80) < 3
    got = {r.image_id: r.mse for r in px.line_fit_mse(table(spark, {"bar": bar, "arc": arc})).collect()}
    assert got["bar"] < 5 < 50 < got["arc"]


@pytest.mark.parametrize("pitch", [16, 20, 40])
@pytest.mark.parametrize("tilt", [0, 5, -5])
def test_ruler(pitch, tilt):
    strip = np.full((80, 460), 220, np.uint8)
    for x in range(30, 440, pitch):
        strip[8:72, x : x + 3] = 20
    whole = shapes.rotate(strip, tilt, 220) if tilt else strip
    assert abs(signals.ruler_ticks(whole)[1] - pitch) <= 1.5


def test_ruler_without_ticks():
    assert signals.ruler_ticks(np.full((30, 100), 200, np.uint8))[1] == 0.0


def test_spacing_rules(spark):
    rows = [("a", t) for t in (0, 20, 40, 60, 80, 300)] + [("b", 5), ("c", 0), ("c", 5)]
    got = {r.series: r.spacing for r in ruler.tick_spacing(spark.createDataFrame(rows, "series string, t long")).collect()}
    assert got == {"a": 20.0, "b": 0.0, "c": 0.0}
    assert signals.tick_spacing(np.array([0, 20, 40, 60, 80, 300])) == 20.0


def test_smoothing_equals_kernel(spark):
    v = np.random.default_rng(1).normal(size=23)
    df = spark.createDataFrame([("s", i, float(x)) for i, x in enumerate(v)], "series string, t long, v double")
    got = [r.v for r in ruler.gaussian_smooth(df).orderBy("t").collect()]
    assert np.allclose(got, signals.gaussian(v, 2.0))


def test_no_scale_and_equal_scales(spark):
    one = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 0.0)], "image_id int, ppm double")
    assert ruler.scale_stats(one.where("ppm = 0")).first()["count"] == 0
    assert ruler.scale_outliers(one).count() == 0
    assert ruler.scale_stats(one).first()["std"] == 0


@pytest.mark.parametrize("right", [True, False])
@pytest.mark.parametrize("up", [True, False])
def test_head_and_back(spark, right, up):
    body = ellipse(100, 200, 100, 50, 80, 30)
    eye = ellipse(100, 200, 150 if right else 50, 38 if up else 62, 4, 4)
    b, e = table(spark, {"a": body}), table(spark, {"a": eye})
    assert orient.head_from_masks(b, e).first().head_right is right
    assert orient.dorsal_from_masks(b, e, e.where("false")).first().dorsal_up is up


def test_standardize_faces_right_and_up(spark):
    body = ellipse(120, 240, 120, 60, 90, 25, 30)
    t = np.radians(30)
    eye = ellipse(120, 240, 120 - 60 * np.cos(t) - 8 * np.sin(t), 60 - 60 * np.sin(t) + 8 * np.cos(t), 4, 4)
    image, mask, meta = im.standardize_one(np.where(body, 120, 10).astype(np.uint8), body, eye)
    assert meta["error"] is None and not meta["head_right"] and meta["rotated_180"]
    assert abs(meta["angle"] - 30) < 1
    assert mask.shape[1] > 2 * mask.shape[0] and image.shape == mask.shape


def test_features_and_identity():
    rng = np.random.default_rng(2)
    points, d = detect(spots(rng.uniform(20, 140, (9, 2))), contrast=0.01)
    assert len(points) == len(d) > 0 and d.shape[1] == 128
    assert detect(np.zeros((50, 50), np.uint8))[0] == []


def test_pipelines_find_the_shifted_image(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(3):
        c = rng.uniform(25, 125, (14, 2))
        for shift in (0, 10):
            x = spots(c + shift, r=4)
            rows.append((f"A{k}{'L' if shift else 'R'}", *x.shape, 1, x.tobytes()))
    pictures = spark.createDataFrame(rows, "image_id string, height int, width int, n_channels int, data binary")
    features = im.extract_features(pictures, contrast_threshold=0.01).cache()
    for plan in (one_vs_many, pairwise):
        best = plan(features, None, Matching(min_inliers=4)).where("rank = 1").collect()
        assert best and all(r.query_id[:2] == r.match_id[:2] for r in best), plan
    with pytest.raises(ValueError):
        im.extract_features(pictures, "surf")


def test_png_files_roundtrip(spark, tmp_path):
    rgb = np.random.default_rng(0).integers(0, 255, (9, 7, 3)).astype(np.uint8)
    rows = [("a", 9, 7, 3, rgb.tobytes()), ("b", 9, 7, 1, rgb[..., 0].tobytes())]
    df = spark.createDataFrame(rows, "image_id string, height int, width int, n_channels int, data binary")
    images.export(images.png_files(df), str(tmp_path / "x"))
    assert len(list((tmp_path / "x").glob("*.png"))) == 2
    got = {r.image_id: r for r in images.read(spark, str(tmp_path / "x")).collect()}
    assert bytes(got["a"].data) == rgb.tobytes() and bytes(got["b"].data) == rgb[..., 0].tobytes()
    assert images.scan(spark, str(tmp_path / "x"), "*.png").count() == 2


def test_orientation_tag():
    x = np.arange(6).reshape(2, 3)
    assert png.exif_orientation(b"\x89PNG") == 1
    tag = b"Exif\0\0MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x06\0\0\0\0\0\0"
    jpeg = b"\xff\xd8\xff\xe1" + (len(tag) + 2).to_bytes(2, "big") + tag
    assert png.exif_orientation(jpeg) == 6
    assert png.upright(x, 6).tolist() == [[3, 0], [4, 1], [5, 2]]
    assert png.upright(x, 3).tolist() == [[5, 4, 3], [2, 1, 0]]


def test_measures_and_error_codes(spark):
    h, w = 120, 480
    picture = np.full((h, w), 220, np.uint8)
    rule = np.zeros((h, w), np.uint8)
    rule[10:60, 20:460] = 1
    for x in range(30, 450, 20):
        picture[14:56, x : x + 3] = 20
    fish = ellipse(h, w, 200, 90, 80, 15).astype(np.uint8)
    flat = np.full((h, w), 220, np.uint8)
    rows = [("ok", h, w, 1, picture.tobytes()), ("none", h, w, 1, picture.tobytes()), ("flat", h, w, 1, flat.tobytes()), ("size", h, w, 1, picture.tobytes())]
    mask = lambda i, p, m: (i, p, m.shape[0], m.shape[1], int(m.sum()), m.tobytes())
    masks = [mask("ok", "ruler", rule), mask("ok", "whole fish", fish), mask("flat", "ruler", rule), mask("size", "ruler", rule[:50])]
    pictures = spark.createDataFrame(rows, "image_id string, height int, width int, n_channels int, data binary")
    got = {r.image_id: r for r in im.measure(pictures, spark.createDataFrame(masks, "image_id string, prompt string, height int, width int, area long, mask binary")).collect()}
    assert abs(got["ok"].pixels_per_mm - 20) <= 1 and abs(got["ok"].fish_length_px - 160) < 4 and got["ok"].extraction_error is None
    assert [got[k].extraction_error for k in ("none", "flat", "size")] == ["no_ruler_detected", "no_ticks_detected", "dimension_mismatch"]


def test_required_steps(spark):
    rows = [(f"{s}{m}{t}", bool(s), bool(m), bool(t), False) for s in (0, 1) for m in (0, 1) for t in (0, 1)]
    df = spark.createDataFrame(rows, "image_id string, segmentation boolean, metrics boolean, standardization boolean, qa_plots boolean")
    for extract in (True, False):
        for stand in (True, False):
            for force in (True, False):
                for r in progress.required_steps(df, extract, stand, force).collect():
                    seg, met, std = r.segmentation, r.metrics, r.standardization
                    want = (True, extract, stand) if force else ((extract and not seg) or (stand and not std and not seg), extract and (not seg or not met), stand and not std)
                    assert (r.need_segmentation, r.need_metrics, r.need_standardization) == want


def test_results_files(spark, tmp_path):
    df = spark.createDataFrame([("A1L", "A2R", 3.5, 0.5, 3, 6), ("A1L", "A3R", 9.0, None, 9, 0)], "query_id string, match_id string, score double, lnbnn_score double, inliers long, total_matches long")
    tables.write_results(df, str(tmp_path / "r"))
    back = tables.read_results(spark, str(tmp_path / "r"))
    from markwise.operators.results import flatten

    flat = flatten(back)
    tables.write_csv(flat, str(tmp_path / "c"))
    rows = tables.read_csv(spark, str(tmp_path / "c")).orderBy("match_id").collect()
    assert [(r.match_id, r.inlier_ratio, r.lnbnn_score) for r in rows] == [("A2R", 0.5, 0.5), ("A3R", 0.0, None)]


def test_stream_of_files(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    step = lambda b: b.selectExpr("image_id", "length(content) AS n")
    for k in (1, 2):
        (folder / f"x{k}.png").write_bytes(b"a" * k)
        incremental.append_each(incremental.new_files(spark, str(folder)), step, target, str(tmp_path / "cp")).awaitTermination()
    assert {(r.image_id, r.n) for r in incremental.current(spark, target, "image_id").collect()} == {("x1", 1), ("x2", 2)}


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("matching: {k: 7, unknown: 1}")
    assert settings.matching(settings.load(str(tmp_path / "c.yaml"))).k == 7
    assert settings.resolve("a/b", "/base/") == "/base/a/b" and settings.resolve("/a", "/base") == "/a"


PICTURE = "image_id string, height int, width int, n_channels int, data binary"
MASK = "image_id string, prompt string, height int, width int, area long, mask binary"


def as_mask(i, p, m):
    return (i, p, m.shape[0], m.shape[1], int(m.sum()), m.astype(np.uint8).tobytes())


def animal(right=True, h=120, w=480):
    """A scene with a ruler of 20 px, an animal with an eye, and its masks."""
    picture, rule = np.full((h, w), 220, np.uint8), np.zeros((h, w), bool)
    rule[4:44, 20:460] = True
    for x in range(30, 450, 20):
        picture[6:42, x : x + 3] = 20
    fish, eye = ellipse(h, w, 200, 85, 90, 22), ellipse(h, w, 260 if right else 140, 78, 4, 4)
    rng = np.random.default_rng(1)
    picture[fish] = 130
    for cx, cy in zip(rng.uniform(130, 270, 16), rng.uniform(72, 98, 16), strict=True):
        picture[ellipse(h, w, cx, cy, 3, 3) & fish] = 230
    picture[eye] = 15
    return picture, {"ruler": rule, "whole fish": fish, "fish eye": eye}


def test_names_of_masks(spark):
    names = {"IMG_1234_whole_fish_mask": ("IMG_1234", "whole fish"), "a_fish_eye_mask": ("a", "fish eye"), "a_b_fish_mask": ("a_b", "fish"), "x_ruler_mask": ("x", "ruler"), "a_tail_mask": ("a", "tail"), "plain_mask": ("plain", "")}
    assert {n: images.mask_name(n) for n in names} == names
    columns = images.mask_names(images.F.col("n"))
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", *[c.alias(a) for c, a in zip(columns, ("i", "p"), strict=True)]).collect()
    assert {r.n: (r.i, r.p.replace("_", " ")) for r in got} == {n: x if x[1] in images.PROMPTS else ("", "") for n, x in names.items()}


def test_masks_without_pixels(spark):
    masks = spark.createDataFrame([("a", "fish", 0, 0, 0, b""), as_mask("b", "fish", np.zeros((2, 3), bool)), as_mask("c", "fish", np.eye(3, dtype=bool))], MASK)
    assert sorted((r.image_id, r.x, r.y) for r in im.mask_pixels(masks).collect()) == [("c", i, i) for i in range(3)]


def test_outline_and_tips():
    m = np.zeros((9, 12), bool)
    m[2:7, 3:10] = True
    assert shapes.outline(m).tolist() == [[3, 2], [3, 6], [9, 6], [9, 2]]
    assert shapes.outline(np.zeros((3, 3), bool)).shape == (0, 2) and len(shapes.outline(np.eye(1, dtype=bool))) == 1
    sharp, angle, sure = shapes.tip_angle(np.array([[0, 0], [4, 1], [8, 2], [4, 3], [0, 4]]))
    assert sharp and 0 < angle < 60 and abs(sure - (1 - angle / 60)) < 1e-9
    square = np.array([[0, 0], [0, 9], [9, 9], [9, 0]])
    assert abs(shapes.mean_turn(square) - np.pi / 2) < 1e-9 and shapes.tip_angle(square) == (False, 180.0, 0.0)
    assert shapes.tail_shape(np.zeros((5, 5), bool)) == (None, 0.0)
    side, sure = shapes.tail_shape(ellipse(80, 200, 100, 40, 80, 25))
    assert side in (True, False) and 0 <= sure <= 1


def test_votes_of_the_picture(spark):
    """A dark, round spot in the left part: the head is left and the back is up; the votes reach the shape's decision."""
    h, w = 100, 220
    body, eye = ellipse(h, w, 110, 50, 90, 30), ellipse(h, w, 45, 42, 10, 10)
    body |= ellipse(h, w, 120, 18, 12, 9)
    gray = np.random.default_rng(0).normal(160, 12, (h, w)).astype(np.uint8)
    gray[eye] = 10
    votes = im.votes_of(gray, body)
    assert votes["eye_left"] and votes["eye_top"] and votes["eye_confidence"] > 0.3
    assert votes["fin_top"] and votes["fin_confidence"] > 0
    blank = im.votes_of(gray, np.zeros((h, w), bool))
    assert blank["eye_left"] is None and blank["fin_top"] is None and blank["eye_confidence"] == 0
    pictures = spark.createDataFrame([("a", h, w, 1, gray.tobytes()), ("b", h, w, 1, gray.tobytes())], PICTURE)
    masks = spark.createDataFrame([as_mask("a", "fish", body)], MASK)
    got = im.image_votes(pictures, masks).collect()
    assert len(got) == 1 and got[0].eye_left
    assert [(r.image_id, r.head_left) for r in im.heads(pictures, masks).collect()] == [("a", True)]
    back = orient.dorsal_from_shape(table(spark, {"a": body}), im.image_votes(pictures, masks).select("image_id", "eye_top", "eye_confidence"), im.image_votes(pictures, masks).select("image_id", "fin_top", "fin_confidence"))
    assert back.first().dorsal_up


def test_votes_in_a_task_are_those_of_the_table(spark):
    """head_votes and back_votes against the column expressions, on lopsided shapes."""
    rng = np.random.default_rng(3)
    masks, votes = {}, {}
    for k in range(12):
        m = ellipse(60, 140, 70, 30, 50, 15) | ellipse(60, 140, 30 + rng.integers(0, 80), 20 + rng.integers(0, 20), 8 + rng.integers(0, 14), 6 + rng.integers(0, 10))
        masks[f"m{k}"], on = m, lambda: bool(rng.random() < 0.5) if rng.random() < 0.6 else None
        v = {"eye_left": on(), "eye_top": on(), "fin_top": on(), "head_left_by_tail": on()}
        eye, fin, tail = rng.random(3).round(3).tolist()
        if v["eye_left"] is None or v["eye_top"] is None:
            v["eye_left"] = v["eye_top"] = None
        votes[f"m{k}"] = v | {"eye_confidence": eye if v["eye_left"] is not None else 0.0, "fin_confidence": fin if v["fin_top"] is not None else 0.0, "tail_confidence": tail if v["head_left_by_tail"] is not None else 0.0}
    names = [c.split()[0] for c in im.VOTES.split(", ")][1:]
    t = spark.createDataFrame([(k, *[v[n] for n in names]) for k, v in votes.items()], im.VOTES)
    body = table(spark, masks)
    heads = {r.image_id: r for r in orient.head_from_shape(body, t.select("image_id", "eye_left", "eye_confidence"), t.select("image_id", "head_left_by_tail", "tail_confidence")).collect()}
    backs = {r.image_id: r for r in orient.dorsal_from_shape(body, t.select("image_id", "eye_top", "eye_confidence"), t.select("image_id", "fin_top", "fin_confidence")).collect()}
    for k, m in masks.items():
        edge = [e[m.any(0)].astype(float).std() for e in (m.argmax(0), m[::-1].argmax(0))]
        if abs(edge[0] - edge[1]) < 1e-9:  # edges of one roughness: sums in another order decide
            continue
        head, sure = im.head_votes(m, votes[k])
        assert head == heads[k].head_left and abs(sure - heads[k].confidence) < 1e-9, k
        up, sure = im.back_votes(m, votes[k])
        assert up == backs[k].dorsal_up and abs(sure - backs[k].confidence) < 1e-9, k


def test_standardize_without_an_eye_mask():
    """The picture's eye decides, and says so."""
    h, w = 100, 240
    body, eye = ellipse(h, w, 120, 50, 100, 30), ellipse(h, w, 45, 42, 10, 10)
    gray = np.random.default_rng(0).normal(160, 12, (h, w)).astype(np.uint8)
    gray[eye] = 10
    _, _, meta = im.standardize_one(gray, body)
    assert meta["head_method"] == "image_votes" and not meta["head_right"] and meta["rotated_180"]


def test_model_input():
    x = im.model_input(np.full((50, 30), 255, np.uint8))
    assert x.shape == (3, 224, 224) and np.allclose(x[:, 0, 0], [(1 - m) / d for m, d in zip(im.MEAN, im.DEVIATION, strict=True)], atol=1e-5)
    ramp = np.repeat(np.arange(224, dtype=np.uint8)[None, :, None], 224, 0).repeat(3, 2)
    assert np.allclose(im.model_input(ramp)[0, 0], (np.arange(224) / 255 - im.MEAN[0]) / im.DEVIATION[0], atol=1e-4)


def test_models_over_tables(spark):
    class Mean:
        name = "mean"

        def embed(self, x):
            return x.mean((1, 2))

    class Bright:
        def segment(self, image, prompts):
            return {prompts[0]: [(0.9, image > 100), (0.2, image >= 0)], prompts[1]: [(0.1, image > 0)]}

    picture, _ = animal()
    pictures = spark.createDataFrame([("a", *picture.shape, 1, picture.tobytes())], PICTURE)
    got = im.embed(pictures, Mean).first()
    assert got.model == "mean" and len(got.embedding) == 3 and got.error is None
    found = {r.prompt: r for r in im.segment(pictures, Bright, ["fish", "ruler"]).collect()}
    assert found["fish"].area == int((picture > 100).sum()) and found["ruler"].area == 0
    both = im.fish_and_ruler(pictures, Bright).first()
    assert (both.fish_area, both.ruler_area, len(both.fish), any(both.ruler)) == (found["fish"].area, 0, picture.size, False)
    assert "licence" in str(im.NoAccess("a model", "gated")) and isinstance(im.NoAccess("x"), PermissionError)


@pytest.mark.parametrize("few", [10_000, 0])
@pytest.mark.parametrize("kind", ["spread", "ties", "one", "none"])
def test_exact_quantiles(spark, monkeypatch, few, kind):
    monkeypatch.setattr(ruler, "FEW", few if kind == "spread" or few else 1)
    rng = np.random.default_rng(1)
    v = {"spread": rng.lognormal(size=3001), "ties": rng.integers(0, 4, 2000).astype(float), "one": np.array([7.5]), "none": np.zeros(0)}[kind]
    df = spark.createDataFrame([(float(x),) for x in v] + [(None,)], "x double").repartition(3)
    for p in (0.25, 0.5, 0.75, 0.0, 1.0):
        got = ruler.quantile(df, "x", p).first()["quantile"]
        assert got is None if kind == "none" else abs(got - np.percentile(v, 100 * p)) < 1e-9, (kind, p)


def test_data_of_figures(spark):
    picture, own = animal()
    pictures = spark.createDataFrame([("a", *picture.shape, 1, picture.tobytes())], PICTURE)
    masks = spark.createDataFrame([as_mask("a", p, m) for p, m in own.items()], MASK)
    ticks = im.ruler_ticks(pictures, masks).orderBy("tick").collect()
    assert len(ticks) > 15 and abs(ticks[0].pixels_per_mm - 20) <= 1 and 15 <= ticks[1].x - ticks[0].x <= 25
    blend = {r.prompt: r for r in im.overlays(pictures, masks).collect()}["whole fish"]
    x = im.array(blend.height, blend.width, 3, blend.data)
    y0, x0 = 85, 200
    assert x[y0, x0].tolist() == np.rint(picture[y0, x0] * 0.7 + np.array([0, 255, 0]) * 0.3).astype(int).tolist() and x[0, 0].tolist() == [220] * 3
    points = spark.createDataFrame([("a", 0, 10.0, 20.0, 4.0)], "image_id string, local_idx int, x double, y double, size double")
    assert im.scaled_points(points, 0.5).first()[2:] == (5.0, 10.0, 2.0)
    im.check_panels({"a": 1}, {"a"})
    with pytest.raises(ValueError, match="missing"):
        im.check_panels({"a": 1, "c": 2}, {"a", "b"})


@pytest.mark.parametrize("most", [10, 0])
def test_turned_files(spark, tmp_path, most):
    """A JPEG with an orientation tag is turned, whether its tag is sent or joined."""
    picture = spark._jvm.java.awt.image.BufferedImage(16, 8, 5)
    for x in range(8):
        for y in range(8):
            picture.setRGB(x, y, 0xFFFFFF)
    spark._jvm.javax.imageio.ImageIO.write(picture, "jpg", spark._jvm.java.io.File(str(tmp_path / "a.jpg")))
    plain = (tmp_path / "a.jpg").read_bytes()
    tag = b"Exif\0\0MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x06\0\0\0\0\0\0"
    (tmp_path / "b.jpg").write_bytes(plain[:2] + b"\xff\xe1" + (len(tag) + 2).to_bytes(2, "big") + tag + plain[2:])
    got = {r.image_id: im.array(r.height, r.width, 3, r.data) for r in images.read(spark, str(tmp_path), most_turned=most).collect()}
    assert got["a"].shape == (8, 16, 3) and got["a"][0, 0, 0] > 250 > 5 > got["a"][0, 15, 0]
    assert got["b"].tolist() == png.upright(got["a"], 6).tolist() and got["b"].shape == (16, 8, 3)


def test_files_that_are_no_images(spark, tmp_path):
    (tmp_path / "x.png").write_bytes(png.encode(np.zeros((3, 3), np.uint8)))
    (tmp_path / "y.png").write_bytes(b"nothing")
    assert [r.image_id for r in images.read(spark, str(tmp_path)).collect()] == ["x"]
    assert [(r.image_id, r.error) for r in images.unreadable(spark, str(tmp_path)).collect()] == [("y", "not an image")]


def test_process_match_and_again(spark, tmp_path):
    """Raw images and masks to metrics, standardized images and matches; a second run finds nothing to do."""
    from markwise.plans import cli

    raw, masks = tmp_path / "raw", tmp_path / "masks"
    raw.mkdir(), masks.mkdir()
    for name, right in (("JAVR0001", True), ("JAVR0002", False), ("CSDD_0003L", True)):
        picture, own = animal(right)
        (raw / f"{name}.png").write_bytes(png.encode(picture))
        for p, m in own.items():
            (masks / f"{name}_{p.replace(' ', '_')}_mask.png").write_bytes(png.encode((m * 255).astype(np.uint8)))
    (raw / "broken.png").write_bytes(b"no image")
    folder = lambda n: str(tmp_path / n)
    (tmp_path / "c.yaml").write_text(f"data:\n  raw_dir: {raw}\n  masks_dir: {masks}\n  metadata_dir: {folder('meta')}\n  standardized_dir: {folder('std')}\nmatching:\n  min_inliers: 3\n")
    args = ["process", "--config", folder("c.yaml"), "--qa-dir", folder("qa")]
    assert cli.main(args) == 0
    read = lambda: {r.image_id: r for r in spark.read.schema(im.METRICS).json(folder("meta/metrics")).collect()}
    first = read()
    assert set(first) == {"JAVR0001", "JAVR0002", "CSDD_0003L", "broken"} and first["broken"].extraction_error == "not an image"
    assert all(abs(r.pixels_per_mm - 20) <= 1 for k, r in first.items() if k != "broken")
    made = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "std").iterdir()}
    assert {n for n in made if n.endswith("_standardized.png")} == {f"{k}_standardized.png" for k in first if k != "broken"} and len(made) == 6
    (raw / "broken.png").unlink()
    assert cli.main(args) == 0
    assert {p.name: p.stat().st_mtime_ns for p in (tmp_path / "std").iterdir()} == made and read() == first
    assert cli.main([*args, "--no-skip-existing"]) == 0
    assert {p.name for p in (tmp_path / "std").iterdir()} == set(made) and any(p.stat().st_mtime_ns != made[p.name] for p in (tmp_path / "std").iterdir())
    match = ["match", "--config", folder("c.yaml"), "--standardized-dir", folder("std"), "--features-dir", folder("features"), "--output-dir", folder("out")]
    for _ in range(2):
        assert cli.main(match) == 0
    found = spark.read.parquet(folder("features"))
    assert found.select("image_id").distinct().count() == 3 and found.groupBy("image_id", "local_idx").count().where("count > 1").count() == 0
    assert tables.read_csv(spark, folder("out/matches.csv")).count() > 0
    with pytest.raises(ValueError, match="no image"):
        cli.main([*match, "--query", "nobody"])
    assert cli.main(["rename", "--images-dir", str(raw), "--masks-dir", str(masks), "--output", folder("names")]) == 0
    plan = {r.old_name: r.head_direction for r in spark.read.json(folder("names")).collect()}
    assert plan == {"JAVR0001": "R", "JAVR0002": "L"}


def test_deviations_are_summed_up_in_order_whatever_the_partitions(spark):
    """Edges of equal deviation decide by the last bit, which must be that of one fold in order of x."""
    r = np.random.default_rng(4)
    edges = {k: (r.integers(0, 9, 40), r.integers(20, 61, 40)) for k in range(30)}
    rows = [(k, x, int(y)) for k, pair in edges.items() for edge in pair for x, y in enumerate(edge)]
    r.shuffle(rows)

    def literal(values):
        n, mean, squares = 0.0, 0.0, 0.0
        for v in map(float, values):
            n, new = n + 1, mean + (v - mean) / (n + 1)
            mean, squares = new, squares + (v - new) * (v - mean)
        return (squares / n) ** 0.5

    got = px.edge_roughness(spark.createDataFrame([tuple(map(int, x)) for x in rows], "image_id long, x int, y int").repartition(7)).collect()
    assert {(x.image_id, x.top_roughness, x.bottom_roughness) for x in got} == {(k, literal(a), literal(b)) for k, (a, b) in edges.items()}
