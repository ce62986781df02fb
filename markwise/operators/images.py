"""Kernels over tables of images: one row in, one or many rows out; failures are rows with an error, never lost.

images: (image_id, height, width, n_channels, data), gray or RGB bytes, as sources.images gives them;
masks: (image_id, prompt, height, width, mask), one byte per pixel.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markwise.kernels import shapes, signals
from markwise.kernels.sift import detect

METHODS = ("sift", "rootsift")
# Mean and deviation of the channels that embedding models were trained with.
MEAN = (0.485, 0.456, 0.406)
DEVIATION = (0.229, 0.224, 0.225)
FEATURES = "image_id string, local_idx int, x float, y float, size float, angle float, response float, octave int, d array<float>, error string"
METRICS = "image_id string, pixels_per_mm double, fish_length_px double, fish_length_mm double, x_min int, y_min int, x_max int, y_max int, length_method string, ruler_detected boolean, extraction_error string"


class Segmenter(Protocol):
    """A model of masks from text prompts; loaded once per worker."""

    def segment(self, image: np.ndarray, prompts: list[str]) -> dict[str, list[tuple[float, np.ndarray]]]:
        """Confidence and mask of each detection, by prompt."""


def array(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    out = np.frombuffer(data, np.uint8).reshape(height, width, -1)[:, :, :channels]
    return out[:, :, 0] if channels == 1 else out


def to_gray(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else np.rint(image[..., :3] @ np.array([0.299, 0.587, 0.114])).astype(np.uint8)


def segment(images: DataFrame, segmenter: type, prompts: list[str], confidence: float = 0.5) -> DataFrame:
    """masks: the union of the detections above the confidence; without one an empty mask. segmenter() is made in the worker."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = segmenter()
        for part in parts:
            rows = []
            for r in part.itertuples():
                found = model.segment(array(r.height, r.width, r.n_channels, r.data), prompts)
                for p in prompts:
                    out = np.zeros((r.height, r.width), bool)
                    for sure, m in found.get(p, []):
                        if sure >= confidence:
                            if m.shape != out.shape:
                                y, x = (np.arange(n) * s // n for n, s in zip(out.shape, m.shape, strict=True))
                                m = m[y][:, x]
                            out |= m.astype(bool)
                    rows.append((r.image_id, p, r.height, r.width, int(out.sum()), out.astype(np.uint8).tobytes()))
            yield pd.DataFrame(rows, columns=["image_id", "prompt", "height", "width", "area", "mask"])

    return images.mapInPandas(run, "image_id string, prompt string, height int, width int, area long, mask binary")


class NoAccess(PermissionError):
    """A model's weights need a licence or a login that this environment hasn't."""

    def __init__(self, model: str, reason: str = "") -> None:
        super().__init__(f"no access to {model}{': ' + reason if reason else ''}. Accept its licence where it is published, log in, and check with the command `report`.")


def fish_and_ruler(images: DataFrame, segmenter: type, confidence: float = 0.5) -> DataFrame:
    """(image_id, fish, ruler, fish_area, ruler_area): both masks of each image in one row; empty ones where nothing was found."""
    found = segment(images, segmenter, ["fish", "ruler"], confidence)
    pick = lambda c, p: F.max_by(c, F.col("prompt") == p)
    return found.groupBy("image_id").agg(pick("mask", "fish").alias("fish"), pick("mask", "ruler").alias("ruler"), pick("area", "fish").alias("fish_area"), pick("area", "ruler").alias("ruler_area"))


def model_input(image: np.ndarray, size: int = 224) -> np.ndarray:
    """(3, size, size) as embedding models take it: resized bilinearly, channel by channel less the mean, over the deviation."""
    rgb = np.repeat(image[:, :, None], 3, 2) if image.ndim == 2 else image[:, :, :3]
    x = rgb.astype(np.float32) / 255
    for axis in (0, 1):
        n = x.shape[axis]
        at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
        low = np.minimum(at.astype(int), max(0, n - 2))
        part = (at - low).astype(np.float32).reshape([-1 if a == axis else 1 for a in range(3)])
        x = np.take(x, low, axis) * (1 - part) + np.take(x, np.minimum(low + 1, n - 1), axis) * part
    return ((x - np.array(MEAN, np.float32)) / np.array(DEVIATION, np.float32)).transpose(2, 0, 1)


def embed(images: DataFrame, embedder: type) -> DataFrame:
    """(image_id, model, embedding, error); embedder() is made in the worker and has name and embed(model_input)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = embedder()
        for part in parts:
            rows = []
            for r in part.itertuples():
                try:
                    rows.append((r.image_id, model.name, np.asarray(model.embed(model_input(array(r.height, r.width, r.n_channels, r.data))), np.float32).ravel().tolist(), None))
                except Exception as e:
                    rows.append((r.image_id, model.name, [], str(e)))
            yield pd.DataFrame(rows, columns=["image_id", "model", "embedding", "error"])

    return images.mapInPandas(run, "image_id string, model string, embedding array<float>, error string")


def mask_pixels(masks: DataFrame) -> DataFrame:
    """The relational view of masks: one row per pixel that is set."""
    every = F.when(F.length("mask") > 0, F.sequence(F.lit(0), F.length("mask") - 1)).otherwise(F.array().cast("array<int>"))
    places = F.explode(F.filter(every, lambda i: F.substr("mask", i + 1, F.lit(1)) != F.lit(b"\x00")))
    return masks.select("image_id", "prompt", "width", places.alias("i")).select("image_id", "prompt", (F.col("i") % F.col("width")).alias("x"), F.floor(F.col("i") / F.col("width")).cast("int").alias("y"))


def extract_features(images: DataFrame, method: str = "sift", n_features: int = 0, contrast_threshold: float = 0.04, edge_threshold: float = 10.0, sigma: float = 1.6) -> DataFrame:
    """Key points and descriptors, one row each; an image without any has one row without a local index."""
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in FEATURES.split(", ")]
        for part in parts:
            for r in part.itertuples():
                try:
                    points, d = detect(to_gray(array(r.height, r.width, r.n_channels, r.data)), None, n_features, contrast_threshold, edge_threshold, sigma)
                    if method == "rootsift":
                        d = np.sqrt(d / (d.sum(1, keepdims=True) + 1e-7))
                    rows = [(r.image_id, i, *p, v.tolist(), None) for i, (p, v) in enumerate(zip(points, d, strict=True))]
                    yield pd.DataFrame(rows or [(r.image_id, *[None] * 9)], columns=names)
                except Exception as e:
                    yield pd.DataFrame([(r.image_id, *[None] * 8, str(e))], columns=names)

    return images.mapInPandas(run, FEATURES)


def cached_features(images: DataFrame, cached: DataFrame | None, force: bool = False, **options) -> DataFrame:
    """Cached rows of the images that have them, and new ones of the others; force: all anew."""
    if cached is None or force:
        return extract_features(images, **options)
    own = images.select("image_id").distinct()
    return cached.join(own, "image_id", "left_semi").unionByName(extract_features(uncached(images, cached), **options))


def uncached(images: DataFrame, cached: DataFrame) -> DataFrame:
    return images.join(cached.select("image_id").distinct(), "image_id", "left_anti")


def largest_components(pixels: DataFrame) -> DataFrame:
    """The pixels (image_id, x, y) of each image's largest 8-connected component; a group is one mask."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = p["x"].min(), p["y"].min()
        m = np.zeros((p["y"].max() - y0 + 1, p["x"].max() - x0 + 1), bool)
        m[p["y"] - y0, p["x"] - x0] = True
        y, x = np.nonzero(shapes.largest_component(m))
        return pd.DataFrame({"image_id": p["image_id"].iloc[0], "x": x + x0, "y": y + y0})

    kind = pixels.schema["image_id"].dataType.simpleString()
    return pixels.select("image_id", "x", "y").groupBy("image_id").applyInPandas(run, f"image_id {kind}, x int, y int")


def _measure(r, method: str, margin: int = 10) -> tuple:
    image, fish, ruler = array(r.height, r.width, r.n_channels, r.data), r.fish, r.ruler
    none = (0.0, 0.0, 0.0, None, None, None, None, None)
    if ruler is None or not any(ruler):
        return (r.image_id, *none, False, "no_ruler_detected")
    if r.ruler_height * r.ruler_width != len(ruler) or (r.ruler_height, r.ruler_width) != (r.height, r.width):
        return (r.image_id, *none, True, "dimension_mismatch")
    m = np.frombuffer(ruler, np.uint8).reshape(r.height, r.width) > 0
    ys, xs = np.nonzero(m)
    x0, y0, x1, y1 = max(0, xs.min() - margin), max(0, ys.min() - margin), min(r.width, xs.max() + margin), min(r.height, ys.max() + margin)
    roi = to_gray(image)[y0:y1, x0:x1]
    if not roi.size:
        return (r.image_id, *none, True, "roi_extraction_failed")
    box = (int(x0), int(y0), int(x1), int(y1))
    _, per_mm = signals.ruler_ticks(roi)
    if not per_mm:
        return (r.image_id, 0.0, 0.0, 0.0, *box, None, True, "no_ticks_detected")
    body = np.frombuffer(fish, np.uint8).reshape(r.height, r.width) > 0 if fish else np.zeros((r.height, r.width), bool)
    length = {"medial_axis": shapes.medial_length, "bounding_box": shapes.box_length, "major_axis": shapes.axis_length}[method](body)
    return (r.image_id, per_mm, length, length / per_mm, *box, method, True, None)


def measure(images: DataFrame, masks: DataFrame, method: str = "major_axis", fish: tuple[str, ...] = ("whole fish", "fish"), ruler: str = "ruler", margin: int = 10) -> DataFrame:
    """Scale and length of each image; method: medial_axis, bounding_box or major_axis. The first prompt of fish counts.

    margin: pixels around the ruler's mask that are looked at with it.
    """
    if method not in ("medial_axis", "bounding_box", "major_axis"):
        raise ValueError(f"unknown method {method!r}")
    order = F.array_position(F.lit(list(fish)), F.col("prompt"))
    body = masks.where(F.col("prompt").isin(list(fish))).groupBy("image_id").agg(F.min_by("mask", order).alias("fish"))
    rule = masks.where(F.col("prompt") == ruler).groupBy("image_id").agg(F.first("mask").alias("ruler"), F.first("height").alias("ruler_height"), F.first("width").alias("ruler_width"))
    j = images.join(body, "image_id", "left").join(rule, "image_id", "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in METRICS.split(", ")]
        for part in parts:
            rows = []
            for r in part.itertuples():
                try:
                    rows.append(_measure(r, method, margin))
                except Exception as e:
                    rows.append((r.image_id, 0.0, 0.0, 0.0, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=names)

    return j.mapInPandas(run, METRICS)


STANDARD = "image_id string, height int, width int, n_channels int, data binary, mask binary, angle double, curvature_mse double, straight boolean, head_method string, head_right boolean, head_confidence double, rotated_180 boolean, dorsal_method string, dorsal_up boolean, dorsal_confidence double, flipped boolean, valid boolean, score double, error string"


def _head(m: np.ndarray, eye: np.ndarray | None, gray: np.ndarray | None) -> tuple[str, bool, float]:
    """By the eye's mask; without one by the votes of the picture and the shape."""
    if eye is not None and eye.sum() > 10:
        d = np.nonzero(eye)[1].mean() - np.nonzero(m)[1].mean()
        return "eye_mask", bool(d > 0), min(1.0, 2 * abs(d) / max(1, int(m.any(0).sum())))
    left, sure = head_votes(m, votes_of(gray, m))
    return "image_votes", not left, sure


def _profile(m: np.ndarray, axis: int) -> np.ndarray:
    wide = m.sum(axis).astype(float)
    at = np.flatnonzero(wide)
    return wide[at[0] : at[-1] + 1] if len(at) else wide


def _ballot(votes: list[tuple[bool | None, int]]) -> tuple[bool, float]:
    """Whether yes has more weight than no, and by what share of all."""
    yes, no = (sum(w for on, w in votes if on is side) for side in (True, False))
    return yes > no, abs(yes - no) / max(1, yes + no)


def head_votes(m: np.ndarray, v: dict, flare: float = 1.2) -> tuple[bool, float]:
    """Head is left, and a confidence: orient.head_from_shape for one mask and votes_of() it."""
    p, xs = _profile(m, 0), np.nonzero(m)[1]
    half, k = len(p) // 2, max(1, len(p) // 10)
    mean = lambda x: float(x.mean()) if len(x) else 0.0
    left, right = mean(p[:k]) > mean(p[k : 2 * k]) * flare, mean(p[::-1][:k]) > mean(p[::-1][k : 2 * k]) * flare
    eye, tail = v["eye_confidence"], v["tail_confidence"]
    votes = [(v["eye_left"], int(eye * 5) + 3), (bool(xs.mean() < (xs.min() + xs.max()) / 2), 1), (mean(p[:half]) > mean(p[half:]), 1), (right if left != right else None, 2), (v["head_left_by_tail"], int(tail * 2) + 2)]
    head, margin = _ballot(votes)
    sure = eye * 0.5 + tail * 0.3 + margin * 0.2 if eye > 0 else tail * 0.6 + margin * 0.4 if tail > 0.5 else margin
    sure = min(1.0, sure * 1.2) if left != right else sure
    return head, min(1.0, sure * 1.15) if tail > 0.7 else sure


def back_votes(m: np.ndarray, v: dict) -> tuple[bool, float]:
    """The back is up, and a confidence: orient.dorsal_from_shape for one mask and votes_of() it."""
    p = _profile(m, 1)
    if len(p) <= 1:
        return True, 0.5
    half, columns = len(p) // 2, np.flatnonzero(m.any(0))
    a, b = (float(x.std()) if len(x) else 0.0 for x in (p[:half], p[half:]))
    top, bottom = m.argmax(0)[columns].astype(float), m.shape[0] - 1 - m[::-1].argmax(0)[columns].astype(float)
    bend = [sign * float(e[-1] - e[-2] - e[1] + e[0]) / (len(e) - 2) if len(e) > 2 else 0.0 for sign, e in ((-1, top), (1, bottom))]
    eye, fin = v["eye_confidence"], v["fin_confidence"]
    votes = [(v["eye_top"], int(eye * 5) + 4), (v["fin_top"], int(fin * 5) + 3), (a > b, 2), (int(p.argmax()) < half, 1), (bend[0] < bend[1], 1), (bool(top.std() > bottom.std()), 1)]
    up, margin = _ballot(votes)
    unlike = abs(a - b) / (max(a, b) + 1e-6)
    steady = min(1.0, unlike) if unlike > 0.3 else 0.5
    sure = eye * 0.5 + fin * 0.25 + steady * 0.15 + margin * 0.1 if eye > 0 else fin * 0.5 + steady * 0.3 + margin * 0.2 if fin > 0 else steady * 0.6 + margin * 0.4
    sure = min(1.0, sure * 1.3) if unlike > 0.5 else sure
    sure = min(1.0, sure * 1.2) if eye > 0.8 else sure
    return a > b if unlike > 0.3 else up, sure


def _dorsal(m: np.ndarray, eye: np.ndarray | None, fin: np.ndarray | None, gray: np.ndarray) -> tuple[str, bool, float]:
    ys, xs = np.nonzero(m)
    if eye is not None and eye.sum() > 10:
        ey, ex = (v.mean() for v in np.nonzero(eye))
        rows = np.nonzero(m[:, max(0, int(ex) - 2) : int(ex) + 3])[0]
        if len(rows):
            above, below, size = ey - rows.min(), rows.max() - ey, np.ptp(rows)
            return "eye_mask", bool(above < below), min(1.0, 3 * abs(above - below) / size) if size else 0.8
    if fin is not None and fin.sum() > 10:
        d = np.nonzero(fin)[0].mean() - ys.mean()
        return "fin_mask", bool(d < 0), min(1.0, 2 * abs(d) / max(1, int(m.any(1).sum())))
    up, sure = back_votes(m, votes_of(gray, m))
    return "image_votes", up, sure


def _tilt(body: np.ndarray) -> float:
    """Degrees of the main axis, from the second moments."""
    ys, xs = np.nonzero(body)
    mxx, myy, mxy = xs.var(), ys.var(), ((xs - xs.mean()) * (ys - ys.mean())).mean()
    return float(np.degrees(0.5 * np.arctan2(2 * mxy, mxx - myy)) % 180) if myy else 0.0


def standardize_one(image: np.ndarray, body: np.ndarray, eye: np.ndarray | None = None, fin: np.ndarray | None = None, margin: float = 0.1, background: tuple[int, ...] = (0, 0, 0), fill: bool = True, head_right: bool = True, use_picture: bool = True) -> tuple[np.ndarray, np.ndarray, dict]:
    """The animal level, head right (unless that isn't wanted), back up, cropped, on a plain background; its mask; and how that was decided.

    use_picture: whether eyes and fins are looked for in the picture where no mask shows them.
    """
    plain = np.array(background[: image.shape[2]] if image.ndim == 3 else round(sum(background) / len(background)), np.uint8)
    body = shapes.largest_component(body)
    ys, xs = np.nonzero(body)
    if not len(xs):
        return image, body, {"valid": False, "score": 0.0, "error": "empty mask"}
    line = np.nonzero(shapes.skeleton(body))
    mse = 0.0
    if len(line[0]) >= 3:
        vx, vy, c = line[1].var(), line[0].var(), np.cov(line[1], line[0], bias=True)[0, 1]
        mse = float(vy - (c * c / vx if vx else 0.0))
    angle = _tilt(body)
    turn = lambda m: shapes.rotate(m.astype(np.uint8), angle, 0, smooth=False).astype(bool) if m is not None else None
    image, body, eye, fin = shapes.rotate(image, angle, 0.0), turn(body), turn(eye), turn(fin)
    head, right, head_sure = _head(body, eye, to_gray(image) if use_picture else None)
    turned = head_right and not right
    if turned:
        image, body, eye, fin = (None if x is None else np.rot90(x, 2) for x in (image, body, eye, fin))
    back, up, back_sure = _dorsal(body, eye, fin, to_gray(image) if use_picture else None)
    if not up:
        image, body = image[::-1], body[::-1]
    x0, y0, x1, y1 = shapes.crop_box(body, margin)
    if x1 > x0 and y1 > y0:
        image, body = image[y0:y1, x0:x1], body[y0:y1, x0:x1]
    if fill:
        image = np.where(body[..., None] if image.ndim == 3 else body, image, plain)
    wide = body.sum(0)
    wide = wide[np.flatnonzero(wide)[0] : np.flatnonzero(wide)[-1] + 1] if wide.any() else wide
    half = len(wide) // 2
    good = len(wide) > 1 and wide[half:].mean() > wide[:half].mean()
    score = 0.4 * (head_sure + back_sure) / 2 + 0.4 * (1.0 if good else 0.5) + 0.2
    if body.sum() < 0.1 * body.size:
        score, valid = 0.3, False
    else:
        valid = score > 0.6
    return np.ascontiguousarray(image), np.ascontiguousarray(body), {"angle": angle, "curvature_mse": mse, "straight": mse < 50, "head_method": head, "head_right": right, "head_confidence": float(head_sure), "rotated_180": turned, "dorsal_method": back, "dorsal_up": up, "dorsal_confidence": float(back_sure), "flipped": not up, "valid": bool(valid), "score": float(score), "error": None}


def standardize(images: DataFrame, masks: DataFrame, fish: tuple[str, ...] = ("whole fish", "fish"), eye: str = "fish eye", fin: str = "dorsal fin", margin: float = 0.1, **options) -> DataFrame:
    """Each image as standardize_one() leaves it, with its options; where that fails, a row with the error."""
    order = F.array_position(F.lit(list(fish)), F.col("prompt"))
    one = lambda p, name: masks.where(F.col("prompt") == p).groupBy("image_id").agg(F.first("mask").alias(name))
    body = masks.where(F.col("prompt").isin(list(fish))).groupBy("image_id").agg(F.min_by("mask", order).alias("body"))
    j = images.join(body, "image_id", "left").join(one(eye, "eye"), "image_id", "left").join(one(fin, "fin"), "image_id", "left")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STANDARD.split(", ")]
        for part in parts:
            rows = []
            for r in part.itertuples():
                own = dict.fromkeys(names) | {"image_id": r.image_id}
                try:
                    m = [None if x is None else np.frombuffer(x, np.uint8).reshape(r.height, r.width) > 0 for x in (r.body, r.eye, r.fin)]
                    if m[0] is None:
                        raise ValueError("no mask of the animal")
                    out, mask, meta = standardize_one(array(r.height, r.width, r.n_channels, r.data), *m, margin, **options)
                    own |= meta | {"height": out.shape[0], "width": out.shape[1], "n_channels": r.n_channels, "data": out.tobytes(), "mask": mask.astype(np.uint8).tobytes()}
                except Exception as e:
                    own["error"] = str(e)
                rows.append(own)
            yield pd.DataFrame(rows, columns=names)

    return j.mapInPandas(run, STANDARD)


VOTES = "image_id string, eye_left boolean, eye_top boolean, eye_confidence double, fin_top boolean, fin_confidence double, head_left_by_tail boolean, tail_confidence double"


def votes_of(gray: np.ndarray | None, body: np.ndarray) -> dict:
    """What the picture of a level animal says: eyes in the head's part and their half, the fin's half, and the forked end.

    Eyes count with a confidence over 0.3. Unknown votes are None, with confidence 0. Without a picture only the outline votes.
    """
    out = {"eye_left": None, "eye_top": None, "eye_confidence": 0.0, "fin_top": None, "fin_confidence": 0.0}
    ys, xs = np.nonzero(body)
    found, sure = signals.eyes(gray, body) if gray is not None else ([], 0.0)
    if len(xs) and found and sure > 0.3:
        left = sum(x < xs.min() + 0.3 * (xs.max() - xs.min()) for x, _ in found)
        out |= {"eye_left": bool(left > len(found) / 2), "eye_top": bool(np.mean([y for _, y in found]) < (ys.min() + ys.max()) / 2), "eye_confidence": sure}
    place, sure = signals.dorsal_fin(body) if gray is not None else (None, 0.0)
    if place is not None:
        out |= {"fin_top": bool(place[1] < ys.mean()), "fin_confidence": sure}
    out["head_left_by_tail"], out["tail_confidence"] = shapes.tail_shape(body)
    return out


def image_votes(images: DataFrame, masks: DataFrame, fish: tuple[str, ...] = ("whole fish", "fish")) -> DataFrame:
    """votes_of() each image and its body mask, for orient.head_from_shape and orient.dorsal_from_shape; none where either is missing."""
    order = F.array_position(F.lit(list(fish)), F.col("prompt"))
    body = masks.where(F.col("prompt").isin(list(fish))).groupBy("image_id").agg(F.min_by("mask", order).alias("body"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in VOTES.split(", ")]
        for part in parts:
            rows = []
            for r in part.itertuples():
                gray = to_gray(array(r.height, r.width, r.n_channels, r.data))
                rows.append({"image_id": r.image_id} | votes_of(gray, shapes.largest_component(np.frombuffer(r.body, np.uint8).reshape(r.height, r.width) > 0)))
            yield pd.DataFrame(rows, columns=names)

    return images.join(body, "image_id").mapInPandas(run, VOTES)


def levelled(images: DataFrame, masks: DataFrame, fish: tuple[str, ...] = ("whole fish", "fish")) -> DataFrame:
    """images turned so that the animal lies level, with its mask; images without one are left out."""
    order = F.array_position(F.lit(list(fish)), F.col("prompt"))
    body = masks.where(F.col("prompt").isin(list(fish)) & (F.col("area") > 0)).groupBy("image_id").agg(F.min_by("mask", order).alias("body"))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                m = shapes.largest_component(np.frombuffer(r.body, np.uint8).reshape(r.height, r.width) > 0)
                angle = _tilt(m)
                x = np.ascontiguousarray(shapes.rotate(array(r.height, r.width, r.n_channels, r.data), angle, 0.0))
                m = shapes.rotate(m.astype(np.uint8), angle, 0, smooth=False).astype(np.uint8)
                rows.append((r.image_id, x.shape[0], x.shape[1], r.n_channels, x.astype(np.uint8).tobytes(), m.tobytes()))
            yield pd.DataFrame(rows, columns=["image_id", "height", "width", "n_channels", "data", "mask"])

    return images.join(body, "image_id").mapInPandas(run, "image_id string, height int, width int, n_channels int, data binary, mask binary")


def heads(images: DataFrame, masks: DataFrame, fish: tuple[str, ...] = ("whole fish", "fish")) -> DataFrame:
    """(image_id, head_left, confidence) by the picture and the mask's shape, for images whose eye has no mask."""
    from . import orient

    level = levelled(images, masks, fish)
    own = level.select("image_id", F.lit(fish[0]).alias("prompt"), "height", "width", "mask")
    votes = image_votes(level.drop("mask"), own, fish)
    return orient.head_from_shape(mask_pixels(own), votes.select("image_id", "eye_left", "eye_confidence"), votes.select("image_id", "head_left_by_tail", "tail_confidence"))


def overlays(images: DataFrame, masks: DataFrame, color: tuple[int, int, int] = (0, 255, 0), share: float = 0.3) -> DataFrame:
    """images (RGB) with the set pixels of each mask blended with the color: (image_id, prompt, height, width, n_channels, data)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                x = array(r.height, r.width, r.n_channels, r.data)
                x = np.repeat(x[:, :, None], 3, 2) if x.ndim == 2 else x.copy()
                m = np.frombuffer(r.mask, np.uint8).reshape(r.height, r.width) > 0
                x[m] = np.rint(x[m] * (1 - share) + np.array(color) * share).astype(np.uint8)
                rows.append((r.image_id, r.prompt, r.height, r.width, 3, x.tobytes()))
            yield pd.DataFrame(rows, columns=["image_id", "prompt", "height", "width", "n_channels", "data"])

    return images.join(masks.select("image_id", "prompt", "mask"), "image_id").mapInPandas(run, "image_id string, prompt string, height int, width int, n_channels int, data binary")


def ruler_ticks(images: DataFrame, masks: DataFrame, ruler: str = "ruler") -> DataFrame:
    """(image_id, tick, x, pixels_per_mm): the ticks found on each image's ruler, for figures; x in the image."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for r in part.itertuples():
                m = np.frombuffer(r.mask, np.uint8).reshape(r.height, r.width) > 0
                ys, xs = np.nonzero(m)
                if len(xs):
                    gray = to_gray(array(r.height, r.width, r.n_channels, r.data))[ys.min() : ys.max() + 1, xs.min() : xs.max() + 1]
                    found, spacing = signals.ruler_ticks(gray)
                    rows += [(r.image_id, i, int(x) + int(xs.min()), float(spacing)) for i, x in enumerate(found)]
            yield pd.DataFrame(rows, columns=["image_id", "tick", "x", "pixels_per_mm"])

    j = images.join(masks.where(F.col("prompt") == ruler).select("image_id", "mask"), "image_id")
    return j.mapInPandas(run, "image_id string, tick int, x int, pixels_per_mm double")


def scaled_points(points: DataFrame, factor: float) -> DataFrame:
    """Key points of an image drawn at another size: places and sizes times the factor."""
    return points.withColumns({c: F.col(c) * factor for c in ("x", "y", "size")})


def check_panels(panels: dict[str, object], wanted: set[str]) -> None:
    """ValueError unless a figure's panels are the wanted ones."""
    if set(panels) != wanted:
        raise ValueError(f"panels missing: {sorted(wanted - set(panels))}, unknown: {sorted(set(panels) - wanted)}")
