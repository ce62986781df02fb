"""Settings from YAML, with defaults; paths; and what this environment offers."""

from __future__ import annotations

import importlib
import importlib.util
import logging
from dataclasses import dataclass, fields
from pathlib import Path

log = logging.getLogger("markwise")


@dataclass(frozen=True)
class Matching:
    """Defaults are fixed values of the matching method, but that neighbours are exact: use_pq and flann_checks (0: all) ask for approximate ones."""

    method: str = "hotspotter"
    k: int = 5
    ratio_threshold: float = 0.75
    top_candidates: int = 20
    ransac_threshold: float = 5.0
    min_inliers: int = 10
    confidence: float = 0.99
    max_iterations: int = 2000
    geometric_model: str = "affine"
    flann_trees: int = 5
    flann_checks: int = 0
    use_pq: bool = False
    probes: int = 64
    refine: int = 8


@dataclass(frozen=True)
class Features:
    method: str = "sift"
    n_features: int = 0
    contrast_threshold: float = 0.04
    edge_threshold: float = 10.0
    sigma: float = 1.6


@dataclass(frozen=True)
class Metrics:
    method: str = "major_axis"
    margin: int = 10


@dataclass(frozen=True)
class Standardization:
    margin: float = 0.1
    background: tuple[int, ...] = (0, 0, 0)
    head_right: bool = True
    use_picture: bool = True


@dataclass(frozen=True)
class Segmentation:
    prompts: tuple[str, ...] = ("whole fish", "fish", "fish eye", "dorsal fin", "ruler")
    confidence: float = 0.5


def load(path: str) -> dict:
    import yaml

    return yaml.safe_load(Path(path).read_text()) or {}


def _picked(section: str, own: dict, names: dict[str, str], silent: tuple[str, ...] = ()) -> dict:
    """The values of a section's known keys under the names that they have here; unknown keys are warned of."""
    for key in own:
        if key not in names and key not in silent:
            log.warning("settings: %s.%s is unknown and has no effect", section, key)
    return {names[k]: v for k, v in own.items() if k in names and v is not None}


def _same(kind: type) -> dict[str, str]:
    return {f.name: f.name for f in fields(kind)}


def matching(settings: dict) -> Matching:
    """From the sections matching and geometric_verification."""
    own = _picked("matching", settings.get("matching") or {}, _same(Matching) | {"lnbnn_k": "k"}, ("flann_index_type",))
    checked = {k: k for k in ("ransac_threshold", "min_inliers", "max_iterations", "confidence")} | {"model": "geometric_model"}
    return Matching(**own | _picked("geometric_verification", settings.get("geometric_verification") or {}, checked))


def features(settings: dict) -> Features:
    return Features(**_picked("feature_extraction", settings.get("feature_extraction") or {}, _same(Features)))


def metrics(settings: dict) -> Metrics:
    names = {"length_measurement_method": "method", "margin_px": "margin"}
    return Metrics(**_picked("metric_extraction", settings.get("metric_extraction") or {}, names, ("tick_detection_method",)))


def standardization(settings: dict) -> Standardization:
    own = settings.get("standardization") or {}
    if own.get("rotation_method", "pca") not in ("pca", "moments"):
        raise ValueError(f"unknown rotation method {own['rotation_method']!r}")
    names = {"crop_margin": "margin", "background_color": "background", "ensure_head_right": "head_right", "use_image_features": "use_picture"}
    found = _picked("standardization", own, names, ("rotation_method", "confidence_threshold", "enable_validation", "enable_double_check"))
    if "background" in found:
        found["background"] = tuple(found["background"])
    return Standardization(**found)


def segmentation(settings: dict) -> Segmentation:
    found = _picked("segmentation", settings.get("segmentation") or {}, {"prompts": "prompts", "confidence_threshold": "confidence"}, ("device",))
    if "prompts" in found:
        found["prompts"] = tuple(found["prompts"])
    return Segmentation(**found)


#: Sections that are read here or by the command line, and those of models that aren't part of this library.
SECTIONS = ("data", "segmentation", "metric_extraction", "standardization", "feature_extraction", "matching", "geometric_verification", "models", "deep_metric")


def check_sections(settings: dict) -> None:
    for name in settings:
        if name not in SECTIONS:
            log.warning("settings: the section %s is unknown and has no effect", name)


def resolve(path: str, base: str) -> str:
    """Absolute paths and addresses as they are, others under the base."""
    return path if path.startswith("/") or "://" in path else f"{base.rstrip('/')}/{path}"


def environment_report(segmenter: str | None = None) -> dict[str, str]:
    """What this environment offers: each check passes, warns (what is optional is absent) or fails, with the reason.

    segmenter: "module:Class" of a model of masks, which is imported and made once, as a worker would.
    """
    found = {}
    for name, why in (("pyspark", "fail"), ("numpy", "fail"), ("pandas", "fail"), ("pyarrow", "fail"), ("yaml", "warn: settings can't be read")):
        found[name] = "pass" if importlib.util.find_spec(name) else why
    if segmenter:
        module, _, kind = segmenter.partition(":")
        try:
            getattr(importlib.import_module(module), kind)()
            found["segmenter"] = "pass"
        except Exception as e:
            found["segmenter"] = f"fail: {e}"
    else:
        found["segmenter"] = "warn: none is named, so masks must be there already"
    return found
