"""The settings file's sections take effect, unknown keys are warned of, failures stay on record, replacements survive a crash."""

import json
import logging

import numpy as np
import pytest
from test_images import animal

from markwise.kernels import png
from markwise.operators import images as im
from markwise.plans import cli
from markwise.sources import settings, tables

FILE = """
data: {{raw_dir: {raw}, masks_dir: {masks}, metadata_dir: {meta}, standardized_dir: {std}}}
metric_extraction: {{tick_detection_method: sobel, length_measurement_method: medial_axis, margin_px: 6}}
standardization: {{rotation_method: pca, background_color: [9, 9, 9], crop_margin: 0.3, ensure_head_right: false, use_image_features: true, enable_validation: true}}
feature_extraction: {{method: rootsift, n_features: 40, contrast_threshold: 0.02, edge_threshold: 12, sigma: 1.6}}
matching: {{method: hotspotter, lnbnn_k: 7, top_candidates: 9, flann_index_type: 1, flann_trees: 3, flann_checks: 50, ratio_threshold: 0.8, typo: 1}}
geometric_verification: {{model: homography, ransac_threshold: 4.0, min_inliers: 3, max_iterations: 500, confidence: 0.95}}
nonsense: {{a: 1}}
"""


def test_every_section(tmp_path, caplog):
    path = tmp_path / "c.yaml"
    path.write_text(FILE.format(raw="r", masks="m", meta="e", std="s"))
    given = settings.load(str(path))
    with caplog.at_level(logging.WARNING):
        own = settings.matching(given)
        settings.check_sections(given)
        assert settings.features(given) == settings.Features("rootsift", 40, 0.02, 12, 1.6)
        assert settings.metrics(given) == settings.Metrics("medial_axis", 6)
        assert settings.standardization(given) == settings.Standardization(0.3, (9, 9, 9), False, True)
        assert settings.segmentation({"segmentation": {"prompts": ["fish"], "confidence_threshold": 0.7, "device": "cpu"}}) == settings.Segmentation(("fish",), 0.7)
    assert (own.k, own.top_candidates, own.flann_trees, own.flann_checks, own.ratio_threshold) == (7, 9, 3, 50, 0.8)
    assert (own.geometric_model, own.ransac_threshold, own.min_inliers, own.max_iterations, own.confidence) == ("homography", 4.0, 3, 500, 0.95)
    assert [r.getMessage().split(":")[1].split(" is")[0].strip() for r in caplog.records] == ["matching.typo", "the section nonsense"]
    with pytest.raises(ValueError):
        settings.standardization({"standardization": {"rotation_method": "guess"}})
    assert settings.matching({}) == settings.Matching() and settings.matching({"matching": None}).k == 5


def test_sections_take_effect(spark, tmp_path):
    raw, masks = tmp_path / "raw", tmp_path / "masks"
    raw.mkdir(), masks.mkdir()
    for name, right in (("JAVR0001", True), ("JAVR0002", False)):
        picture, own = animal(right)
        (raw / f"{name}.png").write_bytes(png.encode(picture))
        for p, m in own.items():
            (masks / f"{name}_{p.replace(' ', '_')}_mask.png").write_bytes(png.encode((m * 255).astype(np.uint8)))
    (raw / "nomask.png").write_bytes(png.encode(np.full((30, 30), 200, np.uint8)))
    folder = lambda n: str(tmp_path / n)
    (tmp_path / "c.yaml").write_text(FILE.format(raw=raw, masks=masks, meta=folder("meta"), std=folder("std")))
    assert cli.main(["process", "--config", folder("c.yaml")]) == 0
    measured = {r.image_id: r for r in spark.read.schema(im.METRICS).json(folder("meta/metrics")).collect()}
    assert measured["JAVR0001"].length_method == "medial_axis"
    said = {r.image_id: r for r in spark.read.json(folder("meta/standardization")).collect()}
    assert said["nomask"].error == "no mask of the animal" and said["JAVR0002"].error is None
    assert said["JAVR0001"].rotated_180 is said["JAVR0002"].rotated_180 is False and said["JAVR0002"].head_right is False
    from markwise.sources import images

    out = {r.image_id: im.array(r.height, r.width, r.n_channels, r.data) for r in images.read(spark, folder("std"), "*_standardized.png").collect()}
    assert out["JAVR0001_standardized"][0, 0] == 9 and out["JAVR0001_standardized"].shape[1] > 1.4 * 180
    match = ["match", "--config", folder("c.yaml"), "--standardized-dir", folder("std"), "--features-dir", folder("features"), "--output-dir", folder("out")]
    assert cli.main(match) == 0
    rows = spark.read.parquet(folder("features")).where("d is not null").collect()
    assert rows and max(sum(1 for r in rows if r.image_id == i) for i in {r.image_id for r in rows}) <= 40
    assert all(abs(np.square(r.d).sum() - 1) < 1e-3 for r in rows)  # square roots of shares
    (tmp_path / "c.yaml").write_text(FILE.format(raw=raw, masks=masks, meta=folder("meta"), std=folder("std")).replace("rootsift", "sift"))
    assert cli.main(match) == 0  # the cache was made with other options
    assert any(np.square(r.d).sum() > 2 for r in spark.read.parquet(folder("features")).where("d is not null").collect())
    assert cli.main([*match, "--matching-method", "pairwise"]) == 0
    assert cli.main([*match, "--index-dir", folder("index")]) == 0 and (tmp_path / "index" / "codes").exists()


def test_replacements_survive_a_crash(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "metrics")
    one, two, three = (spark.createDataFrame([(k,)], "k long") for k in (1, 2, 3))
    read = lambda: [r.k for r in spark.read.schema("k long").json(path).collect()]
    assert not tables.recovered(spark, path)
    tables.replace_json(one, path)
    assert tables.recovered(spark, path) and read() == [1]
    tables.replace_json(two.union(spark.read.schema("k long").json(path)), path)  # may read what it replaces
    assert sorted(read()) == [1, 2]
    (tmp_path / "metrics").rename(tmp_path / "metrics.old")  # it died after the old contents were moved away
    three.write.json(f"{path}.new")
    assert tables.recovered(spark, path) and read() == [3] and not (tmp_path / "metrics.old").exists()
    (tmp_path / "metrics").rename(tmp_path / "metrics.old")  # and the new ones aren't whole
    (tmp_path / "metrics.new").mkdir()
    assert tables.recovered(spark, path) and read() == [3]
    tables.replace_json(one, path)
    assert read() == [1] and sorted(p.name for p in tmp_path.iterdir()) == ["metrics"]


def test_report(capsys, monkeypatch):
    assert cli.main(["report"]) == 0
    found = json.loads(capsys.readouterr().out)
    assert found["pyspark"] == "pass" and found["segmenter"].startswith("warn")
    assert cli.main(["report", "--segmenter", "no_such_module:Model"]) == 1
    assert json.loads(capsys.readouterr().out)["segmenter"].startswith("fail")
