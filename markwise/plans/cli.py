"""python -m markwise.plans.cli match|process|rename|report"""

from __future__ import annotations

import argparse
import importlib
import json
import logging
import os
from dataclasses import asdict

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from markwise.operators import images as im
from markwise.operators import orient, progress, results, ruler
from markwise.sources import files, images, settings, tables

from .matching import one_vs_many, pairwise, stored_index

log = logging.getLogger("markwise")


def _settings(a: argparse.Namespace) -> dict:
    given = settings.load(a.config) if a.config else {}
    settings.check_sections(given)
    return given


def _match(spark: SparkSession, a: argparse.Namespace) -> None:
    given = _settings(a)
    own, options = settings.matching(given), asdict(settings.features(given))
    pictures = images.read(spark, a.standardized_dir, "*_standardized.png")
    noted = f"{a.features_dir.rstrip('/')}_options"
    same = tables.recovered(spark, noted) and spark.read.json(noted).first().asDict() == options
    anew = a.force_recompute or not tables.exists(spark, a.features_dir) or not same
    if anew:
        tables.write_features(im.extract_features(pictures, **options), a.features_dir)
        tables.replace_json(spark.createDataFrame([Row(**options)]).coalesce(1), noted)
    else:
        im.extract_features(im.uncached(pictures, spark.read.parquet(a.features_dir)), **options).write.mode("append").parquet(a.features_dir)
    features = im.cached_features(pictures, spark.read.parquet(a.features_dir), **options)
    wanted = pictures.where(F.col("image_id").startswith(a.query)).orderBy("image_id").limit(1) if a.query else None
    if wanted is not None and wanted.isEmpty():
        raise ValueError(f"no image is named {a.query}")
    if (a.matching_method or own.method) == "pairwise":
        found = pairwise(features, wanted, own)
    else:
        index = stored_index(features, a.index_dir or f"{a.features_dir.rstrip('/')}_index", anew) if own.use_pq or a.index_dir else None
        found = one_vs_many(features, wanted, own, index)
    found = found if "lnbnn_score" in found.columns else found.withColumn("lnbnn_score", F.lit(None).cast("double"))
    tables.write_results(found, f"{a.output_dir}/matches.json")
    tables.write_csv(results.flatten(results.nest(found)), f"{a.output_dir}/matches.csv")
    for r in results.first_matches(found).collect():  # five rows
        log.info("%s: %s (%.3f)", r["query_id"], r["match_id"], r["score"])


def _artifacts(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """(image_id, kind) of what earlier runs have left in the folders."""
    image, prompt = images.mask_names(F.col("name"))
    masks = images.names(spark, a.masks_dir, "*_mask.png").select(image.alias("image_id"), prompt.alias("kind")).where("image_id <> ''")
    done = images.names(spark, a.standardized_dir, "*.png").select(
        F.regexp_replace("name", "_standardized(_mask)?$", "").alias("image_id"), F.when(F.col("name").endswith("_standardized_mask"), "mask").when(F.col("name").endswith("_standardized"), "image").alias("kind")
    )
    out = masks.union(done.where("kind is not null"))
    if a.qa_dir:
        drawn = images.names(spark, a.qa_dir, "*.png").select(F.regexp_extract("name", "^(.*)_(ticks|standardized)$", 1).alias("image_id"), F.concat(F.lit("qa_"), F.regexp_extract("name", "_(ticks|standardized)$", 1)).alias("kind"))
        out = out.union(drawn.where("image_id <> ''"))
    return out


def _segmenter(name: str) -> type:
    module, _, kind = name.partition(":")
    return getattr(importlib.import_module(module), kind)


def _process(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """Runs the steps that are left, and returns their summary."""
    given = _settings(a)
    for folder in (a.masks_dir, a.standardized_dir):
        files.recover(folder)
    path = f"{a.metadata_dir}/metrics"
    before = tables.recovered(spark, path)
    old = spark.read.schema(im.METRICS).json(path) if before else spark.createDataFrame([], im.METRICS)
    raw = images.read(spark, a.raw_dir)
    state = progress.progress(images.scan(spark, a.raw_dir, "*.{jpg,JPG,png}"), _artifacts(spark, a), old.select("image_id", "pixels_per_mm"))
    steps = progress.required_steps(state, not a.no_metrics, not a.no_standardize, a.no_skip_existing).cache()
    summary = progress.step_summary(steps)
    log.info("%s", summary.first().asDict())
    todo = lambda step: raw.join(steps.where(f"need_{step}").select("image_id"), "image_id", "left_semi")
    if a.segmenter and not steps.where("need_segmentation").isEmpty():
        cut = settings.segmentation(given)
        found = im.segment(todo("segmentation"), _segmenter(a.segmenter), list(cut.prompts), cut.confidence)
        images.export(images.mask_files(found.where("area > 0")), a.masks_dir)
    masks = images.read_masks(spark, a.masks_dir)
    if not a.no_metrics and not steps.where("need_metrics").isEmpty():
        kinds = [f.dataType for f in old.schema.fields]
        bad = images.unreadable(spark, a.raw_dir).select("image_id", *[F.lit(None).cast(t).alias(c) for c, t in zip(old.columns[1:-1], kinds[1:-1], strict=True)], F.col("error").alias("extraction_error"))
        tables.replace_json(progress.upsert(old, im.measure(todo("metrics"), masks, **asdict(settings.metrics(given))).unionByName(bad), "image_id"), path)
        tables.write_json(ruler.scale_stats(spark.read.schema(im.METRICS).json(path), "pixels_per_mm"), f"{a.metadata_dir}/scale_distribution")
    if not a.no_standardize and not steps.where("need_standardization").isEmpty():
        scratch, results_path = tables.scratch(spark, "standardized"), f"{a.metadata_dir}/standardization"
        im.standardize(todo("standardization"), masks, **asdict(settings.standardization(given))).write.parquet(scratch)
        tried = spark.read.parquet(scratch)
        said = tried.drop("data", "mask")
        earlier = spark.read.schema(said.schema).json(results_path) if tables.recovered(spark, results_path) else spark.createDataFrame([], said.schema)
        tables.replace_json(progress.upsert(earlier, said, "image_id"), results_path)
        for r in said.where("error is not null").select("image_id", "error").limit(20).collect():
            log.warning("%s was not standardized: %s", r["image_id"], r["error"])
        out = tried.where(F.col("error").isNull())
        named = lambda ending, data, n: out.select(F.concat("image_id", F.lit(ending)).alias("image_id"), "height", "width", n.alias("n_channels"), data.alias("data"))
        both = named("_standardized_mask", F.unhex(F.regexp_replace(F.hex("mask"), "01", "FF")), F.lit(1)).union(named("_standardized", F.col("data"), F.col("n_channels")))
        images.export(images.png_files(both), a.standardized_dir)
    if a.qa_dir and not a.no_metrics:
        im.ruler_ticks(raw, masks).write.mode("overwrite").parquet(f"{a.qa_dir}/ticks")
    return summary


def _rename(spark: SparkSession, a: argparse.Namespace) -> None:
    raw, masks = images.read(spark, a.images_dir), images.read_masks(spark, a.masks_dir)
    body = masks.where(F.col("prompt").isin("whole fish", "fish"))
    seen = masks.where((F.col("prompt") == "fish eye") & (F.col("area") > orient.LEAST_EYE)).select("image_id").distinct()
    marked = orient.head_from_masks(im.mask_pixels(body.join(seen, "image_id", "left_semi")), im.mask_pixels(masks.where(F.col("prompt") == "fish eye")))
    shaped = im.heads(raw.join(seen, "image_id", "left_anti"), body.join(seen, "image_id", "left_anti"))
    plan = progress.rename_plan(raw.select("image_id"), marked.select("image_id", (~F.col("head_right")).alias("head_left")).union(shaped.select("image_id", "head_left")))
    plan.show(truncate=False) if a.dry_run else tables.write_json(plan, a.output)
    if a.run_processing:
        _process(spark, argparse.Namespace(**vars(a) | {"raw_dir": a.images_dir}))


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="markwise")
    sub = p.add_subparsers(dest="command", required=True)
    m = sub.add_parser("match")
    for name in ("--query", "--matching-method"):
        m.add_argument(name)
    for name in ("--standardized-dir", "--features-dir", "--output-dir"):
        m.add_argument(name, required=True)
    m.add_argument("--index-dir", help="folder of a stored index of product codes, made or grown; the settings' use_pq puts one beside the features")
    m.add_argument("--force-recompute", action="store_true")
    q = sub.add_parser("process")
    q.add_argument("--raw-dir")
    r = sub.add_parser("rename")
    for name in ("--images-dir", "--output"):
        r.add_argument(name, required=True)
    r.add_argument("--dry-run", action="store_true")
    r.add_argument("--run-processing", action="store_true", help="process the images afterwards")
    for x in (q, r):
        for name in ("--masks-dir", "--metadata-dir", "--standardized-dir", "--qa-dir", "--segmenter"):
            x.add_argument(name, help="module:Class of a model of masks" if name == "--segmenter" else None)
        for name in ("--no-metrics", "--no-standardize", "--no-skip-existing"):
            x.add_argument(name, action="store_true")
    for x in (m, q, r):
        x.add_argument("--config")
        x.add_argument("--verbose", "-v", action="store_true")
    sub.add_parser("report").add_argument("--segmenter", help="module:Class of a model of masks, to be tried")
    a = p.parse_args(argv)
    if a.command == "report":
        found = settings.environment_report(a.segmenter)
        print(json.dumps(found))
        return 1 if any(x.startswith("fail") for x in found.values()) else 0
    logging.basicConfig(level=logging.DEBUG if a.verbose else logging.INFO)
    if a.command != "match":
        data = settings.load(a.config).get("data", {}) if a.config else {}
        for name in ("raw_dir", "masks_dir", "metadata_dir", "standardized_dir"):
            if getattr(a, name, None) is None and name in data:
                setattr(a, name, settings.resolve(data[name], os.getcwd()))
        needed = ["masks_dir"] + (["raw_dir"] if a.command == "process" else []) + (["metadata_dir", "standardized_dir"] if a.command == "process" or a.run_processing else [])
        if missing := [n for n in needed if getattr(a, n) is None]:
            p.error(f"no {', '.join(missing)} on the command line or in the settings")
    spark = SparkSession.builder.appName("markwise").getOrCreate()
    {"match": _match, "process": _process, "rename": _rename}[a.command](spark, a)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
