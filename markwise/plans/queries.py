"""Every operator as a query over a folder of tables, and its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from markwise.functions import geometry, names, vectors
from markwise.operators import features, forest, images, knn, matching, orient, outline, peaks, pq, progress, results, ruler, verify
from markwise.operators import pixels as px
from markwise.sources.tables import scratch
from markwise.streaming import incremental
from markwise.streaming import steps as stream_of_steps

from . import surrogates as s
from .surrogates import AFFINE, WITH

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in columns})


def _self_votes(spark: SparkSession, sf: str) -> DataFrame:
    d = s.descriptors(spark, sf)
    return matching.votes(matching.survivors(s.as_queries(d), d))


def _resight_votes(spark: SparkSession, sf: str) -> DataFrame:
    return matching.votes(matching.survivors(s.resight(spark, sf), s.descriptors(spark, sf), exclude_own=False))


_SELF = WITH("descriptors", "self_near", "votes", "scores")
_AGAIN = WITH("descriptors", "resight", "resight_near", "votes", "scores", "verified")


# One-vs-many matching


@query(_SELF + "SELECT query_id, match_id, round(lnbnn_score, 6) AS lnbnn_score, n_matches FROM scores")
def lnbnn_scores(spark, sf):
    return rounded(matching.scores(_self_votes(spark, sf)), "lnbnn_score")


@query(_AGAIN + "SELECT query_id, match_id, round(lnbnn_score, 6) AS lnbnn_score, n_matches FROM scores")
def lnbnn_resight(spark, sf):
    return rounded(matching.scores(_resight_votes(spark, sf)), "lnbnn_score")


@query(_SELF + "SELECT query_id, query_idx, image_id AS match_id, train_idx, global_idx, round(d2, 6) AS d2 FROM votes")
def lnbnn_correspondences(spark, sf):
    return rounded(_self_votes(spark, sf).select("query_id", "query_idx", F.col("image_id").alias("match_id"), "train_idx", "global_idx", "d2"), "d2")


@query(_AGAIN + """, c AS (SELECT query_id, count(*) AS n_query FROM resight GROUP BY 1),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lnbnn_score DESC, match_id) AS r FROM scores)
SELECT query_id, match_id, round(lnbnn_score / n_query + inliers, 6) AS score, round(lnbnn_score, 6) AS lnbnn_score, inliers, total_matches,
row_number() OVER (PARTITION BY query_id ORDER BY lnbnn_score / n_query + inliers DESC, match_id) AS rank FROM t JOIN c USING (query_id) JOIN verified USING (query_id, match_id) WHERE r <= 20 AND inliers >= 10""")
def hotspotter_ranked(spark, sf):
    """The flagship: neighbours, votes, candidates, geometric verification, ranking."""
    voted = _resight_votes(spark, sf)
    top = matching.top_candidates(matching.scores(voted)).drop("rank")
    pairs = voted.select("query_id", F.col("image_id").alias("match_id"), "query_idx", "train_idx").join(top.select("query_id", "match_id"), ["query_id", "match_id"], "left_semi")
    points = matching.with_points(pairs, s.query_points(spark, sf), s.database_points(spark, sf))
    counts = s.resight(spark, sf).groupBy("query_id").agg(F.count("*").alias("n_query"))
    out = matching.ranked(top.join(verify.verify(points).drop("transform"), ["query_id", "match_id"]), counts)
    return rounded(out.select("query_id", "match_id", "score", "lnbnn_score", "inliers", "total_matches", "rank"), "score", "lnbnn_score")


@query(WITH("descriptors", "self_near") + "SELECT qid, global_idx, round(d2, 6) AS d2, rank FROM near")
def knn_topk(spark, sf):
    d = s.descriptors(spark, sf)
    return rounded(knn.nearest(s.as_queries(d), d, 11), "d2")


@query(WITH("descriptors", "self_near") + "SELECT qid, global_idx, round(d2, 6) AS d2, rank FROM near")
def knn_blocks(spark, sf):
    """The way beyond the broadcast bound."""
    d = s.descriptors(spark, sf)
    return rounded(knn.nearest(s.as_queries(d), d, 11, broadcast_bytes=0, block_rows=512), "d2")


_COPIES = WITH("descriptors") + f""", k AS (SELECT p.global_idx AS qid, p.d FROM descriptors p WHERE global_idx % 10 = 0),
t AS (SELECT x.global_idx, s.d FROM descriptors x JOIN descriptors s ON s.global_idx = x.global_idx % 20)
SELECT qid, global_idx, round(d2, 6) AS d2, rank FROM (SELECT q.qid, p.global_idx, {s._L2} AS d2, row_number() OVER (PARTITION BY q.qid ORDER BY {s._L2}, p.global_idx) AS rank FROM k q CROSS JOIN t p) WHERE rank <= 7"""


def _copies(spark, sf):
    """Queries, and a database in which every vector is one of twenty."""
    d = s.descriptors(spark, sf)
    few = d.where("global_idx < 20").select(F.col("global_idx").alias("_s"), F.col("d").alias("_d"))
    return s.as_queries(d.where("global_idx % 10 = 0")), d.withColumn("_s", F.col("global_idx") % 20).join(few, "_s").select("global_idx", "image_id", "local_idx", F.col("_d").alias("d"))


@query(_COPIES)
def knn_copies(spark, sf):
    q, d = _copies(spark, sf)
    return rounded(knn.nearest(q, d, 7), "d2")


@query(_COPIES)
def knn_copies_blocks(spark, sf):
    q, d = _copies(spark, sf)
    return rounded(knn.nearest(q, d, 7, broadcast_bytes=0, block_rows=100), "d2")


@query()
def ivf_knn(spark, sf):
    d = s.descriptors(spark, sf)
    return rounded(knn.nearest_by_cells(s.as_queries(d), d, 11, knn.cells(d, 16)), "d2")


def _pq_near(spark, sf, probes, refine):
    """Neighbours by an index that was trained on all images, filled with some and grown by the others; named by the table's indices."""
    d = s.descriptors(spark, sf)
    index = pq.Index.create(d, scratch(spark, "pq"), n_cells=32)
    index.add(d.where("image_id < 'img_7'"))
    index.add(d)
    found = index.search(s.as_queries(d), 11, probes, refine)
    return found.select("qid", "image_id", "local_idx", "d2").join(d.select("image_id", "local_idx", "global_idx"), ["image_id", "local_idx"])


@query()
def pq_knn(spark, sf):
    """Half of the cells are probed: approximate."""
    return rounded(_pq_near(spark, sf, 16, 8).select("qid", "global_idx", "d2"), "d2")


@query(WITH("descriptors", "self_near") + "SELECT qid, global_idx, round(d2, 6) AS d2, rank FROM near")
def pq_knn_whole(spark, sf):
    """All cells probed and all candidates measured again: what is left must be the exact neighbours."""
    refine = -(-s.table(spark, sf, "embeddings").count() // 11)
    own = W.Window.partitionBy("qid").orderBy("d2", "global_idx")
    return rounded(_pq_near(spark, sf, 32, refine).select("qid", "global_idx", "d2", F.row_number().over(own).alias("rank")), "d2")


_PAIRS = "list_sum(list_transform(list_zip(q.d, p.d), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
_RATIO = WITH("descriptors", "resight") + f""", n AS (SELECT q.query_id, q.qid, q.query_idx, p.image_id AS match_id, p.global_idx, p.local_idx, sqrt({_PAIRS}) AS distance FROM resight q JOIN descriptors p ON q.query_id <> p.image_id),
r AS (SELECT *, row_number() OVER w AS r, lead(distance) OVER w AS second FROM n WINDOW w AS (PARTITION BY qid, match_id ORDER BY distance, global_idx)),
m AS (SELECT query_id, match_id, query_idx, local_idx AS train_idx, distance FROM r WHERE r = 1 AND distance < second * 0.75::DOUBLE) """


@query()
def lsh_join(spark, sf):
    """Second sightings joined to the database by random projections, at most 0.5 apart."""
    return rounded(knn.near_by_projections(s.resight(spark, sf), s.descriptors(spark, sf), 0.5), "distance")


@query(_RATIO + "SELECT query_id, match_id, query_idx, train_idx, round(distance, 6) AS distance FROM m")
def ratio_test_matches(spark, sf):
    return rounded(matching.ratio_matches(s.resight(spark, sf), s.descriptors(spark, sf)), "distance")


def _forest_matches(spark, sf, checks):
    d = s.descriptors(spark, sf)
    q = s.resight(spark, sf)
    near = forest.nearest_in_images(q, forest.grow(d), 2, checks)
    return rounded(matching.ratio_matches(q, d, near=near), "distance")


@query()
def forest_matches(spark, sf):
    """The ratio test on neighbours of 50 checks: approximate."""
    return _forest_matches(spark, sf, forest.CHECKS)


@query(_RATIO + "SELECT query_id, match_id, query_idx, train_idx, round(distance, 6) AS distance FROM m")
def forest_matches_whole(spark, sf):
    """Every leaf is visited: what is left must be the exact matches."""
    return _forest_matches(spark, sf, 1 << 30)


@query(_RATIO + "SELECT query_id, match_id, count(*) AS n FROM m GROUP BY ALL")
def match_counts_by_pair(spark, sf):
    return matching.ratio_matches(s.resight(spark, sf), s.descriptors(spark, sf)).groupBy("query_id", "match_id").agg(F.count("*").alias("n"))


_DOT = "list_sum(list_transform(list_zip(a.d, b.d), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_NORM = "sqrt(list_sum(list_transform({0}.d, lambda z: z::DOUBLE * z::DOUBLE)))"
_COS = f"{_DOT} / ({_NORM.format('a')} * {_NORM.format('b')})"


@query(WITH("descriptors") + f"SELECT a.global_idx AS a, b.global_idx AS b, round({_COS}, 6) AS similarity FROM descriptors a JOIN descriptors b ON a.image_id = b.image_id AND a.global_idx < b.global_idx")
def cosine_similarity_pairs(spark, sf):
    """Pairs inside each image."""
    return rounded(knn.cosines(s.descriptors(spark, sf), "image_id"), "similarity")


@query(WITH("descriptors", "resight") + f"SELECT a.qid, b.global_idx, round({_COS}, 6) AS similarity FROM resight a CROSS JOIN descriptors b WHERE {_COS} >= 0.7")
def similarity_threshold_join(spark, sf):
    """On unit vectors cosine is 1 - d2 / 2, so a search by distance finds the candidates and cosine confirms them."""
    unit = lambda c: F.transform(c, lambda x: x.cast("double") / F.sqrt(vectors.dot(c, c)))
    q, d = s.resight(spark, sf), s.descriptors(spark, sf)
    near = knn.within(q.select("qid", unit("d").alias("d")), d.select("global_idx", unit("d").alias("d")), 2 - 2 * 0.7 + 1e-9)
    j = near.join(q.select("qid", F.col("d").alias("_q")), "qid").join(d.select("global_idx", F.col("d").alias("_d")), "global_idx")
    return rounded(j.select("qid", "global_idx", vectors.cosine("_q", "_d").alias("similarity")).where("similarity >= 0.7"), "similarity")


@query(WITH("descriptors") + "SELECT global_idx, i::INT AS i, round(sqrt(abs(d[i + 1]::DOUBLE) / (list_sum(list_transform(d, lambda z: abs(z::DOUBLE))) + 1e-7::DOUBLE)), 6) AS value FROM (SELECT *, unnest(range(len(d))) AS i FROM descriptors)")
def rootsift_normalize(spark, sf):
    d = s.descriptors(spark, sf).withColumn("d", F.transform("d", F.abs))
    return rounded(d.select("global_idx", F.posexplode(vectors.root_normalised("d")).alias("i", "value")), "value")


_OFFSETS = WITH("descriptors") + ", o AS (SELECT image_id, row_number() OVER (ORDER BY image_id) - 1 AS image_idx, count(*) AS n_desc, coalesce(sum(count(*)) OVER (ORDER BY image_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM descriptors GROUP BY image_id) "


@query(_OFFSETS + 'SELECT image_id, image_idx, n_desc, off AS "offset" FROM o')
def descriptor_offsets(spark, sf):
    return matching.offsets(s.descriptors(spark, sf))


@query(WITH("descriptors") + "SELECT image_id AS match_id, global_idx, local_idx AS train_idx FROM descriptors")
def global_to_local(spark, sf):
    """Positions in the matrix, in order of image and local index, back to local indices."""
    d = s.descriptors(spark, sf)
    table = matching.offsets(d)
    placed = d.join(table, "image_id").select(F.col("image_id").alias("match_id"), "global_idx", (F.col("offset") + F.col("local_idx")).alias("position"))
    return matching.to_local(placed, table).select("match_id", "global_idx", "train_idx")


@query(WITH("descriptors") + "SELECT 'img_' || i AS image_id FROM range(20) t(i) WHERE 'img_' || i IN (SELECT image_id FROM descriptors)")
def valid_images(spark, sf):
    return features.valid_images(spark.range(20).select(F.concat(F.lit("img_"), F.col("id")).alias("image_id")), s.descriptors(spark, sf))


@query(WITH("names") + "SELECT image_id, doc_id FROM names WHERE starts_with(image_id, 'CSDD00001') ORDER BY image_id LIMIT 1")
def query_by_prefix(spark, sf):
    return features.by_prefix(s.names(spark, sf), "CSDD00001")


@query(_AGAIN + "SELECT query_id, match_id, inliers, total_matches FROM verified")
def ransac_verify(spark, sf):
    voted = _resight_votes(spark, sf).select("query_id", F.col("image_id").alias("match_id"), "query_idx", "train_idx")
    return verify.verify(matching.with_points(voted, s.query_points(spark, sf), s.database_points(spark, sf))).drop("transform")


@query(_AGAIN + "SELECT query_id, match_id, inliers, total_matches FROM verified")
def inliers_given_affine(spark, sf):
    voted = _resight_votes(spark, sf).select("query_id", F.col("image_id").alias("match_id"), "query_idx", "train_idx")
    swapped = matching.with_points(voted, s.query_points(spark, sf), s.database_points(spark, sf)).selectExpr("query_id", "match_id", "tx AS qx", "ty AS qy", "qx AS tx", "qy AS ty")
    return verify.inliers_given(swapped, AFFINE)


@query()
def descriptor_pca(spark, sf):
    return features.descriptor_colours(s.descriptors(spark, sf))


# Masks


def _moments(*columns: str) -> Query:
    return lambda spark, sf: rounded(px.moments(s.pixels(spark, sf)).select("image_id", *columns), *[c for c in columns if c in ("cx", "cy", "box_x", "box_y", "angle")])


for _name, _columns, _sql in (
    ("mask_area", ("area",), "count(*) AS area"),
    ("mask_centroid", ("cx", "cy"), "round(avg(x), 6) AS cx, round(avg(y), 6) AS cy"),
    ("mask_bbox", ("x_min", "x_max", "y_min", "y_max"), "min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max"),
    ("mask_bbox_center", ("box_x", "box_y"), "round((min(x) + max(x)) / 2, 6) AS box_x, round((min(y) + max(y)) / 2, 6) AS box_y"),
    ("mask_orientation", ("angle",), "round(CASE WHEN var_pop(y) = 0 THEN 0 ELSE (degrees(0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y))) + 180) % 180 END, 6) AS angle"),
):
    QUERIES[_name] = _moments(*_columns)
    ORACLE[_name] = WITH("pixels") + f"SELECT image_id, {_sql} FROM pixels GROUP BY image_id"


@query(WITH("pixels", "columns") + "SELECT image_id, x::INT AS x, n FROM dense")
def column_profile(spark, sf):
    return px.profile(s.pixels(spark, sf), "x")


@query(WITH("pixels", "rows") + "SELECT image_id, y::INT AS y, n FROM tall")
def row_profile(spark, sf):
    return px.profile(s.pixels(spark, sf), "y")


@query(WITH("pixels", "edges") + "SELECT * FROM edges")
def edge_profile(spark, sf):
    return px.edge_profile(s.pixels(spark, sf))


_HALVES = """SELECT image_id, round(avg(n) FILTER (rn <= len // 2), 6) AS mean_first, round(avg(n) FILTER (rn > len // 2), 6) AS mean_second,
round(stddev_pop(n) FILTER (rn <= len // 2), 6) AS std_first, round(stddev_pop(n) FILTER (rn > len // 2), 6) AS std_second, max(len) AS len, arg_min(rn, row(-n, rn)) AS widest FROM {0} GROUP BY image_id"""


@query(WITH("pixels", "columns") + _HALVES.format("dense"))
def half_profile_stats(spark, sf):
    return rounded(px.half_profile_stats(s.pixels(spark, sf), "x"), "mean_first", "mean_second", "std_first", "std_second")


@query(WITH("pixels", "rows") + _HALVES.format("tall"))
def half_profile_rows(spark, sf):
    return rounded(px.half_profile_stats(s.pixels(spark, sf), "y"), "mean_first", "mean_second", "std_first", "std_second")


@query(WITH("pixels", "edges") + "SELECT image_id, round(stddev_pop(top), 6) AS top_roughness, round(stddev_pop(bottom), 6) AS bottom_roughness FROM edges GROUP BY image_id")
def edge_roughness(spark, sf):
    return rounded(px.edge_roughness(s.pixels(spark, sf)), "top_roughness", "bottom_roughness")


@query(WITH("pixels", "rows") + "SELECT image_id, arg_min(y, row(-n, y))::INT AS y, max(n) AS n FROM tall GROUP BY image_id")
def argmax_width(spark, sf):
    return px.profile(s.pixels(spark, sf), "y").groupBy("image_id").agg(F.min_by("y", F.struct(-F.col("n"), F.col("y"))).alias("y"), F.max("n").alias("n"))


_K = "greatest(1, len // 10)"
_TIPS = WITH("pixels", "columns") + f""", t AS (SELECT image_id, avg(n) FILTER (rn <= {_K}) AS left_tip, avg(n) FILTER (rn > {_K} AND rn <= 2 * {_K}) AS left_neck, avg(n) FILTER (len - rn + 1 <= {_K}) AS right_tip, avg(n) FILTER (len - rn + 1 > {_K} AND len - rn + 1 <= 2 * {_K}) AS right_neck FROM dense GROUP BY image_id)
SELECT image_id, round(left_tip, 6) AS left_tip, round(left_neck, 6) AS left_neck, round(right_tip, 6) AS right_tip, round(right_neck, 6) AS right_neck, left_tip > left_neck * 1.2::DOUBLE AS left_flares, right_tip > right_neck * 1.2::DOUBLE AS right_flares FROM t"""


@query(_TIPS)
def tip_neck_flare(spark, sf):
    return rounded(px.tips(s.pixels(spark, sf)), "left_tip", "left_neck", "right_tip", "right_neck")


@query(WITH("pixels", "edges") + """, d AS (SELECT *, top - lag(top) OVER w AS dt, bottom - lag(bottom) OVER w AS db FROM edges WINDOW w AS (PARTITION BY image_id ORDER BY x)),
e AS (SELECT *, dt - lag(dt) OVER w AS ddt, db - lag(db) OVER w AS ddb FROM d WINDOW w AS (PARTITION BY image_id ORDER BY x))
SELECT image_id, coalesce(round(-avg(ddt), 6), 0) + 0.0::DOUBLE AS convexity_top, coalesce(round(avg(ddb), 6), 0) + 0.0::DOUBLE AS convexity_bottom FROM e GROUP BY image_id""")
def profile_convexity(spark, sf):
    return rounded(px.convexity(s.pixels(spark, sf)), "convexity_top", "convexity_bottom")


@query(WITH("pixels") + "SELECT image_id, round(regr_syy(y, x) / count(*) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) / count(*), 6) AS mse, regr_syy(y, x) / count(*) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x) / count(*) < 50 AS straight FROM pixels GROUP BY image_id")
def line_fit_mse(spark, sf):
    return rounded(px.line_fit_mse(s.pixels(spark, sf)), "mse")


_BANDS = "bands AS (SELECT image_id, avg(v) FILTER (y <= y0 + floor((y1 - y0) * 0.25)) AS top_value, avg(v) FILTER (y >= y1 - floor((y1 - y0) * 0.25)) AS bottom_value FROM (SELECT *, min(y) OVER (PARTITION BY image_id) AS y0, max(y) OVER (PARTITION BY image_id) AS y1 FROM pixels) GROUP BY image_id)"


@query(WITH("pixels") + f", {_BANDS} SELECT image_id, round(top_value, 6) AS top_value, round(bottom_value, 6) AS bottom_value FROM bands")
def masked_intensity_bands(spark, sf):
    return rounded(px.intensity_bands(s.pixels(spark, sf)), "top_value", "bottom_value")


_STRIP = "center AS (SELECT image_id, count(*) AS eye_area, avg(x) AS eye_x, avg(y) AS eye_y FROM eye GROUP BY image_id), strip AS (SELECT p.image_id, eye_area, eye_x, eye_y, min(y) AS strip_top, max(y) AS strip_bottom FROM pixels p JOIN center c ON p.image_id = c.image_id AND x >= floor(eye_x) - 2 AND x < floor(eye_x) + 3 GROUP BY ALL)"


@query(WITH("pixels", "eye") + f", {_STRIP} SELECT image_id, eye_area, round(eye_x, 6) AS eye_x, round(eye_y, 6) AS eye_y, strip_top, strip_bottom FROM strip")
def eye_strip_range_join(spark, sf):
    p = s.pixels(spark, sf)
    return rounded(px.eye_strip(p, p.where("y < 5")), "eye_x", "eye_y")


@query(WITH("pixels", "eye") + """, o AS (SELECT image_id, avg(x) AS cx, (min(x) + max(x)) / 2 AS bx, count(DISTINCT x) AS w FROM pixels GROUP BY image_id),
e AS (SELECT image_id, count(*) AS n, avg(x) AS ex FROM eye WHERE image_id % 4 <> 0 GROUP BY image_id)
SELECT o.image_id, CASE WHEN coalesce(n, 0) > 10 THEN ex > cx ELSE cx > bx END AS head_right, round(CASE WHEN coalesce(n, 0) > 10 THEN least(1.0::DOUBLE, abs(ex - cx) / w * 2) ELSE least(0.7::DOUBLE, abs(cx - bx) / w * 1.5) END, 6) AS confidence FROM o LEFT JOIN e USING (image_id)""")
def head_direction_mask(spark, sf):
    p = s.pixels(spark, sf)
    return rounded(orient.head_from_masks(p, p.where("y < 5 and image_id % 4 <> 0")), "confidence")


@query(WITH("pixels", "fin") + f""", eye AS (SELECT * FROM pixels WHERE y < 5 AND image_id % 2 = 0), {_STRIP}, {_BANDS},
o AS (SELECT image_id, avg(y) AS cy, count(DISTINCT y) AS h FROM pixels GROUP BY image_id), f AS (SELECT image_id, avg(y) AS fy FROM fin GROUP BY image_id HAVING count(*) > 10), t AS (SELECT * FROM strip WHERE eye_area > 10)
SELECT o.image_id, CASE WHEN eye_area IS NOT NULL THEN eye_y - strip_top < strip_bottom - eye_y WHEN fy IS NOT NULL THEN fy < cy ELSE top_value < bottom_value END AS dorsal_up,
round(CASE WHEN eye_area IS NOT NULL THEN least(1.0::DOUBLE, abs(2 * eye_y - strip_top - strip_bottom) / (strip_bottom - strip_top) * 3) WHEN fy IS NOT NULL THEN least(1.0::DOUBLE, abs(fy - cy) / h * 2) ELSE least(0.7::DOUBLE, abs(top_value - bottom_value) / 50) END, 6) AS confidence
FROM o LEFT JOIN t USING (image_id) LEFT JOIN f USING (image_id) LEFT JOIN bands USING (image_id)""")
def dorsal_orientation_mask(spark, sf):
    p = s.pixels(spark, sf)
    return rounded(orient.dorsal_from_masks(p, p.where("y < 5 and image_id % 2 = 0"), p.where("y > 55 and image_id % 3 = 0")), "confidence")


_SHAPE_X = WITH("pixels", "columns") + f""", h AS (SELECT image_id, avg(n) FILTER (rn <= len // 2) AS a, avg(n) FILTER (rn > len // 2) AS b, avg(n) FILTER (rn <= {_K}) AS lt, avg(n) FILTER (rn > {_K} AND rn <= 2 * {_K}) AS ln_,
avg(n) FILTER (len - rn + 1 <= {_K}) AS rt, avg(n) FILTER (len - rn + 1 > {_K} AND len - rn + 1 <= 2 * {_K}) AS rn_ FROM dense GROUP BY image_id),
m AS (SELECT image_id, avg(x) < (min(x) + max(x)) / 2.0 AS mass FROM pixels GROUP BY image_id),
f AS (SELECT image_id, mass, a > b AS wide, lt > ln_ * 1.2::DOUBLE AS lf, rt > rn_ * 1.2::DOUBLE AS rf FROM h JOIN m USING (image_id)),
v AS (SELECT *, mass::INT + wide::INT + 2 * (rf AND NOT lf)::INT AS l, (NOT mass)::INT + (NOT wide)::INT + 2 * (lf AND NOT rf)::INT AS r FROM f)
SELECT image_id, l > r AS head_left, round(least(1.0, abs(l - r) / greatest(l + r, 1)::DOUBLE * CASE WHEN lf <> rf THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END), 6) + 0.0::DOUBLE AS confidence FROM v"""


@query(_SHAPE_X)
def head_direction_shape(spark, sf):
    return rounded(orient.head_from_shape(s.pixels(spark, sf)), "confidence")


_SHAPE_Y = WITH("pixels", "rows", "edges") + """, h AS (SELECT image_id, coalesce(stddev_pop(n) FILTER (rn <= len // 2), 0) AS a, coalesce(stddev_pop(n) FILTER (rn > len // 2), 0) AS b, max(len) AS len, arg_min(rn, row(-n, rn)) AS widest FROM tall GROUP BY image_id),
d AS (SELECT *, top - lag(top) OVER w AS dt, bottom - lag(bottom) OVER w AS db FROM edges WINDOW w AS (PARTITION BY image_id ORDER BY x)),
e AS (SELECT *, dt - lag(dt) OVER w AS ddt, db - lag(db) OVER w AS ddb FROM d WINDOW w AS (PARTITION BY image_id ORDER BY x)),
c AS (SELECT image_id, coalesce(-avg(ddt), 0) AS ct, coalesce(avg(ddb), 0) AS cb, stddev_pop(top) AS rt, stddev_pop(bottom) AS rb FROM e GROUP BY image_id),
v AS (SELECT *, 2 * (a > b)::INT + (widest - 1 < len // 2)::INT + (ct < cb)::INT + (rt > rb)::INT AS u, abs(a - b) / (greatest(a, b) + 1e-6::DOUBLE) AS x FROM h JOIN c USING (image_id)),
w AS (SELECT *, (CASE WHEN x > 0.3 THEN least(1.0::DOUBLE, x) ELSE 0.5::DOUBLE END) * 0.6::DOUBLE + abs(u - (5 - u)) / 5::DOUBLE * 0.4::DOUBLE AS sure FROM v)
SELECT image_id, CASE WHEN len <= 1 THEN true WHEN x > 0.3 THEN a > b ELSE u > 5 - u END AS dorsal_up, round(CASE WHEN len <= 1 THEN 0.5::DOUBLE WHEN x > 0.5 THEN least(1.0::DOUBLE, sure * 1.3::DOUBLE) ELSE sure END, 6) + 0.0::DOUBLE AS confidence FROM w"""


@query(_SHAPE_Y)
def dorsal_orientation_shape(spark, sf):
    return rounded(orient.dorsal_from_shape(s.pixels(spark, sf)), "confidence")


@query(WITH("pixels", "columns") + """, h AS (SELECT image_id, avg(n) FILTER (rn <= len // 2) AS a, avg(n) FILTER (rn > len // 2) AS b FROM dense GROUP BY image_id), k AS (SELECT image_id, count(*) AS area FROM pixels GROUP BY image_id),
c AS (SELECT image_id, area, (0.9::DOUBLE + 0.5::DOUBLE) / 2.0::DOUBLE * 0.4::DOUBLE + CASE WHEN b > a THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END * 0.4::DOUBLE + 0.2::DOUBLE AS score FROM h JOIN k USING (image_id))
SELECT image_id, area >= 591.7 AND score > 0.6 AS valid, round(CASE WHEN area < 591.7 THEN 0.3 ELSE score END, 6) AS score FROM c""")
def validate_standardization(spark, sf):
    p = s.pixels(spark, sf)
    sizes = p.select("image_id").distinct().select("image_id", F.lit(61).alias("height"), F.lit(97).alias("width"), F.lit(True).alias("head_right"), F.lit(0.9).alias("head_confidence"), F.lit(0.5).alias("dorsal_confidence"))
    return rounded(orient.validate(p, sizes), "score")


@query(WITH("pixels") + """, b AS (SELECT image_id, min(x) + 20 AS a, max(x) - 20 AS c, min(y) + 10 AS d, max(y) - 10 AS e FROM pixels GROUP BY image_id),
g AS (SELECT image_id, greatest(0, a - 10) AS x0, least(97, c + 10) AS x1, greatest(0, d - 10) AS y0, least(61, e + 10) AS y1 FROM b)
SELECT p.image_id, (x - x0)::INT AS x, (y - y0)::INT AS y, v FROM pixels p JOIN g USING (image_id) WHERE x >= x0 AND x < x1 AND y >= y0 AND y < y1""")
def roi_crop(spark, sf):
    """A box in the middle of each mask, grown by ten pixels."""
    p = s.pixels(spark, sf)
    boxes = px.moments(p).select("image_id", (F.col("x_min") + 20).alias("x_min"), (F.col("x_max") - 20).alias("x_max"), (F.col("y_min") + 10).alias("y_min"), (F.col("y_max") - 10).alias("y_max"))
    return px.crop(p, boxes, 0.0, 10, 97, 61).select("image_id", F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), "v")


@query(WITH("pixels") + "SELECT image_id, x, y, CASE WHEN (x + y) % 2 = 0 THEN v ELSE 255 END AS v FROM pixels")
def background_fill(spark, sf):
    p = s.dealt_pixels(spark, sf)
    return px.fill_background(p, p.where("(x + y) % 2 = 0"), 255)


for _name, _op, _word in (("mask_union", px.union, "UNION"), ("mask_intersect", px.intersect, "INTERSECT"), ("mask_except", px.subtract, "EXCEPT")):
    QUERIES[_name] = lambda spark, sf, op=_op: op(s.dealt_pixels(spark, sf).where("x < 60"), s.dealt_pixels(spark, sf).where("x > 30"))
    ORACLE[_name] = WITH("pixels") + f"SELECT image_id, x, y FROM pixels WHERE x < 60 {_word} SELECT image_id, x, y FROM pixels WHERE x > 30"


@query(WITH("pixels") + "SELECT image_id, 96 - x AS x, 60 - y AS y, v FROM pixels")
def rotate180(spark, sf):
    return px.rotate_180(s.pixels(spark, sf), 97, 61)


@query(WITH("pixels") + "SELECT image_id, x, 60 - y AS y, v FROM pixels")
def flip_vertical(spark, sf):
    return px.flip_vertical(s.pixels(spark, sf), 61)


@query(WITH("pixels") + "SELECT image_id, (x // 4)::INT AS x, (y // 4)::INT AS y, count(*) AS n FROM pixels GROUP BY ALL")
def keypoint_density(spark, sf):
    return px.density(s.pixels(spark, sf).select("image_id", (F.col("x") / 4).alias("x"), (F.col("y") / 4).alias("y")))


@query(WITH("pixels") + "SELECT image_id, x, y, round(v * 2 * 0.299 + v * 0.587 + (255 - v) * 0.114, 6) AS gray, round(1 - v / 255, 6) AS darkness FROM pixels")
def gray_levels(spark, sf):
    v = F.col("v")
    return rounded(s.pixels(spark, sf).select("image_id", "x", "y", geometry.gray(v * 2, v, F.lit(255) - v).alias("gray"), geometry.darkness(v).alias("darkness")), "gray", "darkness")


_LARGEST = "WITH RECURSIVE " + WITH("pixels").removeprefix("WITH ").rstrip() + """,
reach AS (
    SELECT image_id, x AS x0, y AS y0, x, y FROM pixels
    UNION SELECT r.image_id, r.x0, r.y0, p.x, p.y FROM reach r JOIN pixels p ON p.image_id = r.image_id AND abs(p.x - r.x) <= 1 AND abs(p.y - r.y) <= 1
),
sizes AS (SELECT image_id, x0, y0, count(*) AS n FROM reach GROUP BY ALL),
best AS (SELECT image_id, arg_min(row(x0, y0), row(-n, y0, x0)) AS first FROM sizes GROUP BY image_id)
SELECT r.image_id, r.x, r.y FROM reach r JOIN best b ON r.image_id = b.image_id AND row(r.x0, r.y0) = b.first"""


@query(_LARGEST)
def largest_component(spark, sf):
    return images.largest_components(s.pixels(spark, sf))


@query(_LARGEST)
def largest_component_runs(spark, sf):
    """The same pixels by components of runs, cut into tiles of 16 columns."""
    return outline.largest(s.pixels(spark, sf), 16)


@query(WITH("pixels")[:-1] + """, p AS (SELECT a.image_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM pixels a JOIN pixels b ON a.image_id = b.image_id AND (a.x, a.y) <= (b.x, b.y))
SELECT image_id, best.ax::DOUBLE AS ax, best.ay::DOUBLE AS ay, best.bx::DOUBLE AS bx, best.by_::DOUBLE AS by, round(sqrt(best.d2), 6) AS distance
FROM (SELECT image_id, arg_min({'ax': ax, 'ay': ay, 'bx': bx, 'by_': by_, 'd2': d2}, (-d2, ax, ay, bx, by_)) AS best FROM p GROUP BY image_id)""")
def farthest_pair(spark, sf):
    return rounded(outline.farthest_pair(s.pixels(spark, sf)), "distance")


@query()
def fitted_ellipse(spark, sf):
    return rounded(outline.fitted_ellipse(s.strips(spark, sf)), "cx", "cy", "major", "minor", "angle")


_CONTOUR = "WITH RECURSIVE " + WITH("pixels", "strips").removeprefix("WITH ").rstrip() + """,
around AS (SELECT a.image_id, a.x, a.y, w, b.x AS nx, b.y AS ny FROM strips a, (SELECT unnest(range(8))::INT AS w, unnest([1, 1, 0, -1, -1, -1, 0, 1]) AS dx, unnest([0, -1, -1, -1, 0, 1, 1, 1]) AS dy) o
  JOIN strips b ON b.image_id = a.image_id AND b.x = a.x + dx AND b.y = a.y + dy),
ways AS (SELECT image_id, x, y, list(w) AS ws FROM around GROUP BY ALL),
steps AS (SELECT a.image_id, a.x, a.y, a.w, a.nx, a.ny, list_min(list_transform(ws, lambda v: (v - a.w + 11) % 8 * 8 + v)) % 8 AS next FROM around a JOIN ways n ON n.image_id = a.image_id AND n.x = a.nx AND n.y = a.ny),
first AS (SELECT image_id, arg_min({'x': x, 'y': y}, (y, x)) AS p FROM strips GROUP BY image_id),
start AS (SELECT w.image_id, w.x, w.y, list_min(list_transform(ws, lambda v: (v + 4) % 8 * 8 + v)) % 8 AS w FROM ways w JOIN first f ON w.image_id = f.image_id AND w.x = f.p.x AND w.y = f.p.y),
walk AS (SELECT image_id, 0 AS i, x, y, w FROM start UNION ALL SELECT s.image_id, k.i + 1, s.nx, s.ny, s.next FROM walk k JOIN steps s ON s.image_id = k.image_id AND s.x = k.x AND s.y = k.y AND s.w = k.w
  JOIN start z ON z.image_id = s.image_id WHERE NOT (s.nx = z.x AND s.ny = z.y AND s.next = z.w)),
turns AS (SELECT *, coalesce(lag(w) OVER o, last_value(w) OVER (PARTITION BY image_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS before FROM walk WINDOW o AS (PARTITION BY image_id ORDER BY i)),
corners AS (SELECT image_id, row_number() OVER (PARTITION BY image_id ORDER BY i) - 1 AS place, x, y FROM turns WHERE w <> before
  UNION ALL SELECT f.image_id, 0, f.p.x, f.p.y FROM first f ANTI JOIN start s ON f.image_id = s.image_id)"""


@query(_CONTOUR + " SELECT image_id, place::BIGINT AS place, x, y FROM corners")
def contour_corners(spark, sf):
    """Corners in walking order, by list ranking."""
    return outline.contour(s.strips(spark, sf))


@query(_CONTOUR + """, sized AS (SELECT *, count(*) OVER (PARTITION BY image_id) AS len FROM corners), ends AS (SELECT image_id, greatest(5, len // 7) AS n, place, len, x::DOUBLE AS x, y::DOUBLE AS y FROM sized WHERE len > 10),
sides AS (SELECT image_id, n, 'first' AS side, place AS i, x, y FROM ends WHERE place < n UNION ALL SELECT image_id, n, 'last', place - len + n, x, y FROM ends WHERE place >= len - n),
near AS (SELECT *, (x - avg(x) OVER e) * (x - avg(x) OVER e) + (y - avg(y) OVER e) * (y - avg(y) OVER e) AS far,
  coalesce(lag(x, 2) OVER o, first_value(x) OVER o) - x AS ux, coalesce(lag(y, 2) OVER o, first_value(y) OVER o) - y AS uy, coalesce(lead(x, 2) OVER o, last_value(x) OVER e) - x AS vx, coalesce(lead(y, 2) OVER o, last_value(y) OVER e) - y AS vy,
  x - lag(x) OVER o AS px, y - lag(y) OVER o AS py, lead(x) OVER o - x AS qx, lead(y) OVER o - y AS qy
  FROM sides WINDOW o AS (PARTITION BY image_id, side ORDER BY i), e AS (PARTITION BY image_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
angles AS (SELECT *, CASE WHEN (ux <> 0 OR uy <> 0) AND (vx <> 0 OR vy <> 0) THEN degrees(acos(greatest(-1, least(1, (ux * vx + uy * vy) / (sqrt(ux * ux + uy * uy) * sqrt(vx * vx + vy * vy)))))) END AS tip,
  CASE WHEN (px <> 0 OR py <> 0) AND (qx <> 0 OR qy <> 0) THEN acos(greatest(-1, least(1, (px * qx + py * qy) / (sqrt(px * px + py * py) * sqrt(qx * qx + qy * qy))))) END AS turn FROM near),
found AS (SELECT image_id, side, n, arg_max({'i': i, 'tip': tip}, (far, -i)) AS t, coalesce(avg(turn), 0) AS mean_turn FROM angles GROUP BY ALL),
judged AS (SELECT *, CASE WHEN t.i > 0 AND t.i < n - 1 THEN coalesce(t.tip, 180) ELSE 180 END AS a, t.i > 0 AND t.i < n - 1 AND t.tip IS NOT NULL AS inside FROM found)
SELECT image_id, side, n, round(a, 6) AS tip_angle, a < 90 AS sharp, round(CASE WHEN NOT inside THEN 0 WHEN a < 60 THEN 1 - a / 60 WHEN a > 120 THEN (a - 120) / 60 ELSE 0.5 END, 6) AS sure, round(mean_turn, 6) AS mean_turn FROM judged""")
def contour_ends(spark, sf):
    """How sharp and how curved the first and last seventh of a contour are."""
    return rounded(outline.contour_ends(outline.contour(s.strips(spark, sf))), "tip_angle", "sure", "mean_turn")


@query(WITH("metrics") + "SELECT image_id, round(CASE WHEN image_id % 3 = 0 THEN ppm % 180 ELSE ppm % 180 + 180 END, 6) AS angle FROM metrics")
def adjusted_angle(spark, sf):
    """The axis' angle, turned by half a circle where the head is on the right."""
    angle = geometry.facing_left(geometry.half_turn(F.col("ppm")), F.col("image_id") % 3 == 0)
    return rounded(s.metrics(spark, sf).select("image_id", angle.alias("angle")), "angle")


@query(WITH("descriptors", "points") + "SELECT image_id, local_idx, x * 0.25::DOUBLE AS x, y * 0.25::DOUBLE AS y, (1 + local_idx) * 0.25::DOUBLE AS size FROM points")
def scaled_keypoints(spark, sf):
    points = s.database_points(spark, sf).select("image_id", "local_idx", "x", "y", (F.col("local_idx") + 1).cast("double").alias("size"))
    return images.scaled_points(points, 0.25)


@query(WITH("pixels") + "SELECT image_id, x, y, round(48 + (x - 48) * cos(radians(30)) + (y - 30) * sin(radians(30)), 6) AS rx, round(30 - (x - 48) * sin(radians(30)) + (y - 30) * cos(radians(30)), 6) AS ry FROM pixels")
def rotate_points(spark, sf):
    """Pixels turned by 30 degrees around a center."""
    at = (F.col("x"), F.col("y"), F.lit(48), F.lit(30), F.lit(30.0))
    return rounded(s.pixels(spark, sf).select("image_id", "x", "y", geometry.rotate_x(*at).alias("rx"), geometry.rotate_y(*at).alias("ry")), "rx", "ry")


@query(WITH("pixels") + ", m AS (SELECT image_id, count(*) AS area, (max(x) - min(x) + max(y) - min(y)) * 2 AS around FROM pixels GROUP BY image_id) SELECT image_id, round(4 * pi() * area / (around * around), 6) AS circularity FROM m")
def box_circularity(spark, sf):
    m = px.moments(s.pixels(spark, sf))
    around = (F.col("x_max") - F.col("x_min") + F.col("y_max") - F.col("y_min")) * 2
    return rounded(m.select("image_id", geometry.circularity(F.col("area"), around).alias("circularity")), "circularity")


@query(WITH("pixels") + "SELECT image_id, round(quantile_cont(v, 0.15), 6) AS dark FROM pixels GROUP BY image_id")
def dark_threshold(spark, sf):
    return rounded(s.pixels(spark, sf).groupBy("image_id").agg(F.percentile("v", 0.15).alias("dark")), "dark")


# Scale


_SMOOTH = """, e AS (SELECT series, count(*) AS n FROM {0} GROUP BY series), o AS (SELECT unnest(range(-8, 9)) AS o), w AS (SELECT o, exp(-0.5 * (o / 2.0) * (o / 2.0)) / (SELECT sum(exp(-0.5 * (o / 2.0) * (o / 2.0))) FROM o) AS w FROM o),
p AS (SELECT s.series, s.t, n, w, (s.t - 1 + o + 8 * 2 * n) % (2 * n) AS m FROM {0} s JOIN e USING (series) CROSS JOIN w)
SELECT p.series, p.t, round(sum(w * g.v), 6) + 0.0::DOUBLE AS v FROM p JOIN {0} g ON g.series = p.series AND g.t = CASE WHEN m < n THEN m ELSE 2 * n - 1 - m END + 1 GROUP BY ALL"""


@query(WITH("signal") + _SMOOTH.format("signal"))
def gaussian_smooth(spark, sf):
    return rounded(ruler.gaussian_smooth(s.signal(spark, sf)), "v")


@query(WITH("signal", "short") + _SMOOTH.format("short"))
def gaussian_smooth_short(spark, sf):
    """Series shorter than the kernel, whose mirror images repeat."""
    return rounded(ruler.gaussian_smooth(s.short(spark, sf)), "v")


@query(WITH("metrics") + """, b AS (SELECT quantile_cont(ppm, 0.25) AS q1, quantile_cont(ppm, 0.5) AS median, quantile_cont(ppm, 0.75) AS q3 FROM metrics WHERE ppm > 0),
i AS (SELECT ppm, ppm BETWEEN q1 - (q3 - q1) * 1.5 AND q3 + (q3 - q1) * 1.5 AS inside FROM metrics, b WHERE ppm > 0)
SELECT round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(low, 6) AS low, round(high, 6) AS high, fliers FROM b, (SELECT min(ppm) FILTER (inside) AS low, max(ppm) FILTER (inside) AS high, count(*) FILTER (NOT inside) AS fliers FROM i)""")
def scale_box(spark, sf):
    return rounded(ruler.scale_box(s.metrics(spark, sf)), "q1", "median", "q3", "low", "high")


@query(WITH("descriptors", "self_near", "votes", "scores", "matches") + "SELECT query_id, match_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id DESC) AS r FROM matches) WHERE r = 1 ORDER BY query_id LIMIT 5")
def first_matches(spark, sf):
    """The first five queries' best match."""
    scored = matching.scores(_self_votes(spark, sf))
    side = lambda c, x: F.concat(c, F.lit(f"{x}_standardized")).alias(c)
    return rounded(results.first_matches(scored.select(side("query_id", "L"), side("match_id", "R"), (F.col("lnbnn_score") + F.col("n_matches")).alias("score"))), "score")


@query(WITH("signal") + ", m AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS b, quantile_cont(v, 0.5) OVER (PARTITION BY series) AS q FROM signal WINDOW w AS (PARTITION BY series ORDER BY t)) SELECT series, t, v FROM m WHERE v > a AND v > b AND v >= q")
def local_maxima(spark, sf):
    return ruler.local_maxima(s.signal(spark, sf))


_HIGHER = """higher AS (SELECT k.series, k.t, k.v, (SELECT max(l.t) FROM levels l WHERE l.series = k.series AND l.t < k.t AND l.v > k.v) AS before, (SELECT min(l.t) FROM levels l WHERE l.series = k.series AND l.t > k.t AND l.v > k.v) AS after FROM {0} k),
judged AS (SELECT h.series, h.t, h.v, h.v - greatest(min(l.v) FILTER (l.t <= h.t AND l.t >= coalesce(before, 0)), min(l.v) FILTER (l.t >= h.t AND l.t <= coalesce(after, 1000000000))) AS prominence FROM higher h JOIN levels l ON l.series = h.series GROUP BY h.series, h.t, h.v)"""


@query("WITH RECURSIVE " + WITH("levels", "plateaus")[5:-1] + ", " + """high AS (SELECT t.* FROM tops t JOIN (SELECT series, quantile_cont(v, 0.5) AS least FROM levels GROUP BY series) m ON t.series = m.series AND v >= least),
turns AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY v DESC, t DESC) AS r FROM high),
kept AS (SELECT series, 1::BIGINT AS r, [t] AS places FROM turns WHERE r = 1
  UNION ALL SELECT n.series, n.r, CASE WHEN len(list_filter(places, lambda p: abs(p - n.t) < 12)) > 0 THEN places ELSE list_append(places, n.t) END FROM kept k JOIN turns n ON n.series = k.series AND n.r = k.r + 1),
chosen AS (SELECT h.* FROM high h JOIN (SELECT series, arg_max(places, r) AS places FROM kept GROUP BY series) k ON h.series = k.series AND list_contains(places, h.t)), """ + _HIGHER.format("chosen") + " SELECT series, t, v, prominence FROM judged")
def peaks_distance(spark, sf):
    """Peaks at least as high as the median, 12 places apart."""
    return peaks.peaks(s.levels(spark, sf), percentile=0.5, distance=12)


@query(WITH("levels", "plateaus")[:-1] + ", " + _HIGHER.format("tops") + " SELECT series, t, v, prominence FROM judged WHERE prominence >= 5")
def peaks_prominence(spark, sf):
    return peaks.peaks(s.levels(spark, sf), prominence=5.0)


@query(WITH("signal", "ticks") + """, d AS (SELECT series, (t - lag(t) OVER (PARTITION BY series ORDER BY t))::DOUBLE AS d FROM ticks), q AS (SELECT series, count(*) AS n_ticks, quantile_cont(d, 0.25) AS q1, quantile_cont(d, 0.75) AS q3 FROM d GROUP BY series),
f AS (SELECT d.*, d BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS ok FROM d JOIN q USING (series) WHERE d IS NOT NULL), g AS (SELECT *, bool_or(ok) OVER (PARTITION BY series) AS any_ok FROM f)
SELECT q.series, n_ticks, round(coalesce(quantile_cont(d, 0.5) FILTER ((ok OR NOT any_ok) AND d BETWEEN 15 AND 150), 0), 6) AS spacing FROM q LEFT JOIN g USING (series) GROUP BY ALL""")
def tick_spacing_iqr(spark, sf):
    return rounded(ruler.tick_spacing(s.ticks(spark, sf)), "spacing")


@query(WITH("metrics", "stats") + "SELECT round(mean, 6) AS mean, round(median, 6) AS median, round(std, 6) AS std, round(min, 6) AS min, round(max, 6) AS max, count FROM stats")
def scale_distribution(spark, sf):
    return rounded(ruler.scale_stats(s.metrics(spark, sf)), "mean", "median", "std", "min", "max")


@query(WITH("metrics", "stats") + "SELECT image_id, round(ppm, 6) AS ppm, round(abs((ppm - mean) / std), 6) AS z FROM metrics, stats WHERE ppm > 0 AND abs((ppm - mean) / std) > 2")
def scale_outliers(spark, sf):
    return rounded(ruler.scale_outliers(s.metrics(spark, sf)).select("image_id", "ppm", "z"), "ppm", "z")


@query(WITH("metrics", "stats") + "SELECT least(30, floor((ppm - min) / (max - min) * 30)::INT + 1)::INT AS bin, count(*) AS n FROM metrics, stats WHERE ppm > 0 GROUP BY ALL")
def scale_histogram(spark, sf):
    return ruler.scale_histogram(s.metrics(spark, sf))


@query(WITH("metrics") + "SELECT image_id, CASE WHEN image_id % 7 = 0 THEN 'no_ruler_detected' WHEN image_id % 11 = 0 THEN 'dimension_mismatch' WHEN image_id % 13 = 0 THEN 'roi_extraction_failed' WHEN ppm = 0 THEN 'no_ticks_detected' END AS extraction_error FROM metrics")
def metric_error_class(spark, sf):
    m = s.metrics(spark, sf).selectExpr("image_id", "ppm", "image_id % 7 AS ruler_pixels", "image_id % 11 <> 0 AS same_shape", "image_id % 13 AS roi_pixels")
    return ruler.error_class(m).select("image_id", "extraction_error")


@query(WITH("metrics") + "SELECT image_id, round(CASE WHEN ppm > 0 THEN length_px / ppm ELSE 0 END, 6) AS length_mm FROM metrics")
def px_to_mm(spark, sf):
    return rounded(s.metrics(spark, sf).select("image_id", geometry.to_mm(F.col("length_px"), F.col("ppm")).alias("length_mm")), "length_mm")


# Names and results


@query(WITH("names") + "SELECT image_id, nullif(regexp_extract(image_id, '([LR])', 1), '') AS side, nullif(regexp_extract(image_id, '([LR])(_standardized)?$', 1), '') AS side_suffix FROM names")
def extract_side(spark, sf):
    return s.names(spark, sf).select("image_id", names.side("image_id").alias("side"), names.side_suffix("image_id").alias("side_suffix"))


@query(WITH("names") + "SELECT replace(image_id, '_standardized', '') AS name FROM names")
def strip_suffix(spark, sf):
    return s.names(spark, sf).select(names.strip_suffix("image_id").alias("name"))


@query(WITH("names") + "SELECT image_id, regexp_replace(image_id, '[RL]', '', 'g') AS animal FROM names")
def animal_id(spark, sf):
    return s.names(spark, sf).select("image_id", names.animal("image_id").alias("animal"))


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    scored = matching.scores(_self_votes(spark, sf))
    named = scored.select(F.concat("query_id", F.lit("L_standardized")).alias("query_id"), F.concat("match_id", F.lit("R_standardized")).alias("match_id"), (F.col("lnbnn_score") + F.col("n_matches")).alias("score"), "lnbnn_score", F.col("n_matches").alias("inliers"), (F.col("n_matches") * 2).alias("total_matches"))
    return rounded(results.flatten(results.nest(named)), "score", "inlier_ratio", "lnbnn_score")


_FLAT = WITH("descriptors", "self_near", "votes", "scores", "matches", "flat")


@query(_FLAT + "SELECT * FROM flat")
def results_flatten(spark, sf):
    return _flat(spark, sf)


@query(_FLAT + "SELECT query_id, match_id, inlier_ratio FROM flat")
def inlier_ratio(spark, sf):
    return _flat(spark, sf).select("query_id", "match_id", "inlier_ratio")


@query(_FLAT + "SELECT * FROM flat WHERE regexp_replace(query_id, '[RL]', '', 'g') <> regexp_replace(match_id, '[RL]', '', 'g')")
def drop_same_animal(spark, sf):
    return results.drop_same_animal(_flat(spark, sf))


@query(_FLAT + "SELECT * FROM flat")
def results_json_roundtrip(spark, sf):
    """The nested results as one JSON document per query, parsed again."""
    scored = matching.scores(_self_votes(spark, sf))
    named = scored.select(F.concat("query_id", F.lit("L_standardized")).alias("query_id"), F.concat("match_id", F.lit("R_standardized")).alias("match_id"), (F.col("lnbnn_score") + F.col("n_matches")).alias("score"), "lnbnn_score", F.col("n_matches").alias("inliers"), (F.col("n_matches") * 2).alias("total_matches"))
    text = results.nest(named).select(F.to_json(F.create_map("query_id", "matches")).alias("j"))
    back = text.select(F.explode(F.from_json("j", results.RESULTS)).alias("query_id", "matches"))
    return rounded(results.flatten(back), "score", "inlier_ratio", "lnbnn_score")


@query(_FLAT + "SELECT * FROM flat WHERE query_id = 'img_3L' ORDER BY score DESC, match_id LIMIT 5")
def top_matches(spark, sf):
    return results.top_matches(_flat(spark, sf), "img_3L")


@query(_FLAT + "SELECT *, 2 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, match_id) AS r FROM flat) WHERE r = 2".replace("SELECT *, 2", "SELECT * EXCLUDE (r), 2"))
def rank_n_match(spark, sf):
    return results.rank_n(_flat(spark, sf), 2)


@query(_FLAT + "SELECT * FROM flat WHERE (query_id = 'img_1L' AND match_id = 'img_2R') OR (query_id = 'img_2R' AND match_id = 'img_1L') ORDER BY query_id LIMIT 1")
def pair_lookup(spark, sf):
    return results.pair(_flat(spark, sf), "img_1L", "img_2R")


@query(_FLAT + """SELECT query_id, match_id,
    printf('%s vs %s: score %.4f, %d of %d inliers (%.1f%%)', query_id, match_id, score, inliers, total_matches, inlier_ratio * 100) AS caption FROM flat""")
def match_captions(spark, sf):
    return results.pair_text(_flat(spark, sf)).select("query_id", "match_id", "caption")


@query(_FLAT + "SELECT query_id, match_id, CASE WHEN total_matches = 0 THEN 0.0::DOUBLE ELSE inliers::DOUBLE END AS score FROM (SELECT * REPLACE (CASE WHEN inliers % 2 = 0 THEN 0 ELSE total_matches END AS total_matches) FROM flat)")
def inlier_scores(spark, sf):
    """The pairwise score; pairs of an even number of inliers count as pairs without matches."""
    total = F.when(F.col("inliers") % 2 == 0, F.lit(0)).otherwise(F.col("total_matches"))
    return _flat(spark, sf).select("query_id", "match_id", matching.inlier_score(F.col("inliers"), total).alias("score"))


# Planning


def _progress(spark: SparkSession, sf: str) -> DataFrame:
    n = s.names(spark, sf)
    j = n.join(s.table(spark, sf, "labels"), "doc_id")
    kinds = F.explode(F.filter(F.array(F.lit("fish"), F.lit("ruler"), F.when(F.col("toxic") == 1, F.lit("image")), F.when(F.col("toxic") == 1, F.lit("mask"))), lambda k: k.isNotNull()))
    return progress.progress(n, j.select("image_id", kinds.alias("kind")), j.select("image_id", F.col("quality").cast("double").alias("pixels_per_mm")))


@query(WITH("names", "progress") + "SELECT * FROM progress")
def progress_status(spark, sf):
    return _progress(spark, sf)


@query(WITH("names", "progress", "steps") + "SELECT * FROM steps")
def required_steps(spark, sf):
    return progress.required_steps(_progress(spark, sf))


@query(WITH("names", "progress", "steps") + "SELECT * FROM steps")
def stream_steps(spark, sf):
    """The same steps, by a stream with state over the images and their artifacts in two micro-batches."""
    n = s.names(spark, sf)
    j = n.join(s.table(spark, sf, "labels"), "doc_id")
    at = F.timestamp_seconds(F.lit(1_600_000_000) + F.col("doc_id"))
    event = lambda kind, value=None: F.struct(F.lit(kind).alias("kind"), (F.lit(value) if value is None else value).cast("double").alias("value"))
    made = F.array(event("fish"), event("ruler"), event("metrics", F.col("quality")), F.when(F.col("toxic") == 1, event("image")), F.when(F.col("toxic") == 1, event("mask")))
    rows = j.select("image_id", F.explode(F.array_compact(made)).alias("e"), at.alias("ts")).select("image_id", "e.*", "ts")
    source, target = scratch(spark, "events"), scratch(spark, "steps")
    rows.write.parquet(source)
    n.select("image_id", F.lit("raw").alias("kind"), F.lit(None).cast("double").alias("value"), at.alias("ts")).write.mode("append").parquet(source)
    stream = spark.readStream.schema(stream_of_steps.EVENTS).option("maxFilesPerTrigger", 16).parquet(source)
    stream_of_steps.keep_steps(stream, target, scratch(spark, "checkpoint")).awaitTermination()
    return stream_of_steps.steps_now(spark, target).drop("stuck")


@query(WITH("names", "progress", "steps") + "SELECT image_id FROM steps WHERE need_segmentation OR need_metrics OR need_standardization")
def work_queue(spark, sf):
    return progress.work_queue(progress.required_steps(_progress(spark, sf))).select("image_id")


@query(WITH("names", "progress", "steps") + "SELECT count(*) AS n_images, sum(need_segmentation::INT)::BIGINT AS need_segmentation, sum(need_metrics::INT)::BIGINT AS need_metrics, sum(need_standardization::INT)::BIGINT AS need_standardization, sum((need_segmentation OR need_metrics OR need_standardization)::INT)::BIGINT AS n_work FROM steps")
def step_summary(spark, sf):
    return progress.step_summary(progress.required_steps(_progress(spark, sf)))


@query(WITH("metrics") + "SELECT image_id, round(CASE WHEN image_id % 3 = 0 THEN ppm + 1 ELSE ppm END, 6) AS ppm FROM metrics")
def metrics_upsert(spark, sf):
    """New values for every third image; of repeated new rows the last counts."""
    m = s.metrics(spark, sf).select("image_id", "ppm")
    new = m.where("image_id % 3 = 0").selectExpr("image_id", "ppm + 1 AS ppm", "2 AS n").union(m.where("image_id % 3 = 0").selectExpr("image_id", "ppm + 5 AS ppm", "1 AS n"))
    return rounded(progress.upsert(m, progress.latest(new, "image_id", "n").drop("n"), "image_id"), "ppm")


@query("""WITH n AS (SELECT 'JAVR' || lpad(doc_id::VARCHAR, 6, '0') AS image_id, doc_id FROM documents UNION ALL SELECT 'JAVR' || lpad(doc_id::VARCHAR, 6, '0') || 'L', NULL FROM documents WHERE doc_id % 10 = 0)
SELECT image_id AS old_name, image_id || h || '.jpg' AS new_name, h AS head_direction, CASE WHEN h IS NULL OR (h = 'L' AND doc_id % 10 = 0) THEN 'failed' ELSE 'ok' END AS status FROM (SELECT *, CASE WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 2 = 0 THEN 'L' ELSE 'R' END AS h FROM n WHERE doc_id IS NOT NULL)""")
def rename_plan(spark, sf):
    d = s.table(spark, sf, "documents").select("doc_id")
    plain = F.concat(F.lit("JAVR"), F.lpad(F.col("doc_id").cast("string"), 6, "0"))
    images = d.select(plain.alias("image_id")).union(d.where("doc_id % 10 = 0").select(F.concat(plain, F.lit("L"))))
    heads = d.where("doc_id % 5 <> 4").select(plain.alias("image_id"), (F.col("doc_id") % 2 == 0).alias("head_left"))
    return progress.rename_plan(images, heads)


@query("""SELECT strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M') AS start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL""")
def event_rates(spark, sf):
    """The streaming aggregate, over a table."""
    found = incremental.event_rates(s.table(spark, sf, "events"))
    return rounded(found.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n", "total"), "total")


def entry(spark: SparkSession, sf: str) -> DataFrame:
    return hotspotter_ranked(spark, sf)
