"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is budget * weight / rows, weights summing to 1 over the sources that are there. Each
row draws a uniform number from a hash of seed and key and inverts the Poisson distribution with that mean; it is
exploded by the count, and all copies are shuffled globally by a hash of seed, key and copy. Without a weights table every
source weighs the same; without a budget the mix has as many rows as the input, in the mean. Rates above PART are drawn as
a sum of equal parts, so no term underflows, and no array holds more than one part's copies. Copies are numbered from 0; where a
rate is drawn in parts, each number is one copy's own, but some are left out.

A null source is a source of its own. Rows of a null key draw by their text; repeated rows draw alike, and ties in the
shuffle go by key and copy. An empty table gives an empty result. Sources that weigh nothing, or that the table of weights
doesn't name, give no rows. Very long texts travel whole in their rows. Extra columns pass through, whatever their names; ones named
like the results are overwritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, plainly

SEED = "mix-1"
PART = 500.0
#: Up to so many sources are broadcast; beyond, rows and sources are joined over SALTS shares of each source.
BROADCAST_SOURCES = 100_000
SALTS = 32
#: Rows of more parts have their copies made by part, in several tasks.
SPREAD = 16


def uniform(*parts: Column) -> Column:
    """In [0, 1), from the first 52 bits of an MD5 hash."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def rates(df: DataFrame, source: str, weights: DataFrame | None, budget: float | None) -> DataFrame:
    """(_source, _parts, _cdf): in how many parts a source's rate is drawn, and the distribution function of one part."""
    sizes = df.groupBy(F.col(source).alias("_source")).agg(F.count("*").alias("_n"))
    if weights is not None:
        known = weights.groupBy(F.col(source).alias("_w")).agg(F.sum("weight").alias("_weight"))
        sizes = sizes.join(known, F.col("_source").eqNullSafe(F.col("_w")), "left").select("_source", "_n", F.greatest(F.coalesce(F.col("_weight").cast("double"), F.lit(0.0)), F.lit(0.0)).alias("_weight"))
    else:
        sizes = sizes.withColumn("_weight", F.lit(1.0))
    total = sizes.agg(F.sum("_n").alias("n"), F.sum("_weight").alias("w")).first()
    rows, weight = float(total["n"] or 0), float(total["w"] or 0)
    rate = F.lit(rows if budget is None else float(budget)) * F.col("_weight") / (F.lit(weight or 1.0) * F.col("_n"))
    out = sizes.select("_source", rate.alias("_rate")).withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("_rate") / PART).cast("int"))).withColumn("_mean", F.col("_rate") / F.col("_parts"))
    start = F.struct(F.exp(-F.col("_mean")).alias("p"), F.array(F.exp(-F.col("_mean"))).alias("cdf"))

    def add(state, k):
        p = state["p"] * F.col("_mean") / k
        return F.struct(p.alias("p"), F.concat(state["cdf"], F.array(F.element_at(state["cdf"], -1) + p)).alias("cdf"))

    last = F.ceil(F.col("_mean") + 12 * F.sqrt("_mean") + 30).cast("int")  # beyond it less than 2^-52 is left
    return out.select("_source", "_parts", F.aggregate(F.sequence(F.lit(1), last), start, add)["cdf"].alias("_cdf"))


def mix(
    df: DataFrame, weights: DataFrame | None = None, budget: float | None = None, source: str = "source", key: str = "doc_id", text: str = "text", seed: str = SEED,
    broadcast_sources: int = BROADCAST_SOURCES,
) -> DataFrame:
    """The mix: df's columns, copy (from 0), n_copies, and mix_key, by which the rows are ordered."""
    plain, name, back = plainly(df, ["copy", "n_copies", "mix_key"])
    own = weights.select(F.col(source).alias(name[source]), "weight") if weights is not None else None
    return back(_mix(plain, own, budget, name[source], name[key], name[text], seed, broadcast_sources))


def _mix(df: DataFrame, weights: DataFrame | None, budget: float | None, source: str, key: str, text: str, seed: str, broadcast_sources: int) -> DataFrame:
    names = df.columns
    own_id, from_, parts, cdf, share, salt, counts, part, n, i = fresh(df, "_id", "_source", "_parts", "_cdf", "_share", "_salt", "_counts", "_part", "_n", "_i")
    table = rates(df, source, weights, budget).toDF(from_, parts, cdf)
    known = table.agg(F.count("*").alias("sources"), F.coalesce(F.max(parts), F.lit(1)).alias("parts")).first()
    own = df.select(*names, F.coalesce(F.col(key).cast("string"), F.col(text), F.lit("")).alias(own_id))
    if known["sources"] <= broadcast_sources:
        joined = own.join(F.broadcast(table), F.col(source).eqNullSafe(F.col(from_)))
    else:
        salted = table.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = own.withColumn(share, F.pmod(F.xxhash64(own_id), F.lit(SALTS)).cast("int")).join(salted, F.col(source).eqNullSafe(F.col(from_)) & (F.col(share) == F.col(salt)))
    draw = lambda j: uniform(F.lit(seed), F.col(own_id), j.cast("string"))
    inverted = lambda j: F.aggregate(cdf, F.struct(draw(j).alias("u"), F.lit(0).alias("k")), lambda a, c: F.struct(a["u"].alias("u"), (a["k"] + (c <= a["u"]).cast("int")).alias("k")), lambda a: a["k"])
    drawn = joined.select(*names, own_id, parts, F.transform(F.sequence(F.lit(0), F.col(parts) - 1), inverted).alias(counts))
    drawn = drawn.withColumn("n_copies", F.aggregate(counts, F.lit(0).cast("long"), lambda a, k: a + k)).where(F.col("n_copies") > 0)
    dealt = drawn.select(*names, own_id, parts, "n_copies", F.posexplode(counts).alias(part, n)).where(F.col(n) > 0)
    if known["parts"] > SPREAD:  # the copies of one row are made in several tasks
        dealt = dealt.repartition(F.xxhash64(own_id, part))
    copies = dealt.select(*names, own_id, parts, part, "n_copies", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)).alias(i))
    copies = copies.select(*names, own_id, (F.col(i) * F.col(parts) + F.col(part)).alias("copy"), "n_copies")
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), F.col(own_id), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    return copies.select(*names, "copy", "n_copies", place.alias("mix_key")).orderBy("mix_key", key, "copy")


#: DuckDB's SQL for mix over documents with equal weights.
MIX_SQL = f"""
WITH RECURSIVE s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(n)::DOUBLE AS rows_, count(*)::DOUBLE AS w FROM s),
r AS (SELECT source, rows_ * 1.0::DOUBLE / (w * n) AS m FROM s, t),
c AS (SELECT source, m, 0 AS k, exp(-m) AS p, exp(-m) AS cdf FROM r
      UNION ALL SELECT source, m, k + 1, p * m / (k + 1), cdf + p * m / (k + 1) FROM c WHERE k < ceil(m + 12 * sqrt(m) + 30)),
d AS (SELECT *, coalesce(doc_id::VARCHAR, text, '') AS id FROM documents),
u AS (SELECT *, ('0x' || substr(md5('{SEED}|' || id || '|0'), 1, 13))::BIGINT / {float(1 << 52)}::DOUBLE AS u FROM d),
n AS (SELECT doc_id, text, lang, u.source, n_chars, id, (SELECT count(*) FROM c WHERE c.source IS NOT DISTINCT FROM u.source AND cdf <= u) AS n_copies FROM u)
SELECT doc_id, text, lang, source, n_chars, copy, n_copies, ('0x' || substr(md5('{SEED}|order|' || id || '|' || copy), 1, 15))::BIGINT AS mix_key
FROM (SELECT *, unnest(range(0, n_copies)) AS copy FROM n)
"""
