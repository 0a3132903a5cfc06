"""Mixing sources to target weights by Poisson replication.

Each source s gets a mean repetition rate: weight * total / its number of documents. A document's number of copies is
the inverse of the Poisson distribution with that mean at a number that a keyed hash of its id gives, so a rerun, on
any cluster, draws the same copies. Copies are exploded and dealt out by a hash, which puts them in random order.

Results for odd input: a null source is a source of its own; a null id draws as an id of its own; rows that share an
id draw alike; empty tables give empty ones; a source of weight 0 gives no rows, and if all sources have it there are
none. All columns of docs are kept, but those named like copy_col and order_col give way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from snapsync.llm.common import free_names

#: Sources up to this number are sent to all tasks (some hundred bytes each); more are joined by shuffle.
FEW_SOURCES = 10_000
#: A larger mean is drawn as a sum of this many times smaller ones: exp(-mean) must not vanish.
LARGEST_MEAN = 200.0


def hash_unit(*parts: Column) -> Column:
    """A number in [0, 1) with 52 bits from the MD5 of the parts."""
    digest = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_cdf(mean: Column) -> Column:
    """Array of P(X <= k) for k = 0, 1, ... until it is as good as 1."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 40).cast("int")
    step = lambda s, k: F.struct(
        (s["p"] * mean / k).alias("p"),
        (s["c"] + s["p"] * mean / k).alias("c"),
        F.concat(s["all"], F.array(s["c"] + s["p"] * mean / k)).alias("all"),
    )
    p0 = F.exp(-mean)
    return F.aggregate(F.sequence(F.lit(1), last), F.struct(p0.alias("p"), p0.alias("c"), F.array(p0).alias("all")), step, lambda s: s["all"])


def source_rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, total: int | None) -> DataFrame:
    """source, mean, parts, cdf: the mean rate, cut in equal parts, and the distribution of one part."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        counts = counts.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(temperature)))
    else:
        given = [x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))]
        counts = counts.withColumn("w", F.coalesce(F.create_map(*given)[F.col("source")], F.lit(0.0)) if given else F.lit(0.0))
    sums = counts.agg(F.sum("w").alias("all_w"), F.sum("n").alias("all_n"))
    goal = F.lit(total) if total is not None else F.col("all_n")
    rates = counts.join(F.broadcast(sums)).withColumn("mean", F.when(F.col("all_w") > 0, F.col("w") / F.nullif("all_w", F.lit(0.0)) * goal / F.col("n")).otherwise(0.0))
    rates = rates.withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("mean") / LARGEST_MEAN).cast("int")))
    return rates.select(F.col("source").alias("rate_source"), "mean", "parts", poisson_cdf(F.col("mean") / F.col("parts")).alias("cdf"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, total: int | None = None, seed: str = "mix", copy_col: str = "copy", order_col: str = "order_key") -> DataFrame:
    """docs with each row as often as drawn, in random order, and the columns copy (from 0) and order_key.

    weights: by source; without them a source weighs as its count to the power temperature. total: rows to aim at,
    as many as there are without it.
    """
    docs = docs.drop(copy_col, order_col)
    source, parts, cdf, n = free_names(docs, "rate_source", "rate_parts", "rate_cdf", "n_copies")
    rates = source_rates(docs.select("source"), weights, temperature, total).select(F.col("rate_source").alias(source), F.col("parts").alias(parts), F.col("cdf").alias(cdf))
    few = docs.select("source").distinct().limit(FEW_SOURCES + 1).count() <= FEW_SOURCES
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    drawn = lambda part: F.size(F.filter(cdf, lambda c: c < hash_unit(F.lit(seed), key, part.cast("string"))))
    copies = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda total, part: total + drawn(part))
    joined = docs.join(F.broadcast(rates) if few else rates, F.col("source").eqNullSafe(F.col(source)))
    rows = joined.withColumn(n, copies).where(F.col(n) > 0)
    rows = rows.select(*docs.columns, F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(copy_col))
    rows = rows.withColumn(order_col, F.md5(F.concat_ws("|", F.lit(seed), F.lit("order"), key, F.col(copy_col).cast("string"))))
    return rows.repartition(F.col(order_col)).sortWithinPartitions(order_col)


#: The rows of mix_sources(documents) with its defaults.
SQL = """
WITH RECURSIVE counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS w FROM documents GROUP BY source),
rates AS (SELECT source, w / sum(w) OVER () * sum(n) OVER () / n AS mean FROM counts),
parts AS (SELECT source, greatest(1, ceil(mean / 200.0)::INT) AS parts, mean / greatest(1, ceil(mean / 200.0)::INT) AS mean FROM rates),
cdf(source, mean, k, p, c) AS (
  SELECT source, mean, 0, exp(-mean), exp(-mean) FROM parts
  UNION ALL
  SELECT source, mean, k + 1, p * mean / (k + 1), c + p * mean / (k + 1) FROM cdf WHERE k < ceil(mean + 12 * sqrt(mean) + 40)),
lists AS (SELECT source, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, (SELECT sum(len(list_filter(l.cdf, lambda x: x < ('0x' || substr(md5(concat_ws('|', 'mix', coalesce(d.doc_id::VARCHAR, 'null'), j::VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0)))
               FROM unnest(range(1, p.parts + 1)) t(j))::INT AS n_copies
  FROM documents d JOIN lists l ON d.source IS NOT DISTINCT FROM l.source JOIN parts p ON d.source IS NOT DISTINCT FROM p.source),
copies AS (SELECT * EXCLUDE (n_copies), unnest(range(0, n_copies))::INT AS copy FROM drawn WHERE n_copies > 0)
SELECT *, md5(concat_ws('|', 'mix', 'order', coalesce(doc_id::VARCHAR, 'null'), copy::VARCHAR)) AS order_key FROM copies
"""
