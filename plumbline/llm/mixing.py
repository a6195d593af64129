"""Mixing sources to target weights by Poisson replication (DataFrame functions only)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import with_columns_replaced

#: Up to so many sources their distributions (at most 3 KB each) are broadcast; beyond, the join is salted.
BROADCAST_SOURCES = 4096
#: Larger mean rates are drawn as sums of independent draws of at most this mean.
MAX_DRAW_MEAN = 64.0
SALTS = 32


def hash_long(*parts: Column) -> Column:
    """52 bits of the MD5 of the parts, as a long; other engines can repeat it."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("long")


def hash_uniform(*parts: Column) -> Column:
    """A double strictly between 0 and 1 from hash_long."""
    return (hash_long(*parts) + F.lit(0.5)) / F.lit(float(2**52))


def poisson_cdf(mean: Column) -> Column:
    """array(F(0), F(1), ...) of the Poisson distribution, far enough that the rest is below 2^-53."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    start = F.struct(
        (-mean).alias("logp"), F.exp(-mean).alias("cum"), F.array(F.exp(-mean)).alias("cdf")
    )

    def step(state: Column, k: Column) -> Column:
        logp = state["logp"] + F.ln(mean) - F.ln(k)
        cum = state["cum"] + F.exp(logp)
        return F.struct(logp.alias("logp"), cum.alias("cum"), F.array_append(state["cdf"], cum).alias("cdf"))

    steps = F.aggregate(F.sequence(F.lit(1), last), start, step, lambda state: state["cdf"])
    return F.when(mean > 0, steps).otherwise(F.array(F.lit(1.0)))


def source_rates(
    docs: DataFrame,
    *,
    source_col: str = "source",
    weights: dict[str | None, float] | None = None,
    alpha: float = 0.5,
    total_rows: int | None = None,
) -> tuple[DataFrame, int]:
    """(source_key, n_rows, rate) for each source, and the number of sources.

    weights: the share of the output for each source, in any unit; sources that it lacks get none.
    Without weights the shares are proportional to n_rows ** alpha. total_rows: the expected number
    of rows out; as many as come in by default.
    """
    stats = docs.groupBy(F.col(source_col).alias("source_key")).agg(F.count("*").alias("n_rows"))
    if weights is None:
        weight = F.pow(F.col("n_rows").cast("double"), F.lit(alpha))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source_key").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    stats = stats.withColumn("weight", weight)
    sums = stats.agg(
        F.count("*").alias("n"), F.sum("n_rows").alias("rows"), F.sum("weight").alias("weight")
    ).first()
    total = float(total_rows if total_rows is not None else sums["rows"] or 0)
    scale = total / sums["weight"] if sums["weight"] else 0.0
    rates = stats.select(
        "source_key", "n_rows", (F.lit(scale) * F.col("weight") / F.col("n_rows")).alias("rate")
    )
    return rates, sums["n"]


def mix_sources(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    source_col: str = "source",
    weights: dict[str | None, float] | None = None,
    alpha: float = 0.5,
    total_rows: int | None = None,
    seed: str = "mix-1",
) -> DataFrame:
    """Repeat each row by a Poisson count whose mean brings its source to its target share, in random order.

    The count inverts the Poisson distribution at a uniform number hashed from seed and id, so it does
    not depend on partitions, retries or other rows. Adds rate (mean count), n_copies (1 or more; rows
    drawn 0 times are absent), copy_no (from 0) and shuffle_key; rows come dealt out by shuffle_key
    and what they hold, and sorted by the key within each partition, a global random order.

    Nulls: a null source is a source of its own; a null id counts as the text "null". Rows that share an
    id share the draw. Texts decide nothing but where a row is dealt. An empty table stays empty. Input columns named like the
    added ones are replaced.
    """
    rates, n_sources = source_rates(
        docs, source_col=source_col, weights=weights, alpha=alpha, total_rows=total_rows
    )
    draws = F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_DRAW_MEAN)).cast("int")
    rates = rates.where("rate > 0").select(
        "source_key", "rate", draws.alias("draws"), poisson_cdf(F.col("rate") / draws).alias("cdf")
    )
    key = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))
    kept = [c for c in docs.columns if c.lower() not in {"rate", "n_copies", "copy_no", "shuffle_key"}]
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), key.alias("id_key"))
    source = F.col("row")[source_col]
    if n_sources <= BROADCAST_SOURCES:
        joined = keyed.join(F.broadcast(rates), source.eqNullSafe(F.col("source_key")))
    else:
        salted = rates.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        keyed = keyed.withColumn("doc_salt", F.pmod(F.xxhash64("id_key"), F.lit(SALTS)).cast("int"))
        joined = keyed.join(
            salted, source.eqNullSafe(F.col("source_key")) & (F.col("doc_salt") == F.col("salt"))
        )

    def draw(j: Column) -> Column:
        part = F.when(j == 1, hash_uniform(F.lit(seed), F.col("id_key"))).otherwise(
            hash_uniform(F.lit(seed), F.col("id_key"), j.cast("string"))
        )
        return F.size(F.filter(F.col("cdf"), lambda c: c < part))

    counts = F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), lambda n, j: n + draw(j))
    copies = (
        joined.select("row", "id_key", "rate", counts.alias("n_copies"))
        .where("n_copies > 0")
        .select("*", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy_no"))
    )
    order = hash_long(F.lit(seed), F.lit("order"), F.col("id_key"), F.col("copy_no").cast("string"))
    dealt = copies.select("row.*", "rate", "n_copies", "copy_no", order.alias("shuffle_key"))
    # rows that share an id, or have none, share a key: what else they hold parts them
    plain = [F.col(f"`{c}`") for c in kept if not re.search("map<|variant", docs.schema[c].dataType.simpleString())]
    return dealt.repartition("shuffle_key", F.xxhash64(*plain)).sortWithinPartitions("shuffle_key")


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("rate")


OP1_SQL = """
WITH stats AS (SELECT source, count(*) AS n_rows, pow(count(*)::DOUBLE, 0.5) AS weight FROM documents GROUP BY source),
rates AS (
  SELECT source, (SELECT sum(n_rows)::DOUBLE / sum(weight) FROM stats) * weight / n_rows AS rate FROM stats),
pmf AS (
  SELECT source, rate, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
  FROM rates, (SELECT unnest(range(0, 200)) AS k)),
cdf AS (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf),
drawn AS (
  SELECT d.*, (('0x' || substr(md5('mix-1|' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents d),
counted AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, count(c.k) FILTER (c.c < d.u) AS n
  FROM drawn d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source
  GROUP BY ALL),
copies AS (
  SELECT doc_id, text, lang, source, n_chars, n, unnest(range(0, n)) AS k FROM counted WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, n::INTEGER AS n_copies, k::INTEGER AS copy_no,
  ('0x' || substr(md5('mix-1|order|' || doc_id || '|' || k), 1, 13))::BIGINT AS shuffle_key
FROM copies
"""
