"""Numbering that depends on the row before, in pieces of bounded size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], value: str, chunk: Column, name: str = "island") -> DataFrame:
    """Number the runs of equal `value` of each key in order, from 0.

    chunk must not fall as the order goes on. A task sorts one chunk of a key; what a chunk must know of
    those before it, their last value and their number of runs, comes from a row for each chunk.
    """
    df = df.withColumn("__chunk", chunk)
    within = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    before = F.lag(value).over(within)
    first = F.row_number().over(within) == 1
    df = df.withColumn("__change", F.when(first, F.lit(0)).otherwise((~before.eqNullSafe(F.col(value))).cast("int")))
    df = df.withColumn("__run", F.sum("__change").over(within.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.struct(*order)
    chunks = df.groupBy(*keys, "__chunk").agg(
        F.min_by(value, at).alias("__first"), F.max_by(value, at).alias("__last"), F.max("__run").alias("__changes")
    )
    along = Window.partitionBy(*keys).orderBy("__chunk")
    edge = F.when(F.row_number().over(along) == 1, F.lit(0)).otherwise((~F.lag("__last").over(along).eqNullSafe(F.col("__first"))).cast("int"))
    chunks = chunks.withColumn("__edge", edge)
    earlier = F.sum(F.col("__edge") + F.col("__changes")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__changes")
    chunks = chunks.select(*[F.col(k).alias(f"__key{i}") for i, k in enumerate(keys)], F.col("__chunk").alias("__of"), earlier.alias("__earlier"))
    same = F.col("__chunk") == F.col("__of")
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"__key{i}"))
    joined = df.join(chunks, same)
    dropped = ["__chunk", "__change", "__run", "__of", "__earlier", *[f"__key{i}" for i in range(len(keys))]]
    return joined.withColumn(name, F.col("__earlier") + F.col("__run")).drop(*dropped)
