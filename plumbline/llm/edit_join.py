"""The segment-partition edit join for any threshold (DataFrame functions only): lines of two edits or more apart.

llm.lines has the form for one edit, which resolves crowded buckets without pairs.
"""

from __future__ import annotations

from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import materialize, new_path, release

#: Pairs are formed in buckets of so many lines at most; of larger ones the segments left out are split.
BUCKET = 4
#: Segments that one is split into.
SPLIT = 4


def _changes(edits: int) -> list[tuple[int, ...]]:
    """By how many characters each of the segments left out may be longer in the probing line, which is no shorter in all."""
    return [d for d in product(range(-edits, edits + 1), repeat=edits) if sum(map(abs, d)) <= edits and sum(d) >= 0]


def _ints(values: list[tuple[int, ...]]) -> Column:
    return F.lit([list(v) for v in values]).cast("array<array<int>>")


def _key(line: Column, parts: int, wild: Column, change: Column, edits: int) -> tuple[Column, Column]:
    """(key, length of the indexed line): a hash of all of a line but the segments left out, and of their places.

    Segments are cut by the length of the indexed line; in a probing one places shift by the changes before.
    """
    of = lambda values, k: F.element_at(values, k + 1)
    total = F.aggregate(change, F.lit(0), lambda a, x: a + x)
    length = F.length(line) - total
    cut = lambda k: F.floor(length * k / F.lit(parts)).cast("int")
    kept, at, shift = [], F.lit(0), F.lit(0)
    for k in range(edits):
        start = cut(of(wild, k))
        kept.append(F.substring(line, at + shift + 1, start - at))
        at, shift = cut(of(wild, k) + 1), shift + of(change, k)
    kept.append(F.substring(line, at + shift + 1, F.length(line)))
    return F.xxhash64(F.lit(parts), wild, length, *kept), length


def _entries(rows: DataFrame, parts: int, edits: int) -> DataFrame:
    key, length = _key(F.col("line"), parts, F.col("wild"), F.col("change"), edits)
    role = F.when(F.exists("change", lambda d: d != 0), F.lit(1)).otherwise(F.lit(0))
    return rows.select("c1", "c2", "line", "wild", "change", role.alias("role"), length.alias("length"), key.alias("key")).where("length > 0")


def _bucketed(entries: DataFrame) -> DataFrame:
    sizes = entries.groupBy("key").agg(F.count_if(F.col("role") == 0).alias("n0"), F.count("*").alias("n"))
    return entries.join(sizes.where("n0 > 0 AND n > 1").select("key", "n").hint("merge"), "key")


def _pairs(met: DataFrame) -> DataFrame:
    a = met.where("role = 0").select("key", F.col("c1").alias("a1"), F.col("c2").alias("a2"))
    b = met.select("key", "role", F.col("c1").alias("b1"), F.col("c2").alias("b2"))
    once = (F.struct("a1", "a2") != F.struct("b1", "b2")) & ((F.col("role") == 1) | (F.struct("a1", "a2") < F.struct("b1", "b2")))
    return a.join(b.hint("merge"), "key").where(once).select("a1", "a2", "b1", "b2").distinct()


def _finer(rows: DataFrame, edits: int) -> DataFrame:
    """The rows once for each choice of finer segments in those left out, the changes of each adding up to what they were."""
    places = list(combinations(product(range(edits), range(SPLIT)), edits))
    shapes = [tuple(x for place in p for x in place) + d for p in places for d in _changes(edits)]
    spread = rows.select("c1", "c2", "line", F.col("wild").alias("w"), F.col("change").alias("d"), F.explode(_ints(shapes)).alias("s"))
    of = lambda k: F.element_at("s", k + 1)
    for k in range(edits):
        own = sum((F.when(of(2 * j) == k, of(2 * edits + j)).otherwise(F.lit(0)) for j in range(edits)), F.lit(0))
        spread = spread.where(own == F.element_at("d", k + 1))
    wild = F.array(*[F.element_at("w", of(2 * j) + 1) * SPLIT + of(2 * j + 1) for j in range(edits)])
    return spread.select("c1", "c2", "line", wild.alias("wild"), F.array(*[of(2 * edits + j) for j in range(edits)]).alias("change"))


def candidate_pairs(texts: DataFrame, edits: int) -> DataFrame:
    """(a1, a2, b1, b2): pairs of lines (c1, c2, line) that may be within so many edits; none that is gets lost.

    Lines are cut into edits + 1 segments, so that of two lines within reach at most `edits` segments differ; a
    line has a key for each choice of that many, and as a probe of shorter lines for each way in which the
    lengths of those segments may differ. Crowded buckets split the segments left out until single characters
    are left; lines of such a bucket differ in `edits` characters only, so their number is bounded by the
    alphabet, and their pairs are formed.
    """
    path = new_path(texts.sparkSession, "edit-pairs")
    parts, written = edits + 1, []
    shapes = [wild + change for wild in combinations(range(parts), edits) for change in _changes(edits)]
    rows = texts.select("c1", "c2", "line", F.explode(_ints(shapes)).alias("s"))
    rows = rows.select("c1", "c2", "line", F.slice("s", 1, edits).alias("wild"), F.slice("s", edits + 1, edits).alias("change"))
    while True:
        met = materialize(_bucketed(_entries(rows, parts, edits)), "edit-met")
        done = (F.col("n") <= BUCKET) | (F.col("length") <= parts)
        _pairs(met.where(done)).write.mode("append").parquet(path)
        written.append(met)
        dense = met.where(~done)
        if dense.isEmpty():
            break
        rows, parts = _finer(dense, edits), parts * SPLIT
    for table in written:
        release(table)
    return texts.sparkSession.read.schema("a1 long, a2 long, b1 long, b2 long").parquet(path).distinct()
