"""Ball k-means on integer vectors: centroids of neighbouring balls are all that a member is compared with."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import floor, isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import materialize, release

CLUSTERS = 16
ROUNDS = 3
DIMENSIONS = 64
#: Components are counted in 1/SCALE.
SCALE = 64
#: Integers below this stay in 64-bit arithmetic, squared distances times four included; larger ones are Python's.
NARROW = 1 << 24
#: Sums go to Spark in digits of so many bits, so that they are exact at every size.
DIGIT_BITS = 32
LONGEST = (1 << 63) - 1


@dataclass
class Balls:
    """Centroids, and of each ball its neighbours as (squared distance of the centroids, number), nearest first.

    known: whether members have a ball from the round before; else they are compared with every centroid.
    """

    centroids: list[list[int]]
    known: bool = False
    neighbours: list[list[tuple[int, int]]] = field(default_factory=list)


def _squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def _root_up(n: int) -> int:
    """The square root of n, rounded up."""
    return isqrt(n - 1) + 1 if n else 0


def find_neighbours(centroids: list[list[int]], radii: list[int | None]) -> list[list[tuple[int, int]]]:
    """Of each ball the centroids that may be as near to a member as its own: within twice its radius (None: unbounded)."""
    found = []
    for i, (centre, radius) in enumerate(zip(centroids, radii, strict=True)):
        others = sorted((_squared(centre, other), j) for j, other in enumerate(centroids) if j != i)
        found.append([(d, j) for d, j in others if radius is None or d <= 4 * radius * radius])
    return found


def integers(column: pa.Array, dimensions: int, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) of each component: rows of 64-bit integers, or of Python's where one is too large."""
    values = np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), dimensions)
    if not values.size or np.abs(values).max() < NARROW / scale:
        return np.floor(scale * values).astype(np.int64)
    whole = lambda x: scale * int(x) if abs(x) >= 2.0**52 else floor(scale * x)
    return np.array([[whole(x) for x in row] for row in values.tolist()], object)


def _distances(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    apart = rows - centre
    return (apart * apart).sum(axis=1)


def assign(rows: np.ndarray, own: np.ndarray | None, balls: Balls) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, squared distance, centroids compared) of each row.

    A member x of ball i is nearer to its centroid than to j's wherever 2 d(x, i) < d(i, j). Those for which this
    holds for all j are the stable core. The others lie in annuli: a member in the k-th is compared with the
    first k neighbours. Ties go to the smaller number.
    """
    wide = rows.dtype == object or any(abs(v) >= NARROW for c in balls.centroids for v in c)
    kind = object if wide else np.int64
    rows, centres = rows.astype(kind), [np.array(c, kind) for c in balls.centroids]
    if own is None:
        cluster, best = np.zeros(len(rows), np.int32), _distances(rows, centres[0])
        for j in range(1, len(centres)):
            found = _distances(rows, centres[j])
            nearer = (found < best).astype(bool)
            cluster[nearer], best[nearer] = j, found[nearer]
        return cluster, best, np.full(len(rows), len(centres), np.int32)
    cluster, best, compared = own.copy(), np.zeros(len(rows), kind), np.ones(len(rows), np.int32)
    for i in np.unique(own):
        members = np.flatnonzero(own == i)
        near = _distances(rows[members], centres[i])
        neighbours = balls.neighbours[i]
        annulus = np.searchsorted(np.array([d for d, _ in neighbours], kind), 4 * near, side="right")
        compared[members] += annulus.astype(np.int32)
        nearest = np.full(len(members), i, np.int32)
        for k in range(int(annulus.max(initial=0))):
            j = neighbours[k][1]
            outer = np.flatnonzero(annulus > k)
            found = _distances(rows[members[outer]], centres[j])
            nearer = ((found < near[outer]) | ((found == near[outer]) & (j < nearest[outer]))).astype(bool)
            near[outer[nearer]], nearest[outer[nearer]] = found[nearer], j
        cluster[members], best[members] = nearest, near
    return cluster, best, compared


def _assigned(rows: DataFrame, balls: Balls, dimensions: int, scale: int) -> DataFrame:
    """rows (vec_id, vector, cluster) with the new cluster, the one before and the squared distance (null beyond 64 bits)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                before = batch.column("cluster")
                own = np.asarray(before, np.int32) if balls.known else None
                cluster, distance, compared = assign(integers(batch.column("vector"), dimensions, scale), own, balls)
                fits = [int(d) if d <= LONGEST else None for d in distance] if distance.dtype == object else distance
                arrays = [pa.array(cluster, pa.int32()), before, pa.array(fits, pa.int64()), pa.array(compared, pa.int32())]
                names = ["cluster", "before", "distance", "compared"]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vector"), *arrays], ["vec_id", "vector", *names])

    kind = rows.schema["vector"].dataType.simpleString()
    return rows.select("vec_id", "vector", "cluster").mapInArrow(
        each, f"vec_id long, vector {kind}, cluster int, before int, distance long, compared int"
    )


def _changes(rows: DataFrame, dimensions: int, scale: int) -> DataFrame:
    """(cluster, component, digit, total): what rows that changed their ball add to the sums; component -1 counts them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = integers(batch.column("vector"), dimensions, scale)
            for column, sign in (("cluster", 1), ("before", -1)):
                numbers = np.asarray(batch.column(column), np.int32)
                for i in np.unique(numbers[numbers >= 0]):
                    members = vectors[numbers == i]
                    total = np.array([*members.sum(axis=0).tolist(), len(members)], object)
                    sums[int(i)] = sums.get(int(i), 0) + sign * total
        found = []
        for i, totals in sums.items():
            for component, total in enumerate(totals):
                rest, sign, digit = abs(total), (-1 if total < 0 else 1), 0
                while rest:
                    found.append((i, component if component < dimensions else -1, digit, sign * (rest & ((1 << DIGIT_BITS) - 1))))
                    rest, digit = rest >> DIGIT_BITS, digit + 1
        if found:
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            columns = [pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "component", "digit", "total"])

    parts = rows.select("vector", "cluster", "before").mapInArrow(each, "cluster int, component int, digit int, total long")
    return parts.groupBy("cluster", "component", "digit").agg(F.sum("total").alias("total"))


def _radii(rows: DataFrame, clusters: int) -> list[int | None]:
    """The radius of each ball rounded up, 0 of an empty one, None where a distance is beyond 64 bits."""
    radii: list[int | None] = [0] * clusters
    for r in rows.groupBy("cluster").agg(F.max("distance").alias("most"), F.bool_or(F.col("distance").isNull()).alias("wide")).collect():
        radii[r["cluster"]] = None if r["wide"] else _root_up(r["most"])
    return radii


def ball_kmeans(
    embeddings: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    dimensions: int = DIMENSIONS,
    scale: int = SCALE,
    seed: int = 1,
) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance, compared) of each vector kept, the centroids) after so many rounds.

    Vectors have `dimensions` components, each floor(scale * x); others go. The first centroids are the vectors with
    the smallest SHA-256 of "<seed>:<id>". A round assigns each vector to the nearest centroid (ties: the smaller
    number), then replaces each centroid by the floor of its members' mean; empty ones stay. At the end vectors are
    assigned again. distance is squared; compared counts the centroids looked at in the last assignment.

    Every assignment is a pass over the vectors that writes them with their ball. Sums change by the members that
    moved, which alone are read for them. Neighbours come from the radii of the last assignment, plus the way
    that the centroid has gone since; so one pass a round is enough. Only centroids, radii and sums (clusters x
    dimensions) come to the driver. All arithmetic is exact.

    Nulls: vectors that are null, of another width or hold null or non-finite components go; a null id is an
    empty text in its hash and keeps its row. Rows that repeat an id or a vector are rows of their own, and seeds
    that tie are ordered by vector. With fewer vectors than clusters there are as many centroids as vectors; an
    empty table gives none. distance is null where it exceeds 64 bits. Extra columns are not returned.
    """
    vector = F.col(f"`{vector_col}`")
    if embeddings.schema[vector_col].dataType.simpleString() not in ("array<float>", "array<double>"):
        vector = vector.cast("array<double>")
    rows = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vector.alias("vector"), F.lit(-1).alias("cluster"))
    finite = F.forall("vector", lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))
    rows = rows.where((F.size("vector") == dimensions) & finite)
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    seeds = rows.select(mark.alias("mark"), "vector").orderBy("mark", "vector").limit(clusters).collect()
    if not seeds:
        none = rows.select("vec_id", "cluster", F.lit(0).cast("long").alias("distance"), F.lit(0).alias("compared"))
        return none, []
    first = integers(pa.array([r["vector"] for r in seeds], pa.list_(pa.float64())), dimensions, scale)
    balls = Balls([[int(v) for v in row] for row in first])
    counts, sums = [0] * len(seeds), [[0] * dimensions for _ in seeds]
    current = materialize(_assigned(rows, balls, dimensions, scale), "balls")
    for _ in range(rounds):
        for r in _changes(current.where("cluster <> before"), dimensions, scale).collect():
            change = r["total"] << (DIGIT_BITS * r["digit"])
            if r["component"] < 0:
                counts[r["cluster"]] += change
            else:
                sums[r["cluster"]][r["component"]] += change
        moved = [[v // n for v in total] if n else old for n, total, old in zip(counts, sums, balls.centroids, strict=True)]
        steps = [_root_up(_squared(a, b)) for a, b in zip(moved, balls.centroids, strict=True)]
        radii = [None if r is None else r + s for r, s in zip(_radii(current, len(seeds)), steps, strict=True)]
        balls = Balls(moved, True, find_neighbours(moved, radii))
        before, current = current, materialize(_assigned(current, balls, dimensions, scale), "balls")
        release(before)
    return current.select("vec_id", "cluster", "distance", "compared"), balls.centroids


def op11_ball_kmeans(spark, sf_dir: str) -> DataFrame:
    found, centroids = ball_kmeans(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), F.bool_or(F.col("distance").isNull()).alias("wide"))
    inertia = {r["cluster"]: None if r["wide"] else int(r["s"]) for r in sums.collect()}
    total = None if None in inertia.values() else sum(inertia.values())
    fit = lambda v: None if v is None or v > LONGEST else v
    rows = [
        (i, fit(inertia.get(i, 0)), fit(total), hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)
    ]
    # a row for each centroid
    figures = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(figures), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared"
    )
