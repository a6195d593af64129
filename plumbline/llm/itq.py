"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, rerank on the vectors."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import acos, comb, pi, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import connected_components
from plumbline.llm.tables import materialize, release

THRESHOLD = 0.95
#: The rotation is learned on so many vectors at most: those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
ROTATION_ROUNDS = 50
#: Codes are cut into substrings of about log2(vectors) bits, between these. Wider ones would need probes in
#: the ten thousands for the same recall, so beyond four million vectors buckets grow instead.
SUBSTRING_BITS = (16, 22)
#: Tables look up substrings in so wide a radius that this share of pairs at the threshold meets in one of them.
MEETING = 0.93
#: Vectors whose codes differ in more bits than all but this share of the pairs at the threshold count as not found;
#: at a cosine of 0.95 that is 16 of 64 bits, where the mean is 6.5.
BEYOND = 2e-4
#: A bucket's codes, and its vectors, are compared in blocks of so many by so many.
BLOCK = 2048


def learn_rotation(sample: np.ndarray, bits: int = 64, rounds: int = ROTATION_ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection): principal directions turned so that signs lose least (iterative quantisation)."""
    mean = sample.mean(axis=0)
    centred = sample - mean
    _, vectors = np.linalg.eigh(centred.T @ centred)
    principal = vectors[:, ::-1][:, : min(bits, sample.shape[1])]
    values = centred @ principal
    turn, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((values.shape[1],) * 2))
    for _ in range(rounds):
        signs = np.where(values @ turn > 0, 1.0, -1.0)
        u, _, vt = np.linalg.svd(signs.T @ values)
        turn = vt.T @ u.T
    return mean, principal @ turn


def unit_vectors(vectors: np.ndarray) -> np.ndarray:
    """Rows of length 1; powers of two come off first, so that no square overflows or vanishes."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def encode(unit: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    """The signs of the turned unit vectors as 64-bit codes.

    Vectors of another width than the rotation was learned on take random directions of their own width.
    """
    if unit.shape[1] != len(projection):
        mean, projection = 0.0, np.random.default_rng(unit.shape[1]).standard_normal((unit.shape[1], projection.shape[1]))
    signs = (unit - mean) @ projection > 0
    padded = np.zeros((len(unit), 64), bool)
    padded[:, : signs.shape[1]] = signs
    return np.packbits(padded, axis=1, bitorder="little").view("<i8").ravel()


def substrings(bits: int, rows: int) -> list[tuple[int, int]]:
    """(first bit, bits) of each substring."""
    wanted = min(max(int(np.ceil(np.log2(max(rows, 2)))), SUBSTRING_BITS[0]), SUBSTRING_BITS[1])
    parts = max(1, bits // wanted, -(-bits // SUBSTRING_BITS[1]))
    cuts = [round(k * bits / parts) for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def substring_radius(parts: list[tuple[int, int]], threshold: float) -> int:
    """Bits that a substring looked up may differ in, for MEETING of the pairs at the threshold to meet.

    A bit differs with the probability of a random plane between the two; bits count as independent.
    """
    p = acos(min(max(threshold, -1.0), 1.0)) / pi
    for radius in range(max(bits for _, bits in parts)):
        within = [sum(comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(radius + 1)) for _, bits in parts]
        if 1 - prod(1 - w for w in within) >= MEETING:
            return radius
    return max(bits for _, bits in parts)


def code_radius(threshold: float) -> int:
    """Bits of 64 that codes may differ in, for all but BEYOND of the pairs at the threshold to be within."""
    p = acos(min(max(threshold, -1.0), 1.0)) / pi
    more = 1.0
    for radius in range(64):
        more -= comb(64, radius) * p**radius * (1 - p) ** (64 - radius)
        if more <= BEYOND:
            return radius
    return 64


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _keyed(classes: DataFrame, mean: np.ndarray, projection: np.ndarray, parts: list[tuple[int, int]], radius: int) -> DataFrame:
    """(bucket, probing, rep, code) for each table: a vector's own substring as indexed, and all within the radius as probes.

    Vectors of different widths never share a bucket.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = np.diff(batch.column("vector").offsets.to_numpy())
            for width in np.unique(widths):
                own = batch.filter(pa.array(widths == width))
                code = encode(unit_vectors(_matrix(own.column("vector"))), mean, projection)
                for table, (at, bits) in enumerate(parts):
                    part = ((code.view(np.uint64) >> np.uint64(at)).astype(np.int64)) & ((1 << bits) - 1)
                    for k in range(radius + 1):
                        for flip in (sum(1 << b for b in places) for places in combinations(range(bits), k)):
                            bucket = pa.array((table << 56) | (int(width) << SUBSTRING_BITS[1]) | (part ^ flip))
                            for probing in (0, 1) if not k else (1,):
                                sides = pa.array(np.full(len(code), probing, np.int32))
                                yield pa.RecordBatch.from_arrays([bucket, sides, own.column("rep"), pa.array(code)], ["bucket", "probing", "rep", "code"])

    return classes.select("rep", "vector").mapInArrow(keys, "bucket long, probing int, rep long, code long")


def _blocked(entries: DataFrame, probes: int) -> DataFrame:
    """The entries of buckets with an indexed one and so many probes, once for each block of BLOCK by BLOCK that they are in."""
    sizes = entries.groupBy("bucket").agg(F.sum("probing").alias("x"), F.sum(1 - F.col("probing")).alias("y")).where((F.col("x") >= probes) & (F.col("y") > 0))
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int").alias(f"{n}_blocks")
    # stored, so that adaptive execution can split a bucket of very many in the join
    stored = materialize(sizes.select("bucket", blocks("x"), blocks("y")), "bucket-sizes")
    salted = entries.join(stored.hint("merge"), "bucket")
    mine = lambda n: F.array(F.pmod(F.xxhash64("rep"), F.col(n)).cast("int"))
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    own = F.col("probing") == 1
    salted = salted.withColumn("x_block", F.explode(F.when(own, mine("x_blocks")).otherwise(every("x_blocks"))))
    return salted.withColumn("y_block", F.explode(F.when(own, every("y_blocks")).otherwise(mine("y_blocks")))).drop("x_blocks", "y_blocks")


_BLOCK = ["bucket", "x_block", "y_block"]


def _dealt(blocks: DataFrame) -> DataFrame:
    return blocks.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """(rows, cuts): rows of whole blocks, and where each begins and ends, of rows sorted by block."""
    held: list[pa.RecordBatch] = []

    def cuts_of(table: pa.Table) -> np.ndarray:
        keys = np.stack([table.column(c).to_numpy() for c in _BLOCK], axis=1)
        return np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        whole = pa.Table.from_batches(held)
        ends = cuts_of(whole)
        if len(ends):
            yield whole.slice(0, int(ends[-1])).combine_chunks(), [0, *map(int, ends)]
            held = whole.slice(int(ends[-1])).to_batches()
    if held:
        whole = pa.Table.from_batches(held).combine_chunks()
        yield whole, [0, *map(int, cuts_of(whole)), whole.num_rows]


def _near_codes(blocks: DataFrame, most: int) -> DataFrame:
    """The (bucket, probing, rep, code) of a block with another one's code within `most` bits across the two sides."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, cuts in _whole_blocks(batches):
            ids, codes = whole.column("rep").to_numpy(), whole.column("code").to_numpy().view(np.uint64)
            probing = whole.column("probing").to_numpy() == 1
            kept = np.zeros(len(ids), bool)
            for a, b in zip(cuts, cuts[1:], strict=False):
                x, y = a + np.flatnonzero(probing[a:b]), a + np.flatnonzero(~probing[a:b])
                near = (np.bitwise_count(codes[x][:, None] ^ codes[y][None, :]) <= most) & (ids[x][:, None] != ids[y][None, :])
                kept[x], kept[y] = near.any(axis=1), near.any(axis=0)
            yield from whole.select(["bucket", "probing", "rep", "code"]).filter(pa.array(kept)).to_batches()

    return blocks.mapInArrow(compared, "bucket long, probing int, rep long, code long")


def _local_roots(linked: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least id of each side's component in one block's links."""
    of_x, of_y = x.copy(), y.copy()
    big = np.iinfo(np.int64).max
    while True:
        new_x = np.minimum(of_x, np.where(linked, of_y[None, :], big).min(axis=1, initial=big))
        new_y = np.minimum(of_y, np.where(linked, new_x[:, None], big).min(axis=0, initial=big))
        if (new_x == of_x).all() and (new_y == of_y).all():
            return of_x, of_y
        of_x, of_y = new_x, new_y


def _compare(blocks: DataFrame, parts: list[tuple[int, int]], radius: int, threshold: float) -> DataFrame:
    """Compare each block's probing vectors with its indexed ones: (rep, links, root) by block and vector.

    A pair is found if some substring is within the radius and the codes are within code_radius(), in buckets of
    every size; it counts in the first table of which that is true.
    """
    most = code_radius(threshold)
    masks = [np.uint64(((1 << bits) - 1) << at) for at, bits in parts]

    def block(ids, probing, codes, vectors, weights, table):
        unit = unit_vectors(vectors)
        x, y = ids[probing], ids[~probing]
        apart = codes[probing][:, None] ^ codes[~probing][None, :]
        linked = (unit[probing] @ unit[~probing].T >= threshold) & (x[:, None] != y[None, :]) & (np.bitwise_count(apart) <= most)
        counted = linked.copy()
        for mask in masks[:table]:
            counted &= np.bitwise_count(apart & mask) > radius
        links = (counted * weights[~probing][None, :]).sum(axis=1)
        roots = _local_roots(linked, x, y)
        return np.concatenate([x, y]), np.concatenate([links, np.zeros(len(y), np.int64)]), np.concatenate(roots)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, cuts in _whole_blocks(batches):
            ids, codes, weights, buckets = (whole.column(c).to_numpy() for c in ("rep", "code", "weight", "bucket"))
            probing = whole.column("probing").to_numpy() == 1
            vectors = whole.column("vector").combine_chunks()
            found = [
                block(ids[a:b], probing[a:b], codes[a:b].view(np.uint64), _matrix(vectors.slice(a, b - a)), weights[a:b], int(buckets[a] >> 56))
                for a, b in zip(cuts, cuts[1:], strict=False)
            ]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["rep", "links", "root"])

    return blocks.mapInArrow(compared, "rep long, links long, root long")


def embedding_groups(
    embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """One row for each vector: vec_id, n_links, component_id, kept (the least id of its component).

    Equal vectors are one class. Codes of the classes meet in substring tables, in blocks of a bounded size: codes
    that are near no other there go, and the vectors of the others are compared by cosine in double precision,
    block by block, which gives counts and a root for each vector instead of pairs. Vectors are compared with
    those of their own width; the rotation is learned on the commonest one.

    Nulls: vectors that are null, zero, or hold null or non-finite components link with nothing and are kept; a
    null id keeps n_links but joins no component. Rows that repeat an id with another vector are rows of their
    own, which an id links. Extra columns are not returned. An empty table gives none.
    """
    rows = embeddings.select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector")
    )
    largest = F.array_max(F.transform("vector", F.abs))  # NaN counts as larger than all numbers
    sound = ~F.exists("vector", lambda v: v.isNull()) & (largest > 0) & (largest < F.lit(float("inf")))
    hashed = rows.withColumn("class", F.when(F.coalesce(sound, F.lit(False)), F.xxhash64("vector")))
    classes = materialize(
        hashed.where("class IS NOT NULL").groupBy("class", "vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")).where("rep IS NOT NULL"),
        "vectors",
    )
    widths = classes.groupBy(F.size("vector").alias("n")).count()
    common = widths.orderBy(F.desc("count"), F.desc("n")).first()
    if common is None:
        none = F.lit(0).cast("long")
        return rows.select("vec_id", none.alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    sample = classes.where(F.size("vector") == common["n"]).orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).select("vector").toPandas()["vector"]
    mean, projection = learn_rotation(unit_vectors(np.stack([np.asarray(v, np.float64) for v in sample])))
    parts = substrings(projection.shape[1], common["count"])
    radius = substring_radius(parts, threshold)
    keyed = materialize(_keyed(classes, mean, projection, parts, radius), "codes")
    # an indexed code is met by its own probe in any case
    members = materialize(_near_codes(_dealt(_blocked(keyed, 2)), code_radius(threshold)).distinct(), "members")
    release(keyed)
    blocks = _blocked(members, 1).join(classes.select("rep", "vector", "weight").hint("merge"), "rep")
    links = materialize(_compare(_dealt(blocks.select(*_BLOCK, "probing", "rep", "code", "weight", "vector")), parts, radius, threshold), "links")
    release(members)
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    components = connected_components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    named = (
        classes.withColumn("class", F.xxhash64("vector"))
        .join(counts.hint("merge"), "rep", "left")
        .join(components.withColumnRenamed("node", "rep").hint("merge"), "rep", "left")
        .select(
            "class",
            F.col("vector").alias("class_vector"),
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    joined = hashed.join(
        named.hint("merge"), (hashed["class"] == named["class"]) & (F.col("vector") == F.col("class_vector")), "left"
    )
    component = F.coalesce("component_id", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"),
    )


def op5_itq(spark, sf_dir: str) -> DataFrame:
    return embedding_groups(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
