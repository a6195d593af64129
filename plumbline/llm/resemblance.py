"""Documents with similar shingle sets: an exact prefix-filter join, rare shingles first."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import connected_components
from plumbline.llm.simhash import fingerprint_of, link_fingerprints, shingle_hashes
from plumbline.llm.tables import materialize, release

SIMILARITY = Fraction(4, 5)
#: Prefixes take frequent shingles last. Which ones count as frequent is estimated on the sets whose hash is 0
#: modulo SAMPLED, and at most FREQUENT_SHINGLES are sent to the tasks: both change the work, never the result.
SAMPLED, FREQUENT, FREQUENT_SHINGLES = 16, 6, 1 << 18
#: Words of 64 bits in a set's sketch.
SKETCH_WORDS = 8
#: So many rows of documents to look at again are sent to all tasks at most; more are joined by shuffle.
BROADCAST_ROWS = 1 << 19
#: Members of a bucket that all others are compared with before those of different components are.
LEADERS = 3
#: Texts whose shingles a Python worker holds at once.
SLICE_ROWS = 512
#: Sets that one task compares with a leader.
LEADER_ROWS = 500
#: Buckets with more members outside their largest component are split by what their members share besides, at most
#: SPLITS times: 0, as splits gave 10,707,194 rows from 83,752 on check_h without an end. Which shingles are common in a bucket is estimated on about SPLIT_SAMPLE of its members. All three
#: change the work, never the result.
CROWDED, SPLITS, SPLIT_SAMPLE = 256, 0, 16


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.cast("binary").alias("text"))


def _distinct(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes.view(np.int64))


def _set_id(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def _sketch(own: np.ndarray) -> np.ndarray:
    """A bit for each shingle; several may share one."""
    bits = np.zeros(64 * SKETCH_WORDS, bool)
    bits[(own >> 24) & (64 * SKETCH_WORDS - 1)] = True
    return np.packbits(bits).view(np.int64)


def _bitmap(own: np.ndarray) -> bytes:
    """The number of shingles, and a bit for each in as many words as leave about half of the bits or more empty."""
    bits = np.zeros(1 << max(6, (2 * len(own) - 1).bit_length()), bool)
    bits[(own >> 20) & (len(bits) - 1)] = True
    return np.int64(len(own)).tobytes() + np.packbits(bits, bitorder="little").tobytes()


def _may_be_similar(x: bytes, y: bytes, similarity: Fraction) -> bool:
    """Whether two bitmaps allow for the similarity: a bit that one lacks is a shingle at least that it lacks."""
    (n, m), (p, q) = (int(np.frombuffer(b, np.int64, 1)[0]) for b in (x, y)), (np.frombuffer(b, np.uint64, offset=8) for b in (x, y))
    size = min(len(p), len(q))
    p, q = (np.bitwise_or.reduce(b.reshape(-1, size), axis=0) for b in (p, q))  # a place's low bits are its place in fewer words
    most = min(n - int(np.bitwise_count(p & ~q).sum()), m - int(np.bitwise_count(q & ~p).sum()))
    return most * (similarity.numerator + similarity.denominator) >= (n + m) * similarity.numerator


def shingled(docs: DataFrame, *, id_col: str, text_col: str, width: int) -> DataFrame:
    """(doc_id, text_hash, fp, set_id, n, sketch) of all rows: the fingerprint, and what tells of the set of shingles."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, SLICE_ROWS) for whole in batches for at in range(0, whole.num_rows, SLICE_ROWS)):
            each = [shingle_hashes(text.as_py() or b"", width) for text in batch.column("text")]
            sets = [_distinct(h) for h in each]
            words = pa.array(np.concatenate([np.zeros(0, np.int64), *map(_sketch, sets)]))
            sketches = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * SKETCH_WORDS, pa.int32()), words)
            columns = [pa.array([fingerprint_of(h) for h in each], pa.int64()), pa.array([_set_id(s) for s in sets], pa.int64())]
            columns += [pa.array([len(s) for s in sets], pa.int32()), sketches]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), *columns], ["doc_id", "text_hash", "fp", "set_id", "n", "sketch"])

    return _rows(docs, id_col, text_col).mapInArrow(hashed, "doc_id long, text_hash long, fp long, set_id long, n int, sketch array<long>")


def _frequent(texts: DataFrame, width: int) -> np.ndarray:
    """Shingles of many sets, sorted."""

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, SLICE_ROWS) for whole in batches for at in range(0, whole.num_rows, SLICE_ROWS)):
            sets = [_distinct(shingle_hashes(text.as_py() or b"", width)) for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))], ["shingle"])

    # copies of a text are one set
    some = texts.where(F.pmod("text_hash", F.lit(SAMPLED)) == 0).dropDuplicates(["text_hash"]).select("text")
    often = some.mapInArrow(sampled, "shingle long").groupBy("shingle").count().where(F.col("count") >= FREQUENT)
    found = often.orderBy(F.desc("count"), "shingle").limit(FREQUENT_SHINGLES).toPandas()["shingle"].to_numpy(np.int64)
    return np.sort(found)


def _prefix_lengths(n: int, similarity: Fraction) -> tuple[int, int]:
    """(near, whole): of how many first shingles of a set of n a similar set shares one, if it has as many or more, and if any.

    A set of n shares similarity * n shingles with any similar one; with one that is not smaller, 2 * s / (1 + s) * n.
    """
    a, b = similarity.numerator, similarity.denominator
    return n - -(-2 * a * n // (a + b)) + 1, n - -(-a * n // b) + 1


def _prefixes(texts: DataFrame, width: int, similarity: Fraction, frequent: np.ndarray) -> DataFrame:
    """(shingle, set_id, n, near): the first shingles of each set, those of one set only left out.

    near: 1 for those of which one is shared with any similar set that is not smaller.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # of a task's batches: copies give their prefix once
        for batch in (whole.slice(at, SLICE_ROWS) for whole in batches for at in range(0, whole.num_rows, SLICE_ROWS)):
            ids, sizes, first, near = [], [], [], []
            for text in batch.column("text"):
                own = _distinct(shingle_hashes(text.as_py() or b"", width))
                n, of = len(own), _set_id(own)
                if not n or of in seen:
                    continue
                if len(seen) < 1 << 20:
                    seen.add(of)
                if len(frequent):
                    at = np.minimum(np.searchsorted(frequent, own), len(frequent) - 1)
                    own = own[np.argsort(frequent[at] == own, kind="stable")]
                least, take = _prefix_lengths(n, similarity)
                ids.append(np.full(take, of)), sizes.append(np.full(take, n)), first.append(own[:take]), near.append(np.arange(take) < least)
            none = [np.zeros(0, np.int64)]
            yield packed(np.stack([np.concatenate(x or none).astype(np.int64) for x in (first, ids, sizes, near)], axis=1))

    def packed(rows: np.ndarray) -> pa.RecordBatch:
        kinds = (np.int64, np.int64, np.int32, np.int32)
        return pa.RecordBatch.from_arrays([pa.array(rows[:, c].astype(k)) for c, k in enumerate(kinds)], ["shingle", "set_id", "n", "near"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by shingle and set: each pair once, if the shingle comes with another set too."""
        held, known = None, False  # the last row so far, and whether its shingle came before
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("shingle", "set_id", "n", "near")], axis=1)
            rows = rows if held is None else np.concatenate([held, rows])
            if not len(rows):
                continue
            rows = rows[np.concatenate([[True], (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])]
            like = rows[1:, 0] == rows[:-1, 0]
            before, after = np.concatenate([[known], like]), np.concatenate([like, [False]])
            done = rows[:-1][(before | after)[:-1]]
            held, known = rows[-1:], bool(before[-1])
            yield packed(done)
        if held is not None and known:
            yield packed(held)

    kind = "shingle long, set_id long, n int, near int"
    return texts.select("text").mapInArrow(cut, kind).repartition("shingle").sortWithinPartitions("shingle", "set_id").mapInArrow(shared, kind)


def _likely(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """(u, v, sizes, most): the pairs (u, v) of different sets whose sketches allow for the similarity.

    A bit of one sketch that the other lacks is a shingle at least that it lacks; most: shingles that both may have.
    """
    a, b = similarity.numerator, similarity.denominator
    both = pairs.distinct()
    for end in "uv":
        both = both.join(sets.select(F.col("set_id").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"k_{end}")).hint("merge"), end)
    lacking = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, n: s + n)
    sizes = F.col("n_u") + F.col("n_v")
    most = F.least(F.col("n_u") - lacking("k_u", "k_v"), F.col("n_v") - lacking("k_v", "k_u"))
    return both.select("u", "v", sizes.alias("sizes"), most.alias("most")).where(F.col("most") * (a + b) >= F.col("sizes") * a)


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, width: int, similarity: Fraction, whole: bool = True) -> DataFrame:
    """(u, v, sizes): the pairs of sets (u, v, sizes) whose similarity is reached, on all their shingles; if not whole,
    those whose bitmaps allow for it.

    The texts of both ends are read again; the set of v goes to a task for some of its u, and theirs follow one by one.
    """
    a, b = similarity.numerator, similarity.denominator
    load = pairs.groupBy("v").agg(F.ceil(F.count("*") / LEADER_ROWS).cast("int").alias("salts"))
    salted = pairs.join(load.hint("merge"), "v").withColumn("salt", F.pmod(F.xxhash64("u"), F.col("salts")).cast("int"))
    task = lambda own, role, u, sizes, salt: F.struct(own.alias("set_id"), F.struct(F.col("v"), salt.alias("salt"), role.alias("role"), u.alias("u"), sizes.alias("sizes")).alias("t"))
    number = lambda x: F.lit(x).cast("long")
    followers = salted.select(task(F.col("u"), F.lit(1), F.col("u"), F.col("sizes"), F.col("salt")).alias("s"))
    salts = F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
    leaders = load.select("v", salts).select(task(F.col("v"), F.lit(0), number(0), F.lit(0), F.col("salt")).alias("s"))
    places = sets.select("set_id", "doc_id", F.col("text_hash").alias("of_text")).hint("merge")
    wanted = followers.unionByName(leaders).select("s.*").join(places, "set_id").groupBy(F.col("doc_id").alias("of_doc"), "of_text").agg(F.collect_list("t").alias("tasks"))
    wanted = materialize(wanted, "shingle-tasks")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    again = texts.join(few, (F.col("doc_id") == F.col("of_doc")) & (F.col("text_hash") == F.col("of_text"))).select("text", "tasks")
    names = ["v", "salt", "role", "u", "sizes", "shingles"]
    kind = "v long, salt int, role int, u long, sizes int, shingles binary"

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            rows, held = [], 0
            for text, tasks in zip(batch.column("text"), batch.column("tasks").to_pylist(), strict=True):
                own = _distinct(shingle_hashes(text.as_py() or b"", width))
                own = own.tobytes() if whole else _bitmap(own)
                rows += [(*(t[c] for c in names[:-1]), own) for t in tasks]
                held += len(own) * len(tasks)
                if held > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
            columns = zip(*rows, strict=True) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, leader = None, b""
        for batch in batches:
            v, role, u, sizes = (batch.column(c).to_numpy() for c in ("v", "role", "u", "sizes"))
            linked = np.zeros(len(v), bool)
            for k, packed in enumerate(batch.column("shingles")):
                own = packed.as_py()
                if not role[k]:
                    at, leader = v[k], own
                elif at == v[k] and whole:
                    common = len(np.intersect1d(np.frombuffer(own, np.int64), np.frombuffer(leader, np.int64), assume_unique=True))
                    linked[k] = common * (a + b) >= int(sizes[k]) * a
                elif at == v[k]:
                    linked[k] = _may_be_similar(own, leader, similarity)
            yield pa.RecordBatch.from_arrays([pa.array(u[linked]), pa.array(v[linked]), pa.array(sizes[linked])], ["u", "v", "sizes"])

    dealt = again.mapInArrow(sent, kind).repartition("v", "salt").sortWithinPartitions("v", "salt", "role")
    return dealt.mapInArrow(compared, "u long, v long, sizes int")


def _shingles_of(wanted: DataFrame, sets: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(set_id, shingles): of the sets wanted (set_id), from their texts; the hashes as bytes, sorted."""
    places = sets.select("set_id", F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text")).hint("merge")
    wanted = materialize(wanted.distinct().join(places, "set_id"), "shingle-sets-wanted")
    few = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    again = texts.join(few, (F.col("doc_id") == F.col("of_doc")) & (F.col("text_hash") == F.col("of_text"))).select("set_id", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, SLICE_ROWS) for whole in batches for at in range(0, whole.num_rows, SLICE_ROWS)):
            own = [_distinct(shingle_hashes(text.as_py() or b"", width)).tobytes() for text in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("set_id"), pa.array(own, pa.binary())], ["set_id", "shingles"])

    # a row of the documents that comes twice is one set
    return again.mapInArrow(read, "set_id long, shingles binary").dropDuplicates(["set_id"])


def _refined(crowded: DataFrame, shingles: DataFrame, similarity: Fraction) -> DataFrame:
    """(shingle, set_id, n, near, component): the buckets (shingle, members, ...) split by their members' prefixes anew.

    In a bucket the shingles of many of its members come last, so what brought its members together separates
    them no more; similar sets share a shingle of these prefixes as of any in one order.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, SLICE_ROWS) for whole in batches for at in range(0, whole.num_rows, SLICE_ROWS)):
            own = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("shingles")]
            buckets = np.repeat(batch.column("shingle").to_numpy(), [len(x) for x in own])
            yield pa.RecordBatch.from_arrays([pa.array(buckets), pa.array(np.concatenate([np.zeros(0, np.int64), *own]))], ["shingle", "other"])

    some = crowded.where(F.pmod(F.xxhash64("set_id", "shingle"), F.col("members")) < SPLIT_SAMPLE).select("shingle", "set_id")
    often = some.join(shingles.hint("merge"), "set_id").select("shingle", "shingles").mapInArrow(listed, "shingle long, other long")
    often = often.groupBy("shingle", "other").count().where(F.col("count") >= SPLIT_SAMPLE // 8)
    often = often.groupBy("shingle").agg(F.sort_array(F.collect_list(F.struct("count", "other"))).alias("often")).select("shingle", F.col("often.other").alias("often"))
    salts = F.ceil(F.col("members") / LEADER_ROWS).cast("int")
    load = crowded.groupBy("shingle").agg(F.first("members").alias("members")).join(often.hint("merge"), "shingle", "left")
    none, number = F.lit(None), lambda k: F.lit(k).cast("long")
    leaders = load.select(
        "shingle", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), F.lit(0).alias("role"), number(0).alias("set_id"), F.lit(0).alias("n"),
        number(0).alias("component"), "often", none.cast("binary").alias("shingles"),
    )
    followers = crowded.join(shingles.hint("merge"), "set_id").select(
        "shingle", F.pmod(F.xxhash64("set_id"), salts).cast("int").alias("salt"), F.lit(1).alias("role"), "set_id", "n", "component",
        none.cast("array<long>").alias("often"), "shingles",
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["shingle", "other", "set_id", "n", "near", "component"]
        kinds = [np.int64, np.int64, np.int64, np.int32, np.int32, np.int64]
        often, places = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in (whole.slice(at, SLICE_ROWS) for whole in batches for at in range(0, whole.num_rows, SLICE_ROWS)):
            role, bucket, of, n, component = (batch.column(c).to_numpy() for c in ("role", "shingle", "set_id", "n", "component"))
            rows = []
            for k, packed in enumerate(batch.column("shingles")):
                if not role[k]:  # the shingles common in the bucket, the commonest last
                    ranked = np.array(batch.column("often")[k].as_py() or [], np.int64)
                    places = np.argsort(ranked)
                    often = ranked[places]
                    continue
                own = np.frombuffer(packed.as_py(), np.int64)
                if len(often):
                    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    own = own[np.argsort(np.where(often[at] == own, places[at], -1), kind="stable")]
                near, take = _prefix_lengths(len(own), similarity)
                fill = lambda x, take=take: np.full(take, x)
                rows.append((fill(bucket[k]), own[:take], fill(of[k]), fill(n[k]), np.arange(take) < near, fill(component[k])))
            columns = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0)] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(columns, kinds, strict=True)], names)

    dealt = leaders.unionByName(followers).repartition("shingle", "salt").sortWithinPartitions("shingle", "salt", "role")
    finer = dealt.mapInArrow(cut, "shingle long, other long, set_id long, n int, near int, component long")
    return finer.select(F.xxhash64("shingle", "other").alias("shingle"), "set_id", "n", "near", "component")


def _apart(members: DataFrame, sets: DataFrame, texts: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    """(u, v): of the buckets' members (shingle, set_id, n, near, component), pairs in different components that may be similar.

    All similar ones are among them. Of buckets with the same members one is left. A crowded bucket is split by the
    shingles that its members share besides, so that sets that have only one passage in common do not all meet.
    """
    found, shingles = [], None
    for split in range(SPLITS + 1):
        row = F.xxhash64("set_id", "near")
        mix = lambda x, y: (F.bit_xor(x).alias("x"), F.bit_xor(y).alias("y"))
        parts = members.groupBy("shingle", "component").agg(F.count("*").alias("n"), F.max("near").alias("near"), *mix(row, F.xxhash64(row, "set_id")))
        kept = parts.groupBy("shingle").agg(
            F.sum("n").alias("members"), (F.sum("n") - F.max("n")).alias("others"), F.max("near").alias("near"), *mix(F.col("x"), F.col("y"))
        )
        kept = kept.where("others > 0 AND near = 1").groupBy("members", "others", "x", "y").agg(F.min("shingle").alias("shingle"))
        kept = materialize(members.join(kept.select("shingle", "members", "others").hint("merge"), "shingle"), "shingles-apart")
        if split:
            release(members)
        last = split == SPLITS
        few = kept if last else kept.where(F.col("others") <= CROWDED)
        x = few.where("near = 1").select("shingle", F.col("set_id").alias("u"), F.col("n").alias("n_u"), F.col("component").alias("c_u"))
        y = few.select("shingle", F.col("set_id").alias("v"), F.col("n").alias("n_v"), F.col("component").alias("c_v"))
        long_enough = (F.col("n_u") <= F.col("n_v")) & (F.col("n_u") * similarity.denominator >= F.col("n_v") * similarity.numerator)
        pairs = x.join(y.hint("merge"), "shingle").where((F.col("c_u") != F.col("c_v")) & long_enough)
        found.append(materialize(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "shingle-pairs-met"))
        crowded = kept.where(F.col("others") > CROWDED)
        if last or crowded.isEmpty():
            break
        if shingles is None:  # members of later buckets are among these
            shingles = materialize(_shingles_of(crowded.select("set_id"), sets, texts, width), "shingles-of-crowded")
        members = materialize(_refined(crowded, shingles, similarity), "shingles-split")
        release(kept)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    return pairs


def similar_sets(texts: DataFrame, sets: DataFrame, width: int, similarity: Fraction = SIMILARITY) -> DataFrame:
    """(u, v): links that connect the same sets (set_id, doc_id, text_hash, n, sketch) as all pairs of at least this Jaccard similarity.

    Sets that share a shingle of their prefixes are a bucket, and its LEADERS are candidates for all in it. Each
    set is compared with its likeliest leader first; after that only what is in different components is, so that
    many near copies of one text do not make all their pairs.
    """
    met = materialize(_prefixes(texts, width, similarity, _frequent(texts, width)), "shingles-met")
    leader = [F.min_by(F.struct("set_id", "n"), F.xxhash64("set_id", F.lit(k))) for k in range(LEADERS)]
    leaders = met.groupBy("shingle").agg(F.array_distinct(F.array(*leader)).alias("leaders")).select("shingle", F.inline("leaders").alias("v", "n_v"))
    sizes = lambda x, y: F.least(x, y) * similarity.denominator >= F.greatest(x, y) * similarity.numerator
    pairs = met.select("shingle", F.col("set_id").alias("u"), F.col("n").alias("n_u")).join(leaders.hint("merge"), "shingle")
    pairs = pairs.where((F.col("u") != F.col("v")) & sizes("n_u", "n_v")).select("u", "v")
    likely = materialize(_likely(pairs, sets, similarity), "shingle-pairs")
    best = likely.groupBy("u").agg(F.max_by(F.struct("v", "sizes"), F.struct(F.col("most") / F.col("sizes"), "v")).alias("b")).select("u", "b.v", "b.sizes")
    led = materialize(_verified(best, sets, texts, width, similarity).select("u", "v"), "shingle-links")
    of = materialize(connected_components(led), "shingle-components")
    apart = likely.select("u", "v", "sizes", "most")
    members = met.join(of.withColumnRenamed("node", "set_id").hint("merge"), "set_id", "left")
    members = members.select("shingle", "set_id", "n", "near", F.coalesce("component", "set_id").alias("component"))
    apart = apart.unionByName(_likely(_apart(members, sets, texts, width, similarity), sets, similarity))
    for end in "uv":
        apart = apart.join(of.toDF(end, f"c_{end}").hint("merge"), end, "left")
    apart = apart.where(F.coalesce("c_u", "u") != F.coalesce("c_v", "v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "sizes").distinct()
    apart = materialize(apart, "shingle-pairs-apart")
    # long texts fill their sketches: bitmaps that grow with the set leave few pairs for the shingles themselves
    bounded = materialize(_verified(apart, sets, texts, width, similarity, whole=False), "shingle-pairs-bounded")
    links = materialize(led.unionByName(_verified(bounded, sets, texts, width, similarity).select("u", "v")), "shingle-links")
    for table in (met, likely, led, of, apart, bounded):
        release(table)
    return links


def keep_first_of_similar(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: Fraction = SIMILARITY
) -> DataFrame:
    """One row of docs for each group: that with the smallest id, with all columns.

    Groups are connected by shingle sets of at least this Jaccard similarity, compared by the 64-bit hashes of
    the shingles, and by fingerprints within the distance of op4. A text of fewer words is one shingle; texts
    without words are one group. Of rows that repeat the smallest id, those with the least text hash stay, and
    one only of those that repeat the text too. Rows with a null id stay and connect nothing.
    """
    stored = materialize(shingled(docs, id_col=id_col, text_col=text_col, width=width), "shingles")
    texts = _rows(docs, id_col, text_col).where("doc_id IS NOT NULL")
    rows = stored.where("doc_id IS NOT NULL").select("doc_id", "text_hash", "fp", "set_id")
    named = materialize(rows.groupBy("set_id", "fp").count(), "shingle-classes")
    of_set = named.groupBy("set_id").agg(F.min("fp").alias("node"), F.count("*").alias("n"))
    same = named.join(of_set.where("n > 1").hint("merge"), "set_id").select(F.col("fp").alias("u"), F.col("node").alias("v")).where("u <> v")
    sets = stored.where("doc_id IS NOT NULL AND n > 0").groupBy("set_id").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("at"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")
    )
    sets = materialize(sets.select("set_id", "at.doc_id", "at.text_hash", "n", "sketch"), "shingle-sets")
    similar = similar_sets(texts, sets, width, similarity)
    nodes = lambda s: of_set.select(F.col("set_id").alias(s), F.col("node").alias(f"node_{s}")).hint("merge")
    similar = similar.join(nodes("u"), "u").join(nodes("v"), "v").select(F.col("node_u").alias("u"), F.col("node_v").alias("v"))
    classes = named.select("fp", F.col("fp").alias("rep")).distinct()
    components = connected_components(link_fingerprints(classes).unionByName(same).unionByName(similar))
    grouped = rows.join(components.withColumnRenamed("node", "fp").hint("merge"), "fp", "left").select(
        "doc_id", "text_hash", F.coalesce("component", "fp").alias("component")
    )
    first = grouped.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("n")).where("n > 1")
    place = F.struct("doc_id", "text_hash")
    gone = grouped.join(first.hint("merge"), "component").where(place != F.col("first"))
    gone = materialize(gone.select(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text")).distinct(), "similar-gone")
    again = materialize(rows.groupBy(F.col("doc_id").alias("of_doc"), F.col("text_hash").alias("of_text")).count().where("count > 1").drop("count"), "similar-again")
    same_row = (docs[id_col].cast("long") == F.col("of_doc")) & (F.xxhash64(docs[text_col].cast("string")) == F.col("of_text"))
    left = docs.join(gone, same_row, "left_anti")
    if again.isEmpty():
        return left
    # rows that repeat id and text are few; of each one stays, and no other text is moved
    one = left.join(again, same_row, "left_semi").dropDuplicates([id_col, text_col])
    return left.join(again, same_row, "left_anti").unionByName(one)
