"""SimHash near-duplicates: Golay-decoded segment keys, joined and verified."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.components import connected_components
from plumbline.llm.tables import materialize

HASH_SEED = 42
MAX_DISTANCE = 3
#: Segments of the 64 bits: the last is a shortened word, padded with zeros to 23 bits.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial of the binary Golay code of length 23, dimension 12 and distance 7.
GOLAY_GENERATOR = 0b110001110101
#: Keys with more fingerprints are split by the bits of the segment that they leave free.
CROWDED = 256
#: Blocks that such a segment is cut into: of six, three are equal where three bits differ, and five where one does.
FREE_BLOCKS = 6
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16


def shingle_hashes(text: bytes, width: int) -> np.ndarray:
    """The hashes of a text's shingles in their order; none without words."""
    words = text.lower().split()  # on bytes: A-Z only, and the six ASCII white-space characters
    n = max(1, len(words) - width + 1) if words else 0
    return np.fromiter(
        (xxhash.xxh64_intdigest(b" ".join(words[i : i + width]), HASH_SEED) for i in range(n)), np.uint64, n
    )


def fingerprint_of(hashes: np.ndarray) -> int:
    """Bit by bit the majority of the hashes; zero without any."""
    n = len(hashes)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        part = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = 2 * ones > n
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little", signed=True)


def fingerprint(text: bytes, width: int) -> int:
    """The SimHash of a text."""
    return fingerprint_of(shingle_hashes(text, width))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp) of all rows; a null text has no words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text.as_py() or b"", width) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["doc_id", "fp"])

    # spark.sql.ansi allows string to binary, which is its UTF-8
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")
    ).mapInArrow(hashed, "doc_id long, fp long")


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GOLAY_GENERATOR << (bit - 11)
    return word


class Golay:
    """Nearest codewords of 23-bit words, as 12-bit indices; every word is within 3 bits of exactly one."""

    def __init__(self):
        unit = np.array([_remainder(1 << i) for i in range(23)])
        low = np.zeros(1 << 12, np.int64)
        high = np.zeros(1 << 11, np.int64)
        for i in range(12):
            low ^= np.where(np.arange(1 << 12) >> i & 1, unit[i], 0)
        for i in range(11):
            high ^= np.where(np.arange(1 << 11) >> i & 1, unit[12 + i], 0)
        self.low, self.high = low, high
        self.error = np.zeros(1 << 11, np.int64)  # by remainder: the error pattern of 3 bits or fewer
        for k in range(1, 4):
            for places in combinations(range(23), k):
                self.error[np.bitwise_xor.reduce(unit[list(places)])] = sum(1 << p for p in places)

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[self.low[words & 0xFFF] ^ self.high[words >> 12]]) >> 11

    def near(self, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of each word and of all words one bit away: (rows, which are first of their kind)."""
        around = np.concatenate([[0], 1 << np.arange(bits)])
        found = np.sort(self.index(words[:, None] ^ around[None, :]), axis=1)
        first = np.ones(found.shape, bool)
        first[:, 1:] = found[:, 1:] != found[:, :-1]
        return found, first


_golay: list[Golay] = []


def segment_keys(fps: np.ndarray) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """(index keys, probes): index keys hold one key for each fp and table, probes (fp's position, key).

    Of two fingerprints that differ in 3 bits or fewer, either some segment is equal and another differs
    in one bit at most, or each of the three differs in exactly one bit. Six tables serve the first case
    (the equal segment in full, the codeword index of the other), one the second (the codeword indices of
    the long segments and the parity of all three). A word's index is among those of the words one bit
    away from it, five or six in most cases, and these are what a probe looks up.
    """
    if not _golay:
        _golay.append(Golay())
    golay = _golay[0]
    words = [(fps.view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1) for at, bits in SEGMENTS]
    own = [golay.index(w) for w in words]
    near = [golay.near(w, bits) for w, (_, bits) in zip(words, SEGMENTS, strict=True)]
    index, probes = [], []
    table = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                table += 1
                index.append((table << 40) | (words[i] << 12) | own[j])
                found, first = near[j]
                row, column = np.nonzero(first)
                probes.append((row, (table << 40) | (words[i][row] << 12) | found[row, column]))
    parity = sum((np.bitwise_count(w.astype(np.uint64)).astype(np.int64) & 1) << k for k, w in enumerate(words))
    index.append((7 << 40) | (own[0] << 15) | (own[1] << 3) | parity)
    row, a = np.nonzero(near[0][1])
    firsts = near[1][1][row]
    at, b = np.nonzero(firsts)
    row, a = row[at], a[at]
    probes.append((row, (7 << 40) | (near[0][0][row, a] << 15) | (near[1][0][row, b] << 3) | (parity[row] ^ 7)))
    return index, probes


def _keyed(classes: DataFrame, probing: bool) -> DataFrame:
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole_fp, whole_rep = (batch.column(c).to_numpy() for c in ("fp", "rep"))
            for at in range(0, len(whole_fp), 1 << 13):
                fp, rep = whole_fp[at : at + (1 << 13)], whole_rep[at : at + (1 << 13)]
                index, probes = segment_keys(fp)
                each = probes if probing else [(np.arange(len(fp)), key) for key in index]
                for row, key in each:
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[row]), pa.array(rep[row])], ["key", "fp", "rep"])

    return classes.mapInArrow(keys, "key long, fp long, rep long")


#: The segment that each table's keys leave free, from table 1 on, and the bits in which it may differ.
_FREE = [(3 - i - j, MAX_DISTANCE) for i in range(3) for j in range(3) if i != j] + [(2, 1)]


def _split(entries: DataFrame) -> DataFrame:
    """(key, part, fp, rep): the entries of crowded keys by the equal blocks of the segment that is left free."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, table = batch.column("fp").to_numpy(), batch.column("key").to_numpy() >> 40
            for t in np.unique(table):
                segment, errors = _FREE[t - 1]
                at, bits = SEGMENTS[segment]
                own = batch.filter(pa.array(table == t))
                word = (fps[table == t].view(np.uint64) >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1)
                cuts = [round(k * bits / FREE_BLOCKS) for k in range(FREE_BLOCKS + 1)]
                for number, blocks in enumerate(combinations(range(FREE_BLOCKS), FREE_BLOCKS - errors)):
                    mask = sum(((1 << cuts[b + 1]) - (1 << cuts[b])) for b in blocks)
                    part = pa.array((word & mask) | (number << 32))
                    yield pa.RecordBatch.from_arrays([own.column("key"), part, own.column("fp"), own.column("rep")], ["key", "part", "fp", "rep"])

    return entries.mapInArrow(parts, "key long, part long, fp long, rep long")


def link_fingerprints(classes: DataFrame) -> DataFrame:
    """(u, v): the representatives of distinct fingerprints (fp, rep) that differ in 3 bits or fewer.

    Fingerprints that crowd under one key agree in the segments that it is made of. They are compared where
    enough blocks of the free segment agree too, so that their pairs stay few.
    """
    index, probes = _keyed(classes, probing=False), _keyed(classes, probing=True)
    crowded = materialize(index.groupBy("key").count().where(F.col("count") > CROWDED).select("key"), "crowded-keys")

    def met(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
        pairs = a.withColumnsRenamed({"fp": "fp_a", "rep": "u"}).join(b.withColumnsRenamed({"fp": "fp_b", "rep": "v"}), on)
        near = (F.col("fp_a") != F.col("fp_b")) & (F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= MAX_DISTANCE)
        return pairs.where(near).select("u", "v")

    if crowded.isEmpty():
        return met(probes, index, ["key"])
    few = met(probes.join(crowded, "key", "left_anti"), index.join(crowded, "key", "left_anti"), ["key"])
    many = met(_split(probes.join(crowded, "key", "left_semi")), _split(index.join(crowded, "key", "left_semi")), ["key", "part"])
    return few.unionByName(many)


def simhash_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (least id reachable).

    Equal fingerprints are one class from the start, so copies cost nothing in the join, and only links
    between different fingerprints are looked for.

    Nulls: a null text has no words, so fingerprint zero, as an empty one; a row with a null id keeps its
    fingerprint and gets the component of the others that share it, or null. Rows that repeat an id are
    rows of their own. Extra columns are not returned. An empty table gives none.
    """
    stored = materialize(fingerprints(docs, id_col=id_col, text_col=text_col, width=width), "fingerprints")
    classes = materialize(stored.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    links = link_fingerprints(classes.where("rep IS NOT NULL"))
    components = connected_components(links)
    named = classes.join(components, classes["rep"] == components["node"], "left").select(
        F.col("fp").alias("class_fp"), F.coalesce("component", "rep").alias("component_id")
    )
    return stored.join(named, F.col("fp") == F.col("class_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_first_of_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """The rows of docs that are the first of their group, with all columns.

    The row with the smallest id of each component stays; of rows that repeat this id, and of null ids
    without a component, all stay.
    """
    groups = simhash_groups(docs, id_col=id_col, text_col=text_col, width=width)
    first = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("dropped_id")).distinct()
    return docs.join(first, docs[id_col] == first["dropped_id"], "left_anti")


def op4_simhash(spark, sf_dir: str) -> DataFrame:
    return simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3)
