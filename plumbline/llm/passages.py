"""Substring deduplication: fixed-block anchors, probed with every rolling window and extended to exact repeats."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.lines import row_key
from plumbline.llm.tables import materialize, new_path

WINDOW_WORDS = 35
#: Window hashes that one task compares at once, in the search for anchors and in the check of whole windows.
BUCKET_HASHES = 2_000_000
#: Words of the documents that one task reads again together.
CHUNK_WORDS = 100_000
#: Words whose windows a task holds at once before it sends them.
SEND_WORDS = 1_000_000
MIN_BUCKETS = 64
#: Texts are cut into words in slices of so many bytes.
SLICE_BYTES = 4 << 20
#: Hashes of words that a Python worker remembers.
CACHE_WORDS = 150_000
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)  # odd, so that their powers have inverses modulo 2^64
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_hashes = _WordHashes()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_of(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 ... base^(n-1) modulo 2^64, and their inverses."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, 4096)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        _powers[base] = held = (both[0], both[1])
    return held[0][:n], held[1][:n]


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


class Texts:
    """The words of several texts: their hashes one after the other, and the bytes of each text's words with a space behind each."""

    def __init__(self, column: pa.Array):
        """column: binary; a null is empty. Each distinct word of the column is hashed once."""
        column = column.cast(pa.large_binary()).fill_null(b"")
        offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        heads = np.unique(offsets[:-1])
        heads = heads[heads < len(raw)]
        word = ~_SPACE[raw]
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1]
        first[heads] = word[heads]
        last[:-1] &= ~word[1:]
        last[heads[1:] - 1] = word[heads[1:] - 1]
        places = np.flatnonzero(first)
        lengths = np.flatnonzero(last) - places + 1
        #: The words of text k are those from bounds[k] to bounds[k + 1].
        self.bounds = np.searchsorted(places, offsets)
        self.ends = np.concatenate([[0], np.cumsum(lengths + 1)])
        self.bytes = np.full(self.ends[-1], 0x20, np.uint8)
        body = np.ones(self.ends[-1], bool)
        body[self.ends[1:] - 1] = False
        own = raw[word]
        self.bytes[body] = own
        starts = np.concatenate([[0], np.cumsum(lengths)])
        words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(starts), pa.py_buffer(own)])
        table = words.dictionary_encode()
        self.hashes = word_hashes(table.dictionary.to_pylist())[np.asarray(table.indices)] if len(lengths) else np.zeros(0, np.uint64)

    def of(self, k: int) -> np.ndarray:
        """The hashes of a text's words."""
        return self.hashes[self.bounds[k] : self.bounds[k + 1]]

    def joined(self, k: int) -> np.ndarray:
        """The bytes of a text's words, joined by single spaces."""
        a, b = self.bounds[k], self.bounds[k + 1]
        return self.bytes[self.ends[a] : self.ends[b] - 1] if b > a else self.bytes[:0]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The batches in slices of about SLICE_BYTES of text, or of one text that is longer."""
    for batch in batches:
        ends = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), np.int64))])
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1)
            part = batch.slice(at, upto - at)
            yield part, Texts(part.column("text"))
            at = upto


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hashes of all runs of `width` words: polynomials in base modulo 2^64, mixed."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers_of(base, len(hashes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * up[: len(hashes)], dtype=np.uint64)])
    found = (sums[width:] - sums[:-width]) * down[:n]
    found = (found ^ (found >> np.uint64(29))) * _MIX
    return found ^ (found >> np.uint64(32))


def _codes(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket and 32 more bits of each hash, as one long."""
    return (((hashes >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32)) | (hashes & np.uint64(0xFFFFFFFF))


def _once_and_more(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    values, counts = np.unique(values, return_counts=True)
    return values[counts == 1], values[counts > 1]


def _in_order(pairs: np.ndarray) -> np.ndarray:
    """Pairs sorted by a, then b. Sorting by a alone does, unless different pairs share it, which 64 bits hardly let happen."""
    found = pairs[np.argsort(pairs["a"])]
    if ((found["a"][1:] == found["a"][:-1]) & (found["b"][1:] != found["b"][:-1])).any():
        found = pairs[np.lexsort((pairs["b"], pairs["a"]))]
    return found


def _as_before(found: np.ndarray) -> np.ndarray:
    """Whether each pair but the first equals the one before."""
    return (found["a"][1:] == found["a"][:-1]) & (found["b"][1:] == found["b"][:-1])


def _distinct_pairs(pairs: np.ndarray) -> np.ndarray:
    """The different pairs, sorted."""
    found = _in_order(pairs)
    return found[np.append(True, ~_as_before(found))] if len(found) else found


def _pairs_once_and_more(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = _in_order(pairs)
    if not len(found):
        return found, found
    starts = np.flatnonzero(np.append(True, ~_as_before(found)))
    once = np.diff(np.append(starts, len(found))) == 1
    return found[starts[once]], found[starts[~once]]


def _split(codes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, 32-bit rests) of sorted codes."""
    of = (codes >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(of)) + 1
    for part, at in zip(np.split(codes, cuts), np.concatenate([[0], cuts]), strict=True):
        if len(part):
            yield int(of[at]), part.astype(np.uint32)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(
        *row_key(id_col, text_col), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")
    )


def _anchors(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    """Each row with its number of words, the digest of all of them, and the codes of its reference blocks."""
    block = (window + 1) // 2

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _slices(batches):
            counts, digests, blocks = np.diff(texts.bounds), [], []
            for k in range(batch.num_rows):
                digests.append(hashlib.sha256(texts.joined(k)).hexdigest())
                own = rolling(texts.of(k), block, BASES[0])[::block] if counts[k] >= window else np.zeros(0, np.uint64)
                blocks.append(_codes(own, buckets).astype(np.int64))
            arrays = [batch.column("row_a"), batch.column("row_b"), batch.column("doc_id")]
            arrays += [pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(blocks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["row_a", "row_b", "doc_id", "n_words", "sha256", "blocks"])

    return texts.mapInArrow(measured, "row_a long, row_b long, doc_id long, n_words long, sha256 string, blocks array<long>")


def _repeated_anchors(texts: DataFrame, window: int, buckets: int) -> DataFrame:
    """(code): the reference blocks that occur twice or more among all rolling windows of their width.

    A batch of documents sends, to each bucket, the hashes that it has once, those that it has more often,
    and those of its blocks, each as packed 32-bit numbers; so a passage costs a batch one number.
    """
    block = (window + 1) // 2

    def packed(every: list[np.ndarray], own: list[np.ndarray]) -> pa.RecordBatch:
        none = [np.zeros(0, np.uint64)]
        once, more = _once_and_more(_codes(np.concatenate(every or none), buckets))
        blocks = np.unique(_codes(np.concatenate(own or none), buckets))
        rows = [(bucket, kind, rest.tobytes()) for kind, codes in (("once", once), ("more", more), ("block", blocks)) for bucket, rest in _split(codes)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 3
        arrays = [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.string(), pa.binary()), strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["bucket", "kind", "rests"])

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, own, held = [], [], 0
        for batch, texts in _slices(batches):
            for k in range(batch.num_rows):
                hashes = texts.of(k)
                if len(hashes) >= window:
                    found = rolling(hashes, block, BASES[0])
                    every.append(found)
                    own.append(found[::block].copy())
                    held += len(found)
                if held >= SEND_WORDS:
                    yield packed(every, own)
                    every, own, held = [], [], 0
        yield packed(every, own)

    def probed(group: pa.Table) -> pa.Table:
        held: dict[str, list[np.ndarray]] = {"once": [], "more": [], "block": []}
        for kind, rests in zip(group.column("kind").to_pylist(), group.column("rests").to_pylist(), strict=True):
            held[kind].append(np.frombuffer(rests, np.uint32))
        of = {k: np.concatenate(v) if v else np.zeros(0, np.uint32) for k, v in held.items()}
        every = np.sort(np.concatenate([of["once"], of["more"]]))
        again = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], of["more"]]))
        found = np.intersect1d(again, of["block"])
        bucket = group.column("bucket")[0].as_py()
        return pa.table({"code": pa.array((np.int64(bucket) << 32) | found.astype(np.int64), pa.int64())})

    return texts.mapInArrow(sent, "bucket long, kind string, rests binary").groupBy("bucket").applyInArrow(probed, "code long")


def _near_blocks(blocks: np.ndarray, n_words: int, window: int) -> np.ndarray:
    """Starts of the windows that hold one of the blocks whole."""
    block = (window + 1) // 2
    last = n_words - window
    steps = np.zeros(last + 2, np.int64)
    first = np.clip(blocks * block - (window - block), 0, last + 1)
    np.add.at(steps, first, 1)
    np.add.at(steps, np.clip(blocks * block + 1, 0, last + 1), -1)
    return np.flatnonzero(np.cumsum(steps[:-1]) > 0)


def _windows(hashes: np.ndarray, blocks: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, 128-bit hashes as complex pairs of longs) of the windows to be checked."""
    starts = _near_blocks(blocks, len(hashes), window)
    pair = np.empty(len(starts), [("a", "<u8"), ("b", "<u8")])
    pair["a"] = rolling(hashes, window, BASES[0])[starts]
    pair["b"] = rolling((hashes ^ (hashes >> np.uint64(31))) * _MIX, window, BASES[1])[starts]
    return starts, pair


def _is_in(pairs: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each pair is among the others, which are different and sorted."""
    if not len(of) or not len(pairs):
        return np.zeros(len(pairs), bool)
    first = np.ascontiguousarray(of["a"])
    at = np.searchsorted(first, pairs["a"])
    found = np.zeros(len(pairs), bool)
    # the others that share a, one after the other: one as a rule
    left = np.flatnonzero(at < len(of))
    while len(left):
        left = left[first[at[left]] == pairs["a"][left]]
        found[left] |= of["b"][at[left]] == pairs["b"][left]
        at[left] += 1
        left = left[~found[left] & (at[left] < len(of))]
    return found


def _repeated_windows(chunks: DataFrame, window: int, buckets: int) -> DataFrame:
    """(chunk, pairs): for each chunk those of its windows that start twice or more in the corpus.

    A chunk sends each of its windows once, marked if it has it more often; so a window of very many
    documents costs as many pairs as there are chunks.
    """
    kind = np.dtype([("a", "<u8"), ("b", "<u8")])

    def sent(group: pa.Table) -> pa.Table:
        found = [np.zeros(0, kind)]
        for text, blocks in zip(group.column("text").chunks, group.column("blocks").chunks, strict=True):
            texts = Texts(text)
            found += [_windows(texts.of(k), np.array(own, np.int64), window)[1] for k, own in enumerate(blocks.to_pylist())]
        once, more = _pairs_once_and_more(np.concatenate(found))
        rows = []
        for again, pairs in ((False, once), (True, more)):
            of = (pairs["a"] >> np.uint64(32)).astype(np.int64) % buckets
            order = np.argsort(of, kind="stable")
            cuts = np.flatnonzero(np.diff(of[order])) + 1
            rows += [(int(of[part[0]]), again, pairs[part].tobytes()) for part in np.split(order, cuts) if len(part)]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 3
        chunk = group.column("chunk")[0].as_py()
        return pa.table(
            {
                "bucket": pa.array(columns[0], pa.int64()),
                "chunk": pa.array([chunk] * len(columns[0]), pa.int64()),
                "again": pa.array(columns[1], pa.bool_()),
                "pairs": pa.array(columns[2], pa.binary()),
            }
        )

    def counted(group: pa.Table) -> pa.Table:
        parts = [np.frombuffer(p, kind) for p in group.column("pairs").to_pylist()]
        again, chunk = group.column("again").to_pylist(), group.column("chunk").to_pylist()
        every = _in_order(np.concatenate(parts))
        twice = _distinct_pairs(np.concatenate([every[1:][_as_before(every)], *[p for p, more in zip(parts, again, strict=True) if more]]))
        rows = [(c, p[hit].tobytes()) for c, p in zip(chunk, parts, strict=True) if (hit := _is_in(p, twice)).any()]
        columns = list(zip(*rows, strict=True)) if rows else [()] * 2
        return pa.table({"chunk": pa.array(columns[0], pa.int64()), "pairs": pa.array(columns[1], pa.binary())})

    pairs = chunks.groupBy("chunk").applyInArrow(sent, "bucket long, chunk long, again boolean, pairs binary")
    return pairs.groupBy("bucket").applyInArrow(counted, "chunk long, pairs binary")


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,length:long>>"


def _removed(chunks: DataFrame, repeated: DataFrame, window: int) -> DataFrame:
    """RESULT rows of the documents of the chunks: hits are extended to maximal runs of repeated windows."""
    kind = np.dtype([("a", "<u8"), ("b", "<u8")])
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))

    def cut(group: pa.Table, hits: pa.Table) -> pa.Table:
        of = _distinct_pairs(np.concatenate([np.zeros(0, kind), *[np.frombuffer(p, kind) for p in hits.column("pairs").to_pylist()]]))
        rows = []
        texts = Texts(group.column("text").combine_chunks())
        for k, (doc, blocks) in enumerate(zip(group.column("doc_id").to_pylist(), group.column("blocks").to_pylist(), strict=True)):
            n, words = len(texts.of(k)), texts.joined(k)
            starts, pairs = _windows(texts.of(k), np.array(blocks, np.int64), window)
            steps = np.zeros(n + 1, np.int64)
            hit = starts[_is_in(pairs, of)]
            np.add.at(steps, hit, 1)
            np.add.at(steps, hit + window, -1)
            gone = np.cumsum(steps[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
            spans = [{"start": int(a), "length": int(b - a)} for a, b in edges.reshape(-1, 2)]
            # the words with their spaces; the last kept one has none
            lengths = np.diff(texts.ends[texts.bounds[k] : texts.bounds[k + 1] + 1])
            kept = np.append(words, np.uint8(0x20))[np.repeat(~gone, lengths)][:-1] if n else words
            rows.append((doc, n, int(gone.sum()), hashlib.sha256(kept).hexdigest(), spans))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), spans_type]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"]
        return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})

    return chunks.groupBy("chunk").cogroup(repeated.groupBy("chunk")).applyInArrow(cut, RESULT)


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """One row for each row of docs: doc_id, n_words, n_removed, kept_sha256 and spans, the word ranges to remove.

    Words are runs of other than ASCII white space. A word goes if it lies in a run of `window` words that
    also starts anywhere else in docs. Reference blocks of half a window follow one another in each
    document, so each window holds one whole; blocks that no second rolling window equals rule their
    windows out, and what is left is decided on 128-bit hashes of whole windows. kept_sha256 is the digest
    of the words that stay, joined by single spaces.

    Nulls: a null text has no words; a null id stays null. Rows that repeat an id or a text count each on
    its own. Extra columns are not returned. An empty table gives none.
    """
    spark = docs.sparkSession
    texts = _texts(docs, id_col, text_col)
    size = docs.agg(F.sum(F.octet_length(F.col(f"`{text_col}`").cast("string")))).first()[0] or 0
    buckets = max(MIN_BUCKETS, int(size) // (6 * BUCKET_HASHES))
    anchors = materialize(_anchors(texts, window, buckets), "anchors")
    repeated = materialize(_repeated_anchors(texts, window, buckets), "anchors-repeated")
    found = (
        anchors.select("row_a", "row_b", F.posexplode("blocks").alias("block", "code"))
        .join(repeated, "code")
        .groupBy("row_a", "row_b")
        .agg(F.collect_set("block").alias("blocks"))
    )
    found = materialize(found, "passages-found")
    blocks = found.agg(F.sum(F.size("blocks"))).first()[0] or 0
    path = new_path(spark, "passages-documents")
    texts.join(found, ["row_a", "row_b"]).select("doc_id", "text", "blocks").write.parquet(path)
    stored = spark.read.schema("doc_id long, text binary, blocks array<int>").parquet(path)
    n_chunks = max(1, blocks * window // (2 * CHUNK_WORDS) + 1)
    # by place in the stored table, so that rows which are all alike are spread as well
    place = F.xxhash64("_metadata.file_path", "_metadata.row_index")
    chunks = stored.select("*", F.pmod(place, F.lit(n_chunks)).cast("long").alias("chunk"))
    hits = materialize(_repeated_windows(chunks, window, max(MIN_BUCKETS, blocks * window // BUCKET_HASHES)), "passages-hits")
    whole = anchors.join(found.select("row_a", "row_b"), ["row_a", "row_b"], "left_anti").select(
        "doc_id",
        "n_words",
        F.lit(0).cast("long").alias("n_removed"),
        F.col("sha256").alias("kept_sha256"),
        F.array().cast("array<struct<start:long,length:long>>").alias("spans"),
    )
    return whole.unionByName(_removed(chunks, hits, window))


def op7_passages(spark, sf_dir: str) -> DataFrame:
    return repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("spans")


OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)),
windows AS (
  SELECT doc_id, pos, w, CASE WHEN count(*) OVER ahead = 35 THEN md5(string_agg(w, ' ') OVER ahead) END AS h
  FROM w WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
counts AS (SELECT h, count(*) AS n FROM windows WHERE h IS NOT NULL GROUP BY h),
marked AS (
  SELECT doc_id, pos, w, coalesce(max(n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 34 PRECEDING AND CURRENT ROW), 0) > 1 AS gone
  FROM windows LEFT JOIN counts USING (h)),
kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(w, ' ' ORDER BY pos) FILTER (NOT gone) AS t
  FROM marked GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM documents LEFT JOIN kept USING (doc_id)
"""
