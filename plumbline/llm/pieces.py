"""SentencePiece encoding and decoding by a table of distinct chunks."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The character that stands for a space in pieces.
MARK = "▁"
#: Texts are cut into chunks in slices of so many bytes, or of one text that is longer.
SLICE_BYTES = 2 << 20
#: Chunks of up to so many bytes are remembered by a worker, so many of them; then it forgets them all.
REMEMBERED_BYTES, REMEMBERED_CHUNKS = 32, 100_000


class Pieces:
    """A SentencePiece model that encodes and decodes chunk by chunk.

    A chunk is a run of spaces and what follows up to the next space. Where no piece has a marker behind another
    character, and the model leaves texts as they are but for a marker in front, no merge crosses the start of a
    chunk, so the ids of a text are those of its chunks. For other models (`separable` is false) a text is one chunk.
    """

    def __init__(self, model_path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        with open(model_path, "rb") as file:
            described = sentencepiece_model_pb2.ModelProto.FromString(file.read())
        rules, trained = described.normalizer_spec, described.trainer_spec
        plain = rules.add_dummy_prefix and rules.escape_whitespaces and not rules.remove_extra_whitespaces and not rules.precompiled_charsmap
        kinds = described.SentencePiece
        crossing = any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in described.pieces if p.type != kinds.BYTE)
        own = any(p.type == kinds.USER_DEFINED for p in described.pieces)
        self.mark_id = self.model.piece_to_id(MARK)
        known = self.mark_id != self.model.unk_id() and trained.byte_fallback
        self.separable = bool(plain and known and not (crossing or own or trained.treat_whitespace_as_suffix))
        #: Of each id: 0 goes on with a chunk, 1 starts one, 2 is written in a way that depends on its place (control, unknown).
        marks = [2 if p.type in (kinds.CONTROL, kinds.UNKNOWN) else int(p.piece.startswith(MARK)) for p in described.pieces]
        self.kind = np.array(marks, np.int8)
        self.encoded: dict[bytes, bytes] = {}
        self.decoded: dict[bytes, bytes] = {}

    def encode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """Ids (32 bits each) of each chunk, whose first space is the marker in front."""
        return _remembered(chunks, self.encoded, self._encode)

    def _encode(self, chunks: list[bytes]) -> list[bytes]:
        if self.separable:
            # the library puts the marker in front itself, but for an empty text
            found = self.model.encode([c[1:].decode() for c in chunks], num_threads=1)
            return [array("i", ids or [self.mark_id]).tobytes() for ids in found]
        return [array("i", ids).tobytes() for ids in self.model.encode([c.decode() for c in chunks], num_threads=1)]

    def decode_chunks(self, chunks: list[bytes]) -> list[bytes]:
        """The text of each chunk of ids, without the marker in front."""
        return _remembered(chunks, self.decoded, self._decode)

    def _decode(self, chunks: list[bytes]) -> list[bytes]:
        return [t.encode() for t in self.model.decode([array("i", c).tolist() for c in chunks], num_threads=1)]


def _remembered(chunks: list[bytes], memory: dict[bytes, bytes], find) -> list[bytes]:
    """What find() gives for each chunk; that of short ones is remembered."""
    found = [memory.get(c) for c in chunks]
    missing = [k for k, f in enumerate(found) if f is None]
    if len(memory) + len(missing) > REMEMBERED_CHUNKS:
        memory.clear()
    for k, value in zip(missing, find([chunks[k] for k in missing]) if missing else [], strict=True):
        found[k] = value
        if len(chunks[k]) <= REMEMBERED_BYTES and len(memory) < REMEMBERED_CHUNKS:
            memory[chunks[k]] = value
    return found


_loaded: dict[str, Pieces] = {}


def load_pieces(model_path: str) -> Pieces:
    """The model, read once by a worker."""
    if model_path not in _loaded:
        _loaded[model_path] = Pieces(model_path)
    return _loaded[model_path]


def _binary(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    buffers = [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, buffers)


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets from 0, bytes) of a column of large_binary without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return offsets - offsets[0], data


def _each_once(chunks: pa.Array, find) -> pa.Array:
    """What find() gives for each chunk, asked once for each distinct one; joined back by position."""
    table = chunks.dictionary_encode()
    return pa.array(find(table.dictionary.to_pylist()), pa.large_binary()).take(table.indices)


def encode(texts: pa.Array, pieces: Pieces) -> pa.ListArray:
    """The ids of each text; none of a null or empty one."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if pieces.separable:
        texts = pc.replace_substring(texts, MARK, " ")  # the same to the model
    offsets, data = _parts(texts.cast(pa.large_binary()))
    full = np.diff(offsets) > 0
    ends = np.zeros(len(texts) + 1, np.int64)
    if not full.any():
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array([], pa.int32()))
    first = offsets[:-1][full]
    if pieces.separable:
        heads = first + np.arange(len(first))  # a space more in front of each text
        body = np.ones(len(data) + len(first), bool)
        body[heads] = False
        marked = np.full(len(body), 0x20, np.uint8)
        marked[body] = data
        space = marked == 0x20
        starts = space.copy()
        starts[1:] &= ~space[:-1]
        starts[heads] = True
        cuts = np.append(np.flatnonzero(starts), len(marked))
        at = np.searchsorted(cuts, heads)
    else:
        marked, cuts, at = data, np.append(first, len(data)), np.arange(len(first))
    ids_of = _each_once(_binary(cuts, marked), pieces.encode_chunks)
    places, ids = _parts(ids_of)
    counts = np.diff(np.append(places[at], places[-1])) // 4
    lengths = np.zeros(len(texts), np.int64)
    lengths[full] = counts
    np.cumsum(lengths, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.ascontiguousarray(ids).view(np.int32)))


def decode(ids: pa.ListArray, pieces: Pieces) -> pa.Array:
    """The text of each list of ids; empty of null and of no ids. Null elements are left out."""
    if ids.flatten().null_count:
        ids = pa.array([[v for v in x or [] if v is not None] for x in ids.to_pylist()], pa.list_(pa.int32()))
    counts = np.asarray(pc.fill_null(pc.list_value_length(ids), 0), np.int64)
    flat = np.ascontiguousarray(np.asarray(ids.flatten(), np.int32))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    known = (flat >= 0) & (flat < len(pieces.kind))
    kind = np.where(known, pieces.kind[np.where(known, flat, 0)], 2)
    full = np.flatnonzero(counts)
    odd = np.zeros(len(ids), bool)
    if len(flat):
        odd[full] = np.maximum.reduceat(kind, bounds[:-1][full]) == 2
    if not pieces.separable:
        odd[:] = True
    if odd.any():
        lists = ids.to_pylist()
        whole = [pieces.model.decode(x or []) for x, o in zip(lists, odd, strict=True) if o]
        rest = decode(ids.filter(pa.array(~odd)), pieces).to_pylist() if not odd.all() else []
        whole, rest = iter(whole), iter(rest)
        return pa.array([next(whole) if o else next(rest) for o in odd], pa.large_string())
    heads = bounds[:-1][full]
    starts = kind == 1
    starts[heads] = True
    cuts = np.flatnonzero(starts)
    text_of = _each_once(_binary(np.append(cuts, len(flat)) * 4, flat.view(np.uint8)), pieces.decode_chunks)
    places, text = _parts(text_of)
    # the marker in front is a space but at the start of a text
    spaced = kind[cuts] == 1
    spaced[np.searchsorted(cuts, heads)] = False
    at = places[:-1][spaced] + np.arange(spaced.sum())
    body = np.ones(len(text) + len(at), bool)
    body[at] = False
    joined = np.full(len(body), 0x20, np.uint8)
    joined[body] = text
    moved = np.concatenate([[0], np.cumsum(np.diff(places) + spaced)])
    sizes = np.zeros(len(ids), np.int64)
    sizes[full] = np.diff(np.append(moved[np.searchsorted(cuts, heads)], moved[-1]))
    return _binary(np.concatenate([[0], np.cumsum(sizes)]), joined).cast(pa.large_string())


def _sliced(batches: Iterator[pa.RecordBatch], column: str, width: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about SLICE_BYTES of a column of texts or lists (width: bytes of an element)."""
    for batch in batches:
        ends = np.asarray(batch.column(column).offsets if width > 1 else _text_ends(batch.column(column)), np.int64) * width
        at = 0
        while at < batch.num_rows:
            upto = max(at + 1, int(np.searchsorted(ends, ends[at] + SLICE_BYTES, side="right")) - 1)
            yield batch.slice(at, upto - at)
            at = upto


def _text_ends(column: pa.Array) -> np.ndarray:
    wide = column.type == pa.large_string()
    return np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]


def _with_columns(df: DataFrame, source: str, width: int, targets: dict[str, str], find) -> DataFrame:
    """df with more columns (name: type), arrays that find(column) gives; columns of these names are replaced, whatever their case."""
    gone = {t.lower() for t in targets}
    kept = [c for c in df.columns if c.lower() not in gone or c == source]
    names = [f"in{k}" for k in range(len(kept))]  # clashing names in a batch would be ambiguous
    own = names[kept.index(source)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches, own, width):
            if batch.num_rows:
                found = find(batch.column(own))
                yield pa.RecordBatch.from_arrays([*batch.columns, *found], [*names, *(f"out{k}" for k in range(len(found)))])

    schema = [f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, kept, strict=True)]
    schema += [f"out{k} {kind}" for k, kind in enumerate(targets.values())]
    done = df.select(*[F.col(f"`{c}`").alias(n) for n, c in zip(names, kept, strict=True)]).mapInArrow(each, ", ".join(schema))
    held = [F.col(n).alias(c) for n, c in zip(names, kept, strict=True) if c.lower() not in gone]
    return done.select(*held, *[F.col(f"out{k}").alias(t) for k, t in enumerate(targets)])


def model_path(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = str(public_tokenizers.path("piece_bpe_32k.model"))
    return path


def encode_documents(
    docs: DataFrame, *, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, path: str | None = None
) -> DataFrame:
    """docs with the ids of each whole text, exactly as the library encodes it without begin or end ids.

    Texts are cut where spaces begin, each distinct chunk of a slice is segmented once by the library, and its ids
    are joined back by position. A worker remembers short chunks over slices. Nothing is shuffled, and a task holds a
    slice of SLICE_BYTES, or one text that is longer. path: the model's file, there on every executor. decoded_col: add
    what decode_documents() makes of the ids, in the same pass.

    Null and empty texts have no ids. Repeated rows stay. Other columns are kept; one with the name of ids_col or
    decoded_col is replaced.
    """
    path = model_path(path)

    def find(texts: pa.Array) -> list[pa.Array]:
        known = load_pieces(path)
        ids = encode(texts, known)
        return [ids] if decoded_col is None else [ids, decode(ids, known).cast(pa.string())]

    targets = {ids_col: "array<int>"} | ({} if decoded_col is None else {decoded_col: "string"})
    return _with_columns(docs, text_col, 1, targets, find)


def decode_documents(docs: DataFrame, *, ids_col: str = "ids", text_col: str = "decoded", path: str | None = None) -> DataFrame:
    """docs with the text that the library decodes from each array of ids (of null: empty).

    Ids are cut where a piece starts with a space, each distinct chunk of a slice is decoded once, and its text is
    joined back by position. Arrays with control or unknown ids, whose text depends on what is around them, are
    decoded whole; ids that the model lacks raise the library's error.
    """
    path = model_path(path)
    return _with_columns(docs, ids_col, 4, {text_col: "string"}, lambda ids: [decode(ids, load_pieces(path)).cast(pa.string())])


def op13_sentencepiece(spark, sf_dir: str) -> DataFrame:
    done = encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), decoded_col="decoded")
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
