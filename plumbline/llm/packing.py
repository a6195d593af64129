"""Packing token sequences by cutting-stock column generation."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import materialize

SEQUENCE_TOKENS = 2048
END_ID = 1
#: Rows of the linear program. Fewer different lengths count as they are; of more, neighbours are rounded up together.
LENGTH_CLASSES = 128
#: The program is solved when its sequences are within this share of the fewest (by Farley's bound, or by their room).
GAP = 0.005
#: Pricing ends where so many rounds together save less than this share of the sequences: the rest is not worth it.
TAIL_ROUNDS, TAIL_SHARE = 30, 0.0005
#: Words that a Python worker remembers; beyond, it forgets them all and starts anew.
CACHE_WORDS = 150_000
#: Pieces for each part of a length class, when pieces are ranked.
RANK_PART_ROWS = 100_000
#: Pieces are cut where whole ones need this share more sequences than their ids, into rooms of so many ids or more.
SPARE_SHARE, LEAST_ROOM = 0.02, 32

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"

_HEAD = re.compile(r"[^\W\d_]+")
_ODD_SPACE = re.compile(r" (?=\s|\Z)")
_WORD_START = re.compile(r" (?=\S)")


class TokenBytes:
    """Token ids of texts as little-endian 32-bit bytes.

    A byte-level vocabulary starts a new piece at each space before a non-space, so a text is the
    concatenation of its words, each with its space, and words repeat. The ids equal those of
    tokenizers for the same vocabulary; a text with a special token's string goes there directly.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding(
            "words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        owner = self

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= CACHE_WORDS:
                    self.clear()
                self[word] = found = owner.word(word)
                return found

        class Tails(dict):
            def __missing__(self, tail: str) -> bytes:
                if len(self) >= CACHE_WORDS:
                    self.clear()
                self[tail] = found = owner.plain(tail)
                return found

        self.words, self.tails = Words(), Tails()

    def plain(self, text: str) -> bytes:
        return np.asarray(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def word(self, word: str) -> bytes:
        """The ids of a space and a word that starts with a non-space."""
        if word.isalpha():
            return np.asarray(self.encoding._core_bpe.encode_single_piece(b" " + word.encode()), "<u4").tobytes()
        head = _HEAD.match(word)
        if head and head.end() < len(word) and head.group().isalpha():
            tail = word[head.end() :]
            if len(tail) <= 4:
                return self.words[head.group()] + self.tails[tail]
        return self.plain(" " + word)

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.asarray(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        parts = (_WORD_START.split if _ODD_SPACE.search(text) else _SPACE_SPLIT)(text)
        words = self.words
        return self.plain(parts[0]) + b"".join([words[w] for w in parts[1:]])


def _SPACE_SPLIT(text: str) -> list[str]:
    return text.split(" ")


_loaded: dict[tuple[str, str], TokenBytes] = {}


def _token_bytes(json_path: str, ranks_path: str) -> TokenBytes:
    key = (json_path, ranks_path)
    if key not in _loaded:
        _loaded[key] = TokenBytes(json_path, ranks_path)
    return _loaded[key]


def tokenize_pieces(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    json_path: str | None = None,
    ranks_path: str | None = None,
    size: int = SEQUENCE_TOKENS,
    keep_ids: bool = False,
) -> DataFrame:
    """The pieces of each document: its ids and an end id, cut every `size` ids; ids too with keep_ids."""
    import public_tokenizers

    json_path = json_path or str(public_tokenizers.path("byte_bpe_50k.json"))
    ranks_path = ranks_path or str(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    end = np.asarray([END_ID], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _token_bytes(json_path, ranks_path)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                n = len(ids) // 4
                for start in range(0, n, size):
                    part = ids[4 * start : 4 * (start + size)]
                    rows.append((doc, start, len(part) // 4, zlib.crc32(part), n, part))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            arrays = [pa.array(columns[k], pa.int64()) for k in range(5)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                arrays.append(pa.array([np.frombuffer(p, "<i4") for p in columns[5]], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    schema = PIECES + (", ids array<int>" if keep_ids else "")
    return docs.select(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string")).mapInArrow(cut, schema)


def good_patterns(prices: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack by dynamic programming: for each size the pattern of the largest price that holds it, best first."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if upto[c]:
            values = best[c - sizes[: upto[c]]] + prices[: upto[c]]
            k = int(values.argmax())
            if values[k] > best[c] + 1e-12:
                best[c], choice[c] = values[k], k
    found = np.zeros((len(sizes), len(sizes)))
    for k, size in enumerate(sizes):
        found[k, k] = 1
        c = capacity - size
        while c > 0:
            if choice[c] < 0:
                c -= 1
            else:
                found[k, choice[c]] += 1
                c -= sizes[choice[c]]
    return found[np.argsort(-(found @ prices), kind="stable")]


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, times): patterns[j] holds how many items of each size, times[j] how often to use it.

    Column generation: the linear program over patterns keeps one pattern for each size in its basis;
    its dual prices go to a knapsack, whose patterns enter while they are worth more than one sequence.
    The basis rounds down, and best fit decreasing packs the few items left. Every item is covered
    exactly. The work depends on the number of sizes alone, not on the demand.
    """
    m = len(sizes)
    if not m:
        return np.zeros((0, 0), int), np.zeros(0, int)
    each = capacity // sizes
    basis, inverse = np.diag(each.astype(float)), np.diag(1.0 / each)
    spread = demand * (1 + 1e-7 * np.arange(1, m + 1))  # breaks ties between equal ratios
    x = inverse @ spread
    sums = []
    while True:
        sums.append(x.sum())
        if len(sums) > TAIL_ROUNDS and sums[-1 - TAIL_ROUNDS] - sums[-1] < TAIL_SHARE * sums[-1]:
            break
        if x.sum() <= (1 + GAP) * (sizes @ demand) / capacity:  # all sequences nearly full
            break
        # prices jump about; patterns for prices nearer to the sizes, which those end near, are worth more
        for share in (0.9, 0.5, 0.0):
            prices = inverse.sum(axis=0)
            columns = good_patterns(share * sizes / capacity + (1 - share) * prices, sizes, capacity)
            if (columns @ prices).max() > 1 + GAP:
                break
        else:
            break  # the best of all packings needs at least the sum of prices over the best column's price
        for column in columns:
            if x.sum() <= (1 + GAP / 2) * (sizes @ demand) / capacity:
                break
            if inverse.sum(axis=0) @ column <= 1 + GAP / 2:
                continue
            way = inverse @ column
            rows = np.flatnonzero(way > 1e-9)
            leave = rows[np.argmin(x[rows] / way[rows])]
            theta = x[leave] / way[leave]
            x -= theta * way
            x[leave] = theta
            basis[:, leave] = column
            pivot = inverse[leave] / way[leave]
            inverse -= np.outer(way, pivot)
            inverse[leave] = pivot
    x = np.linalg.solve(basis, demand.astype(float))
    times = np.floor(np.maximum(x, 0) + 1e-9).astype(np.int64)
    patterns = basis.round().astype(np.int64)
    while (short := np.flatnonzero(patterns @ times > demand)).size:
        times[np.flatnonzero((patterns[short[0]] > 0) & (times > 0))[0]] -= 1
    left = demand - patterns @ times
    rest, room = [], np.zeros(0, int)
    for k in range(m - 1, -1, -1):
        for _ in range(int(left[k])):
            fits = np.flatnonzero(room >= sizes[k])
            if fits.size:
                at = fits[np.argmin(room[fits])]
            else:
                at, room = len(rest), np.append(room, capacity)
                rest.append(np.zeros(m, np.int64))
            rest[at][k] += 1
            room[at] -= sizes[k]
    used = times > 0
    stacked = [patterns.T[used], *([np.array(rest)] if rest else [])]
    return np.vstack(stacked), np.concatenate([times[used], np.ones(len(rest), np.int64)])


def length_classes(lengths: np.ndarray, counts: np.ndarray, most: int = LENGTH_CLASSES) -> np.ndarray:
    """The lengths (sorted) that stand for themselves and for those below them, down to the one before.

    Again and again the length whose pieces lose least tokens by being rounded up goes, until `most` are left.
    """
    kept, weight = [int(x) for x in lengths], [int(n) for n in counts]
    while len(kept) > most:
        loss = np.array(weight[:-1], float) * np.diff(kept)
        k = int(loss.argmin())
        kept.pop(k)
        moved = weight.pop(k)
        weight[k] += moved
    return np.array(kept, np.int64)


def histogram_of(pieces: DataFrame) -> np.ndarray:
    """(length, pieces) in order; at most as many rows as a sequence has ids."""
    return np.array(sorted(pieces.groupBy("length").count().collect()), np.int64).reshape(-1, 2)


def whole_patterns(histogram: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size classes, patterns, times) of pieces that stay whole."""
    sizes = length_classes(histogram[:, 0], histogram[:, 1])
    demand = np.bincount(np.searchsorted(sizes, histogram[:, 0]), weights=histogram[:, 1], minlength=len(sizes)).astype(np.int64)
    return sizes, *cutting_stock(sizes, demand, size)


def pads_much(histogram: np.ndarray, times: np.ndarray, size: int) -> bool:
    """Whether whole pieces take so many sequences that some are to be cut."""
    return times.sum() > (1 + SPARE_SHARE) * (histogram[:, 0] @ histogram[:, 1]) / size + 1


def given_up(content: np.ndarray, room: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How many sequences of each pattern, the emptiest first, the room of all others can take in."""
    given, need, left = np.zeros_like(times), 0, int(room @ times)
    for j in np.argsort(content, kind="stable"):
        given[j] = min(times[j], (left - need) // (content[j] + room[j]))
        need, left = need + int(given[j] * content[j]), left - int(given[j] * room[j])
        if given[j] < times[j]:
            break
    return given


def assign_sequences(pieces: DataFrame, *, size: int = SEQUENCE_TOKENS) -> DataFrame:
    """Give each piece a sequence_id and its offset there; pieces must be a stored table with PIECES columns.

    Pieces with their ids are cut where whole ones would leave much room: the emptiest sequences are given up, their
    pieces laid end to end, and the rooms of the others laid end to end take in what stands at the same places.
    """
    histogram = histogram_of(pieces)
    sizes, patterns, times = whole_patterns(histogram, size)
    of_length = np.zeros(size + 1, np.int64)
    of_length[histogram[:, 0]] = sizes[np.searchsorted(sizes, histogram[:, 0])]
    classed = pieces.withColumn("size_class", F.element_at(F.lit(of_length.tolist()), (F.col("length") + 1).cast("int")).cast("int"))
    content = patterns @ sizes
    room = np.where(size - content >= LEAST_ROOM, size - content, 0)
    cut = "ids" in pieces.columns and pads_much(histogram, times, size)
    given = given_up(content, room, times) if cut else np.zeros_like(times)
    kept = times - given
    first_sequence, first_room, first_given = (np.cumsum(n) - n for n in (kept, kept * room, given * content))
    slots = []  # (size class, first rank, pieces of the class in a sequence, first sequence or -1, first place, ids of a sequence)
    for k, size_class in enumerate(sizes):
        rank = 0
        for j in np.flatnonzero(patterns[:, k]):
            each, inside = int(patterns[j, k]), int(patterns[j, :k] @ sizes[:k])
            for n, first, place in ((kept[j], first_sequence[j], 0), (given[j], -1, first_given[j] + inside)):
                if n:
                    slots.append((int(size_class), rank, each, int(first), int(place), int(content[j])))
                    rank += int(each * n)
    table = np.array(slots, np.int64).reshape(-1, 6)
    keys = table[:, 0] * (1 << 48) + table[:, 1]
    open_patterns = np.flatnonzero(kept * room)
    rooms, room_starts, room_sequences = room[open_patterns], first_room[open_patterns], first_sequence[open_patterns]

    # Rank within a size class: parts of a class are numbered apart, then shifted by the parts before.
    parts = max(64, int(histogram[:, 1].sum()) // RANK_PART_ROWS)
    parted = classed.withColumn("part", F.pmod(F.xxhash64("doc_id", "start"), F.lit(parts)).cast("int"))
    part = Window.partitionBy("size_class", "part")
    shifts = (
        parted.groupBy("size_class", "part")
        .agg(F.count("*").alias("n"))
        .select(
            "size_class",
            "part",
            F.coalesce(
                F.sum("n").over(
                    Window.partitionBy("size_class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
                ),
                F.lit(0),
            ).alias("shift"),
        )
    )
    ranked = (
        parted.withColumn("place", F.row_number().over(part.orderBy("doc_id", "start", "ids_crc32")) - 1)
        .join(shifts, ["size_class", "part"])
        .withColumn("rank", F.col("place") + F.col("shift"))
        .drop("place", "shift", "part")
    )

    def laid(place: int, length: int) -> Iterator[tuple[int, int, int]]:
        """(ids before, ids, sequence) of the parts of a given piece: it is cut where a room ends."""
        at = 0
        while at < length:
            j = np.searchsorted(room_starts, place + at, side="right") - 1
            n, used = divmod(int(place + at - room_starts[j]), int(rooms[j]))
            part = min(length - at, int(rooms[j]) - used)
            yield at, part, int(room_sequences[j]) + n
            at += part

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of_class = batch.column("size_class").to_numpy(zero_copy_only=False).astype(np.int64)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            row = table[np.searchsorted(keys, of_class * (1 << 48) + rank, side="right") - 1]
            again, nth = np.divmod(rank - row[:, 1], row[:, 2]) if len(rank) else (rank, rank)
            moved = row[:, 3] < 0
            filled = pa.schema([*[pa.field(f.name, f.type) for f in batch.schema], pa.field("sequence_id", pa.int64())])
            whole = batch.filter(pa.array(~moved))
            yield pa.RecordBatch.from_arrays([*whole.columns, pa.array((row[:, 3] + again)[~moved], pa.int64())], schema=filled)
            parts = []  # (row, start, length, crc, ids, sequence)
            for i in np.flatnonzero(moved).tolist():
                ids, start = batch.column("ids")[i].values.to_numpy(), batch.column("start")[i].as_py()
                where = int(row[i, 4] + again[i] * row[i, 5] + nth[i] * row[i, 0])
                for at, n, sequence in laid(where, len(ids)):
                    part = ids[at : at + n]
                    parts.append((i, start + at, n, zlib.crc32(part.astype("<u4").tobytes()), part, sequence))
            if parts:
                index, starts, lengths, sums, ids, sequences = zip(*parts, strict=True)
                new = {"start": starts, "length": lengths, "ids_crc32": sums, "ids": ids}
                taken = batch.take(pa.array(index))
                columns = [pa.array(new[f.name], f.type) if f.name in new else taken.column(f.name) for f in batch.schema]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(sequences, pa.int64())], schema=filled)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema) + ", sequence_id long"
    before = (
        Window.partitionBy("sequence_id")
        .orderBy(F.desc("length"), "doc_id", "start", "rank")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        ranked.mapInArrow(place, schema)
        .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long")))
        .drop("size_class", "rank")
    )


def pack_documents(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    json_path: str | None = None,
    ranks_path: str | None = None,
    size: int = SEQUENCE_TOKENS,
    keep_ids: bool = False,
) -> DataFrame:
    """Pack all documents into sequences of `size` tokens; one row for each piece of a document.

    Columns: doc_id, start (ids of the document before the piece), length, ids_crc32 (of the ids as
    little-endian unsigned 32-bit numbers), doc_tokens (with the end id), sequence_id, offset (place in
    the sequence, gapless from 0), and ids with keep_ids. A document is cut where it exceeds `size`, and where pieces
    that stay whole would leave more than SPARE_SHARE of the sequences empty; then texts are tokenized once more, as
    pieces are stored without ids before that is known.

    Nulls: a null text is empty, so its one piece is the end id; a null id stays null. Rows that repeat
    an id or a text are packed each on its own. Extra columns are not returned. An empty table gives none.
    """
    tokenized = lambda ids: materialize(
        tokenize_pieces(docs, id_col=id_col, text_col=text_col, json_path=json_path, ranks_path=ranks_path, size=size, keep_ids=ids), "pieces"
    )
    pieces = tokenized(keep_ids)
    if not keep_ids:
        histogram = histogram_of(pieces)
        if pads_much(histogram, whole_patterns(histogram, size)[2], size):
            return assign_sequences(tokenized(True), size=size).drop("ids")
    return assign_sequences(pieces, size=size)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
