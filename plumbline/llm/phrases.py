"""Collocations: n-gram counts from suffix arrays of word ids, one for each shard, merged by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.tables import materialize

MAX_WORDS = 4
MIN_COUNT = 30
#: A phrase goes if a longer one around it has this share of its occurrences, in percent.
COVERED_PERCENT = 80
BEST = 2000
SCORE_SCALE = 2_000_000
NO_LANGUAGE = "und"
#: A suffix array holds so many words; a text that has more is a shard of its own.
SHARD_WORDS = 1 << 20
#: Texts are cut into words in slices of so many bytes.
SLICE_BYTES = 4 << 20
#: Slots of the filter for each frequent key, and the bits of its largest size (128 MB). It only saves work: what
#: passes by chance is counted like all else.
SLOTS_PER_KEY, FILTER_BITS = 16, (15, 30)
#: Rows of a batch that a task returns.
BATCH_ROWS = 1 << 16

_BLANK, _CUT = 1, 2
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = _BLANK
_CLASS[[ord(c) for c in ".,;:!?\n\v\f\r"]] = _CUT
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, lengths, new) of the words of all texts, in order: lower-case bytes one after the other, whether a piece starts."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    heads = np.unique(offsets[:-1] - offsets[0])
    heads = heads[heads < len(raw)]
    kind = _CLASS[raw]
    word = kind == 0
    first = word.copy()
    first[1:] &= ~word[:-1]
    first[heads] = word[heads]
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[heads[1:] - 1] = word[heads[1:] - 1]
    places = np.flatnonzero(first)
    lengths = np.flatnonzero(last) - places + 1
    piece = np.searchsorted(np.flatnonzero(kind == _CUT), places) + np.searchsorted(heads, places, side="right")
    new = np.ones(len(places), bool)
    new[1:] = piece[1:] != piece[:-1]
    return _LOWER[raw[word]], lengths, new


def left_in_piece(new: np.ndarray) -> np.ndarray:
    """Words from each one to the end of its piece, itself included."""
    ends = np.append(np.flatnonzero(new)[1:], len(new))
    return np.repeat(ends, np.diff(np.append(np.flatnonzero(new), len(new)))) - np.arange(len(new))


def suffix_array(ids: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of what follows them in their piece, as far as `depth` words, by prefix doubling.

    ids: word ids from 1 on; left: words to the end of the piece, before which a suffix ends.
    """
    rank, known = ids.astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while known < depth:
        beyond = np.zeros(len(rank), np.int64)
        inside = np.flatnonzero(left > known)
        beyond[inside] = rank[inside + known]
        key = rank * (int(rank.max(initial=0)) + 1) + beyond
        order = np.argsort(key, kind="stable")
        known *= 2
        if known < depth:
            step = np.zeros(len(key), np.int64)
            step[1:] = key[order][1:] != key[order][:-1]
            rank = np.empty(len(key), np.int64)
            rank[order] = np.cumsum(step) + 1
    return order


def common_prefixes(ids: np.ndarray, left: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Words that each suffix shares with the one before it in the order (LCP), at most `depth`; 0 of the first."""
    shared = np.zeros(len(order), np.int8)
    alive = np.arange(1, len(order))
    for k in range(depth):
        a, b = order[alive - 1], order[alive]
        inside = (left[a] > k) & (left[b] > k)
        alive, a, b = alive[inside], a[inside], b[inside]
        alive = alive[ids[a + k] == ids[b + k]]
        shared[alive] += 1
    return shared


def phrase_counts(ids: np.ndarray, new: np.ndarray, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, a place of each n-gram, its number) for n from 1 to depth: the intervals of suffixes that share n words."""
    if not len(ids):
        return
    left = left_in_piece(new)
    order = suffix_array(ids, left, depth)
    shared = common_prefixes(ids, left, order, depth)
    for n in range(1, depth + 1):
        starts = np.flatnonzero(shared < n)
        counts = np.diff(np.append(starts, len(order)))
        long = left[order[starts]] >= n
        yield n, order[starts[long]], counts[long]


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _pair_keys(hashes: np.ndarray, following: np.ndarray) -> np.ndarray:
    return _mixed(hashes * np.uint64(3) + _mixed(following))


class Shard:
    """The words of one language: ids in the order in which they first come, and a hash of each."""

    def __init__(self, lang: str, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        data, lengths, self.new = (np.concatenate(p) for p in zip(*parts, strict=True))
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        table = words.dictionary_encode()
        self.lang, self.ids = lang, np.asarray(table.indices, np.int64) + 1
        self.words = table.dictionary.cast(pa.large_string())
        seed = xxhash.xxh64_intdigest(lang.encode())
        self.hashes = np.array([0, *[xxhash.xxh64_intdigest(w, seed) for w in table.dictionary.to_pylist()]], np.uint64)

    def phrases(self, ids: np.ndarray, places: np.ndarray, n: int) -> pa.Array:
        """The n words from each place on, joined by spaces."""
        columns = [self.words.take(pa.array(ids[places + k] - 1)) for k in range(n)]
        return pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string())) if n > 1 else columns[0]


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards of batches (lang, text), of one language each; all that are open have SHARD_WORDS together at most."""
    held: dict[str, list] = {}
    count = 0
    for batch in batches:
        langs = batch.column(0)
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(1)), 0), np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            upto = max(at + 1, int(np.searchsorted(ends, before + SLICE_BYTES, side="right")))
            part = batch.slice(at, upto - at)
            for lang in pc.unique(part.column(0)).to_pylist():
                found = words_of(part.filter(pc.equal(part.column(0), lang)).column(1))
                if len(found[1]):
                    held.setdefault(lang, []).append(found)
                    count += len(found[1])
            at = upto
            if count >= SHARD_WORDS:
                yield from (Shard(lang, held.pop(lang)) for lang in list(held))
                count = 0
    yield from (Shard(lang, held.pop(lang)) for lang in list(held))


def _by_language(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit(NO_LANGUAGE))
    return docs.select(lang.alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))


def _batched(columns: list[pa.Array], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(columns, names)
    for at in range(0, whole.num_rows, BATCH_ROWS):
        yield whole.slice(at, BATCH_ROWS)


def _frequent_keys(texts: DataFrame, least: int) -> DataFrame:
    """Hashes of words and pairs of words that come `least` times or more."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches):
            for n, places, counts in phrase_counts(shard.ids, shard.new, 2):
                keys = shard.hashes[shard.ids[places]]
                if n == 2:
                    keys = _pair_keys(keys, shard.hashes[shard.ids[places + 1]])
                yield from _batched([pa.array(keys.view(np.int64)), pa.array(counts, pa.int64())], ["key", "n"])

    return texts.mapInArrow(counted, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key")


def _filter(keys: DataFrame, count: int) -> bytes:
    """A bitmap of the keys' lowest bits, with SLOTS_PER_KEY bits for each key up to the largest size."""
    bits = min(max(int(SLOTS_PER_KEY * max(count, 1) - 1).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
    slot = F.col("key").bitwiseAND(F.lit((1 << bits) - 1)) + 1  # these functions count from 1
    parts = keys.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    bitmap = bytearray((1 << bits) // 8)
    for r in parts.toLocalIterator():
        at = (r["bucket"] - 1) * len(r["bits"])
        bitmap[at : at + len(r["bits"])] = r["bits"]
    return bytes(bitmap)


def _passing(keys: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    slot = keys & np.uint64(8 * len(bitmap) - 1)
    return (bitmap[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def count_phrases(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", max_words: int = MAX_WORDS, min_count: int = MIN_COUNT
) -> DataFrame:
    """(lang, phrase, words, f): all phrases of 1 to max_words words that come min_count times or more in a language.

    A row of 0 words has the number of all words of a language. Counts are exact and cover whole texts. Texts are
    lower-cased (A-Z), split at punctuation and line ends into pieces and at blanks into words. Two passes over the
    texts: the first counts hashes of words and pairs in each shard and merges them; the second counts phrases whose
    pairs may all be frequent. Shards hold SHARD_WORDS words; what they return is a row for each different phrase, so
    a phrase that is everywhere is no hot key. The filter between them is a bitmap of a bounded size.

    Nulls: a null language is `und`, a null text is empty. Repeated rows count each time. An empty table gives no row.
    """
    spark, texts = docs.sparkSession, _by_language(docs, text_col, lang_col)
    keys = materialize(_frequent_keys(texts, min_count), "phrase-keys")
    sent = spark.sparkContext.broadcast(_filter(keys, keys.count()))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(sent.value, np.uint8)
        names = ["lang", "phrase", "words", "n"]
        for shard in _shards(batches):
            ids, new = shard.ids, shard.new

            def rows(phrases: pa.Array, n: int, counts: np.ndarray, lang: str = shard.lang) -> Iterator[pa.RecordBatch]:
                same = [pa.array([v], kind).take(pa.array(np.zeros(len(phrases), np.int32))) for v, kind in ((lang, pa.string()), (n, pa.int32()))]
                yield from _batched([same[0], phrases.cast(pa.string()), same[1], pa.array(counts, pa.int64())], names)

            yield from rows(pa.array([""]), 0, np.array([len(ids)]))
            single = np.flatnonzero(_passing(shard.hashes[1:], bitmap))
            times = np.bincount(ids, minlength=len(shard.hashes))[1:]
            yield from rows(shard.words.take(pa.array(single)), 1, times[single])
            # words between two pairs that are both too rare are in no phrase
            hashes = shard.hashes[ids]
            joined = np.zeros(len(ids) + 1, bool)
            joined[1:-1] = ~new[1:]
            pairs = np.flatnonzero(joined[1:-1])
            joined[pairs + 1] = _passing(_pair_keys(hashes[pairs], hashes[pairs + 1]), bitmap)
            kept = joined[:-1] | joined[1:]
            ids, new = ids[kept], ~joined[:-1][kept]
            for n, places, counts in phrase_counts(ids, new, max_words):
                for at in range(0, len(places), BATCH_ROWS) if n > 1 else ():
                    some = slice(at, at + BATCH_ROWS)
                    yield from rows(shard.phrases(ids, places[some], n), n, counts[some])

    found = texts.mapInArrow(counted, "lang string, phrase string, words int, n long").groupBy("lang", "phrase", "words").agg(F.sum("n").alias("f"))
    stored = materialize(found.where((F.col("words") == 0) | (F.col("f") >= min_count)), "phrases")
    sent.unpersist()
    return stored


def _cut_out(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    max_words: int = MAX_WORDS,
    min_count: int = MIN_COUNT,
    covered_percent: int = COVERED_PERCENT,
    best: int = BEST,
) -> DataFrame:
    """The `best` phrases of 2 to max_words words of each language: lang, rank, phrase, a, l, r, n, score.

    a counts the phrase, l and r its two parts at the cut with the lowest score, floor(2000000 a / (l + r)), the
    earliest of equal ones; n counts all words of the language. A phrase goes if a longer one that holds its words in
    a row has covered_percent of its occurrences or more. Order: score, a (both descending), phrase (bytes).

    Nulls, repeats and empty tables: as in count_phrases(). Columns of the input are not returned, so none clash.
    """
    counts = count_phrases(docs, text_col=text_col, lang_col=lang_col, max_words=max_words, min_count=min_count)
    phrases = counts.where("words > 1").withColumn("w", F.split("phrase", " "))
    parts = counts.where("words > 0").select("lang", F.col("phrase").alias("part"), F.col("f").alias("part_f"))
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({"left": _cut_out(F.col("w"), F.lit(1), F.col("k")), "right": _cut_out(F.col("w"), F.col("k") + 1, F.col("words") - F.col("k"))})
    left = parts.select(F.col("lang"), F.col("part").alias("left"), F.col("part_f").alias("l"))
    right = parts.select(F.col("lang"), F.col("part").alias("right"), F.col("part_f").alias("r"))
    cuts = cuts.join(left, ["lang", "left"]).join(right, ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr(f"cast(f AS decimal(19,0)) * {SCORE_SCALE} div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))")
    lowest = F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r"))
    scored = cuts.groupBy("lang", "phrase").agg(F.first("f").alias("a"), lowest.alias("cut"))
    # every row of words that a longer phrase holds, and the most occurrences of such a phrase
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(2), F.col("words") - 1),
            lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda at: _cut_out(F.col("w"), at, n)),
        )
    )
    held = phrases.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "f")
    around = held.groupBy("lang", "phrase").agg(F.max("f").alias("longest"))
    covered = wide("longest") * 100 >= wide("a") * covered_percent
    kept = scored.join(around, ["lang", "phrase"], "left").where(~F.coalesce(covered, F.lit(False)))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    top = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    words = counts.where("words = 0").select("lang", F.col("f").alias("n"))
    return top.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrases(spark, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
grams AS (
  SELECT lang, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) AS phrase
  FROM words, (VALUES (1), (2), (3), (4)) AS sizes(n) WHERE len(w) >= n),
f AS (SELECT lang, n, phrase, string_split(phrase, ' ') AS g, f
  FROM (SELECT lang, n, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
parted AS (
  SELECT lang, phrase, f AS a, k, array_to_string(list_slice(g, 1, k), ' ') AS before, array_to_string(list_slice(g, k + 1, n), ' ') AS after
  FROM f, (VALUES (1), (2), (3)) AS places(k) WHERE k < n),
cuts AS (
  SELECT p.lang, p.phrase, a, k, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score
  FROM parted p JOIN f l ON l.lang = p.lang AND l.phrase = p.before JOIN f r ON r.lang = p.lang AND r.phrase = p.after),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
around AS (
  SELECT lang, array_to_string(list_slice(g, i, i + m - 1), ' ') AS phrase, max(f) AS longest
  FROM f, (VALUES (2), (3)) AS sizes(m), (VALUES (1), (2), (3)) AS places(i) WHERE m < n AND i + m - 1 <= n GROUP BY ALL),
kept AS (
  SELECT s.* FROM scored s LEFT JOIN around USING (lang, phrase)
  WHERE longest IS NULL OR 100::HUGEINT * longest < 80::HUGEINT * a),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
