"""Line deduplication: a segment-partition edit join (DataFrame functions only)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.edit_join import candidate_pairs
from plumbline.llm.tables import materialize, new_path, release

#: Lines that differ in so many inserted, deleted or replaced characters count as the same line.
MAX_EDITS = 1
SEGMENTS = MAX_EDITS + 1
#: Columns of a line's first keys: (name, role, segment left out).
KEYS = [(f"key_{role}_{part}", role, part) for role in (0, 1) for part in range(SEGMENTS)]
#: Shorter lines (normalised) go if they are equal only: short ones are near each other by chance.
MIN_CHARS = 20
#: Pairs are formed in buckets of so many lines at most; larger ones split into finer segments.
BUCKET = 4
#: Segments that one is split into.
SPLIT = 4
#: A wild stretch of so few characters is resolved character by character.
SHORT_STRETCH = 4
#: Rows of the filter that is broadcast: hashes of the lines whose texts are looked at again.
FILTER_SLOTS = 1 << 20


def normalized(line: Column) -> Column:
    """Lower case, white space (ASCII) as single spaces, none at the ends."""
    # most lines need no replacement, and to see that takes a fraction of its time
    odd = line.contains("  ")
    for char in "\t\r\v\f":
        odd |= line.contains(char)
    return F.lower(F.trim(F.when(odd, F.regexp_replace(line, r"[\x20\x09-\x0D]+", " ")).otherwise(line)))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two hashes that tell rows apart by id and text."""
    i, t = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    return [F.xxhash64(i, t).alias("row_a"), F.xxhash64(t, F.lit("row"), i).alias("row_b")]


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row_a, row_b, doc_id, line_no, line, c1, c2): lines that are not blank, with a 128-bit hash of their normal form."""
    text = F.col(f"`{text_col}`").cast("string")
    lines = docs.where(text.isNotNull()).select(
        *row_key(id_col, text_col), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.posexplode(F.split(text, "\n")).alias("line_no", "raw")
    )
    lines = lines.where(F.length("raw") > 0).withColumn("line", normalized(F.col("raw"))).drop("raw")
    return lines.where(F.length("line") > 0).select(
        "*", F.xxhash64("line").alias("c1"), F.xxhash64(F.lit("line"), "line").alias("c2")
    )


def _bounds(length: Column, parts: int, part: Column) -> tuple[Column, Column]:
    """First character (from 0) of a segment and of the one after it."""
    cut = lambda k: F.floor(length * k / F.lit(parts)).cast("int")
    return cut(part), cut(part + 1)


def _segment_key(line: Column, parts: int, part: Column, role: Column) -> Column:
    """Hash of all of a line but one segment, with the length of the lines to match.

    role 0: the line as indexed, cut by its own length. role 1: the line as probing lines one character
    shorter, cut by their length, the segment left out being one longer here.
    """
    length = F.length(line) - role
    start, end = _bounds(length, parts, part)
    return F.xxhash64(
        F.lit(parts), part, length, F.substring(line, F.lit(1), start), F.substring(line, end + 1 + role, F.length(line))
    )


def _joined(rows: DataFrame, other: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by shuffle. A loop over levels would else collect a broadcast for each join at the driver."""
    return rows.join(other.hint("merge"), on, how)


def _bucketed(entries: DataFrame) -> DataFrame:
    """The entries that share their key with another that they can match, with n, the size of the bucket."""
    sizes = entries.groupBy("key").agg(F.count_if(F.col("role") == 0).alias("n0"), F.count("*").alias("n"))
    return _joined(entries, sizes.where("n0 > 0 AND n > 1").select("key", "n"), "key")


def _pairs(met: DataFrame, parts: int) -> DataFrame:
    """Pairs of a bucket: two indexed lines, or an indexed and a probing one, with the segment that is left out."""
    a = met.where("role = 0").select("key", F.col("c1").alias("a1"), F.col("c2").alias("a2"))
    b = met.select("key", "role", "part", F.col("c1").alias("b1"), F.col("c2").alias("b2"))
    once = (F.col("role") == 1) | (F.struct("a1", "a2") < F.struct("b1", "b2"))
    return _joined(a, b, "key").where(once).select("a1", "a2", "b1", "b2", "role", F.lit(parts).alias("parts"), "part")


def within_edits(a: Column, b: Column, edits: int = MAX_EDITS) -> Column:
    """Whether two arrays of characters are within so many edits, by bit-parallel simulation of a band of diagonals.

    Word e holds a bit for each diagonal from -edits to edits: whether the characters of a so far match
    those of b up to that diagonal with e edits. A character of a costs a few word operations for all
    diagonals at once: equal characters stay, a replaced one comes from the word before, an inserted or
    deleted one from the word before shifted. a and b must be plain columns, as each step reads them.
    """
    width, mask = 2 * edits + 1, (1 << (2 * edits + 1)) - 1
    start = F.array(*[F.lit(sum(1 << (edits + d) for d in range(e + 1))).cast("long") for e in range(edits + 1)])

    def step(state: Column, i: Column) -> Column:
        c = F.get(a, i)
        match = reduce(
            lambda x, y: x.bitwiseOR(y),
            [F.when(F.get(b, i + F.lit(k - edits)) == c, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k in range(width)],
        )
        words = [F.element_at(state, 1).bitwiseAND(match)]
        for e in range(1, edits + 1):
            before, kept = F.element_at(state, e), F.element_at(state, e + 1).bitwiseAND(match)
            moved = before.bitwiseOR(F.shiftright(before, 1)).bitwiseOR(F.shiftleft(words[e - 1], 1))
            words.append(kept.bitwiseOR(moved).bitwiseAND(F.lit(mask).cast("long")))
        return F.array(*words)

    apart = F.size(b) - F.size(a)
    places = F.when(F.size(a) > 0, F.sequence(F.lit(0), F.size(a) - 1)).otherwise(F.array().cast("array<int>"))
    last = F.element_at(F.aggregate(places, start, step), edits + 1)
    return F.when(F.abs(apart) <= edits, F.getbit(last, F.lit(edits) + apart) == 1).otherwise(F.lit(False))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The later of each pair of lines that are within MAX_EDITS: (c1, c2).

    Outside of the segment left out the lines must be equal; only its characters go through the edit distance.
    """
    side = lambda s: texts.select(F.col("c1").alias(f"{s}1"), F.col("c2").alias(f"{s}2"), F.col("line").alias(f"line_{s}"), F.col("rank").alias(f"rank_{s}"))
    both = _joined(_joined(pairs.dropDuplicates(["a1", "a2", "b1", "b2"]), side("a"), ["a1", "a2"]), side("b"), ["b1", "b2"])
    both = both.where(F.length("line_b") - F.col("role") == F.length("line_a"))
    bounds = [F.floor(F.length("line_a") * k / F.col("parts")).cast("int") for k in (F.col("part"), F.col("part") + 1)]
    both = both.withColumn("start", bounds[0]).withColumn("end", bounds[1])
    cut = lambda line, at, to: F.substring(F.col(line), at, to)
    one, start, end, shift = F.lit(1), F.col("start"), F.col("end"), F.col("role")
    equal = (cut("line_a", one, start) == cut("line_b", one, start)) & (
        cut("line_a", end + 1, F.length("line_a")) == cut("line_b", end + 1 + shift, F.length("line_b"))
    )
    chars = lambda line, n: F.filter(F.split(F.substring(F.col(line), start + 1, n), ""), lambda c: c != "")
    rest = both.where(equal).select(
        "a1", "a2", "b1", "b2", "rank_a", "rank_b", chars("line_a", end - start).alias("chars_a"), chars("line_b", end - start + shift).alias("chars_b")
    )
    # stored, as a filter would else move below the split and split the text anew at every step
    rest = materialize(rest, "lines-pairs")
    near = rest.where(within_edits(F.col("chars_a"), F.col("chars_b")))
    later = F.col("rank_a") > F.col("rank_b")
    return near.select(F.when(later, F.col("a1")).otherwise(F.col("b1")).alias("c1"), F.when(later, F.col("a2")).otherwise(F.col("b2")).alias("c2"))


def _without(line: Column, at: Column) -> Column:
    return F.concat(F.substring(line, F.lit(1), at), F.substring(line, at + 2, F.length(line)))


def _resolved(dense: DataFrame, parts: int) -> DataFrame:
    """(c1, c2) of lines with an earlier one in buckets whose wild stretch is short, without forming pairs.

    Lines of one length that agree without their q-th character are all within one edit of each other, so
    all but the first go. A line and those that equal it without one character are compared with it only.
    """
    length = F.length("line") - F.col("role")
    start, end = _bounds(length, parts, F.col("part"))
    places = F.explode(F.sequence(F.lit(0), F.lit(SHORT_STRETCH)))
    spread = dense.select("role", "c1", "c2", "rank", "line", length.alias("length"), start.alias("start"), end.alias("end"), places.alias("q"))
    at = F.col("start") + F.col("q")
    spread = spread.where((at < F.col("end") + F.col("role")) | (F.col("q") == 0))

    def keyed(rows: DataFrame, kind: str, *what: Column) -> DataFrame:
        return rows.select(
            F.xxhash64(F.lit(kind), "length", *what).alias("k1"), F.xxhash64(*what, F.lit(kind), "length").alias("k2"), "role", "c1", "c2", "rank"
        )

    same = keyed(spread.where((F.col("role") == 0) & (at < F.col("end"))), "same", at, _without(F.col("line"), at))
    shorter = keyed(spread.where("role = 0 AND q = 0"), "less", F.col("line")).unionByName(
        keyed(spread.where((F.col("role") == 1) & (at < F.col("end") + 1)), "less", _without(F.col("line"), at))
    )
    first_same = same.groupBy("k1", "k2").agg(F.min("rank").alias("first"), F.count("*").alias("n")).where("n > 1")
    first_less = shorter.groupBy("k1", "k2").agg(
        F.max(F.when(F.col("role") == 0, F.col("rank"))).alias("whole"), F.min(F.when(F.col("role") == 1, F.col("rank"))).alias("first")
    )
    late = _joined(same, first_same, ["k1", "k2"]).where(F.col("rank") > F.col("first"))
    less = _joined(shorter, first_less.where("whole IS NOT NULL AND first IS NOT NULL"), ["k1", "k2"]).where(
        F.when(F.col("role") == 0, F.col("first") < F.col("rank")).otherwise(F.col("whole") < F.col("rank"))
    )
    return late.select("c1", "c2").unionByName(less.select("c1", "c2"))


def near_lines(occurrences: DataFrame, classes: DataFrame) -> DataFrame:
    """(c1, c2) of the line classes that have an earlier class within MAX_EDITS.

    classes: (c1, c2, rank and KEYS); the keys leave out one of SEGMENTS segments each. Where a bucket holds
    more than BUCKET lines its segment is split again and again, so that the lines of a bucket agree in
    more and more of their characters, until few are left or the rest is one short stretch. Each level
    writes what it finds, so that no plan grows with the levels.
    """
    spark = classes.sparkSession
    pairs_path, gone_path = new_path(spark, "lines-pairs"), new_path(spark, "lines-gone")
    parts = SEGMENTS
    each = F.array(*[F.struct(F.lit(role).alias("role"), F.lit(part).alias("part"), F.col(name).alias("key")) for name, role, part in KEYS])
    entries = classes.select("c1", "c2", F.inline(each)).where("key IS NOT NULL")
    met = materialize(_bucketed(entries), "lines-met")
    slot = F.pmod(F.col("c1"), F.lit(FILTER_SLOTS)).cast("int")
    wanted = met.select("c1", "c2").distinct()
    slots = met.select(slot.alias("slot")).distinct()  # FILTER_SLOTS rows at most
    lines = occurrences.join(F.broadcast(slots), slot == F.col("slot"), "left_semi").groupBy("c1", "c2").agg(F.any_value("line").alias("line"))
    texts = materialize(_joined(_joined(lines, wanted, ["c1", "c2"]), classes.select("c1", "c2", "rank"), ["c1", "c2"]), "lines-texts")
    pairs = _pairs(met.where(F.col("n") <= BUCKET), parts)
    kinds = {pairs_path: pairs.schema, gone_path: texts.select("c1", "c2").schema}
    pairs.write.parquet(pairs_path)
    texts.select("c1", "c2").limit(0).write.parquet(gone_path)
    dense = materialize(_joined(met.where(F.col("n") > BUCKET).drop("n", "key"), texts, ["c1", "c2"]), "lines-dense")
    release(met)
    held = dense
    while not dense.isEmpty():
        start, end = _bounds(F.length("line") - F.col("role"), parts, F.col("part"))
        short = (end - start) <= SHORT_STRETCH
        _resolved(dense.where(short), parts).write.mode("append").parquet(gone_path)
        parts *= SPLIT
        finer = F.explode(F.array(*[F.col("part") * SPLIT + k for k in range(SPLIT)]))
        split = dense.where(~short).select("c1", "c2", "rank", "role", "line", finer.alias("part"))
        children = split.withColumn("key", _segment_key(F.col("line"), parts, F.col("part"), F.col("role")))
        before, met = held, materialize(_bucketed(children), "lines-met")
        _pairs(met.where(F.col("n") <= BUCKET), parts).write.mode("append").parquet(pairs_path)
        release(before)
        held, dense = met, met.where(F.col("n") > BUCKET).drop("n", "key")
    read = lambda path: spark.read.schema(kinds[path]).parquet(path)
    found = materialize(_verified(read(pairs_path), texts).unionByName(read(gone_path)).distinct(), "lines-near")
    for table in (held, texts, read(pairs_path), read(gone_path)):
        release(table)
    return found


def lines_within(occurrences: DataFrame, classes: DataFrame, edits: int) -> DataFrame:
    """near_lines() for another threshold than one edit."""
    lines = occurrences.groupBy("c1", "c2").agg(F.any_value("line").alias("line"))
    texts = materialize(_joined(lines, classes.select("c1", "c2", "rank"), ["c1", "c2"]), "lines-texts")
    if not edits:
        return texts.select("c1", "c2").limit(0)
    side = lambda s: texts.select(F.col("c1").alias(f"{s}1"), F.col("c2").alias(f"{s}2"), F.col("line").alias(f"line_{s}"), F.col("rank").alias(f"rank_{s}"))
    both = _joined(_joined(candidate_pairs(texts, edits), side("a"), ["a1", "a2"]), side("b"), ["b1", "b2"])
    chars = lambda line: F.filter(F.split(F.col(line), ""), lambda c: c != "")
    both = materialize(both.select("a1", "a2", "b1", "b2", "rank_a", "rank_b", chars("line_a").alias("x"), chars("line_b").alias("y")), "lines-pairs")
    end = lambda s: F.struct(F.col(f"{s}1").alias("c1"), F.col(f"{s}2").alias("c2"))
    later = F.when(F.col("rank_a") > F.col("rank_b"), end("a")).otherwise(end("b"))
    found = both.where(within_edits(F.col("x"), F.col("y"), edits)).select(later.alias("l"))
    return materialize(found.select("l.c1", "l.c2").distinct(), "lines-near")


def deduplicate_lines(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, max_edits: int = MAX_EDITS
) -> DataFrame:
    """Remove each line that repeats an earlier one of the corpus, and each of min_chars or more that is within max_edits edits of one.

    Lines end at line feeds and compare in their normal form; they come in order of (id, line number). Blank
    lines stay; lines shorter than min_chars (in their normal form) go if they are equal to an earlier one only.
    A line goes if an earlier one is equal or near, whether or not that one stays itself. Returns all
    columns of docs with the text as it is then, and n_lines, n_removed and emptied (nothing but white
    space is left of a text that had more). Input columns of these names are replaced.

    Nulls: a null text stays null and has no lines; a null id counts as before all others. Rows with the
    same id and text share their positions, so both keep a line that is the first. An empty table gives none.
    """
    occurrences = _occurrences(docs, id_col, text_col)
    long_ = F.length("line") >= min_chars
    keys = [F.when(long_, _segment_key(F.col("line"), SEGMENTS, F.lit(part), F.lit(role))).alias(name) for name, role, part in KEYS]
    # one pass over the texts gives what the classes and the removal need of every line
    places = materialize(occurrences.select("row_a", "row_b", "doc_id", "line_no", "c1", "c2", *keys), "lines-places")
    classes = materialize(
        places.groupBy("c1", "c2").agg(
            F.min(F.struct("doc_id", "line_no", "c1", "c2")).alias("rank"), F.count("*").alias("n"), *[F.max(k[0]).alias(k[0]) for k in KEYS]
        ),
        "lines-classes",
    )
    found = near_lines(occurrences.where(long_), classes) if max_edits == MAX_EDITS else lines_within(occurrences.where(long_), classes, max_edits)
    near = found.withColumn("near", F.lit(True))
    verdicts = (
        classes.select("c1", "c2", "n", F.col("rank.doc_id").alias("first_doc"), F.col("rank.line_no").alias("first_line"))
        .join(near, ["c1", "c2"], "left")
        .where(F.col("near") | (F.col("n") > 1))
    )
    first = F.col("doc_id").eqNullSafe(F.col("first_doc")) & (F.col("line_no") == F.col("first_line"))
    removed = (
        places.select("row_a", "row_b", "doc_id", "line_no", "c1", "c2").join(verdicts, ["c1", "c2"])
        .where(F.coalesce(F.col("near"), F.lit(False)) | ~first)
        .groupBy("row_a", "row_b")
        .agg(F.collect_set("line_no").alias("removed_lines"))
    )
    added = {"n_lines", "n_removed", "emptied"}
    kept = [c for c in docs.columns if c.lower() not in added]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), *row_key(id_col, text_col))
    joined = rows.join(removed, ["row_a", "row_b"], "left")
    text = F.col("row")[text_col].cast("string")
    parts = F.split(text, "\n")
    count = F.coalesce(F.size("removed_lines"), F.lit(0))
    left = F.array_join(F.filter(parts, lambda _, i: ~F.array_contains("removed_lines", i)), "\n")
    joined = joined.select("row", F.when(count > 0, left).otherwise(text).alias("left"), count.alias("count"), F.size(parts).alias("n"))
    empty = lambda x: ~F.coalesce(x, F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    return joined.select(
        *[F.col("left").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in kept],
        F.coalesce(F.when(F.col("n") >= 0, F.col("n")), F.lit(0)).cast("long").alias("n_lines"),
        F.col("count").cast("long").alias("n_removed"),
        ((F.col("count") > 0) & empty(F.col("left"))).alias("emptied"),
    )


def op9_lines(spark, sf_dir: str) -> DataFrame:
    return deduplicate_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_lines", "n_removed", "emptied")


OP9_SQL = r"""
WITH raw AS (
  SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS line_no
  FROM documents WHERE text IS NOT NULL),
norm AS (
  SELECT doc_id, line_no, line, lower(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g'))) AS norm FROM raw),
classes AS (
  SELECT norm, min((doc_id, line_no)) AS first, length(norm) AS n FROM norm WHERE length(norm) > 0 GROUP BY norm),
long AS (SELECT * FROM classes WHERE n >= 20),
same AS (
  SELECT a.norm AS x, b.norm AS y, a.first AS fx, b.first AS fy FROM long a JOIN long b
    ON a.n = b.n AND left(a.norm, a.n // 2) = left(b.norm, b.n // 2) AND a.norm < b.norm
  UNION
  SELECT a.norm, b.norm, a.first, b.first FROM long a JOIN long b
    ON a.n = b.n AND right(a.norm, a.n - a.n // 2) = right(b.norm, b.n - b.n // 2) AND a.norm < b.norm),
replaced AS (
  SELECT * FROM same WHERE list_sum(list_transform(range(1, length(x) + 1), lambda i: (x[i] <> y[i])::INT)) = 1),
shorter AS (
  SELECT norm, first, unnest(list_transform(range(1, n + 1), lambda i: left(norm, i - 1) || substr(norm, i + 1))) AS cut FROM long),
links AS (
  SELECT x, y, fx, fy FROM replaced
  UNION ALL SELECT a.norm, b.norm, a.first, b.first FROM long a JOIN shorter b ON a.norm = b.cut),
near AS (SELECT DISTINCT CASE WHEN fx > fy THEN x ELSE y END AS norm FROM links),
marked AS (
  SELECT r.doc_id, r.line_no, r.line, c.norm IS NOT NULL AND (n.norm IS NOT NULL OR c.first <> (r.doc_id, r.line_no)) AS gone
  FROM norm r LEFT JOIN classes c USING (norm) LEFT JOIN near n USING (norm)),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone) AS text, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed
  FROM marked GROUP BY doc_id)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text, coalesce(n_lines, 0) AS n_lines,
  coalesce(n_removed, 0) AS n_removed,
  coalesce(n_removed, 0) > 0 AND NOT regexp_matches(coalesce(k.text, ''), '[^\x20\x09-\x0D]') AS emptied
FROM documents d LEFT JOIN kept k USING (doc_id)
"""
