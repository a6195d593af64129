"""Quality classifier: document evidence with host and path posteriors by hierarchical empirical Bayes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import materialize, with_columns_replaced

#: The document model is fitted on so many labelled rows at most: those with the smallest hashes of their ids.
TRAIN_ROWS = 20_000
RIDGE = 1.0
#: Documents whose probability of being good is below this are rejected.
ACCEPT = 0.5
#: Up to so many sites (host and path pairs) their figures are broadcast, 40 bytes each; beyond, they are joined.
BROADCAST_SITES = 50_000
#: Prior rows that a level stands for, where sites do not differ more than chance: the strongest shrinkage.
MAX_PRIOR_ROWS = 1e6

FEATURES = (
    "log_words", "distinct_words", "repeats", "word_length", "upper", "lower", "digits", "spaces", "sentence_ends",
    "exclamations", "separators", "symbols", "other_bytes", "marked_words", "capital_words",
)
#: Slots of hashed n-grams, each: words, pairs of words, and runs of three bytes.
SLOTS = 64
WIDTH = len(FEATURES) + 3 * SLOTS
#: The penalty of n-grams' weights is so many times that of FEATURES, which are few and general.
GRAM_RIDGE = 100.0
#: Texts whose features a Python worker holds at once.
SLICE_ROWS = 512
#: Words that a Python worker remembers.
CACHE_WORDS = 150_000
_CLASSES = (
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" \t\r\n\v\f", b".?,;:'\"-",
    b"!", b"|<>{}[]=_\\/~^", b"#$%&*+@`()", bytes(range(128, 256)),
)
_CLASS_OF = np.zeros(256, np.uint8)
for _k, _members in enumerate(_CLASSES):
    _CLASS_OF[list(_members)] = _k + 1
_MARKS = b"!#$%&*+=|~^<>{}[]\\"


class _WordSlots(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = found = zlib.crc32(word.lower())
        return found


_slots = _WordSlots()


def _grams(text: bytes, words: list[bytes]) -> list[np.ndarray]:
    """Roots of the shares of each slot."""
    ids = np.fromiter(map(_slots.__getitem__, words), np.uint32, len(words))
    pairs = (ids[:-1] * np.uint32(2654435761)) ^ ids[1:]
    raw = np.frombuffer(text, np.uint8).astype(np.uint32)
    threes = raw[:-2] * np.uint32(0x9E3779B1) + raw[1:-1] * np.uint32(0x85EBCA77) + raw[2:] * np.uint32(0xC2B2AE3D)
    slots = lambda h: np.bincount((h >> np.uint32(13)) % SLOTS, minlength=SLOTS)
    return [np.sqrt(slots(h) / max(1, len(h))) for h in (ids, pairs, threes)]


def features(text: bytes) -> np.ndarray:
    """FEATURES of a text in UTF-8 and its hashed n-grams, over the whole text. Without words all are 0."""
    words = text.split()
    n = len(words)
    if not n:
        return np.zeros(WIDTH)
    histogram = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    kinds = np.bincount(_CLASS_OF, weights=histogram, minlength=len(_CLASSES) + 1)[1:] / len(text)
    repeats = sum(map(bytes.__eq__, words, words[1:])) / n
    marked = sum(w[-1] in _MARKS for w in words) / n
    capital = sum(map(bytes.isupper, words)) / n
    # a longer text repeats more of its words: compare with the root of the length
    shape = [np.log(n), len(set(words)) / n**0.75, repeats, len(text) / n, *kinds, marked, capital]
    return np.concatenate([shape, *_grams(text, words)])


@dataclass(frozen=True)
class DocumentModel:
    """Logistic regression: mean, scale and weights of the features, intercept, and the share of good training rows."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    intercept: float
    prior: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, good: np.ndarray, ridge: float = RIDGE) -> DocumentModel:
    """Ridge logistic regression by Newton's method; without rows of both kinds, the prior alone."""
    n, k = x.shape if len(x) else (0, WIDTH)
    prior = float((good.sum() + 1) / (n + 2))
    odds = float(np.log(prior / (1 - prior)))
    if n == 0 or good.min() == good.max():
        return DocumentModel(np.zeros(k), np.ones(k), np.zeros(k), odds, prior)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-9] = 1.0
    a = np.hstack([np.clip((x - mean) / scale, -8, 8), np.ones((n, 1))])
    w = np.append(np.zeros(k), odds)
    penalty = np.diag([ridge] * len(FEATURES) + [ridge * GRAM_RIDGE] * (k - len(FEATURES)) + [1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (good - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return DocumentModel(mean, scale, w[:-1], float(w[-1]), prior)


def _rows_of_features(texts: pa.Array) -> np.ndarray:
    return np.array([features(t.as_py() or b"") for t in texts], np.float64).reshape(len(texts), WIDTH)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def fit_documents(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rows: int = TRAIN_ROWS
) -> DocumentModel:
    """Fit the document model on at most `rows` labelled rows; rows without a label of 0 or 1 are not used."""
    wanted = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).alias("label_id"))
        .agg(F.max(label_col).cast("double").alias("good"))
        .orderBy(F.xxhash64("label_id"), "label_id")
        .limit(rows)
    )
    found = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text")).join(
        F.broadcast(wanted), F.col("doc_id") == F.col("label_id")  # TRAIN_ROWS rows of 16 bytes
    )

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            x = _rows_of_features(batch.column("text"))
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * WIDTH, pa.int32()), pa.array(x.ravel().astype(np.float32)))
            yield pa.RecordBatch.from_arrays([rows, batch.column("doc_id"), batch.column("good")], ["x", "doc_id", "good"])

    kind = found.schema["doc_id"].dataType.simpleString()
    # rows that share an id (copies of a row) count once, so that no more than `rows` come to the driver
    one = found.select("doc_id", "good", "text").mapInArrow(measured, f"x array<float>, doc_id {kind}, good double")
    table = one.groupBy("doc_id").agg(F.min_by("x", "x").alias("x"), F.max("good").alias("good")).orderBy("doc_id").toArrow()
    x = table.column("x").combine_chunks().flatten().to_numpy().astype(np.float64).reshape(table.num_rows, WIDTH)
    return fit(x, table.column("good").to_numpy().astype(np.float64))


def document_scores(docs: DataFrame, model: DocumentModel, *, text_col: str = "text", keep: list[Column]) -> DataFrame:
    """The columns keep and doc_prob, the document model's probability of a good text."""
    rows = docs.select(*keep, F.col(f"`{text_col}`").cast("string").cast("binary").alias("__text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            p = model.probability(_rows_of_features(batch.column("__text")))
            yield batch.drop_columns(["__text"]).append_column("doc_prob", pa.array(p, pa.float64()))

    schema = docs.sparkSession.createDataFrame([], rows.drop("__text").schema).withColumn("doc_prob", F.lit(0.0)).schema
    return rows.mapInArrow(scored, schema)


def _prior_rows(groups: DataFrame, level: str, above: str) -> tuple[float, float]:
    """(number of prior rows, groups) by moments: spread of a level's means about the mean above, against chance.

    groups: a row for each group with n, s (sum of the probabilities), q (sum of their squares) and the
    mean of the level above.
    """
    row = groups.agg(
        F.count("*").alias("k"),
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.sum(F.col("q") - F.col("s") * F.col("s") / F.col("n")).alias("within"),
        F.sum(F.col("n") * F.pow(F.col(level) - F.col(above), 2)).alias("between"),
    ).first()
    if not row["n"] or row["k"] < 2 or row["n"] <= row["k"]:
        return MAX_PRIOR_ROWS, row["k"]
    chance = max(row["within"], 0.0) / (row["n"] - row["k"])
    spread = (row["between"] - (row["k"] - 1) * chance) / max(row["n"] - row["nn"] / row["n"], 1e-9)
    return (min(max(chance / spread, 1.0), MAX_PRIOR_ROWS) if spread > 0 else MAX_PRIOR_ROWS), row["k"]


def site_figures(scores: DataFrame) -> tuple[DataFrame, dict[str, float]]:
    """Figures of each (host, path), and the global prior and the prior rows of both levels.

    Sums of doc_prob by path add up to those by host and overall; the number of prior rows of a level
    comes from how much its means differ beyond chance. The figures: path_n, path_s, host_n, host_s.
    """
    paths = materialize(
        scores.groupBy("host", "path").agg(
            F.count("*").cast("double").alias("n"), F.sum("doc_prob").alias("s"), F.sum(F.col("doc_prob") * F.col("doc_prob")).alias("q")
        ),
        "site-paths",
    )
    hosts = materialize(paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("n", "s", "q")]), "site-hosts")
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    prior = total["s"] / total["n"] if total["n"] else 0.5
    host_rows, _ = _prior_rows(hosts.withColumn("m", F.col("s") / F.col("n")).withColumn("up", F.lit(prior)), "m", "up")
    named = hosts.select(F.col("host").alias("of_host"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    joined = materialize(paths.join(named, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host"), "sites")
    up = (F.col("host_s") + F.lit(host_rows * prior)) / (F.col("host_n") + F.lit(host_rows))
    path_rows, sites = _prior_rows(joined.withColumn("m", F.col("s") / F.col("n")).withColumn("up", up), "m", "up")
    figures = joined.select("host", "path", F.col("n").alias("path_n"), F.col("s").alias("path_s"), "host_n", "host_s")
    return figures, {"prior": prior, "host_rows": host_rows, "path_rows": path_rows, "sites": sites}


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(q / (1 - q))


def combine(scores: DataFrame, figures: DataFrame, levels: dict[str, float], prior: float, accept: float = ACCEPT) -> DataFrame:
    """Add host_prob, path_prob, quality and accepted to rows with host, path and doc_prob.

    A document's site says what is known without it: its own probability is taken off the sums. The host's
    mean shrinks to the global prior and the path's mean to that of its host, by the prior rows of the
    level. The document's odds, freed of the training prior, multiply the odds of its path.
    """
    sites = figures.select(F.col("host").alias("of_host"), F.col("path").alias("of_path"), "path_n", "path_s", "host_n", "host_s")
    if levels["sites"] <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    joined = scores.join(sites, F.col("host").eqNullSafe(F.col("of_host")) & F.col("path").eqNullSafe(F.col("of_path")), "left")
    p, g, h, k = F.col("doc_prob"), F.lit(levels["prior"]), F.lit(levels["host_rows"]), F.lit(levels["path_rows"])
    host = (F.col("host_s") - p + h * g) / (F.col("host_n") - 1 + h)
    joined = joined.withColumn("host_prob", F.least(F.greatest(host, F.lit(0.0)), F.lit(1.0)))
    path = (F.col("path_s") - p + k * F.col("host_prob")) / (F.col("path_n") - 1 + k)
    joined = joined.withColumn("path_prob", F.least(F.greatest(path, F.lit(0.0)), F.lit(1.0)))
    odds = _logit(p) - _logit(F.lit(prior)) + _logit(F.col("path_prob"))
    quality = 1 / (1 + F.exp(-odds))
    return joined.drop("of_host", "of_path", "path_n", "path_s", "host_n", "host_s").withColumn("quality", quality).withColumn(
        "accepted", F.col("quality") >= accept
    )


def url_host(url: Column) -> Column:
    """The host of a URL in lower case, without www. and port; empty if there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.\-]*://(?:[^/@?#]*@)?(?:www\.)?([^/:?#]*)", 1)


def url_path(url: Column) -> Column:
    """The first directory of a URL's path, with its slashes; / if there is none."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*(/[^/?#]+/)", 1)
    return F.when(found == "", F.lit("/")).otherwise(found)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host: Column | None = None,
    path: Column | None = None,
    label_col: str = "quality",
    accept: float = ACCEPT,
    columns: list[str] | None = None,
) -> DataFrame:
    """The columns of docs (or those named) with host, path, doc_prob, host_prob, path_prob, quality and accepted.

    host and path say where a document comes from: by default its source, and its language as the path; of a
    table with URLs, url_host() and url_path(). Texts are scored once, into a stored table of these columns.
    Rows come one for one. Nulls: a null text is empty, and is judged by its features (all 0) as any other;
    a null host or path is a site of its own; a null id only cannot have a label. Labels that repeat an id
    count once, as good if any is. Input columns named like the added ones are replaced. An empty table
    gives none; without labels the document model says the same for all.
    """
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = fit_documents(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    added = ("host", "path", "doc_prob", "host_prob", "path_prob", "quality", "accepted")
    kept = [c for c in (docs.columns if columns is None else columns) if c.lower() not in added]
    row = F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    rows = materialize(document_scores(docs, model, text_col=text_col, keep=[row, host.cast("string").alias("host"), path.cast("string").alias("path")]), "quality-scores")
    figures, levels = site_figures(rows)
    return combine(rows, figures, levels, model.prior, accept).select("row.*", *added)


def accepted_documents(docs: DataFrame, labels: DataFrame, **columns) -> DataFrame:
    """The rows of docs that classify() accepts, with the columns of docs."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    held = with_columns_replaced(docs, {"__row": row})
    return classify(held, labels, **columns).where("accepted").select("__row.*")


def op2_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return classify(docs, labels, columns=["doc_id"]).select("doc_id", "host", "path", "doc_prob", "host_prob", "path_prob", "quality", "accepted")
