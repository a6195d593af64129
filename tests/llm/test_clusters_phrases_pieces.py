import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.helpers import empty, odd_documents, text

from plumbline.llm import ball_kmeans, phrases, pieces

MODEL = str(public_tokenizers.path("piece_bpe_32k.model"))


# 11


def plain_kmeans(rows, k, rounds, seed=1, dims=64, scale=64):
    """rows (id, vector): (id, cluster, distance) of those kept, and the centroids, in Python integers."""
    whole = lambda x: scale * int(x) if abs(x) >= 2.0**52 else math.floor(scale * x)
    kept = [r for r in rows if r[1] is not None and len(r[1]) == dims and all(v is not None and math.isfinite(v) for v in r[1])]
    mark = lambda i: hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    kept = [(i, [whole(x) for x in v]) for i, v in sorted(kept, key=lambda r: (mark(r[0]), r[1]))]
    centroids = [v for _, v in kept[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            if members:
                centroids[j] = [sum(c) // len(members) for c in zip(*members)]
    return [(i, *reversed(nearest(v))) for i, v in kept], centroids


def clustered(n, dims, spots, seed, spread=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(spots, dims))
    # one spot has a third of all rows
    at = np.where(rng.random(n) < 1 / 3, 0, rng.integers(spots, size=n))
    return (centres[at] + spread * rng.normal(size=(n, dims))).astype(np.float32).astype(float).tolist()


def check_kmeans(spark, rows, kind="array<float>", **options):
    floats = lambda v: v and [None if x is None else float(x) for x in v]
    df = spark.createDataFrame([(i, floats(v), None, None) for i, v in rows], f"vec_id long, embedding {kind}, cluster string, distance string")
    found, centroids = ball_kmeans.ball_kmeans(df.repartition(3), **options)
    want, want_centroids = plain_kmeans(rows, options.get("clusters", 16), options.get("rounds", 3), dims=options.get("dimensions", 64))
    got = found.collect()
    assert centroids == want_centroids
    key = lambda r: tuple((x is None, x) for x in r)
    fit = lambda d: d if d < 1 << 63 else None
    assert sorted(((r.vec_id, r.cluster, r.distance) for r in got), key=key) == sorted(((i, c, fit(d)) for i, c, d in want), key=key)
    return got


def test_ball_kmeans_compares_only_neighbours(spark):
    rows = list(enumerate(clustered(600, 64, 12, 3)))
    got = check_kmeans(spark, rows, rounds=4)
    assert sum(r.compared for r in got) < 0.5 * 16 * len(got)


def test_ball_kmeans_odd_rows(spark):
    rng = random.Random(5)
    grid = [[float(rng.randrange(3)) / 64 for _ in range(4)] for _ in range(120)]  # many ties and equal vectors
    inf, nan = math.inf, math.nan
    odd = [(None, grid[0]), (None, [9.0, 9, 9, 9]), (7, grid[1]), (7, grid[2]), (500, None), (501, []), (502, [1.0] * 3), (503, [1.0, None, 1, 1]), (504, [nan, 1, 1, 1]), (505, [inf, 1, 1, 1]), (506, [-0.001, 0, 0, -5.3])]
    rows = list(enumerate(grid)) + odd
    check_kmeans(spark, rows, "array<double>", dimensions=4, clusters=9)
    check_kmeans(spark, rows[:5], dimensions=4, clusters=9)
    wide = rows + [(600, [1e30, -1e30, 2.0**60, 1]), (601, [1.7e308, 0, 0, 0]), (602, [3e5, 1, 1, 1])]
    check_kmeans(spark, wide, "array<double>", dimensions=4, clusters=7)
    df = spark.createDataFrame([(i, v and [None if x is None else float(x) for x in v]) for i, v in odd[4:10]], "vec_id long, embedding array<double>")
    found, centroids = ball_kmeans.ball_kmeans(df, dimensions=4)
    assert centroids == [] and found.count() == 0
    assert ball_kmeans.ball_kmeans(empty(spark, df))[0].count() == 0


def test_kmeans_query_equals_plain_rounds(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.vec_id, None if r.embedding is None else list(r.embedding)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want, centroids = plain_kmeans(rows, 16, 3)
    sums = Counter()
    for _, c, d in want:
        sums[c] += d
    mark = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    got = {(r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in ball_kmeans.op11_ball_kmeans(spark, folder).collect()}
    assert got == {(i, c, d, sums[c], sum(sums.values()), mark[c]) for i, c, d in want}


# 12


def plain_collocations(rows, least, best, max_words=4, percent=80):
    lower = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    f, n = Counter(), Counter()
    for lang, body in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (body or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, max_words + 1) for i in range(len(w) - k + 1))
    found = {}
    good = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    for (lang, p), a in good.items():
        cuts = [(2000000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        if not any(g == lang and len(q) > len(p) and inside(q) and 100 * b >= percent * a for (g, q), b in good.items()):
            found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    return {(lang, k, r[2].decode(), *r[3:]) for lang, rows in found.items() for k, r in enumerate(sorted(rows)[:best], 1)}


def phrase_rows(seed, n):
    rng = random.Random(seed)
    words = ["la", "casa", "ñu", "漢字", "The", "the", "x" * 50, "a b", "c\x00d", "😀", "\x1f", "q\x0b"]
    marks = [" ", " ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "! "]
    body = lambda: "".join(rng.choice(words[: rng.choice((2, 5, 12))]) + rng.choice(marks) for _ in range(rng.randrange(40)))
    langs = [None, "", "en", "en", "fr"]
    return [(rng.choice(langs), body()) for _ in range(n)] + [("en", None), (None, ""), ("en", " \t\n. ;"), ("en", "red green blue grey " * 400), ("fr", "Uno dos. " * 50)]


@pytest.mark.parametrize("shard, piece", [(1 << 21, 4 << 20), (300, 200)])
def test_collocations_equal_plain_counts(spark, monkeypatch, shard, piece):
    monkeypatch.setattr(phrases, "SHARD_WORDS", shard)
    monkeypatch.setattr(phrases, "SLICE_BYTES", piece)
    monkeypatch.setattr(phrases, "BATCH_ROWS", 50)
    rows = phrase_rows(1, 300)
    df = spark.createDataFrame([(lang, body, 1, "x") for lang, body in rows], "lang string, text string, f int, phrase string").repartition(3)
    for least, best in ((5, 2000), (3, 7)):
        got = {tuple(r) for r in phrases.collocations(df, min_count=least, best=best).collect()}
        assert got == plain_collocations(rows, least, best)
    three = {tuple(r) for r in phrases.collocations(df, min_count=4, max_words=3, covered_percent=50).collect()}
    assert three == plain_collocations(rows, 4, 2000, 3, 50)


def test_collocations_odd_documents(spark):
    docs = odd_documents(spark)
    assert phrases.collocations(empty(spark, docs)).count() == 0
    rows = [(r.lang, r.text) for r in docs.collect()]
    assert {tuple(r) for r in phrases.collocations(docs, min_count=2).collect()} == plain_collocations(rows, 2, 2000)


def test_filter_of_all_sizes_lets_no_key_slip(spark, monkeypatch):
    monkeypatch.setattr(phrases, "FILTER_BITS", (15, 15))  # nearly full
    rows = phrase_rows(2, 200)
    df = spark.createDataFrame(rows, "lang string, text string")
    assert {tuple(r) for r in phrases.collocations(df, min_count=4).collect()} == plain_collocations(rows, 4, 2000)
    keys = spark.range(0, 40000, 3).toDF("key")
    bitmap = np.frombuffer(phrases._filter(keys, 5), np.uint8)
    assert phrases._passing(np.arange(0, 40000, 3).astype(np.uint64), bitmap).all()
    few = np.frombuffer(phrases._filter(spark.createDataFrame([(0,), (32767,), (-1,)], "key long"), 3), np.uint8)
    assert np.flatnonzero(phrases._passing(np.arange(32768).astype(np.uint64), few)).tolist() == [0, 32767]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.booleans()), max_size=60), st.integers(1, 6))
def test_suffix_array_intervals(words, depth):
    ids = np.array([w for w, _ in words], np.int64)
    new = np.array([b for _, b in words], bool)
    if len(new):
        new[0] = True
    want = Counter()
    for i in range(len(ids)):
        for n in range(1, depth + 1):
            if i + n <= len(ids) and not new[i + 1 : i + n].any():
                want[tuple(ids[i : i + n].tolist())] += 1
    got = {tuple(ids[p : p + n].tolist()): int(c) for n, places, counts in phrases.phrase_counts(ids, new, depth) for p, c in zip(places, counts)}
    assert got == dict(want)


# 13


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


ALPHABET = st.text(st.sampled_from(list("ab the  ▁\n\t.é漢😀\x00<s> 　")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=20), ALPHABET), max_size=8), st.integers(0, 3))
def test_ids_and_texts_equal_the_library(texts, skipped):
    known = pieces.load_pieces(MODEL)
    own = known.model
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    column = pa.array(texts, pa.string()).slice(skipped)
    want = [own.encode(t or "") for t in texts[skipped:]]
    found = pieces.encode(column, known)
    assert found.to_pylist() == want
    assert pieces.decode(found, known).to_pylist() == [own.decode(ids) for ids in want]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 31999), st.sampled_from([0, 1, 2, 13, 230, 259, 28705, 2287])), max_size=12), max_size=6))
def test_any_ids_are_decoded_like_the_library(lists):
    known = pieces.load_pieces(MODEL)
    assert pieces.decode(pa.array(lists, pa.list_(pa.int32())), known).to_pylist() == [known.model.decode(ids) for ids in lists]


def test_a_model_whose_chunks_do_not_stand_alone(model):
    known = pieces.Pieces(MODEL)
    assert known.separable
    known.separable = False
    texts = ["a b ", None, "", " ▁x\n", "a b "]
    found = pieces.encode(pa.array(texts), known)
    assert found.to_pylist() == [model.encode(t or "") for t in texts]
    assert pieces.decode(found, known).to_pylist() == [model.decode(ids) for ids in found.to_pylist()]


@pytest.mark.parametrize("size", [8 << 20, 64])
def test_encoding_odd_documents(spark, model, monkeypatch, size):
    monkeypatch.setattr(pieces, "SLICE_BYTES", size)
    monkeypatch.setattr(pieces, "REMEMBERED_CHUNKS", 50)
    docs = odd_documents(spark)
    done = pieces.decode_documents(pieces.encode_documents(docs))
    assert sorted(done.columns) == sorted(docs.columns)
    got = Counter((r.doc_id, r.text, tuple(r.ids), r.decoded) for r in done.collect())
    assert got == Counter((r.doc_id, r.text, tuple(ids := model.encode(r.text or "")), model.decode(ids)) for r in docs.collect())
    both = pieces.encode_documents(docs, decoded_col="decoded")
    assert Counter((r.doc_id, r.text, tuple(r.ids), r.decoded) for r in both.collect()) == got and both.columns == done.columns
    assert pieces.decode_documents(pieces.encode_documents(empty(spark, docs))).count() == 0
    odd = spark.createDataFrame([(1, None), (2, []), (3, [264, None, 287])], "k int, ids array<int>")
    assert {r.k: r.decoded for r in pieces.decode_documents(odd).collect()} == {1: "", 2: "", 3: "a b"}


def test_pieces_query_equals_the_library(spark, model):
    folder = "/root/testdata/sf0.001"
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.op13_sentencepiece(spark, folder).collect()}
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = set()
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = model.encode(r.text or "")
        want.add((r.doc_id, len(ids), digest(",".join(map(str, ids))), digest(model.decode(ids))))
    assert got == want


def test_long_text_in_one_row(spark, model):
    long_ = text(9, 3000) + "x" * 20000 + "  " * 500
    df = spark.createDataFrame([(1, long_)], "doc_id long, text string")
    assert pieces.encode_documents(df).first()["ids"] == model.encode(long_)
