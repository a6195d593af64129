import gzip
import hashlib
import json
import math
import random
import re
import zlib
from datetime import datetime
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import SMALL, same_rows
from llm.helpers import components, empty, odd_documents, text
from pyspark.sql import functions as F

from plumbline.llm import edit_join, exact_stream, itq, lines, mixing, packing, passages, pii, quality, queries, resemblance, simhash, tables, warc
from plumbline.llm.components import connected_components

SPACE = re.compile(r"[\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, oracle, name):
    same_rows(queries.QUERIES[name](spark, SMALL), oracle, queries.ORACLE_SQL[name])


def test_connected_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(70)] + [(5, 5), (None, 4)]
    df = spark.createDataFrame(links, "u long, v long")
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = components(real, {x for link in real for x in link})
    assert {r.node: r.component for r in connected_components(df).collect()} == want
    assert connected_components(df.limit(0)).count() == 0


# 1


def test_mixing(spark):
    docs = odd_documents(spark)
    rows = mixing.mix_sources(docs, weights={"a": 3.0, "b": 1.0}, total_rows=4000).collect()
    share = Counter(r.source for r in rows)
    assert set(share) == {"a", "b"} and abs(len(rows) - 4000) < 400 and 0.7 < share["a"] / len(rows) < 0.8
    copies = defaultdict(set)
    for r in rows:
        copies[r.doc_id, r.text].add(r.copy_no)
    assert all(c == set(range(max(c) + 1)) for c in copies.values())
    keys = [r.shuffle_key for r in rows]
    again = mixing.mix_sources(docs.repartition(5), weights={"a": 3.0, "b": 1.0}, total_rows=4000).collect()
    assert sorted(keys) == sorted(r.shuffle_key for r in again)
    assert mixing.mix_sources(empty(spark, docs)).count() == 0
    nameless = spark.range(2000).select(F.lit(None).cast("long").alias("doc_id"), F.col("id").cast("string").alias("text"), F.lit("a").alias("source"), F.create_map(F.lit(1), F.lit(2)).alias("m"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for_each = mixing.mix_sources(nameless, total_rows=16_000).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(for_each) > 1 and max(r["count"] for r in for_each) < 0.6 * sum(r["count"] for r in for_each)
    assert mixing.mix_sources(docs.where("source IS NULL")).select("source").distinct().count() <= 1


def test_poisson_distribution(spark):
    means = [0.05, 1.0, 7.5, 40.0]
    df = spark.createDataFrame([(m,) for m in means], "m double").select("m", mixing.poisson_cdf(F.col("m")).alias("c"))
    for r in df.collect():
        exact = np.cumsum([math.exp(k * math.log(r.m) - r.m - math.lgamma(k + 1)) for k in range(len(r.c))])
        assert np.allclose(r.c, exact, atol=1e-12) and 1 - r.c[-1] < 1e-9


# 2


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    done = quality.classify(docs, labels.where("doc_id % 2 = 0"))
    held = done.select("doc_id", "accepted").join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("quality").alias("good")), "doc_id").collect()
    assert len(held) > 150 and sum(r.accepted == (r.good == 1) for r in held) / len(held) > 0.95
    assert done.count() == docs.count()


def test_quality_shrinks_sparse_sites(spark):
    rows = [("big", "p", 0.9)] * 200 + [("bad", "p", 0.1)] * 200 + [("new", "p", 0.5)] + [("big", "odd", 0.2)] * 3
    scores = spark.createDataFrame(rows, "host string, path string, doc_prob double")
    figures, levels = quality.site_figures(scores)
    out = {(r.host, r.path): r for r in quality.combine(scores, figures, levels, 0.5).collect()}
    prior = sum(r[2] for r in rows) / len(rows)
    assert abs(levels["prior"] - prior) < 1e-9
    # a site with one document says nothing of it beyond the levels above
    assert abs(out["new", "p"].host_prob - prior) < 1e-6 and abs(out["new", "p"].path_prob - out["new", "p"].host_prob) < 1e-6
    assert out["big", "p"].path_prob > 0.8 > out["big", "odd"].path_prob > 0.2
    assert out["bad", "p"].path_prob < 0.2
    host = (figures.where("host = 'big' AND path = 'p'").first().host_s - 0.9 + levels["host_rows"] * prior) / (202 + levels["host_rows"])
    assert abs(out["big", "p"].host_prob - host) < 1e-9


def test_quality_of_pages_by_host_and_directory(spark):
    """Posteriors of sites from URLs, most of them with a page or two, against plain Python."""
    urls = {"http://www.A.com:80/x/1": ("a.com", "/x/"), "https://u@a.com/x/2?q": ("a.com", "/x/"), "http://a.com/y.html": ("a.com", "/"), "ftp://b.org": ("b.org", "/"), "junk": ("", "/"), None: ("", "/")}
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: (r.h, r.p) for r in df.select("url", quality.url_host(F.col("url")).alias("h"), quality.url_path(F.col("url")).alias("p")).collect()} == urls
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id < 400")
    labels = pages.selectExpr("page_id", "cast(length(html) % 3 > 0 as int) quality").where("page_id % 2 = 0")
    done = quality.classify(pages, labels, id_col="page_id", text_col="html", host=quality.url_host(F.col("url")), path=quality.url_path(F.col("url")), columns=["page_id"])
    rows = done.collect()
    assert len({(r.host, r.path) for r in rows}) > 40
    sums = defaultdict(lambda: np.zeros(3))
    for r in rows:
        for key in ((), (r.host,), (r.host, r.path)):
            sums[key] += (1, r.doc_prob, r.doc_prob**2)
    prior = sums[()][1] / sums[()][0]

    def strength(length, up):
        groups = [(v, up(k)) for k, v in sums.items() if len(k) == length]
        n, k = sum(v[0] for v, _ in groups), len(groups)
        within, between = (sum(f(v, u) for v, u in groups) for f in (lambda v, u: v[2] - v[1] ** 2 / v[0], lambda v, u: v[0] * (v[1] / v[0] - u) ** 2))
        chance = max(within, 0) / (n - k)
        spread = (between - (k - 1) * chance) / max(n - sum(v[0] ** 2 for v, _ in groups) / n, 1e-9)
        return min(max(chance / spread, 1.0), quality.MAX_PRIOR_ROWS) if spread > 0 else quality.MAX_PRIOR_ROWS

    hosts = strength(1, lambda k: prior)
    paths = strength(2, lambda k: (sums[k[:1]][1] + hosts * prior) / (sums[k[:1]][0] + hosts))
    for r in rows:
        n, s, _ = sums[r.host,]
        host = (s - r.doc_prob + hosts * prior) / (n - 1 + hosts)
        n, s, _ = sums[r.host, r.path]
        path = (s - r.doc_prob + paths * host) / (n - 1 + paths)
        assert abs(r.host_prob - min(max(host, 0), 1)) < 1e-6 and abs(r.path_prob - min(max(path, 0), 1)) < 1e-6


def test_quality_of_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(1, 1), (4, 0), (4, 1), (None, 1), (8, None)], "doc_id long, quality int")
    done = quality.classify(docs, labels)
    assert done.count() == docs.count() and done.where("quality IS NULL OR accepted IS NULL").count() == 0
    assert quality.classify(empty(spark, docs), labels).count() == 0
    assert quality.classify(docs, empty(spark, labels)).select("doc_prob").distinct().count() == 1
    kept = quality.accepted_documents(docs, labels)
    assert kept.columns == docs.columns


# 3


def check_packing(rows, lengths):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id, r.doc_tokens].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    assert sum(r.length for r in rows) == lengths
    return len(by_sequence)


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = odd_documents(spark).unionByName(spark.createDataFrame([(20, "a <|endoftext|> b  c\n\n d'll 12x"), (21, text(3, 900))], "doc_id long, text string"), allowMissingColumns=True)
    rows = packing.pack_documents(docs).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    total = 0
    for d in docs.collect():
        ids = [*whole.encode(d.text or "", add_special_tokens=False).ids, 1]
        total += len(ids)
        for at in range(0, len(ids), 2048):
            part = np.array(ids[at : at + 2048], "<u4").tobytes()
            want[d.doc_id, at, len(part) // 4, zlib.crc32(part), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == want
    check_packing(rows, total)
    assert packing.pack_documents(empty(spark, docs)).count() == 0


def test_packing_pads_little(spark):
    rows = packing.op3_packing(spark, "/root/testdata/sf0.01").collect()
    total = sum(r.length for r in rows)
    assert check_packing(rows, total) <= 1.02 * total / 2048 + 1


@pytest.mark.parametrize("length", [2, 9, 17, 33, 100])
def test_packing_of_pieces_of_one_length(spark, length):
    df = spark.range(20_000).selectExpr("id doc_id", "0L start", f"{length}L length", "0L ids_crc32", f"{length}L doc_tokens")
    rows = packing.assign_sequences(tables.materialize(df, "pieces")).collect()
    assert check_packing(rows, 20_000 * length) == -(-20_000 // (2048 // length))


@pytest.mark.parametrize("lengths", [[700], [1025], [1100], [1500], [1100, 1100, 1100, 40], list(range(1030, 1400))])
def test_packing_cuts_where_much_room_is_left(spark, lengths):
    n = 20_000 if len(lengths) == 1 else 6_000
    length = F.element_at(F.lit(lengths), (F.col("id") % len(lengths) + 1).cast("int")).cast("long")
    df = spark.range(n).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("start"), length.alias("length"), F.lit(0).cast("long").alias("ids_crc32"), length.alias("doc_tokens"))
    ids = F.transform(F.sequence(F.lit(0).cast("long"), F.col("length") - 1), lambda i: ((F.col("doc_id") * 7 + i) % 50_000).cast("int"))
    done = packing.assign_sequences(tables.materialize(df.withColumn("ids", ids), "pieces"))
    rows = done.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset").collect()
    total = sum(r.doc_tokens for r in rows if r.start == 0)
    used = check_packing(rows, total)
    assert used <= 1.02 * total / 2048 + 1 and sorted({r.sequence_id for r in rows}) == list(range(used))
    by_doc = defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append((r.start, r.length))
    for parts in by_doc.values():
        assert [a for a, _ in sorted(parts)][1:] == [a + n for a, n in sorted(parts)][:-1]  # each id in one piece
    assert len(by_doc) == n
    some = done.where("doc_id % 40 = 0").collect()
    for r in some:
        want = [(r.doc_id * 7 + i) % 50_000 for i in range(r.start, r.start + r.length)]
        assert r.ids == want
        assert r.ids_crc32 in (0, zlib.crc32(np.array(want, "<u4").tobytes()))  # zero as given, of pieces that stay whole
        assert r.ids_crc32 or (r.start == 0 and r.length == r.doc_tokens)


def test_packing_of_texts_that_leave_much_room(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([(k, text(k, 1000)) for k in range(60)], "doc_id long, text string")
    rows = packing.pack_documents(docs).collect()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {d.doc_id: [*whole.encode(d.text, add_special_tokens=False).ids, 1] for d in docs.collect()}
    total = sum(map(len, ids.values()))
    assert check_packing(rows, total) <= 1.02 * total / 2048 + 2
    for r in rows:
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())


def test_length_classes_round_up_little():
    lengths = np.arange(1, 2049)
    counts = np.random.default_rng(2).integers(1, 300, 2048)
    kept = packing.length_classes(lengths, counts)
    rounded = kept[np.searchsorted(kept, lengths)]
    assert len(kept) == packing.LENGTH_CLASSES and (rounded >= lengths).all() and kept[-1] == 2048
    assert (counts @ rounded) <= 1.01 * (counts @ lengths)


def test_cutting_stock_covers_the_demand():
    rng = np.random.default_rng(1)
    sizes = np.unique(rng.integers(1, 100, 60))  # all fill up well: the bound is near the sum of sizes
    demand = rng.integers(1, 500, len(sizes))
    patterns, times = packing.cutting_stock(sizes, demand, 256)
    assert (patterns.T @ times == demand).all() and (patterns @ sizes <= 256).all()
    assert times.sum() <= 1.02 * (sizes @ demand) / 256 + len(sizes)


# 4


def plain_fingerprint(value, width):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in value or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_groups(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").unionByName(odd_documents(spark).where("doc_id IS NOT NULL").select(F.col("doc_id") + 10000, "text").toDF("doc_id", "text"))
    rows = docs.collect()
    fp = [(r.doc_id, plain_fingerprint(r.text, 3)) for r in rows]
    links = [(a, b) for i, (a, x) in enumerate(fp) for b, y in fp[:i] if (x ^ y).bit_count() <= 3]
    want = components(links, {a for a, _ in fp})
    got = simhash.simhash_groups(docs).collect()
    assert sorted((r.doc_id, r.fingerprint) for r in got) == sorted((a, f"{x:016x}") for a, x in fp)
    assert {r.doc_id: r.component_id for r in got} == want


def test_simhash_links_all_near_fingerprints(spark):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(120)]
    values = set(base)
    for b in base:
        for n in (1, 2, 3, 4):
            x = b
            for bit in rng.sample(range(64), n):
                x ^= 1 << bit
            values.add(x)
    values = sorted(values)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(v), k) for k, v in enumerate(values)], "fp long, rep long")
    want = {(j, i) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3}
    assert {tuple(sorted((r.u, r.v))) for r in simhash.link_fingerprints(df).collect()} == want


def test_simhash_splits_crowded_keys(spark):
    """Fingerprints equal in two of the three segments, and some near each other in all three, under very full keys."""
    rng = random.Random(31)
    fps = set()
    for free in range(3):
        at, bits = simhash.SEGMENTS[free]
        base = rng.getrandbits(64) & ~(((1 << bits) - 1) << at)
        for _ in range(350):
            value = base | (rng.getrandbits(min(bits, 12)) << at)
            fps |= {value, value ^ (1 << rng.randrange(64))} if rng.random() < 0.2 else {value}
    base = rng.getrandbits(64)
    for _ in range(400):  # one bit in each segment
        fps.add(base ^ sum(1 << (at + rng.randrange(bits)) for at, bits in simhash.SEGMENTS))
    fps = sorted(f - (1 << 64) if f >> 63 else f for f in fps)
    df = spark.createDataFrame([(f, k) for k, f in enumerate(fps)], "fp long, rep long")
    got = {tuple(sorted((r.u, r.v))) for r in simhash.link_fingerprints(df).collect()}
    a = np.array(fps, np.int64)
    near = np.bitwise_count((a[:, None] ^ a[None, :]).view(np.uint64)) <= 3
    assert got == {(int(x), int(y)) for x, y in zip(*np.nonzero(near), strict=True) if x < y}


def test_simhash_pairs_of_a_crowded_key_stay_few(spark):
    at, _ = simhash.SEGMENTS[0]
    free = np.random.default_rng(4).choice(1 << 23, 20_000, replace=False)
    df = spark.createDataFrame([(int(f) << at | 5 << 60, k) for k, f in enumerate(free)], "fp long, rep long")
    split = lambda probing: simhash._split(simhash._keyed(df, probing)).select("key", "part")
    sizes = [split(p).groupBy("key", "part").count().toDF("key", "part", f"n{p:d}") for p in (False, True)]
    pairs = sizes[0].join(sizes[1], ["key", "part"]).selectExpr("sum(n0 * n1) n").first().n
    assert pairs < 810_000_000 / 20  # unsplit keys make as many


def test_simhash_keeps_one_of_each_group(spark):
    docs = odd_documents(spark)
    kept = simhash.keep_first_of_groups(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 in ids and 4 not in ids and 5 not in ids and {9, 10} <= set(ids) and 11 not in ids
    assert simhash.simhash_groups(empty(spark, docs)).count() == 0


def test_near_duplicate_stage_finds_all_similar_documents(spark):
    import corpus_pipeline

    rng = random.Random(21)
    texts = [(k, text(900 + k, n)) for k, n in enumerate([1, 3, 6, 20, 60, 61, 200, 200, 900])]
    for k in range(240):  # words replaced, so that similarities lie on both sides of 0.8
        words = rng.choice(texts)[1].split()
        for _ in range(rng.randrange(1, 2 + len(words) // 40)):
            words[rng.randrange(len(words))] = f"x{k}"
        texts.append((1000 + k, " ".join(words)))
    sets = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for k, t in texts for w in [t.split()]}
    fp = {k: plain_fingerprint(t, 5) for k, t in texts}
    links = [
        (a, b) for a in sets for b in sets
        if a < b and (5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) or (fp[a] ^ fp[b]).bit_count() <= 3)
    ]
    want = {k for k, c in components(links, sets).items() if k == c}
    got = corpus_pipeline.simhash(spark, spark.createDataFrame(texts, "doc_id long, text string"), SMALL)
    assert {r.doc_id for r in got.collect()} == want


def boilerplate_pages(n, paragraphs=40, seed=8):
    """Pages of three of a few shared paragraphs, every tenth a near copy of an earlier one."""
    rng = random.Random(seed)
    shared = [text(5000 + k, 50) for k in range(paragraphs)]
    pages = []
    for k in range(n):
        if k % 10 == 9:
            words = rng.choice(pages)[1].split()
            words[rng.randrange(len(words))] = f"x{k}"
            pages.append((k, " ".join(words)))
        else:
            pages.append((k, " ".join(rng.sample(shared, 3))))
    return pages


@pytest.mark.parametrize("crowded", [4])
def test_crowded_buckets_are_split_without_loss(spark, monkeypatch, crowded):
    monkeypatch.setattr(resemblance, "CROWDED", crowded)
    monkeypatch.setattr(resemblance, "SPLITS", 2)
    monkeypatch.setattr(resemblance, "LEADER_ROWS", 20)
    pages = boilerplate_pages(400, paragraphs=9)
    pages += [(1000 + k, text(77, 170) + " " + text(6000 + k, 30)) for k in range(60)]  # one passage, tails of their own
    pages += [(2000 + k, text(78, 90 + k)) for k in range(60)]  # lengths apart
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in pages for w in [t.split()]}
    fp = {k: plain_fingerprint(t, 5) for k, t in pages}
    similar = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    links = [(a, b) for a in sets for b in sets if a < b and (similar(a, b) or (fp[a] ^ fp[b]).bit_count() <= 3)]
    want = {k for k, c in components(links, sets).items() if k == c}
    got = resemblance.keep_first_of_similar(spark.createDataFrame(pages, "doc_id long, text string"))
    assert {r.doc_id for r in got.collect()} == want


def test_pairs_of_pages_with_shared_paragraphs_grow_with_the_pages(spark, monkeypatch):
    met = []
    apart = resemblance._apart

    def counted(*a):
        pairs = apart(*a)
        met.append(pairs.distinct().count())
        return pairs

    monkeypatch.setattr(resemblance, "_apart", counted)
    monkeypatch.setattr(resemblance, "CROWDED", 32)  # buckets of so few pages are above it
    monkeypatch.setattr(resemblance, "SPLITS", 2)
    for n in (1000, 2000):
        resemblance.keep_first_of_similar(spark.createDataFrame(boilerplate_pages(n), "doc_id long, text string")).count()
    few, more = met
    assert more < 2.5 * few  # without splits they grow with the square of the pages


# 5


def test_embedding_groups(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(60, 32))
    vectors = [(k, v.tolist()) for k, v in enumerate(base)]
    vectors += [(100 + k, (base[k % 20] + rng.normal(size=32) * 0.04).tolist()) for k in range(120)] + [(300 + k, base[3].tolist()) for k in range(40)]
    vectors += [(400, None), (401, [0.0] * 32), (402, [float("nan")] * 32), (403, [None, *[1.0] * 31]), (404, [1.0, 2.0]), (405, [float("inf")] * 32), (406, [])]
    vectors += [(500, [1.0, 2.0]), (501, [1.0, 2.01]), (502, [-1.0, 2.0]), (503, [1e200, 2e200]), (504, [1e-300, 2e-300]), (505, [3.0])]
    df = spark.createDataFrame([(*v, 1, "x") for v in vectors], "vec_id long, embedding array<double>, label int, rep string")
    rows = {r.vec_id: r for r in itq.embedding_groups(df).collect()}
    sound = [(k, np.array(v)) for k, v in vectors if k < 400]
    unit = {k: v / np.linalg.norm(v) for k, v in sound}
    links = [(a, b) for i, (a, _) in enumerate(sound) for b, _ in sound[:i] if unit[a] @ unit[b] >= 0.95]
    found = Counter(x for link in links for x in link)
    recall = sum(rows[k].n_links for k, _ in sound) / sum(found.values())
    assert 0.9 <= recall <= 1 and all(rows[k].n_links <= found[k] for k, _ in sound)
    assert {k: (rows[k].n_links, rows[k].component_id) for k in range(500, 506)} == {500: (4, 404), 501: (4, 404), 502: (0, 502), 503: (4, 404), 504: (4, 404), 505: (0, 505)}
    assert (rows[404].n_links, rows[404].component_id) == (4, 404)
    for k in (400, 401, 402, 403, 405, 406):
        assert rows[k].n_links == 0 and rows[k].component_id == k and rows[k].kept
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows.values())
    assert all(rows[300 + k].component_id == rows[3].component_id for k in range(40))
    assert itq.embedding_groups(empty(spark, df)).count() == 0


def test_embedding_recall_on_the_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    got = {r.vec_id: r.n_links for r in itq.op5_itq(spark, "/root/testdata/sf0.01").collect()}
    pdf = table.toPandas()
    m = np.stack(pdf.embedding.map(lambda v: np.array(v, float)))
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    want = dict(zip(pdf.vec_id, ((unit @ unit.T) >= 0.95).sum(axis=1) - 1, strict=True))
    assert sum(got.values()) >= 0.9 * sum(want.values()) and all(got[k] <= want[k] for k in got)


@pytest.mark.parametrize("rows", [1 << 12, 1 << 17, 1 << 22])
def test_embedding_recall_at_every_size(spark, monkeypatch, rows):
    cut = itq.substrings
    monkeypatch.setattr(itq, "substrings", lambda bits, _: cut(bits, rows))
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=(2, 500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(axis=1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    cosine = rng.uniform(0.951, 0.96, (500, 1))
    y = cosine * x + np.sqrt(1 - cosine**2) * z
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.concatenate([x, y]))], "vec_id long, embedding array<double>")
    got = [r.n_links for r in itq.embedding_groups(df).collect()]
    assert 0.9 * 1000 <= sum(got) <= 1000


@pytest.mark.parametrize("threshold", [0.95, 0.8])
def test_codes_of_linked_pairs_are_within_the_radius(spark, threshold):
    assert itq.code_radius(0.95) == 16 and itq.code_radius(0.8) > 20
    rng = np.random.default_rng(11)
    a = itq.unit_vectors(rng.normal(size=(400, 64)))
    side = itq.unit_vectors(rng.normal(size=(400, 64)))
    side = itq.unit_vectors(side - (side * a).sum(axis=1, keepdims=True) * a)
    b = (threshold + 0.002) * a + np.sqrt(1 - (threshold + 0.002) ** 2) * side
    rows = [(k, v.tolist()) for k, v in enumerate(np.concatenate([a, b]))]
    done = itq.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), threshold=threshold).collect()
    of = {r.vec_id: r.component_id for r in done}
    assert sum(of[k] == of[k + 400] for k in range(400)) >= 0.9 * 400


# 6

PRIVATE = (
    "Dear Mr. John Smith and Mrs. Jane Smith, also Mr. Smith; г-н Иван Петров, г-жа Анна Петрова wrote. Call (415) 555-1234 or +1 (415) 555-1234. "
    "Card 4111 1111 1111 1111 and 4111-1111-1111-1111, SSN 123-45-6789. Mail A.B@X.COM or a.b@x.com, c.d@x.com. DE89 3704 0044 0532 0130 00, 10.0.0.1, "
    "0123456789abcdef0123456789abcdef01234567. Version 1.2.3 of 2024-05-01, 42 and 1234567 stay."
)


MORE = (
    "Dr. Paula Weber met Prof. Weber; Weber and WEBER agree, Paula too, Weberin not. 2001:db8::ff00:42:8329 or fe80:0:0:0:1:2:3:4. "
    "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abcDEF123_-xyz. Born on 12.03.1985, DOB: 1985-03-12. Passport no. C01234567. "
    "12 Long Oak Street, Hauptstraße 12. de89 3704 0044 0532 0130 00. г-н Петров и Петрова, 12:30 at 1.2.2024"
)


def test_more_surrogates(spark):
    text_ = pii.replace_entities(spark.createDataFrame([(1, MORE)], "doc_id long, text string")).first().text
    m = re.fullmatch(
        r"Dr\. (\S+) (\S+) met Prof\. (\S+); (\S+) and (\S+) agree, (\S+) too, Weberin not\. ([0-9a-f:]+) or ([0-9a-f:]+)\. "
        r"(eyJ[\w\-]+\.[\w\-]+\.[\w\-]+)\. Born on (\d\d\.\d\d\.\d{4}), DOB: (\d{4}-\d\d-\d\d)\. Passport no\. ([A-Z]\d{8})\. "
        r"(\d\d [A-Z]\w+ [A-Z]\w+ Street), ([A-Z]\w+straße \d\d)\. ([a-z]{2}\d\d(?: \d{4}){4} \d\d)\. г-н (\S+) и (\S+), 12:30 at 1\.2\.2024", text_)  # fmt: skip
    assert m, text_
    g = m.groups()
    assert g[1] == g[2] == g[3] == g[4].title() and g[0] == g[5] and g[4].isupper() and g[16] == g[15] + "а"
    assert not {x.strip(".,;") for x in MORE.split()} & {x for k in (0, 1, 6, 7, 8, 9, 10, 11, 15, 16) for x in [g[k]]}
    assert [len(a) for a in g[6].split(":")] == [len(a) for a in "2001:db8::ff00:42:8329".split(":")]
    datetime.strptime(g[9], "%d.%m.%Y"), datetime.strptime(g[9], "%m.%d.%Y"), datetime.strptime(g[10], "%Y-%m-%d")
    bban = g[14].replace(" ", "")
    assert g[14][:2] == "de" and int("".join(str(int(c, 36)) for c in bban[4:] + bban[:4])) % 97 == 1
    for private in ("Paula", "Weber ", "db8", "fe80", "1985", "C0123", "Long Oak", "Haupt", "3704", "Петров"):
        assert private not in text_


def test_surrogates(spark):
    docs = odd_documents(spark).unionByName(spark.createDataFrame([(50, PRIVATE), (51, PRIVATE), (51, PRIVATE), (52, "Smith a.b@x.com, Mr. Smith"), (53, "Smith wins"), (54, MORE)], "doc_id long, text string"), allowMissingColumns=True)
    done = pii.replace_entities(docs)
    assert set(done.columns) == set(docs.columns) and done.count() == docs.count()
    rows = done.where("doc_id IN (50, 51)").collect()
    new = rows[0].text
    assert len({r.text for r in rows}) == 1 and rows[0].n_replaced == 16
    for private in ("John", "Jane", "Иван", "Анна", "Петров", "415", "555-1234", "4111", "123-45", "A.B@", "a.b@", "c.d@", "3704", "10.0.0.1", "0123456789abcdef"):
        assert private not in new.replace("1234567 stay", "")
    assert new.endswith("Version 1.2.3 of 2024-05-01, 42 and 1234567 stay.")
    m = re.match(r"Dear Mr\. (\S+) (\S+) and Mrs\. (\S+) (\S+), also Mr\. (\S+); г-н (\S+) (\S+), г-жа (\S+) (\S+) wrote\. Call (\(\d{3}\) \d{3}-\d{4}) or (\+1 \(\d{3}\) \d{3}-\d{4})\. "
                 r"Card (\d{4} \d{4} \d{4} \d{4}) and (\d{4}-\d{4}-\d{4}-\d{4}), SSN (\d{3}-\d{2}-\d{4})\. Mail (\S+) or (\S+), (\S+)\. (DE\d\d(?: \d{4}){4} \d\d), (\d+(?:\.\d+){3}), ([0-9a-f]{40})\.", new)  # fmt: skip
    assert m, new
    g = m.groups()
    ends = lambda name, kind, script: name.endswith(tuple(pii.ENDINGS[kind, script])) and name.startswith(tuple(pii.BEGINNINGS[script]))
    assert ends(g[0], "male", "latin") and ends(g[2], "female", "latin") and g[1] == g[3] == g[4]
    assert ends(g[5], "male", "cyrillic") and ends(g[7], "female", "cyrillic") and g[8] == g[6] + "а"
    bban = (g[17][4:] + g[17][:4]).replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in bban)) % 97 == 1
    assert g[11].replace(" ", "") == g[12].replace("-", "")
    luhn = lambda s: sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(int(c) for c in reversed(s))) % 10
    assert luhn(g[11].replace(" ", "")) == 0
    assert g[14].lower() == g[15] and g[14].isupper() and g[15].split("@")[1] == g[16].split("@")[1] and g[15] != g[16]
    other = done.where("doc_id = 52").first().text
    assert other == f"{g[4]} {g[15]}, Mr. {g[4]}" and done.where("doc_id = 53").first().text == "Smith wins"
    odd = {r.doc_id: r for r in done.where("doc_id IN (3, 4, 9)").collect()}
    assert odd[3].text is None and odd[4].text == "" and odd[9].n_replaced == 0
    assert pii.replace_entities(empty(spark, docs)).count() == 0


NAMES = [
    "Mr. John Ronald Smith came.", "Mr. McDonald and O'Brien, Mr. O'Brien; McDonald's farm.", "Dr. von Braun, Dr. Wernher von Braun; Braun.", "Mr. JOHN SMITH, John Smith.",
    "Mr. Li met Ms. Wu. Li and Wu left, LIfe stays.", "Mr. Smith-Jones and Mrs. Smith-Jones; Jones.", "Mrs. Paula May; Paula was warm in May.", "Mr. Will Long: Will he go? Long ago.",
    "Prof. J. Smith wrote.", "Sra. María del Carmen García; García.", "г-н Иван Петров, ПЕТРОВ.", "Call 07911 123456.",
]


def test_names_of_all_forms(spark):
    rows = spark.createDataFrame(list(enumerate(NAMES)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.replace_entities(rows).collect()}
    shapes = [
        r"Mr\. (\S+) (\S+) (\S+) came\.", r"Mr\. (\S+) and (\S+), Mr\. (\S+); (\S+)'s farm\.", r"Dr\. von (\S+), Dr\. (\S+) von (\S+); (\S+)\.", r"Mr\. ([A-Z]+) ([A-Z]+), (\S+) (\S+)\.",
        r"Mr\. (\S+) met Ms\. (\S+)\. (\S+) and (\S+) left, LIfe stays\.", r"Mr\. (\S+)-(\S+) and Mrs\. (\S+)-(\S+); (\S+)\.", r"Mrs\. (\S+) (\S+); (\S+) was warm in May\.",
        r"Mr\. (\S+) (\S+): Will he go\? Long ago\.", r"Prof\. ([A-Z])\. (\S+) wrote\.", r"Sra\. (\S+) del (\S+) (\S+); (\S+)\.", r"г-н (\S+) (\S+), ([А-ЯЁ]+)\.", r"Call (0\d{4} \d{6})\.",
    ]
    parts = {}
    for k, (shape, old) in enumerate(zip(shapes, NAMES, strict=True)):
        m = re.fullmatch(shape, got[k])
        assert m, got[k]
        before = re.fullmatch(shape, old)
        parts[k] = m.groups()
        # the mapping as plain Python sees it: the same word in a text has the same surrogate, whatever its case
        words = {}
        for a, b in zip(before.groups(), m.groups(), strict=True):
            assert a != b or len(a) == 1 and k == 8, got[k]
            assert words.setdefault(a.lower(), b.lower()) == b.lower()
            assert (len(a) > 1 and a.isupper()) == (len(b) > 1 and b.isupper())
        assert len(set(words.values())) == len(words)
    # over all texts too: Smith of the family is one
    assert parts[0][2] == parts[3][3] == parts[8][1] == parts[5][0]


def test_surrogates_are_distinct(spark):
    """All ten addresses of a format, so that most of its surrogates are taken."""
    found = [("email", f"{k}@x.y") for k in range(10)] + [("family", f"Name{k}") for k in range(150)] + [("given-female", f"Name{k}") for k in range(30)]
    rows = pii.assign_surrogates(spark.createDataFrame(found, "kind string, value string")).collect()
    assert sorted((r.kind, r.value) for r in rows) == sorted(found)
    made = [(r.kind.split("-")[0], r.surrogate.lower()) for r in rows]
    assert len(set(made)) == len(made) and not set(made) & {(k.split("-")[0], v.lower()) for k, v in found}


# 7


def plain_passages(rows, window):
    words = [[w for w in SPACE.split(t or "") if w] for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("window", [35, 6])
def test_passages(spark, window):
    rng = random.Random(window)
    shared = [text(100 + k, 50) for k in range(3)]
    rows = [(r.doc_id, r.text) for r in odd_documents(spark).collect()]
    rows += [(100 + k, f"{text(k, rng.randrange(90))} {rng.choice(shared)} {text(900 + k, rng.randrange(90))}") for k in range(60)]
    rows += [(200, "la " * 40), (201, text(3, 34)), (202, text(3, 34)), (203, text(4, 35)), (204, text(4, 35)), (205, " ".join([text(6, 36)] * 2))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n_words int").repartition(3)
    got = passages.repeated_passages(df, window=window).collect()
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got], key=order) == sorted(plain_passages(rows, window), key=order)
    assert all(sum(s.length for s in r.spans) == r.n_removed for r in got)
    assert passages.repeated_passages(df.limit(0)).count() == 0


# 8


def test_exact_stream(spark):
    docs = odd_documents(spark).select("doc_id", "text", "source")
    docs = docs.unionByName(spark.createDataFrame([(None, "nobody's", None), (None, "nobody's", "b"), (900, "twice", "a"), (900, "twice", "b"), (901, "twice", "c")], docs.schema))
    path = tables.new_path(spark, "exact-in")
    docs.where("doc_id < 8").write.parquet(path)
    folder = tables.new_path(spark, "exact-state")
    exact_stream.deduplicate_table(spark, path, folder=folder).count()
    docs.where("doc_id >= 8 OR doc_id IS NULL").write.mode("append").parquet(path)
    for digits in (64, 1):  # with one digit nearly all texts collide, so that the check of bytes decides
        where = folder if digits == 64 else None
        got = exact_stream.deduplicate_table(spark, path, folder=where, hex_digits=digits, files_per_trigger=1).collect()
        norm = [(r.doc_id, SPACE.sub(" ", r.text or "")) for r in docs.collect()]
        groups = defaultdict(list)
        for doc, t in norm:
            groups[t].append(doc)
        keep = {t: min((d for d in ids if d is not None), default=None) for t, ids in groups.items()}
        want = Counter()
        for t, ids in groups.items():  # one row of a group stays, of those without an id too
            for k, d in enumerate(sorted(ids, key=lambda d: (d is None, d))):
                want[d, keep[t], len(ids), k == 0, hashlib.sha256(t.encode()).hexdigest()] += 1
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got) == want


def test_exact_of_an_empty_table(spark):
    path = tables.new_path(spark, "exact-empty")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    assert exact_stream.deduplicate_table(spark, path).count() == 0


# 9


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_lines(rows, edits=1):
    first = {}
    parsed = []
    for doc, t in rows:
        for no, raw in enumerate(t.split("\n") if t is not None else []):
            norm = SPACE.sub(" ", raw).strip(" ").lower()
            norm = norm or None
            parsed.append((doc, t, no, raw, norm))
            if norm:
                place = (-1 if doc is None else doc, no)
                first[norm] = min(first.get(norm, place), place)
    keys = sorted(k for k in first if len(k) >= lines.MIN_CHARS)
    near = {a for a in keys if any(first[b] < first[a] and abs(len(a) - len(b)) <= edits and 0 < edit_distance(a, b) <= edits for b in keys)}
    out = []
    for doc, t in rows:
        own = [p for p in parsed if p[0] == doc and p[1] == t] if t is not None else []
        own = list({p[2]: p for p in own}.values())
        kept = [p for p in own if not (p[4] and (p[4] in near or first[p[4]] != (-1 if doc is None else doc, p[2])))]
        out.append((doc, "\n".join(p[3] for p in kept) if t is not None else None, len(own) - len(kept)))
    return out


def test_lines(spark):
    rng = random.Random(4)
    base = ["the quick brown fox jumps over", "Straße und ñandú über allem 漢字", "a" * 40, text(1, 40)]
    rows = [(r.doc_id, r.text) for r in odd_documents(spark).collect()]

    def edited(line):
        at = rng.randrange(len(line))
        return rng.choice([line[:at] + rng.choice("xyz") + line[at:], line[:at] + line[at + 1 :], line[:at] + rng.choice("xyz") + line[at + 1 :], line, line.upper(), f" {line}\t "])

    for k in range(150):  # many near lines of few, so that buckets are large and are split
        own = [edited(rng.choice(base)) for _ in range(rng.randrange(1, 4))] + ([edited(edited(base[0]))] if k % 3 == 0 else [])
        rows.append((100 + k, "\n".join([*own, "short", "", rng.choice(["All rights reserved", "All rights reserve"]), text(700 + k, 8)])))
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, emptied int, row_a string")
    got = lines.deduplicate_lines(df).collect()
    order = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted([(r.doc_id, r.text, r.n_removed) for r in got], key=order) == sorted(plain_lines(rows), key=order)
    assert lines.deduplicate_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("edits", [0, 2])
def test_lines_within_other_thresholds(spark, edits, monkeypatch):
    monkeypatch.setattr(edit_join, "BUCKET", 2)  # so that buckets are split
    rng = random.Random(14)
    base = ["the quick brown fox jumps over", "Straße und ñandú über allem 漢字", "a" * 24]
    rows = []

    def edited(line):
        at = rng.randrange(len(line))
        return rng.choice([line[:at] + rng.choice("xyz") + line[at:], line[:at] + line[at + 1 :], line[:at] + rng.choice("xyz") + line[at + 1 :], line[: at - 1] + line[at:] + line[at - 1 : at] if at else line])

    for k in range(45):
        line = rng.choice(base)
        for _ in range(rng.randrange(4)):
            line = edited(line)
        rows.append((k, f"{line}\n{text(800 + k, 6)}"))
    got = lines.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string"), max_edits=edits).collect()
    assert sorted((r.doc_id, r.text, r.n_removed) for r in got) == sorted(plain_lines(rows, edits))


def test_banded_edit_distance(spark):
    rng = random.Random(8)
    pairs = [("", ""), ("", "a"), ("a", ""), ("ab", "ba"), ("é", "e"), ("abc", "abcde")]
    for _ in range(150):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(12)))
        b = list(a)
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "a", "b", "é"])
        pairs.append((a, "".join(b)))
    chars = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    df = spark.createDataFrame(pairs, "a string, b string").withColumn("x", chars("a")).withColumn("y", chars("b"))
    for edits in (1, 2, 3):
        for r in df.select("a", "b", lines.within_edits(F.col("x"), F.col("y"), edits).alias("near")).collect():
            assert r.near == (edit_distance(r.a, r.b) <= edits), (r, edits)


# 10


def test_warc_round_trip(spark):
    page = "<html>" + "x" * 200 + "é\r\n\r\nWARC/1.0\r\n</html>"
    rows = [(5, "http://a.com/x", page), (3, "https://www.A.com:80/x?q=1#f", page), (3, "http://a.com/x", page), (4, None, None), (6, "http://b.org", "short"), (7, "http://b.org", "short"), (None, "u", page), (8, "http://a.com/x\r\ny", "")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n int")
    path = tables.new_path(spark, "warc-test")
    out = warc.archive_pages(df, path=path)
    got = out.collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = Counter()
    for i, _, html in rows:
        big = html == page and i != 3
        want[i, len((html or "").encode()), digest(html), "revisit" if big else "response", 3 if big else None] += 1
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    keys = [(r.url_key, r.captured_at, -1 if r.page_id is None else r.page_id) for r in got]
    assert keys == sorted(keys) and ("com,a)/x?q=1" in {k[0] for k in keys})
    stored = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    files = {r.path.rpartition("/")[2]: r.content for r in stored}
    for name, content in files.items():  # a gzip file as any other
        assert gzip.decompress(content).count(b"WARC-Type: ") == sum(r.warc_file == name for r in got)
    for r in got:  # a record is read from its place alone
        record = gzip.decompress(files[r.warc_file][r.warc_offset : r.warc_offset + r.warc_length])
        assert record.startswith(b"WARC/1.0\r\n") and record.endswith(b"\r\n\r\n")
        if r.record_type == "response":
            body = warc.parse_record(record)[1].partition(b"\r\n\r\n")[2]
            assert hashlib.sha256(body).hexdigest() == r.payload_digest
    assert warc.archive_pages(df.limit(0)).count() == 0


def test_warc_of_long_payloads_and_many_members(spark):
    rng = random.Random(2)
    rows = [(k, f"http://h{k % 7}.org/{rng.random()}", "".join(chr(rng.randrange(32, 900)) for _ in range(200_000 if k % 40 == 0 else k))) for k in range(200)]
    got = {r.page_id: r for r in warc.archive_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k].payload_digest == hashlib.sha256(h.encode()).hexdigest() and got[k].payload_bytes == len(h.encode()) for k, _, h in rows)


def test_loser_tree():
    rng = random.Random(2)
    for n in (0, 1, 2, 3, 7, 20):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(30))) for _ in range(n)]
        assert list(warc.LoserTree(runs)) == sorted(x for r in runs for x in r)


# The pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "lines", "simhash", "mixing", "packing"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        done = tables.materialize(stage(spark, docs, SMALL), name)
        if name != "packing":
            assert done.columns == docs.columns
        seen[name], docs = done, done
    clean = {r.doc_id for r in spark.read.parquet(f"{SMALL}/labels.parquet").where("quality = 1").collect()}
    kept = {r.doc_id for r in seen["quality"].collect()}
    assert len(clean - kept) <= 0.02 * len(clean)
    groups = simhash.simhash_groups(seen["simhash"], width=5).groupBy("component_id").count()
    assert groups.where("count > 1").count() == 0
    assert seen["mixing"].select("doc_id").distinct().join(seen["simhash"], "doc_id", "left_anti").count() == 0
    rows = seen["packing"].collect()
    check_packing(rows, sum(r.length for r in rows))
    assert json.dumps(sorted({r.doc_id for r in rows})) == json.dumps(sorted({r.doc_id for r in seen["mixing"].collect()}))


def test_pipeline_of_odd_and_empty_tables(spark):
    import corpus_pipeline

    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        path = tables.new_path(spark, name)
        stage(spark, docs, SMALL).write.parquet(path)
        done = spark.read.parquet(path)
        if name == "packing":
            break
        assert done.columns == docs.columns
        none = stage(spark, docs.limit(0), SMALL)
        assert none.columns == docs.columns and none.count() == 0
        docs = done
        if name == "simhash":
            groups = docs.groupBy("doc_id", "text").count().where("count > 1 AND doc_id IS NOT NULL")
            assert groups.count() == 0  # a repeated row once
    check_packing(done.collect(), done.agg(F.sum("length")).first()[0])
    assert stage(spark, docs.limit(0), SMALL).count() == 0


def test_pairs_of_hashes_that_share_a_half():
    kind = np.dtype([("a", "<u8"), ("b", "<u8")])
    rng = np.random.default_rng(1)
    for halves in (2, 50, 1 << 62):
        pairs = np.empty(3000, kind)
        pairs["a"], pairs["b"] = rng.integers(0, halves, 3000), rng.integers(0, 40, 3000)
        pairs[2000:] = pairs[:1000]
        values, counts = np.unique(pairs, return_counts=True)
        once, more = passages._pairs_once_and_more(pairs)
        assert (once == values[counts == 1]).all() and (more == values[counts > 1]).all() and len(once) + len(more) == len(values)
        of = passages._distinct_pairs(pairs[:500])
        assert passages._is_in(pairs, of).tolist() == [tuple(x) in {tuple(y) for y in of.tolist()} for x in pairs.tolist()]
    assert not len(passages._distinct_pairs(pairs[:0])) and not passages._is_in(pairs, pairs[:0]).any()
