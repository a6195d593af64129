"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import random

WORDS = [f"w{k:03d}" for k in range(400)]
CLASH = "ids int, decoded int, cluster string, distance string, n_copies int, rate double, copy_no int, row string, host string, path string, quality double, n_removed int, n_replaced int, spans int, fp int, component_id int"


def text(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


def odd_documents(spark):
    """(doc_id, text, lang, source, n_chars and columns that clash with those that operators add)."""
    long_ = text(1, 6000)
    rows = [
        (1, long_, "en", "a"), (2, long_, "en", "a"), (2, long_, "en", "a"), (3, None, "en", None), (4, "", None, "b"), (5, "  \t\n ", "en", "b"),
        (None, text(5, 60), "en", "a"), (7, text(7, 80), None, None), (8, text(7, 80) + " end", "en", "a"), (9, "é ñ 漢字 😀", "xx", "a"), (10, "one", "en", "b"),
        (11, "ONE", "en", "b"), (12, text(12, 35) + "\n" + text(13, 35), "en", "a"), (13, text(14, 35) + "\n" + text(13, 35), "en", "a"), (13, "another text of the same id", "en", "a"),
    ]
    full = [(*r, None if r[1] is None else len(r[1]), *[None] * 16) for r in rows]
    return spark.createDataFrame(full, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


def empty(spark, df):
    return spark.createDataFrame([], df.schema)


def components(links, nodes):
    """Least node reachable from each node."""
    of = {n: n for n in nodes}

    def root(n):
        while of[n] != n:
            n = of[n]
        return n

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        of[b] = a
    return {n: root(n) for n in nodes}
