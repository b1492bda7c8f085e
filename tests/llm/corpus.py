"""Small documents with everything that may go wrong, and plain versions of the operators."""

from __future__ import annotations

import re

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that clash with columns the operators make
        T.StructField("size", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("target", T.StringType()),
        T.StructField("rid", T.StringType()),
        T.StructField("score", T.StringType()),
        T.StructField("n", T.StringType()),
        T.StructField("line", T.StringType()),
        T.StructField("spans", T.StringType()),
        T.StructField("__text", T.StringType()),
        T.StructField("component_id", T.StringType()),
    ]
)
LONG = " ".join(f"w{i % 997}x{i}" for i in range(30_000))
BASE = " ".join(f"plain{i}" for i in range(60))


def rows():
    near = BASE.replace("plain30", "other")
    texts = [
        (1, BASE, "a"), (2, near, "a"), (3, BASE, "b"), (4, None, "b"), (5, "", "c"), (6, "  \n\t ", "c"), (7, LONG, "c"),
        (8, "short one", None), (8, "short one", None), (9, "Short ONE", None), (10, LONG + " tail", "a"), (None, BASE, "a"), (None, None, None),
        (11, "é" * 70_000, "b"), (12, "a b c d e", "zz"), (13, "A B C D E", "zz"), (14, "line one of this text\nline one of this text\n\nline one of thas text\n", "b"),
    ]
    return [(i, t, "en", s, None, "x", "x", None, "x", "x", "x", "x", "x", "x", "x") for i, t, s in texts]


def documents(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, DOCS)


def simple(spark, pairs, source="s"):
    return spark.createDataFrame([(i, t, "en", source, len(t or "")) for i, t in pairs], "doc_id long, text string, lang string, source string, n_chars long")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def blank_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def alnum_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def shingles(text):
    w = blank_words(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def components(docs):
    """doc_id → smallest linked doc_id, by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs if i is not None}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            u, v = sets[a], sets[b]
            if u and v and 100 * len(u & v) >= 75 * len(u | v):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def hits(text, items):
    """(words, hit places, items) of one document against {item: text}."""
    w, hit, found = alnum_words(text), set(), set()
    for item, body in items.items():
        x = alnum_words(body)
        k = min(10, len(x))
        wanted = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if k else set()
        for i in range(len(w) - k + 1):
            if k and tuple(w[i : i + k]) in wanted:
                hit.update(range(i, i + k))
                found.add(item)
    return w, hit, found
