"""Repeated query rows, common vectors and repeated labelled texts."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.llm import ann, langid


def brute(rows, is_query, k):
    out = {}
    for q in sorted({i for i, _ in rows if is_query(i)}):
        v = np.array(min(w for i, w in rows if i == q))
        scored = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q)
        out[q] = [i for _, i in scored[:k]]
    return out


def test_copies_of_a_query_row_and_large_k(spark):
    rows = [(100, [1.0, 0.5])] * 25 + [(200, [1.0, 0.5]), (300, [0.9, 0.5])] + [(400 + i, [0.5, 0.25]) for i in range(50)] + [(500, [0.1, 0.1])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    index = ann.build_index(df)
    for k in (2, 20):
        got = {}
        for r in ann.search(index, df, F.col("vec_id").isin(100, 440), k=k).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.vec_id)
        assert got == brute(rows, lambda i: i in (100, 440), k) and got[100][:2] == [200, 300] and got[440][:2] == [100, 100]
    with pytest.raises(ValueError, match="members"):
        ann.search(index, df, F.col("vec_id") == 100, k=40)
    deep = ann.build_index(df, members=41)
    got = [r.vec_id for r in ann.search(deep, df, F.col("vec_id") == 410, k=40).orderBy("rank").collect()]
    assert got == brute(rows, lambda i: i == 410, 40)[410]
    got = [r.vec_id for r in ann.search(deep, df, F.col("vec_id") == 100, k=40).orderBy("rank").collect()]
    assert got == brute(rows, lambda i: i == 100, 40)[100]


def test_recall_of_a_full_shard(spark):
    """A graph of SHARD_ROWS random vectors, searched with the beam of one shard among many."""
    rng = np.random.default_rng(9)
    x = rng.normal(size=(ann.SHARD_ROWS, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    edges, entry = ann.build_graph(x)
    q = x[::100]
    true = np.argsort(-(q @ x.T), axis=1)[:, 1:6]
    found, _ = ann.beam_search(x, edges, entry, q, 51)
    # Of the 20 neighbours asked for, one shard of many holds few; its first five stand for more than its share.
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(true.tolist(), found.tolist())]) >= 0.9


def test_a_language_of_repeated_texts_is_learned(spark):
    rng = random.Random(1)
    en, es = ["the", "house", "with", "river", "morning", "think"], ["casa", "río", "mañana", "pero", "cuando", "tiene"]
    text = lambda words: " ".join(rng.choice(words) for _ in range(30))
    rows = [(i, text(en), "en", "x") for i in range(300)]
    rows += [(5000 + 5 * k, t, "es", "y") for k, t in enumerate([text(es) for _ in range(3)]) for _ in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, `a column` string").repartition(4)
    assert langid.train(df)[0] == ["en", "es"]
    told = langid.identify(df, keep=tuple(df.columns))
    assert all(r.lang_pred == r.kept_lang for r in told.select("lang_pred", "kept_lang").distinct().collect())
    assert Counter(r["kept_a column"] for r in told.collect()) == Counter(r[3] for r in rows)
