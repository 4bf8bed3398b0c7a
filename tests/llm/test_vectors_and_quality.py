"""Hard negatives, vector codes and the quality classifier against brute force, SQL and held-out rows."""

import math
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairlab.llm import codes, hardneg, quality, queries

VEC = "vec_id long, embedding array<double>, label int, id string, cell int, part string, `row` string, positive_id string"


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


@pytest.fixture(scope="module")
def vectors():
    """Clusters with a hot group of equal vectors, nulls, odd components, a repeated row, a shared id and two dimensions."""
    rng = random.Random(7)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(4)]
    rows = []
    for i in range(600):
        c = centres[i % 4]
        v = [x + rng.gauss(0, 0.3) for x in c]
        if i % 3 == 0:
            v = list(centres[0])
        rows.append((i, v, (i % 4 + (i % 11 == 0)) % 4))
    rows += [(700, None, 1), (701, [], 1), (702, [0.5] * 15 + [None], 1), (703, [0.5] * 15 + [float("nan")], 1), (704, [float("inf")] * 16, 1), (705, [0.1] * 16, None), (None, [0.1] * 16, 2)]
    rows += [(800 + i, [rng.gauss(0, 1) for _ in range(4)], i % 2) for i in range(40)] + [(900, [0.0] * 16, 0)]
    rows += [rows[100], rows[100], (200, [x + 0.1 for x in centres[1]], 3), rows[7]]
    return [(i, v, label, "a", 1, "b", "c", "d") for i, v, label in rows]


def brute_negatives(rows, positives=5, negatives=5):
    data = [(i, np.floor(np.array(v) * 256), label) for i, v, label, *_ in rows if i is not None and label is not None and usable(v)]
    anchors = {}
    for i, v, label in data:
        if i % 20 == 0:
            anchors[i] = min(anchors.get(i, (label, v.tolist())), (label, v.tolist()))
    out = Counter()
    for i, (label, v) in anchors.items():
        scored = [(int(np.dot(v, w)), j, other) for j, w, other in data if j != i and len(w) == len(v)]
        best = sorted([(-s, j) for s, j, other in scored if other == label])[:positives]
        for s, p in best:
            found = sorted([(-t, j) for t, j, other in scored if other != label and 80 * -s <= 100 * t <= 100 * -s])[:negatives]
            for k, (t, j) in enumerate(found):
                out[i, p, k + 1, j, -s, -t] += 1
    return out


def mined(df, **options):
    got = hardneg.hard_negatives(df, F.col("vec_id") % 20 == 0, **options)
    return Counter((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


def test_hard_negatives_against_brute_force(spark, vectors, monkeypatch):
    df = spark.createDataFrame(vectors, VEC).repartition(3)
    want = brute_negatives(vectors)
    assert len(want) > 300
    # Many cells, small blocks and groups: the bounds decide what meets.
    monkeypatch.setattr(hardneg, "PIVOT_ROWS", 40)
    monkeypatch.setattr(hardneg, "BLOCK_BYTES", 2500)
    monkeypatch.setattr(hardneg, "GROUP_ROWS", 3)
    assert mined(df) == want
    monkeypatch.setattr(hardneg, "GROUP_BYTES", 0)  # groups are joined, not broadcast
    assert mined(df, positives=2, negatives=9) == brute_negatives(vectors, 2, 9)


def test_bounds_spare_work(spark, monkeypatch):
    """Of far-apart clusters, an anchor group meets few blocks."""
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 4, (12, 8))
    rows = [(i, (centres[i % 12] + rng.normal(0, 0.05, 8)).tolist(), i // 12 % 2) for i in range(1200)]
    monkeypatch.setattr(hardneg, "PIVOT_ROWS", 20)
    monkeypatch.setattr(hardneg, "BLOCK_BYTES", 3000)
    met = []
    plain = hardneg._replicated
    monkeypatch.setattr(hardneg, "_replicated", lambda needs, blocks, groups, same: (met.append((groups.count() * blocks.count(), (out := plain(needs, blocks, groups, same)).count())), out)[1])
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert mined(df) == brute_negatives(rows)
    assert all(n < 0.25 * every for every, n in met)


def test_hard_negatives_of_large_and_few_vectors(spark):
    """Scores past what doubles hold exactly, components whose squares end doubles, and empty tables."""
    rows = [(20 * i, [3.0e13 + i, 1.0 + i, float(i % 3)], i % 2) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    data = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows]
    with pytest.raises(Exception, match="int too|OverflowError|Overflow"):
        mined(df)
    rows = [(i, [x / 2**22 for x in v], label) for i, v, label in rows]
    data = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows]
    want = Counter()
    for i, v, label in data:
        scored = [(sum(a * b for a, b in zip(v, w)), j, other) for j, w, other in data if j != i]
        for s, p in sorted((-s, j) for s, j, other in scored if other == label)[:5]:
            for k, (t, j) in enumerate(sorted((-t, j) for t, j, other in scored if other != label and 80 * -s <= 100 * t <= 100 * -s)[:5]):
                want[i, p, k + 1, j, -s, -t] += 1
    assert mined(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")) == want
    tiny = spark.createDataFrame([(20, [1e160, 1.0], 1), (21, [0.0, 1.0], 1), (22, [0.0, 2.0], 0)], "vec_id long, embedding array<double>, label int")
    assert mined(tiny) == Counter()  # no squares of a double hold the first, so no bound does; 22 is past the positive's score
    assert mined(tiny.limit(0)) == Counter() and mined(tiny.limit(1)) == Counter()


def same_as_sql(spark, sf_dir, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = c.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, sf_dir).select(*columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())


def test_op11_and_op12_match_sql(spark, sf_dir):
    same_as_sql(spark, sf_dir, "op11_hard_negatives")
    same_as_sql(spark, sf_dir, "op12_vector_codes")


def brute_codes(rows, parts, entries, rounds):
    kept = sorted([(-1 if i is None else i, [math.floor(256 * x) for x in v], -1 if label is None else label) for i, v, label, *_ in rows if usable(v) and len(v) % parts == 0])
    width = len(kept[0][1]) // parts
    kept = [r for r in kept if len(r[1]) == parts * width]
    cut = lambda v: [tuple(v[p * width : (p + 1) * width]) for p in range(parts)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(parts)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        held = [defaultdict(list) for _ in range(parts)]
        for _, v, _ in kept:
            for p, part in enumerate(cut(v)):
                held[p][near(part, books[p])[1]].append(part)
        for p in range(parts):
            for k, own in held[p].items():
                books[p][k] = tuple(sum(x) // len(own) for x in zip(*own))
    out = []
    for i, v, label in kept:
        found = [near(part, books[p]) for p, part in enumerate(cut(v))]
        out.append((i, [k for _, k in found], sum(d for d, _ in found), label))
    return out, books


def test_vector_codes_against_brute_force(spark, vectors):
    df = spark.createDataFrame(vectors, VEC).repartition(3)
    for parts, entries, rounds in ((4, 8, 2), (16, 5, 1), (2, 3000, 3)):
        found, books = codes.compress(df, parts=parts, entries=entries, rounds=rounds)
        want, want_books = brute_codes(vectors, parts, entries, rounds)
        assert [[tuple(e) for e in b.tolist()] for b in books] == want_books
        got = [(-1 if r.vec_id is None else r.vec_id, list(r.codes), r.error, -1 if r.label is None else r.label) for r in found.collect()]
        assert sorted(got) == sorted(want)
    digests = codes.digests(df, parts=4, entries=8).collect()
    want, _ = brute_codes(vectors, 4, 8, 2)
    sums = Counter()
    for _, _, error, label in want:
        sums[label] += error
    label_of = defaultdict(set)
    for i, own, error, label in want:
        label_of[i, "".join(f"{k:02x}" for k in own), error].add(sums[label])
    assert len(digests) == len(want) and all(r.label_error in label_of[-1 if r.vec_id is None else r.vec_id, r.code, r.error] for r in digests)


def test_vector_codes_of_nothing_and_of_large_numbers(spark):
    df = spark.createDataFrame([(1, None, 1), (2, [1.0] * 3, None)], "vec_id long, embedding array<double>, label int")
    assert codes.digests(df).count() == 0 and codes.digests(df.limit(0)).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = [(i, [1e6 * i, 3e6, -2.5 * i, 1.0], i % 2) for i in range(9)]
    big = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted((r.vec_id, list(r.codes), r.error, r.label) for r in codes.compress(big, parts=2, entries=3)[0].collect())
    assert got == sorted(brute_codes(rows, 2, 3, 2)[0])


def test_a_hot_vector_is_one_weighted_row(spark):
    """Copies of one vector are one distinct row a position."""
    rows = [(i, [0.5, 0.25] if i % 4 else [i / 7, i / 9], 1) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found, _ = codes.compress(df, parts=2, entries=4)
    assert sorted((r.vec_id, list(r.codes), r.error, r.label) for r in found.collect()) == sorted(brute_codes(rows, 2, 4, 2)[0])


# ---- quality


def slow_statistics(t):
    t = t or ""
    words = [w for w in __import__("re").split(r"[ \t-\r]+", t) if w]
    lines = [x for x in t.split("\n") if x]
    n = max(1, len(words))
    upper, lower = sum("A" <= c <= "Z" for c in t), sum("a" <= c <= "z" for c in t)
    lengths = [len(w) for w in words]
    raw = Counter(t.encode())
    total = sum(raw.values())
    letter = lambda c: c.isascii() and c.isalpha() or not c.isascii()
    mark = lambda c: c.isascii() and not c.isalnum() and c not in " \t\n\r\x0b\x0c.,;:?!'\"()-"
    cap = lambda w: sum("A" <= c <= "Z" for c in w) > 1 and not any("a" <= c <= "z" for c in w)
    return {
        "log_chars": math.log1p(len(t)), "log_words": math.log1p(len(words)), "mean_word": sum(lengths) / n, "sd_word": float(np.std(lengths)) if words else 0.0,
        "letters": sum(map(letter, t)) / max(1, len(t)), "capitals": upper / max(1, upper + lower), "symbols": sum(map(mark, t)) / max(1, len(t)), "same_as_last": sum(a == b for a, b in zip(words, words[1:])) / n,
        "distinct_words": len(set(words)) / n, "commonest_word": max(Counter(words).values(), default=0) / n, "same_as_two_before": sum(a == b for a, b in zip(words, words[2:])) / n,
        "capital_words": sum("A" <= w[0] <= "Z" for w in words) / n, "words_without_letters": sum(not any(map(letter, w)) for w in words) / n, "words_ending_in_symbols": sum(mark(w[-1]) or w[-1] == "!" for w in words) / n,
        "shouted_words": sum(map(cap, words)) / n, "log_lines": math.log1p(len(lines)), "repeated_lines": (len(lines) - len(set(lines))) / max(1, len(lines)), "lines_with_stop": sum(x[-1] in ".,;:?!" for x in lines) / max(1, len(lines)),
        "byte_entropy": -sum(k / total * math.log2(k / total) for k in raw.values()),
    }


def test_statistics_against_plain_python():
    rng = random.Random(5)
    texts = ["", None, " ", "\n\n", "a", "A!! B!! a", "x x x y", "one two\none two\n\nend.", "héllo wörld 日本 ###", "|", "THE!! END!!", "a" * 5000, "", "\x0b tab\tx"]
    texts += ["".join(rng.choice("abAB é\n .!#1日") for _ in range(rng.randint(0, 200))) for _ in range(60)] + ["", " "]
    found = quality.statistics(pa.array(texts, pa.string()))
    for t, row in zip(texts, found):
        for name, value in slow_statistics(t).items():
            assert row[quality.STATISTICS.index(name)] == pytest.approx(value, abs=1e-9), (t, name)
    assert quality.statistics(pa.array([], pa.string())).shape == (0, len(quality.STATISTICS))


def test_one_level_against_all_splits():
    """The first split is the best of all cuts, and leaves are Newton steps."""
    rng = np.random.default_rng(2)
    x = rng.integers(0, 12, (300, 3)).astype(float)
    y = (x[:, 1] + rng.normal(0, 2, 300) > 6).astype(float)
    t = quality.fit(x, y, trees=1, depth=1, bins=16, rate=1.0)
    p = 1 / (1 + np.exp(-t.base))
    g, h = y - p, np.full(300, p * (1 - p))
    gains = {}
    for f in range(3):
        for c in np.unique(x[:, f])[:-1] + 0.5:
            left = x[:, f] <= c
            gains[f, c] = sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left))
    f, c = max(gains, key=gains.get)
    assert (t.feature[0, 0], t.threshold[0, 0]) == (f, c)
    left = x[:, f] <= c
    assert t.leaf[0] == pytest.approx([g[s].sum() / (h[s].sum() + 1) for s in (left, ~left)])


def test_flat_traversal_is_a_walk_down_each_tree():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (500, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    t = quality.fit(x, y, trees=20, depth=3, bins=32)
    walked = []
    for row in x:
        total = t.base
        for f, c, leaf in zip(t.feature, t.threshold, t.leaf):
            node = 0
            while node < len(f):
                node = 2 * node + (2 if row[f[node]] > c[node] else 1)
            total += leaf[node - len(f)]
        walked.append(total)
    assert t.margin(x) == pytest.approx(walked) and ((t.score(x) >= 0.5) == (y == 1)).mean() > 0.97
    losses = []
    for n in (1, 5, 20):
        s = quality.fit(x, y, trees=n, depth=3, bins=32).score(x)
        losses.append(-np.mean(y * np.log(s) + (1 - y) * np.log(1 - s)))
    assert losses[0] > losses[1] > losses[2]


def test_constant_statistics_and_one_kind_of_label():
    t = quality.fit(np.zeros((10, 2)), np.ones(10), trees=3)
    assert (t.score(np.array([[0.0, 0.0], [5.0, -1.0]])) > 0.9).all()


DOC = "doc_id long, text string, lang string, source string, label int, s0 double, h string, held_out string"


def test_quality_cases(spark):
    """Nulls, labels of no kind, repeated rows, a hot id, conflicting labels, empty tables and clashing columns."""
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    rows = []
    for i in range(900):
        own = [word() for _ in range(rng.randint(10, 80))]
        rows.append((i, " ".join(own) if i % 3 else " ".join(w + "###" for w in own)))
    rows += [(5000, None), (5001, ""), (None, "no id"), (7, "again " + word()), rows[4], rows[4]] + [(12, " ".join(word() for _ in range(20))) for _ in range(300)]
    df = spark.createDataFrame([(i, t, "x", "y", 3, 0.5, "h", "z") for i, t in rows], DOC).repartition(3)
    labels = [(i, int(i % 3 > 0), 9) for i in range(900) if i % 2] + [(2, None, 0), (4, 7, 0), (None, 1, 0), (12, 0, 0), (5000, 0, 0), (99999, 1, 0), (7, 1, 0), (7, 1, 0)]
    told = spark.createDataFrame(labels, "doc_id long, quality int, text int")
    got = quality.classify(df, told, trees=20).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900 and r.doc_id != 12]
    assert len(held) > 200 and sum(r.predicted == int(r.doc_id % 3 > 0) for r in held) >= 0.97 * len(held)
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    # The same rows in another order, and reruns, give the same scores; a sample bound still learns.
    again = quality.classify(df.repartition(5), told, trees=20).collect()
    assert sorted((str(r.doc_id), r.score) for r in got) == sorted((str(r.doc_id), r.score) for r in again)
    small = quality.classify(df, told, trees=20, sample_rows=120).collect()
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in small if r.held_out and r.doc_id < 900) > 0.9 * len(held)
    assert {r.score for r in quality.classify(df, told.limit(0)).collect()} == {0.5}
    assert quality.classify(df.limit(0), told).count() == 0
    one = quality.classify(df, told.filter("quality = 1"), trees=5).collect()
    assert all(r.score > 0.8 for r in one)


def test_held_out_quality(spark, sf_dir):
    found = queries.op13_quality(spark, sf_dir)
    truth = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    rows = found.join(truth, "doc_id").filter("held_out").collect()
    assert len(rows) > 15 and sum(r.predicted == r.quality for r in rows) >= 0.9 * len(rows)
