"""Passages of over 50 words are found whole, wherever they lie and whatever surrounds them."""

import random

from pyspark.sql import functions as F

from pairlab.llm import substring


def test_whole_passages(spark):
    rng = random.Random(4)
    fresh = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(n)]
    rows, want, near = [], {}, {}
    for i in range(600):
        passage, at = fresh(rng.randint(51, 60)), rng.choice((0, rng.randint(1, 90)))
        end = fresh(rng.randint(1, 90) if at else 0)  # at 0, a copy of a whole document
        rows.append((i, " ".join(passage if i % 2 else fresh(30) + passage + fresh(30))))
        if i % 3 == 0:
            k = rng.randrange(len(passage))
            passage = [*passage[:k], "changed", *passage[k + 1 :]]
            near[1000 + i] = (at, len(passage))
        else:
            want[1000 + i] = (at, len(passage), i)
        rows.append((1000 + i, " ".join(fresh(at) + passage + end)))
    rows += [(2000, " ".join(fresh(40) + ["no"] * 60)), (2001, " ".join(["no"] * 80 + fresh(40)))]
    got = {}
    for r in substring.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.start_word, r.n_words, r.kept_doc_id))
    assert {i: got.get(i) for i in want} == {i: [w] for i, w in want.items()}
    assert all(sum(n for _, n, _ in got[i]) >= size // 2 and all(at <= a and a + n <= at + size for a, n, _ in got[i]) for i, (at, size) in near.items())
    assert set(got) == {*want, *near, 2001} and got[2001][0][1] >= 60


def test_every_repeat_of_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen, want = {}, set()
    for r in docs.orderBy("doc_id").collect():
        w = (r.text or "").encode().lower().split()
        for i in range(len(w) - 50):
            if seen.setdefault(tuple(w[i : i + 51]), r.doc_id) != r.doc_id:
                want |= {(r.doc_id, k) for k in range(i, i + 51)}
    got = {(r.doc_id, k) for r in substring.repeated_spans(docs).collect() for k in range(r.start_word, r.start_word + r.n_words)}
    assert want and want <= got


def test_a_crowded_band_leaves_no_link_out(spark):
    """Similar classes of a band that are neither its leader's nor neighbours there are linked; bands in one component give no pair."""
    from pairlab.llm.substring import crowded, line_pairs, remaining_pairs

    rows = [(i, 10 if i == 0 else 1, 30, [7, 1000 + i]) for i in range(12)]
    classes = spark.createDataFrame(rows, "class long, docs long, n int, bands array<long>")
    first = {(r.u, r.v) for r in line_pairs(classes, 0.8).collect()}
    links = spark.createDataFrame([(1, 2), (3, 4)], "u long, v long")
    rest = {(r.u, r.v) for r in remaining_pairs(crowded(classes), links, 0.8).collect()}
    every = {(i, j) for i in range(12) for j in range(i + 1, 12)}
    assert (2, 9) not in first and first | rest | {(1, 2), (3, 4)} == every
    chain = spark.createDataFrame([(i, i + 1) for i in range(11)], "u long, v long")
    assert remaining_pairs(crowded(classes), chain, 0.8).count() == 0


def test_what_stays_apart_in_a_band_is_linked_without_all_pairs(spark):
    """Of 300 edits of one line, most too far apart: all similar pairs of the band are found, and few others are formed."""
    from pairlab.llm.substring import crowded, reaching_pairs, remaining_pairs

    rng = random.Random(23)
    base, sets = list(range(90)), {}
    for i in range(300):
        own = set(base) if i % 10 else set(sets.get(i - 1, base))
        for k in rng.sample(base, rng.randint(8, 24) if i % 10 else 3):
            own.discard(k)
            own.add(1000 * (i + 1) + k)
        sets[i] = own
    classes = spark.createDataFrame([(i, 1, len(s) + 4, [7, 1000 + i]) for i, s in sets.items()], "class long, docs long, n int, bands array<long>")
    links = spark.createDataFrame([], "u long, v long")
    every = {(r.u, r.v) for r in remaining_pairs(crowded(classes), links, 0.8).collect()}
    similar = {(u, v) for u, v in every if len(sets[u] & sets[v]) >= 0.8 * len(sets[u] | sets[v])}
    left = crowded(classes).withColumn("component", F.col("class"))
    held = spark.createDataFrame([(i, sorted(s)) for i, s in sets.items()], "class long, shingles array<long>")
    got = {(min(r.u, r.v), max(r.u, r.v)) for r in reaching_pairs(left, held, 0.8).collect()}
    assert len(every) > 40_000 and 25 < len(similar) and similar <= got <= every
    assert len(got) < len(similar) + 0.05 * len(every)


def test_places_of_a_passage_do_not_depend_on_short_texts_of_its_slice(spark):
    passage = " ".join(f"word{k}" for k in range(60))

    def found(texts):
        rows = substring.places(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), 11, 24, 4, 2).collect()
        return sorted(repr(r[1:]) for r in rows if texts[r.doc_id] == passage)

    alone = found([passage])
    assert alone and found([passage, "a short text"]) == alone == found(["", passage]) and found(["x\n" * 40, passage + " end", passage]) == alone


def test_run_components_equal_those_of_all_links(spark):
    from pairlab.llm.graph import components
    from pairlab.llm.substring import run_components

    links = [(1, 10, 20), (1, 10, 21), (1, 10, 21), (2, 30, 40), (2, 31, 40), (3, 50, 60), (3, 50, 61), (3, 51, 61), (3, 52, 62), (4, 70, 80)]
    df = spark.createDataFrame(links, "band_key long, u long, v long")
    assert sorted(run_components(df).collect()) == sorted(components(df.select("u", "v")).collect())
