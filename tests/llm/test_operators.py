"""Operators against brute force, exact round trips and edge cases on small tables."""

import functools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pairlab.llm import ann, graph, htmltext, langid, mixing, packing, queries, sharding, simhash, substring, tokens, tokenstore, topk

VOCABULARY = "byte_bpe_50k.json"
DOC = "doc_id long, text string, lang string, source string, n_chars long, shard string, `size` string, sequence_id string"


@functools.cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path(VOCABULARY))


@pytest.fixture(scope="module")
def edge_rows():
    """Nulls, blanks, repeats, one long text and columns with clashing names."""
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma,", "Delta.", "héllo", "naïve", "日本", "x"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [None, "", " \n ", "x", "one\ntwo  three\t", text(5000), *[text(rng.randint(1, 300)) for _ in range(30)]]
    texts += [texts[8]] * 12
    rows = [(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else f"s{i % 3}", None, "c", None, "d") for i, t in enumerate(texts)]
    return [*rows, rows[9], rows[9], (None, "no id", None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def edges(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOC).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_word_encoder_equals_the_library():
    texts = ["", " a", "a  b", "x\n\ny", "it's don't 'll", "日本 語", "<|endoftext|> a", "a<|endoftext|>b", "plain a<|endoftext|>b\nand more", "<|endoftext", "a\tb", "\n", "a\nb", "a \nb", "a" * 3000, "1 2 3abc", "é x", "\x1c a", "a\x85b", "ªº × ÷a", "The the, the. The\nthe"]
    assert [x.tolist() for x in tokens.encoder(VOCABULARY).encode(texts)] == [e.ids for e in library().encode_batch(texts, add_special_tokens=False)]


def check_packing(rows, pieces):
    want = Counter()
    for r in rows:
        want[(r[0], tuple(library().encode(r[1] or "", add_special_tokens=False).ids + [0]))] += 1
    held = defaultdict(list)
    for p in pieces:
        held[p.sequence_id].append(p)
    for own in held.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= 1024
    found = Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in pieces)
    by_doc = defaultdict(list)
    for k, n in found.items():
        by_doc[k[0]] += [k] * n
    for (key, ids), n in want.items():
        raw = np.array(ids, "<u4")
        for _, start, length, crc, total in by_doc[key]:
            assert total == len(ids) and zlib.crc32(raw[start : start + length].tobytes()) == crc
        assert sum(k[2] for k in by_doc[key]) == n * len(ids)
    return len(held)


def test_packing(spark, edges, edge_rows, none, docs):
    check_packing(edge_rows, packing.pack(edges).collect())
    assert packing.pack(none).count() == 0
    pieces = packing.pack(docs.repartition(8, "doc_id")).collect()
    n = check_packing([(r.doc_id, r.text) for r in docs.collect()], pieces)
    assert sum(p.length for p in pieces) / (1024 * n) > 0.93


def test_merge_is_best_fit():
    assert packing.merge_windows([600, 500, 400, 300], 1000) == [(0, 0), (1, 0), (0, 600), (1, 500)]


def test_mixing_matches_sql(spark, sf_dir, edges, edge_rows, none, tmp_path):
    edges.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    for where, glob in ((sf_dir, ""), (str(tmp_path), "/*.parquet")):
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{where}/documents.parquet{glob}'")
        got = sorted(map(tuple, queries.op2_mixing(spark, where).select("doc_id", "size", "source_size", "target", "taken").collect()), key=repr)
        assert got == sorted(c.execute(queries.oracle_sql()["op2_mixing"]).fetchall(), key=repr)
    assert mixing.mix(none).count() == 0


def test_targets_reshare_the_excess(spark):
    rows = spark.createDataFrame([("a", 10), ("b", 1000), (None, 1000)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got["a"] == 20 and got["b"] == pytest.approx((3015 - 20) / 3) and got[None] == pytest.approx(2 * (3015 - 20) / 3)
    assert sum(got.values()) == pytest.approx(1.5 * 2010)


def test_mixing_parts(spark):
    """A source of one long document comes near its target; the words that are taken of it are its first."""
    rows = [(1, "long", " a\t" + " ".join(f"w{i}" for i in range(999))), (2, "other", "x y z"), (3, "other", None), (4, None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = {r.doc_id: r for r in mixing.mix(docs, weights=(1, 1, 1), ratio=1.2, parts=True, keep=("text",)).collect()}
    assert (got[1].copies, got[1].taken) == (1, round(got[1].target)) and 0 < got[1].part == got[1].taken - 1000
    assert got[2].taken == 6 and got[3].taken == got[4].taken == 0
    whole = {r.doc_id: r for r in mixing.mix(docs, weights=(1, 1, 1), ratio=1.2).collect()}
    assert whole[1].taken in (1000, 2000) and all(r.part == 0 for r in whole.values())
    texts = spark.createDataFrame([(t, n) for t in (" a\t b  c ", "a b", "", "a", " ", "a\u00a0b c") for n in range(4)], "t string, n int")
    for r in texts.select("t", "n", mixing.first_words(F.col("t"), F.col("n")).alias("got")).collect():
        assert r.t.startswith(r.got) and mixing_words(r.got) == mixing_words(r.t)[: r.n]


def mixing_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


@pytest.mark.parametrize("quality", [1.0, 0.25, 0.001, 30.0])
def test_places_of_keys(spark, quality):
    """Keys of one quality spread over all buckets, in their order."""
    key = -F.ln(mixing.uniform(1, F.col("id"))) / F.lit(quality)
    rows = spark.range(20_000).select(key.alias("k"), mixing.place(key).alias("p")).orderBy("k").collect()
    p = np.array([r.p for r in rows])
    assert (np.diff(p) >= 0).all() and 0 <= p[0] and p[-1] <= 1
    assert np.bincount((p * 1000).astype(int)).max() <= 2 * 52 * len(p) / 1000


def test_mixing_prefers_quality(spark):
    rows = spark.range(4000).selectExpr("id AS doc_id", "'a b c' AS text", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS source", "id % 4 < 2 AS good")
    mixed = mixing.mix(rows, quality=F.when(F.col("good"), 1.0).otherwise(0.2), weights=(1, 9), ratio=0.5, keep=("good",))
    first = {r.kept_good: r.n for r in mixed.filter("source = 'a' AND taken > 0").groupBy("kept_good").agg(F.count("*").alias("n")).collect()}
    assert first[True] > 2 * first.get(False, 0)


def test_language_held_out_accuracy(spark, sf_dir, edges, edge_rows, none):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    told = langid.identify(docs, keep=("lang",)).filter("held_out").collect()
    assert told and np.mean([r.lang_pred == r.kept_lang for r in told]) > 0.97 and all(0 <= r.score <= 1 for r in told)
    rows = langid.identify(edges, keep=("doc_id", "text")).collect()
    assert len(rows) == len(edge_rows)
    for r in rows:
        blank = not any(c.isalpha() for c in r.kept_text or "")
        assert (r.lang_pred == "und" and r.score == 0) if blank else r.lang_pred == "en"
    assert langid.identify(none).count() == 0
    unlabelled = langid.identify(edges.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in unlabelled] == ["und"]


def test_forward_pass_sums_all_segmentations():
    pieces = langid.Pieces("piece_bpe_32k.model")
    probs = np.zeros((len(pieces.number) + 2, 1))
    rng = np.random.default_rng(0)
    probs[:-2, 0] = rng.uniform(0.1, 1, len(pieces.number))
    probs[-1] = 1e-3

    def brute(w):
        if not w:
            return 1.0
        total = 0.0
        for j in range(1, len(w) + 1):
            p = pieces.number.get(w[:j])
            q = probs[p, 0] if p is not None else 1e-3 if j == 1 else 0.0
            if q:
                total += q * brute(w[j:])
        return total

    for w in ("the", "station", "qx", "über"):
        assert langid.log_scores(pieces, probs, [w])[w][0] == pytest.approx(np.log(brute("▁" + w)))
    long = langid.log_scores(pieces, probs * 1e-3, ["ab" * 2000])["ab" * 2000][0]
    assert np.isfinite(long)


def test_token_store_round_trip(spark, edges, edge_rows, none, tmp_path):
    path = str(tmp_path / "store")
    summary = tokenstore.write_store(edges, path)
    got = tokenstore.read_digests(spark, path).orderBy("start").collect()
    assert summary["documents"] == len(got) == len(edge_rows)
    keys = [(-1 if r.doc_id is None else r.doc_id) for r in got]
    assert keys == sorted(keys) and got[0].start == 0
    want = Counter((r[0], tuple(library().encode(r[1] or "", add_special_tokens=False).ids + [0])) for r in edge_rows)
    back = Counter((r.doc_id, tuple(np.frombuffer(r.ids, "<u2").tolist())) for r in tokenstore.reconstruct(spark, path).collect())
    assert back == want
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    crcs = Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got)
    assert crcs == Counter({(k, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())): n for (k, ids), n in want.items()})
    chunks = spark.read.parquet(f"{path}/encoded/kind=chunk")
    assert chunks.count() == chunks.select("address").distinct().count()
    assert tokenstore.stored_digests(none).count() == 0


def rewritten(spark, path, change):
    """The Parquet table at path put in place of itself after change."""
    import shutil

    change(spark.read.parquet(path)).write.parquet(path + "-new")
    shutil.rmtree(path)
    shutil.move(path + "-new", path)


def swapped(recipes):
    """The recipes of documents 5 and 8 exchanged, roots and all."""
    other = F.when(F.col("doc_id") == 5, 8).when(F.col("doc_id") == 8, 5).otherwise(F.col("doc_id"))
    moved = recipes.select(other.alias("doc_id"), *[F.col(c).alias(f"{c}_2") for c in ("addresses", "lengths", "root", "n_tokens")])
    kept = recipes.filter("doc_id IN (5, 8)").drop("addresses", "lengths", "root", "n_tokens").join(moved, "doc_id")
    return recipes.filter("doc_id IS NULL OR doc_id NOT IN (5, 8)").unionByName(kept.select(*[F.col(c if c in kept.columns else f"{c}_2").alias(c) for c in recipes.columns]))


DAMAGE = [
    ("encoded/kind=chunk", lambda t: t.withColumn("ids", F.concat("ids", F.lit(b"\0\0"))), "match its address"),
    ("encoded/kind=chunk", lambda t: t.filter(F.hex("address") > "2"), "missing or of another length"),
    ("documents", lambda t: t.filter("doc_id IS NULL OR doc_id <> 5"), "don't match the manifest"),
    ("documents", lambda t: t.withColumn("addresses", F.reverse("addresses")), "match its root"),
    ("documents", swapped, "don't match the manifest"),
    ("manifest", lambda t: t.withColumn("root", F.when(F.col("part") == 0, F.lit(b"x" * 16)).otherwise(F.col("root"))), "don't match the manifest"),
    ("manifest", lambda t: t.withColumn("tokens", F.col("tokens") + 1), "don't match the manifest"),
    ("manifest", lambda t: t.filter("part <> 0"), "don't match the manifest"),
]


@pytest.mark.parametrize("kind", range(len(DAMAGE)))
def test_token_store_detects_damage(spark, edges, tmp_path, kind):
    path = str(tmp_path / "store")
    tokenstore.write_store(edges, path)
    at, change, message = DAMAGE[kind]
    rewritten(spark, f"{path}/{at}", change)
    for read in (tokenstore.read_digests, tokenstore.reconstruct):
        with pytest.raises(Exception, match=message):
            read(spark, path).collect()


def test_token_store_root(spark, edges, tmp_path):
    path = str(tmp_path / "store")
    told = tokenstore.write_store(edges, path)
    assert tokenstore.read_digests(spark, path, root=told["root"]).count() == told["documents"]
    with pytest.raises(ValueError, match="root"):
        tokenstore.read_digests(spark, path, root="00" * 16)


def test_chunks_follow_content():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50_000, 20_000).astype(np.uint16), rng.integers(0, 50_000, 777).astype(np.uint16)
    ends = lambda x: tokenstore.cuts(len(x), tokenstore.hits(x))
    one, two = ends(a), ends(np.r_[b, a])
    parts = lambda x, e: {x[i:j].tobytes() for i, j in zip([0, *e], e)}
    assert len(parts(a, one) & parts(np.r_[b, a], two)) > 0.8 * len(one)
    sizes = np.diff([0, *one])
    assert sizes.max() <= tokenstore.GREATEST and sizes[:-1].min() >= tokenstore.LEAST


def test_crc_of_parts():
    data = random.Random(1).randbytes(5000)
    parts = [data[:1], data[1:1000], data[1000:]]
    assert tokenstore.compose([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(data)


def test_sharding(spark, edges, edge_rows, none, docs):
    for df, rows in ((edges, [(r[0], r[1]) for r in edge_rows]), (docs, [(r.doc_id, r.text) for r in docs.collect()])):
        got = sharding.shard(df, shards=8).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((k, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for k, t in rows)
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(0 <= s < 8 for s in slots)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    mean = sum(sizes.values()) / 8
    assert max(abs(v - mean) for v in sizes.values()) <= max(r["size"] for r in got) + 0.1 * mean
    assert sharding.shard(none).count() == 0


def test_sharding_splits_a_hot_group(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 'the same text' ELSE concat('text ', id) END AS text")
    got = sharding.shard(rows, shards=10, rows_per_piece=100).collect()
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 0.25 * max(sizes.values()) and len(got) == 3000


def test_sharding_splits_full_repeats(spark):
    """Rows that are equal in every column, and rows without an id, are still spread over shards and tasks."""
    same = spark.range(4000).selectExpr("7 AS doc_id", "'the very same row' AS text")
    rows = same.union(spark.range(2000).selectExpr("CAST(NULL AS LONG)", "'no id, one text'")).union(spark.range(2000).selectExpr("id + 100", "concat('text ', id)"))
    got = sharding.shard(rows, shards=10, rows_per_piece=100).collect()
    assert len(got) == 8000
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r)
    sizes = [sum(r["size"] for r in s) for s in slots.values()]
    assert len(slots) == 10 and max(sizes) - min(sizes) <= 0.1 * max(sizes)
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in slots.values())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>";</script></head><body>
<header class="site"><a href="/">Home</a> Welcome, dear reader.</header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice">We use cookies, as all do, and we like them very much indeed.</div>
<div id="main"><article><h1>Title &amp; more</h1><p>First <b>bold</b>
 paragraph, with   some text. It goes on, and on, for a while.<p>Second one, unclosed; &lt;tag&gt; &#233;t&eacute;.<br>next line.</p>
<div class="ad">Buy now, pay later, never regret it.</div><ul><li>item one, short<li>item two</ul><p>Ok.</p></article>
<aside>Related: other things, many things.</aside><form>Name: <input> Send, please.</form>
<section class="comments"><p>I disagree, with all of this, my friend. It is wrong, very wrong, and badly put.</p></section></div>
<footer>&copy; all rights, always.</footer></body>"""


def test_html(spark, none):
    want = "Title & more\n\nFirst bold paragraph, with some text. It goes on, and on, for a while.\n\nSecond one, unclosed; <tag> été. next line.\n\nitem one, short\n\nitem two\n\nOk."
    assert htmltext.main_text(PAGE) == want
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "", "x"), (None, "w", "just text, no tags", "x"), (5, "c", "<p>cut off, in a <a href='", "x"), (6, "e", "<html><script>only()", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {(r.page_id, r.url): (r.text, r.n_chars) for r in htmltext.extract(df).collect()}
    assert htmltext.extract(df).count() == 7 and got[1, "u"] == (want, len(want))
    assert got[2, None] == got[3, "v"] == got[6, "e"] == ("", 0) and got[None, "w"][0] == "just text, no tags" and got[5, "c"][0] == "cut off, in a"
    assert htmltext.extract(df.filter("page_id > 99")).count() == 0


def test_html_headers_and_forms():
    whole = "<body><form id='aspnet'><div class='menu'>Home</div><h1>T</h1><p>All text, in a form.</p></form></body>"
    assert htmltext.main_text(whole) == "T\n\nAll text, in a form."
    own = "<body><div class='header'>Site, of sites.</div><article><header class='post-header'><h1>T</h1></header><p>Text, more text.</p></article></body>"
    assert htmltext.main_text(own) == "T\n\nText, more text."
    div = "<body><div id='nav'><a>x</a></div><div class='content'><h2>Head</h2><div>Text, with marks; and more of it.</div><div>Short.</div></div><div class='sidebar'>Side, bar.</div></body>"
    assert htmltext.main_text(div) == "Head\n\nText, with marks; and more of it.\n\nShort."


def test_html_pages(spark, sf_dir):
    def article(h):
        inner = re.split(r"</article>|<footer", h.split("<article>", 1)[1])[0]
        blocks = (re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", b)) for b in re.split(r"</?(?:p|h1|ul|li|div)\b[^>]*>", inner))
        import html

        return "\n\n".join(t for b in blocks if (t := re.sub(r"\s+", " ", html.unescape(b)).strip()))

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    assert {r.page_id: r.text for r in htmltext.extract(pages).collect()} == want


def vectors(spark, n, d=16, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, d))
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)]
    rows += [(n, None, "c"), (n + 1, [], "c"), (n + 2, [float("nan")] * d, "c"), (n + 3, [float("inf")] * d, "c"), (n + 4, [None] * d, "c"), (n + 5, [0.0] * d, "c"), (20, x[20].tolist(), "c"), *[(n + 100 + i, x[40].tolist(), "c") for i in range(60)]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string").repartition(3), rows


def usable(rows, zero):
    return [(i, np.array(v)) for i, v, _ in rows if v and all(c is not None and np.isfinite(c) for c in v) and (zero or np.any(np.array(v) != 0))]


def test_exact_top_k(spark):
    df, rows = vectors(spark, 400)
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, block_rows=64, query_rows=8).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    valid = [(i, np.floor(256 * v).astype(int)) for i, v in usable(rows, True)]
    for i, q in valid:
        if i % 20 == 0 and i != 20:
            best = sorted(((-int(q @ c), j) for j, c in valid if j != i))[:5]
            assert sorted(got[i]) == [(k, j, -s) for k, (s, j) in enumerate(best, 1)]
    assert topk.top_k(df.filter("vec_id < 0"), F.lit(True)).count() == 0
    assert topk.top_k(df.filter("vec_id < 3"), F.col("vec_id") == 0).count() == 2


def test_top_k_cutoff_is_safe_for_negative_scores(spark):
    rows = [(i, [-1.0 - i, -2.0, -3.0, -1.0]) for i in range(40)] + [(100, [1.0, 1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 100).orderBy("rank").collect()]
    assert got == [(i, -256 * 256 * (7 + i)) for i in range(5)]


def test_ann_recall(spark):
    df, rows = vectors(spark, 1500, seed=3)
    index = ann.build_index(df)
    got = defaultdict(list)
    for r in ann.search(index, df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    valid = usable(rows, False)
    ids, x = np.array([i for i, _ in valid]), np.stack([v for _, v in valid])
    hit = total = 0
    for i, q in valid:
        if i % 20 == 0 and i != 20:
            s = x @ q
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:20]
            hit += len({ids[j] for j in order} & {v for _, v, _ in got[i]})
            total += 20
            assert [k for k, _, _ in sorted(got[i])] == list(range(1, 21))
            for _, v, score in got[i]:
                assert v != i and score == pytest.approx(float(q @ x[np.flatnonzero(ids == v)[0]]))
    assert hit / total >= 0.95
    assert ann.search(ann.build_index(df.filter("vec_id < 0")), df, F.lit(True)).count() == 0


def brute_simhash(rows):
    import xxhash

    def fp(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        hs = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), seed=42) for i in range(max(1, len(w) - 3))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    f = [(i, fp(t)) for i, t in rows]
    root = list(range(len(f)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(f)):
        for b in range(a):
            if (f[a][1] ^ f[b][1]).bit_count() <= 4:
                root[find(a)] = find(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(f):
        if i is not None:
            least[find(k)].append(i)
    return Counter((i, f"{v:016x}", min(least[find(k)], default=None)) for k, (i, v) in enumerate(f))


def test_simhash(spark, edges, edge_rows, none, docs):
    near = docs.select("doc_id", "text").union(docs.filter("doc_id < 60").selectExpr("doc_id + 100000", "concat(text, ' tail')"))
    for df, rows in ((edges, [r[:2] for r in edge_rows]), (near, [tuple(r) for r in near.collect()])):
        got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(df).collect())
        assert got == brute_simhash(rows)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_balls_meet(spark, radius):
    rng = random.Random(radius)
    base = [rng.getrandbits(64) for _ in range(60)]
    near = [b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(1, 6))) for b in base for _ in range(3)]
    values = sorted({v - (1 << 64) if v >> 63 else v for v in base + near})
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.component for r in graph.components(simhash.links(df, radius=radius, prefix_bits=6)).collect()}
    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                assert got[a] == got[b]
    for v in got:
        assert any(v != w and ((v ^ w) & (2**64 - 1)).bit_count() <= radius for w in values)


@pytest.mark.parametrize("radius", [1, 3, 4])
def test_divided_prefixes(spark, monkeypatch, radius):
    """A dense cluster below one prefix, divided among tasks and formed in slices, gives the brute-force classes."""
    monkeypatch.setattr(simhash, "PREFIX_VARIANTS", 20_000)
    monkeypatch.setattr(simhash, "_VARIANTS", 30_000)
    rng = random.Random(radius)
    values = sorted({rng.getrandbits(63) if rng.random() < 0.1 else (5 << 58) ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for _ in range(500)})
    values = [v - (1 << 64) if v >> 63 else v for v in values]
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                a2, b2 = find(a), find(b)
                root[max(a2, b2)] = min(a2, b2)
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.component for r in graph.components(simhash.links(df, radius=radius, prefix_bits=6)).collect()}
    assert {v: got.get(v, v) for v in values} == {v: find(v) for v in values}


def test_meetings_in_slices(monkeypatch):
    fps = np.random.default_rng(0).integers(0, 2**63, 50).astype(np.uint64)
    fps = np.unique(np.r_[fps, fps ^ np.uint64(5)])
    left = np.full(len(fps), 1)
    whole = simhash.meetings(fps, left, 58)
    monkeypatch.setattr(simhash, "_VARIANTS", 500)
    assert simhash.meetings(fps, left, 58).tolist() == whole.tolist() and len(whole)


def test_slices_of_a_cloud():
    """Variants of near copies of one text spread evenly over slices; each lies in one, the same from either end."""
    rng = np.random.default_rng(1)
    flips = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 4, replace=False).astype(np.uint64)) for _ in range(500)])
    fps, m = np.unique(np.uint64(rng.integers(2**63)) ^ flips), simhash.masks(52, 2)
    variants = fps[:, None] ^ m[None, :]
    slices = simhash.slice_of(variants, 6)
    assert np.bincount(slices.ravel().astype(int), minlength=64).max() < 1.5 * variants.size / 64
    assert (slices == (simhash.slice_of(fps, 6)[:, None] ^ simhash.slice_of(m, 6)[None, :])).all()
    fps = rng.permutation(fps)[:15]
    left = np.full(len(fps), 2)
    whole, parts = simhash.Forest(len(fps)), simhash.Forest(len(fps))
    whole.link(simhash.meetings(fps, left, 52))
    for k in range(8):
        for pairs in simhash.meeting_slices(fps, left, 52, 2, 2, 3, k):
            parts.link(pairs)
    assert parts.root.tolist() == whole.root.tolist() and 1 < len(set(parts.root)) < len(fps)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)] + [(5, 5), (None, 3)]
    root = {x: x for p in pairs if None not in p for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is not None:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert got == {x: find(x) for x in got} and {x for p in pairs if p[0] is not None and p[0] != p[1] for x in p} <= set(got)
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_repeated_passages(spark, none):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    fresh = lambda n: [word() for _ in range(n)]
    passage, short = fresh(60), fresh(12)
    texts = {i: fresh(150) for i in range(40)}
    for i in (3, 17, 30):
        texts[i] = texts[i][:70] + passage + texts[i][70:]
    edited = [*passage[:8], "changed", *passage[9:]]
    texts[33] = texts[33][:10] + edited + texts[33][10:]
    for i in range(0, 40, 2):
        texts[i] = texts[i] + short
    rows = [(i, " ".join(t), "x") for i, t in texts.items()] + [(50, None, "x"), (51, "", "x"), (None, " ".join(passage), "x"), (3, " ".join(texts[3]), "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, place string")
    spans = substring.repeated_spans(df).collect()
    assert {r.doc_id for r in spans} == {17, 30, 33} and {r.kept_doc_id for r in spans} == {3}
    for r in spans:
        lo, hi = (70, 130) if r.doc_id != 33 else (19, 70)
        assert lo <= r.start_word and r.start_word + r.n_words <= hi
    cut = {r.doc_id: r.text for r in substring.remove_spans(df, substring.repeated_spans(df)).filter("doc_id IS NOT NULL").collect()}
    for i in (17, 30):
        assert " ".join(passage) not in cut[i] and set(texts[i][:70] + texts[i][130:]) <= set(cut[i].split())
    assert all(cut[i] == " ".join(texts[i]) for i in texts if i not in (17, 30, 33))
    assert substring.repeated_spans(none).count() == 0
    with pytest.raises(ValueError):
        substring.repeated_spans(df, similarity=0.5)


def test_repeated_passages_of_documents(spark, docs):
    """Every document that repeats over 50 words of one before it is found."""
    seen, want = {}, set()
    for r in docs.orderBy("doc_id").collect():
        w = (r.text or "").lower().split()
        for i in range(len(w) - 50):
            if seen.setdefault(tuple(w[i : i + 51]), r.doc_id) != r.doc_id:
                want.add(r.doc_id)
    got = {r.doc_id for r in substring.repeated_spans(docs).collect()}
    assert want and len(want - got) <= 0.03 * len(want)


@pytest.mark.parametrize("search", ["top_k", "ann"])
def test_ties_and_repeated_ids(spark, search):
    """Ties go to smaller ids; rows with one id are one query and candidates each on its own."""
    rows = [(i, [1.0, 0.0]) for i in range(40)] + [(100, [2.0, 0.0])] * 3 + [(200, [1.0, 0.0]), (200, [0.0, 3.0]), (300, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    if search == "top_k":
        got = topk.top_k(df, F.col("vec_id").isin(5, 200), scale=1, k=6)
    else:
        got = ann.search(ann.build_index(df), df, F.col("vec_id") == 5, k=6)
    found = defaultdict(list)
    for r in got.orderBy("query_id", "rank").collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    assert found[5] == [(1, 100, 2), (2, 100, 2), (3, 100, 2), (4, 0, 1), (5, 1, 1), (6, 2, 1)]
    if search == "top_k":
        assert [s for _, _, s in found[200]] == [3, 2, 2, 2, 1, 1] and found[200][0][1] == 300


def test_queries_in_parts(spark, monkeypatch):
    """Queries beyond what may be broadcast are sent in parts, with the same results."""
    from pairlab.llm import vectors as packs

    df, _ = vectors(spark, 200)
    search = lambda: sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 3 == 0, block_rows=64, query_rows=8).collect())
    whole = search()
    monkeypatch.setattr(packs, "QUERY_BYTES", 3000)
    assert search() == whole


def test_em_counts_are_those_of_all_segmentations():
    """One round of the fit against expected piece counts summed over every segmentation."""
    pieces = langid.Pieces.__new__(langid.Pieces)
    pieces.number = {p: i for i, p in enumerate(["▁", "▁a", "a", "b", "ab", "ba"])}
    pieces.longest, pieces.absent, pieces.other = 2, 6, 7
    counts = {"ab": 3, "ba": 2, "abab": 1, "xa": 1}

    def split(w):
        if not w:
            yield []
        for k in (1, 2):
            p = w[:k]
            if len(p) == k and (p in pieces.number or k == 1):
                for rest in split(w[k:]):
                    yield [p, *rest]

    def normalised(found):
        found = np.array([found[p] for p in pieces.number]) + langid._UNSEEN
        return dict(zip(pieces.number, found / found.sum()))

    spans = Counter()
    for w, n in counts.items():
        m = "▁" + w
        spans.update({p: 0 for p in pieces.number})
        for i in range(len(m)):
            for k in (1, 2):
                if m[i : i + k] in pieces.number and i + k <= len(m):
                    spans[m[i : i + k]] += n
    probs = normalised(spans)
    assert langid.fit(pieces, counts, 0)[:-2] == pytest.approx(list(probs.values()))
    for _ in range(2):
        expected = Counter({p: 0.0 for p in pieces.number})
        for w, n in counts.items():
            ways = [(s, np.prod([probs.get(p, langid._CHARACTER) for p in s])) for s in split("▁" + w)]
            total = sum(q for _, q in ways)
            for s, q in ways:
                for p in s:
                    if p in pieces.number:
                        expected[p] += n * q / total
        probs = normalised(expected)
    assert langid.fit(pieces, counts, 2)[:-2] == pytest.approx(list(probs.values()))


def test_language_learns_from_runs_without_spaces(spark):
    """Two languages whose texts are single runs of hundreds of letters, an id on all rows of one, and more languages than are learned."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        lang, letters = (("ja", "あいうえお"), ("zh", "的一是不了"))[i % 2]
        rows.append((7 if lang == "ja" and i % 3 else i, "".join(rng.choice(letters) for _ in range(rng.randint(60, 400))), lang))
    rows += [(1000 + i, f"rare words here {i}", "xx") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = langid.identify(df, keep=("lang",), max_langs=2).collect()
    assert all(r.lang_pred == r.kept_lang for r in told if r.kept_lang != "xx") and {r.lang_pred for r in told} == {"ja", "zh"}
    assert langid.train(df)[0] == ["ja", "xx", "zh"]


def test_bands_of_long_texts_in_parts(monkeypatch):
    text = " ".join(f"w{k * k % 977}" for k in range(300)) + "\n" + " ".join(f"v{k}" for k in range(90))
    whole = substring.lines(*substring.hashed(text), 24, 4, 2)
    monkeypatch.setattr(substring, "_AT_ONCE", 900)
    parts = substring.lines(*substring.hashed(text), 24, 4, 2)
    assert all((a == b).all() for a, b in zip(whole, parts)) and whole[0].tolist() == [0, 300] and whole[3].shape == (2, 4)


def test_tuned_bands():
    assert substring.tuned(0.8, 0.98) == 4 and substring.tuned(1.0, 0.99) == 1
    for b in (1, 2, 3):
        assert 1 - (1 - 0.64) ** b < 0.98


def test_without_ignores_what_lies_beyond():
    assert substring.without("a b", [(5, 20)]) == "a b" and substring.without("a b c", [(1, 9)]) == "a" and substring.without("", [(0, 3)]) == ""
    assert substring.without("a b c d", [(0, 2), (1, 2)]) == "d"


def test_similar_lines_against_brute_force(spark):
    """Lines with interior edits: nearly all pairs of a Jaccard similarity of 0.8 or more end in one component."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    texts = []
    for group in range(40):
        base = [word() for _ in range(rng.randint(60, 140))]
        for _ in range(6):
            own = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 2, 3))):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice(([word()], [], [own[k], word()]))
            texts.append((group, " ".join([word() for _ in range(30)]) + "\n" + " ".join(own) + "\n" + " ".join(word() for _ in range(30))))
    order = list(range(len(texts)))
    rng.shuffle(order)
    docs = [(i, texts[k][1]) for i, k in enumerate(order)]
    sets = {i: {tuple(w[j : j + 5]) for w in [t.split("\n")[1].split()] for j in range(len(w) - 4)} for i, t in docs}
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = substring.places(substring.taking_part(df, "doc_id", "text"), 11, 24, 4, 2).filter("n IS NOT NULL").cache()
    assert found.count() == 3 * len(docs)
    line = {(r.doc_id, r.place): r.band_key for r in found.collect()}
    middle = {i: line[i, 30] for i, _ in docs}
    classes = found.groupBy(F.col("band_key").alias("class")).agg(F.min(F.struct("doc_id", "place", "n")).alias("line"), F.max("doc_id").alias("last_doc"), F.count("*").alias("docs"), F.first("bands").alias("bands")).select("class", "line.*", "last_doc", "docs", "bands")
    pairs = {(r.u, r.v) for r in substring.line_pairs(classes, 0.8).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    of = {c: i for i, c in middle.items()}
    for u, v in pairs:
        if u in of and v in of:
            a, b = sets[of[u]], sets[of[v]]
            if len(a & b) >= 0.8 * len(a | b):
                root[find(u)] = find(v)
    want = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    hit = sum(find(middle[i]) == find(middle[j]) for i, j in want)
    assert len(want) > 200 and hit >= 0.97 * len(want)
    kept = {}
    for r in substring.repeated_spans(df).collect():
        kept.setdefault(r.doc_id, []).append((r.start_word, r.n_words))
    later = {max(p) for p in want}
    assert sum(i in kept for i in later) >= 0.98 * len(later)


def test_a_hot_group_of_near_copies(spark):
    """600 edits of one line are found without forming their pairs."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(600):
        own = list(base)
        own[rng.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = substring.places(df, 11, 24, 4, 2).filter("n IS NOT NULL")
    classes = found.groupBy(F.col("band_key").alias("class")).agg(F.min(F.struct("doc_id", "place", "n")).alias("line"), F.max("doc_id").alias("last_doc"), F.count("*").alias("docs"), F.first("bands").alias("bands")).select("class", "line.*", "last_doc", "docs", "bands")
    assert substring.line_pairs(classes, 0.8).count() <= 600 * 4 * (substring.SIDE + 1)
    got = {r.doc_id: r.n for r in substring.repeated_spans(df).groupBy("doc_id").agg(F.sum("n_words").alias("n")).collect()}
    assert len(got) >= 590 and min(got.values()) >= 90


def test_texts_under_one_id(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(1, passage + " one"), (2, "start here " + passage), (2, "short"), (2, "start here " + passage), (3, None), (None, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'s' AS spans", "'t' AS span_doc", "'u' AS span_text")
    spans = substring.repeated_spans(df)
    cut = substring.remove_spans(df, spans)
    assert cut.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in cut.collect())
    least = min((("short", 1), ("start here " + passage, 2)), key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t[0]))).first()[0])
    whole = Counter((i, t) for i, t in rows)
    if least[0] == "short":
        assert got == whole
    else:
        whole[2, "start here " + passage] -= 2  # one line, near enough to the kept one to go whole
        assert got == +whole


def test_op8_matches_sql(spark, sf_dir):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    got = sorted(tuple(r) for r in queries.op8_topk(spark, sf_dir).select("query_id", "rank", "vec_id", "score").collect())
    assert got == sorted(c.execute(queries.oracle_sql()["op8_topk"]).fetchall())
