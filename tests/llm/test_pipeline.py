"""The pipeline's stages on the smallest documents, each against its operator's own law."""

import re
from collections import Counter

import corpus_pipeline
from pairlab.llm import queries


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.limit(1).selectExpr("doc_id", "text", "lang", "source", "n_chars")
    odd = spark.createDataFrame([(900001, None, None, None, None), (900002, "12 34 !!", "en", "s", 8), (None, "no id, but words", "en", "s", 16)], docs.schema)
    now = docs.unionByName(extra).unionByName(odd)
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, now, sf_dir).write.parquet(path)
        now = spark.read.parquet(path)
        kept[name] = now
        if k < 4:
            assert now.columns == columns
    told = kept["language ID"]
    assert told.filter("doc_id IN (900001, 900002)").count() == 0 and told.count() == docs.count() + 2
    groups = Counter(r.component_id for r in corpus_pipeline.simhash.near_duplicates(docs).collect())
    assert Counter(r.doc_id for r in kept["SimHash near-dedup"].collect()) == Counter({g: 1 for g in [*groups, None]})
    before = {r.doc_id: r.text for r in kept["SimHash near-dedup"].collect()}
    after = {r.doc_id: r for r in kept["substring dedup"].collect()}
    spans = {r.doc_id for r in corpus_pipeline.substring.repeated_spans(kept["SimHash near-dedup"]).collect()}
    assert spans and all((after[i].text == t) != (i in spans) for i, t in before.items() if i in after)
    assert all(r.n_chars == len(r.text) for r in after.values())
    size = lambda rows: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in rows)
    mixed = kept["mixing"].collect()
    assert max(Counter(r.doc_id for r in mixed).values()) == 2
    assert abs(size(mixed) / (1.5 * size(after.values())) - 1) < 0.05
    pieces = kept["packing"].collect()
    assert sum(p.length for p in pieces if p.start == 0) and {p.doc_id for p in pieces} == {r.doc_id for r in mixed}


def test_registered(spark):
    names = set(queries.queries())
    assert {n.split("_")[0] for n in names} == {f"op{i}" for i in range(1, 14)}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "SimHash near-dedup", "substring dedup", "mixing", "packing"]


def test_odd_tables(spark, sf_dir, tmp_path):
    """An empty table, very long texts, and ids under which different texts stand."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    few = docs.limit(40)
    long = few.limit(1).selectExpr("700001L AS doc_id", "repeat(concat(text, ' '), 400) AS text", "lang", "source", "n_chars")
    other = few.selectExpr("doc_id", "concat('another text altogether, number ', doc_id, ' of the very same id') AS text", "lang", "source", "n_chars")
    for name, table in (("none", docs.limit(0)), ("odd", few.unionByName(long).unionByName(other).unionByName(few))):
        now = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}-{k}")
            stage(spark, now, sf_dir).write.parquet(path)
            now = spark.read.parquet(path)
            if k == 1:
                assert now.groupBy("doc_id").count().filter("count > 2").count() == 0
                once = now.groupBy("doc_id", "text").count().filter("count > 1").count()
                assert once == 0
        assert (now.count() == 0) == (name == "none")
