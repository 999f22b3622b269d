"""The staleness machine, merges, prunes, snapshots and models."""

import pytest
from pyspark.sql import functions as F

from symgraph.operators import evaluate, find, models, patterns, store, vector

COLS = "qualified_name string, short_name string, kind string, file_path string, start_line int, end_line int, signature string, exported boolean, synthesized_description string, embedding array<float>, body_hash string, description_source_hash string"


def sym(q, d=None, b=None, s=None, f="a.rs", e=None, exported=True):
    return (q, q.rpartition("::")[2], "function", f, 1, 3, f"fn {q}()", exported, d, e, b, s)


def df(spark, *rows):
    return spark.createDataFrame(list(rows), COLS)


def rows(d, *cols):
    return {tuple(r) for r in d.select(*cols).collect()}


def test_upsert_keeps_hash_and_description(spark):
    old = df(spark, sym("a.rs::x", "told", "h1", "h1", e=[1.0]), sym("a.rs::z"))
    delta = df(spark, sym("a.rs::x", "ignored", None), sym("a.rs::y", None, "h2"), sym("a.rs::y", None, "h3")).withColumn("ordinal", F.monotonically_increasing_id())
    assert rows(store.upsert_symbols(old, delta), "qualified_name", "synthesized_description", "body_hash", "description_source_hash") == {("a.rs::x", "told", "h1", "h1"), ("a.rs::y", None, "h3", None), ("a.rs::z", None, None, None)}


def test_description_stamps_and_clears(spark):
    s = df(spark, sym("q", None, "h1"))
    d = spark.createDataFrame([("q", 'two\nlines "quoted"\t\\', [0.5])], "qualified_name string, synthesized_description string, embedding array<float>")
    told = store.set_description_and_embedding(s, d)
    assert rows(told, "synthesized_description", "description_source_hash") == {('two\nlines "quoted"\t\\', "h1")}
    same = store.restamp(told, spark.createDataFrame([("q", "h1")], "qualified_name string, body_hash string"))
    assert rows(same, "synthesized_description", "body_hash") == {('two\nlines "quoted"\t\\', "h1")}
    edited = store.restamp(told, spark.createDataFrame([("q", "h2")], "qualified_name string, body_hash string"))
    assert rows(edited, "qualified_name", "synthesized_description", "description_source_hash", "body_hash") == {("q", None, None, "h2")}
    re = store.clear_and_reembed(told, spark.createDataFrame([("q", "h9", [2.0])], "qualified_name string, body_hash string, embedding array<float>"))
    assert rows(re, "synthesized_description", "body_hash") == {(None, "h9")} and re.first()["embedding"] == [2.0]


def test_backfill_stale_clear_and_batch(spark):
    s = df(spark, sym("legacy", "d", "h1"), sym("fresh", "d", "h1", "h1"), sym("old", "d", "h2", "h1"), sym("none", "", "h1", ""))
    new, n = store.backfill_source_hashes(s)
    assert n.first()["n_updated"] == 1 and rows(new.filter("qualified_name = 'legacy'"), "description_source_hash") == {("h1",)}
    assert rows(patterns.stale_descriptions(s), "qualified_name") == {("old",)}
    assert store.clear_all_descriptions(s)[1].first()["n_cleared"] == 3
    want = spark.createDataFrame([("fresh",), ("none",), ("nowhere",)], "qualified_name string")
    assert rows(patterns.source_hashes(s, want), "qualified_name", "description_source_hash") == {("fresh", "h1")}
    assert rows(patterns.source_hashes(s, want.limit(0)), "qualified_name") == set()
    assert rows(patterns.describe(s).filter("qualified_name = 'none'"), "synthesized_description", "description_source_hash") == {(None, None)}
    assert patterns.describe(s).filter("qualified_name = 'nowhere'").count() == 0


def test_prune_and_forget(spark):
    s = df(spark, sym("a.rs::x"), sym("a.rs::y"), sym("b.rs::z", f="b.rs"))
    e = spark.createDataFrame([("a.rs::x", "b.rs::z", "calls", "lsp"), ("a.rs::y", "a.rs::x", "calls", "lsp")], "from_qname string, to_qname string, kind string, edge_source string")
    keep = spark.createDataFrame([("a.rs::x",)], "qualified_name string")
    assert rows(store.prune_stale(s, s.filter("file_path = 'a.rs'"), keep), "qualified_name") == {("a.rs::x",), ("b.rs::z",)}
    assert rows(store.prune_stale(s, s.filter("file_path = 'a.rs'"), keep.limit(0)), "qualified_name") == {("b.rs::z",)}
    files = spark.createDataFrame([("a.rs",), ("b.rs",)], "path string")
    s2, e2, f2 = store.forget_files(s, e, files, files.filter("path = 'b.rs'"))
    assert rows(s2, "qualified_name") == {("a.rs::x",), ("a.rs::y",)} and rows(e2, "from_qname") == {("a.rs::y",)} and rows(f2, "path") == {("a.rs",)}


def test_snapshots_flip_in_one_step(spark, tmp_path):
    snaps = store.Snapshots(spark, str(tmp_path))
    assert snaps.current() is None
    snaps.publish({"t": spark.range(2)})
    snaps.publish({"t": spark.range(5)})
    assert snaps.read("t").count() == 5 and snaps.current().startswith("00000002")


def test_schema_and_embedder_guards(spark):
    m = spark.createDataFrame([("r", "stub/a", 64, 1), ("old", "stub/a", 64, 0)], "repo_id string, embedder_identity string, embedder_dimension int, schema_version int")
    store.check_schema_version(m, "r")
    store.check_schema_version(m, "unknown")
    with pytest.raises(store.SchemaMismatch):
        store.check_schema_version(m, "old")
    vector.check_embedder(m, "unknown", "x", 1)
    with pytest.raises(vector.EmbedderMismatch, match="stub/a@64.*stub/b@64"):
        vector.check_embedder(m, "r", "stub/b", 64)


def test_find_and_models(spark):
    emb = models.HashEmbedder(16)
    t = spark.createDataFrame([("a", "merge two graphs"), ("b", "parse the config"), ("c", None)], "qualified_name string, text string")
    s = models.embed_column(t, emb, "text")
    m = spark.createDataFrame([("r", emb.identity, 16, 1)], "repo_id string, embedder_identity string, embedder_dimension int, schema_version int")
    assert [r[0] for r in find.find(s, m, "r", emb, "config parse", 5).collect()] == ["b", "a"]
    todo = spark.createDataFrame([("q1", "Signature: fn a()", False), ("q2", "nothing", False), ("q3", "x", True), ("q4", None, False)], "q string, prompt string, has_description boolean")
    got = models.synthesize(todo, models.FirstLineSynthesizer())
    assert rows(got, "q", "synthesized_description", "status") == {("q1", "fn a()", "synthesized"), ("q2", None, "failed"), ("q3", None, "skipped"), ("q4", None, "failed")}
    assert tuple(evaluate.outcome_counters(got).first()) == (4, 1, 1, 2)
    assert models.OverlapReranker().rerank("a b", ["a", "x"]) == [0.5, 0.0] and models.OverlapReranker().rerank("", ["a"]) == [None]


def test_rerank_degrades_to_cosine(spark):
    c = spark.createDataFrame([("a", 0.2, "vector"), ("b", 0.9, "vector"), ("c", None, "graph")], "node string, cosine double, origin string")
    got = find.reranked(c, F.lit(None).cast("double")).collect()
    assert [r.node for r in got] == ["b", "a", "c"] and got[0].reranker_degraded
    got = find.reranked(c, F.when(F.col("node") == "c", 1.0)).collect()
    assert got[0].node == "c" and not got[0].reranker_degraded
