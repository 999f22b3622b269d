"""Models over HTTP against a local server, and what belongs to a graph's own bookkeeping."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from symgraph.operators import evaluate, models, patterns, resolve, store


@pytest.fixture(scope="module")
def server():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body))
            if "fail" in json.dumps(body):
                self.send_response(500)
                self.end_headers()
                return
            if self.path == "/api/embed":
                answer = {"embeddings": [[float(len(t)), 1.0] for t in body["input"] if t != "short"]}
            else:
                answer = {"response": '"Yes!" it is' if "lamp" in body["prompt"] else "no." if "shelf" in body["prompt"] else "Description: keeps it"}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *_):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}/", asked
    s.shutdown()


def test_embedder(server):
    e = models.HttpEmbedder(server[0], "m", 2)
    assert e.embed([]) == [] and e.embed(["a", "bb"]) == [[1.0, 1.0], [2.0, 1.0]] and e.identity == "ollama/m"
    assert server[1][-1] == ("/api/embed", {"model": "m", "input": ["a", "bb"]})
    for bad in (["a", "short"], ["short"]):
        with pytest.raises(models.ModelError):
            e.embed(bad)
    with pytest.raises(models.ModelError):
        models.HttpEmbedder(server[0], "m", 3).embed(["a"])


def test_synthesizer(server):
    assert models.HttpSynthesizer(server[0], "m").synthesize("x") == "Description: keeps it"
    assert server[1][-1][1]["options"] == {"temperature": 0.2} and server[1][-1][1]["stream"] is False


def test_reranker(server):
    r = models.HttpReranker(server[0], "m")
    assert r.rerank("q", ["a lamp", "a shelf", "fail", "else"] * 5) == [1.0, 0.0, None, None] * 5 and r.rerank("q", []) == []
    with pytest.raises(models.ModelError):
        r.rerank("q", ["fail", "else"])


def test_rerank_column_degrades(spark, server):
    df = spark.createDataFrame([(1, "a lamp"), (2, "a shelf"), (3, "else"), (4, None)], "id int, d string")
    r = models.HttpReranker(server[0], "m")
    assert {x.id: x["rerank"] for x in models.rerank_column(df, r, "q", "d").collect()} == {1: 1.0, 2: 0.0, 3: None, 4: None}
    assert {x["rerank"] for x in models.rerank_column(df.filter("id > 2"), r, "q", "d").collect()} == {None}


def test_migrations_run_once(spark):
    t = spark.createDataFrame([("g", "001", None), ("other", "002", None)], "graph string, id string, applied_at timestamp_ntz")
    ran = []
    steps = {i: (lambda i=i: ran.append(i)) for i in ("001", "002", "003")}
    t2 = store.run_migrations(t, "g", steps)
    assert ran == ["002", "003"] and {r.id for r in store.applied_migrations(t2, "g").collect()} == set(steps)
    store.run_migrations(t2, "g", steps)
    assert ran == ["002", "003"] and store.run_migrations(t2, "g", {}).count() == 4


def test_manifest_rows_that_are_not_whole_are_none(spark):
    m = spark.createDataFrame([("a", "e", 2, 1, None), ("b", "e", 2, 9, None)], "repo_id string, embedder_identity string, embedder_dimension int, schema_version int, last_indexed_at timestamp_ntz")
    m = m.withColumn("last_indexed_at", F.when(F.col("repo_id") == "b", F.current_timestamp().cast("timestamp_ntz")))
    assert store.read_manifest(m, "a").count() == 0 and store.read_manifest(m, "b").count() == 1 and store.read_manifest(m, "c").count() == 0
    store.check_schema_version(m, "a")
    with pytest.raises(store.SchemaMismatch):
        store.check_schema_version(m, "b")


def test_rows_that_are_no_symbols_drop(spark):
    row = lambda q, kind="function", sig="fn": (q, kind, "f", 1, 2, sig, True)
    s = spark.createDataFrame([row("a"), row(None), row("b", "planet"), row("c", sig=None)], "qualified_name string, kind string, file_path string, start_line int, end_line int, signature string, exported boolean")
    assert [r.qualified_name for r in patterns.decoded(s).collect()] == ["a"]


def test_corpus_judgements(spark):
    corpus = spark.createDataFrame([(1, "a", ["b"]), (2, "c", None), (3, "x", [])], "query_id int, target string, alternates array<string>")
    results = spark.createDataFrame([(1, "z", 1), (1, "b", 2), (2, "c", 1)], "query_id int, node string, rank int")
    judged = evaluate.judged(results, corpus)
    assert {(r.query_id, r["rank"], r.relevant) for r in judged.collect()} == {(1, 1, False), (1, 2, True), (2, 1, True), (3, None, False)}
    assert evaluate.summary(evaluate.retrieval_metrics(judged)).first()["mrr"] == 0.5


def test_definitions_by_position(spark):
    s = spark.createDataFrame([("f::a", "f", 1, 9), ("f::b", "f", 3, 5)], "qualified_name string, file_path string, start_line int, end_line int")
    raw = spark.createDataFrame([(1, "b", "tree_sitter"), (2, "q", "tree_sitter"), (3, None, None)], "raw_id int, to_raw string, edge_source string")
    places = spark.createDataFrame([(1, "f", 4), (2, "f", 99)], "raw_id int, def_path string, def_line int")
    assert {tuple(r) for r in resolve.by_position(raw, places, s).collect()} == {(1, "f::b", "lsp"), (2, "q", "tree_sitter"), (3, None, None)}


@pytest.mark.parametrize("blocks", [(20_000, 4_000), (7, 3)])
def test_block_search_equals_brute_force(spark, monkeypatch, blocks):
    """With copies, which tie, and vectors that are nobody's neighbours."""
    import numpy as np

    from symgraph.operators import vector

    monkeypatch.setattr(vector, "ROW_BLOCK", blocks[0])
    monkeypatch.setattr(vector, "QUERY_BLOCK", blocks[1])
    rnd = np.random.default_rng(2)
    x = rnd.standard_normal((60, 8)).astype(np.float32)
    x[10:20] = x[3]
    rows = [(f"k{i:02}", [float(v) for v in r]) for i, r in enumerate(x)] + [("null", None), ("zero", [0.0] * 8), ("short", [1.0]), ("hole", [None] + [1.0] * 7)]
    df = spark.createDataFrame(rows, "key string, v array<float>")
    asked = df.filter("key < 'k25' OR key = 'zero'").select(F.col("key").alias("query_id"), F.col("v").alias("query_vector"))
    got = {}
    for r in vector.batch_top_k(df, "key", "v", asked, 8, 4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.neighbor
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    c = np.round(u @ u.T, 9)
    want = {f"k{i:02}": dict(enumerate([f"k{j:02}" for j in sorted(range(60), key=lambda j: (-c[i, j], j)) if j != i][:4], 1)) for i in range(25)}
    assert got == want
    assert vector.batch_top_k(df.limit(0), "key", "v", asked, 8, 4).count() == 0 and vector.batch_top_k(df, "key", "v", asked.limit(0), 8, 4).count() == 0


def test_lookups_see_the_latest_row_only(spark):
    log = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "new"), ("b", 2, "old"), ("c", 1, None)], "qualified_name string, indexed_at int, short_name string")
    assert {r.qualified_name for r in store.latest_where(log, F.col("short_name") == "new").collect()} == {"a"}
    assert store.latest_where(log, F.col("short_name") == "none").count() == 0


def test_intermediates_are_shared_and_can_be_dropped(spark):
    import os
    from types import SimpleNamespace as N

    from symgraph import session

    df, n, m = session.materialize_counted(spark.range(7).toDF("x"), "seven", F.col("x") > 4)
    path = session._written[-1]
    assert (n, m) == (7, 2) and df.count() == 7
    session.drop_intermediates(spark)
    assert not os.path.exists(path.removeprefix("file:")) and not session._written
    conf, none = N(get=lambda k, d: d), N(sc=lambda: N(getCheckpointDir=lambda: N(isDefined=lambda: False)))
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(N(sparkContext=N(getConf=lambda: conf, _jsc=none, master="spark://somewhere:7077")))
