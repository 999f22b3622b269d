import json
import os

from pyspark.sql import functions as F

from symgraph import cli
from symgraph.operators.models import HashEmbedder
from symgraph.sources import config, scan, sinks
from symgraph.streaming import changes


def tree(root):
    (root / "src").mkdir()
    (root / "target").mkdir()
    (root / "src/a.rs").write_text("pub fn one() { two(); }\nfn two() {}\n")
    (root / "src/b.ts").write_text("import { x } from './x';\nexport function f() { return g(1); }\nfunction g(n) { return n; }\n")
    (root / "src/bad.rs").write_bytes(b"\xff\xfe fn")
    (root / "target/c.rs").write_text("fn no() {}")
    (root / "notes.md").write_text("fn no() {}")


def test_scan_index_and_ask(spark, tmp_path):
    src = tmp_path / "repo"
    src.mkdir()
    tree(src)
    files = scan.scan(spark, str(src))
    assert {r.path for r in files.collect()} == {"src/a.rs", "src/b.ts"}
    s, e, records = scan.index(files, HashEmbedder(8))
    assert {r.qualified_name for r in s.collect()} == {"src/a.rs::one", "src/a.rs::two", "src/b.ts::f", "src/b.ts::g"}
    assert all(len(r.body_hash) == 64 and len(r.embedding) == 8 for r in s.collect())
    assert {(r.from_qname, r.to_qname, r.kind) for r in e.collect()} == {("src/a.rs::one", "src/a.rs::two", "calls"), ("src/b.ts::f", "src/b.ts::g", "calls"), ("src/b.ts", "./x", "imports")}
    stored = records.withColumn("content_hash", F.when(F.col("path") == "src/a.rs", F.col("content_hash")))
    assert {r.path for r in scan.changed(files, stored).collect()} == {"src/b.ts"}
    assert json.loads(sinks.symbols_json(s).first()["value"])["exported"] in (True, False)


def test_a_comment_behind_a_body_changes_no_hash(spark):
    v1, v2, v3 = "fn a() { 1 }\n", "fn a() { 1 }\n// note\n", "fn a() { 2 }\n"
    h = []
    for t in (v1, v2, v3):
        f = spark.createDataFrame([("a.rs", t)], "path string, text string").withColumns({"file_language": F.lit("rust"), "content_hash": F.sha2("text", 256), "last_modified": F.lit(None).cast("timestamp_ntz")})
        h.append(scan.index(f)[0].first()["body_hash"])
    assert h[0] == h[1] != h[2]


def run(capsys, store, *args):
    """Exit code and lines of a verb, with the stand-ins for models."""
    code = cli.main(["--store", store, "--stubs", *args])
    return code, capsys.readouterr().out.strip().split("\n")


def test_cli(spark, tmp_path, capsys):
    src = tmp_path / "repo"
    src.mkdir()
    tree(src)
    store = str(tmp_path / "store")
    assert run(capsys, store, "callers", "two")[0] == 1
    assert run(capsys, store, "index", str(src)) == (0, ["2 files indexed"])
    assert json.loads(run(capsys, store, "--json", "callers", "two")[1][0])["qualified_name"] == "src/a.rs::one"
    assert run(capsys, store, "describe", "nothing")[0] == 1
    assert len(run(capsys, store, "find", "g", "--limit", "2")[1]) == 2
    first = json.loads(run(capsys, store, "find", "pub fn one", "--rerank", "--root", str(src))[1][0])
    assert (first["node"], first["origin"], first["reranker_degraded"]) == ("src/a.rs::one", "vector", False) and first["rerank"] > 0.6
    assert json.loads(run(capsys, store, "query", "SELECT kind, count(*) AS n FROM {edges} WHERE kind = 'calls' GROUP BY kind")[1][0]) == {"kind": "calls", "n": 2}
    assert json.loads(run(capsys, store, "manifest")[1][0])["embedder_identity"] == "stub/words"


def test_an_index_changes_only_what_has_changed(spark, tmp_path, capsys):
    src, store = tmp_path / "repo", str(tmp_path / "store")
    src.mkdir()
    tree(src)
    versions = lambda: sorted(os.listdir(f"{store}/versions"))
    described = lambda name: json.loads(run(capsys, store, "describe", name)[1][0]).get("synthesized_description")
    run(capsys, store, "index", str(src))
    assert run(capsys, store, "set-description", "src/a.rs::two", "keeps the lamp lit")[0] == 0
    assert run(capsys, store, "set-description", "nothing", "x")[0] == 1
    assert run(capsys, store, "synthesize", str(src), "--limit", "1")[1] == ["considered=1 synthesized=1 skipped=0 failed=0"]
    before = versions()
    assert run(capsys, store, "index", str(src)) == (0, ["0 files indexed"]) and versions() == before
    assert described("src/a.rs::two") == "keeps the lamp lit" and described("src/a.rs::one") == "pub fn one() { two(); }"
    # another body of one, a new symbol, a lost one, a vanished edge; two stays as it was
    (src / "src/a.rs").write_text("pub fn one() { three(); }\nfn two() {}\nfn three() {}\n")
    (src / "src/b.ts").unlink()
    assert run(capsys, store, "index", str(src)) == (0, ["1 files indexed"])
    assert described("src/a.rs::two") == "keeps the lamp lit" and described("src/a.rs::one") is None
    assert run(capsys, store, "callers", "two")[1] == [""] and run(capsys, store, "--json", "callers", "three")[1] != [""]
    assert run(capsys, store, "definers", "f")[1] == [""]
    # edges of a language server win over the parser's
    (tmp_path / "lsp.json").write_text('{"from": "src/a.rs::one", "to": "src/a.rs::two", "kind": "calls"}\n')
    run(capsys, store, "index", str(src), "--resolved", str(tmp_path / "lsp.json"))
    assert json.loads(run(capsys, store, "--json", "callers", "two")[1][0])["qualified_name"] == "src/a.rs::one"
    # another embedder is refused until everything is made anew
    assert cli.main(["--store", store, "find", "g"]) == 1 and cli.main(["--store", store, "index", str(src)]) == 1
    assert run(capsys, store, "index", str(src), "--force-cold-rebuild") == (0, ["1 files indexed"]) and described("src/a.rs::two") is None
    assert run(capsys, store, "index", str(src), "--since", "2100-01-01") == (0, ["0 files indexed"]) and run(capsys, store, "definers", "two")[1] != [""]
    assert run(capsys, store, "synthesize", str(src), "--refresh-hashes-only")[1] == ["0 hashes refreshed"]


def test_watch_snapshots_and_follows(spark, tmp_path, capsys):
    src, store, events = tmp_path / "repo", str(tmp_path / "store"), str(tmp_path / "events")
    src.mkdir()
    tree(src)
    write = lambda *rows: spark.createDataFrame([(*r, None) for r in rows], "path string, kind string, at timestamp").coalesce(1).write.mode("append").parquet(events)
    write(("src/a.rs", "Modify"))
    assert run(capsys, store, "watch", str(src), "--events", events, "--once") == (0, ["2 files indexed"])
    (src / "src/a.rs").write_text("fn new_one() {}\n")
    (src / "src/b.ts").unlink()
    write(("src/a.rs", "Modify"), ("src/a.rs", "Modify"), ("src/b.ts", "Remove"), ("target/c.rs", "Create"), ("never.rs", "Remove"))
    from symgraph.plans.graph import Graph

    g = Graph(spark, store, "default")
    changes.apply_changes(spark, spark.read.parquet(events), lambda p: scan.scan_paths(spark, str(src), p), lambda f: g.changes(f, HashEmbedder()), g.forget)
    assert {r.qualified_name for r in g.tables()["symbols"].collect()} == {"src/a.rs::new_one"}


def test_query_time_descriptions(spark, tmp_path, capsys):
    """The nearest undescribed candidates are described and kept."""
    from symgraph.operators.models import FirstLineSynthesizer
    from symgraph.plans.graph import Graph

    src, store = tmp_path / "repo", str(tmp_path / "store")
    src.mkdir()
    tree(src)
    run(capsys, store, "index", str(src))
    g = Graph(spark, store, "default")
    cands = g.tables()["symbols"].selectExpr("qualified_name AS node", "CAST(start_line AS double) AS cosine").filter("node LIKE '%.rs%'")
    assert g.describe_at_query(cands, scan.scan(spark, str(src)), FirstLineSynthesizer(), HashEmbedder())["synthesized"] == 2
    assert g.describe_at_query(cands, scan.scan(spark, str(src)), FirstLineSynthesizer(), HashEmbedder())["considered"] == 0


def test_config_layers(tmp_path):
    (tmp_path / ".symgraph.toml").write_text('endpoint = "http://repo"\n[embedder]\nmodel = "own"\n')
    c = config.load(str(tmp_path), env={"SYMGRAPH_SYNTHESIZER": "off"})
    assert c["endpoint"] == "http://repo" and c["embedder"] == {"model": "own", "dimension": 768} and c["synthesizer"] == "off"
    assert [config.tier_of(x) for x in (8, 12, 24, None)] == ["minimal", "balanced", "max", "balanced"]


def test_lsp_edges(spark, tmp_path):
    (tmp_path / "e.json").write_text('{"from": "a", "to": "b", "kind": "calls", "source": "lsp"}\n{"kind": "calls"}\nnot json\n')
    assert [tuple(r) for r in scan.lsp_edges(spark, str(tmp_path / "e.json")).collect()] == [("a", "b", "calls", "lsp")]


def test_state_merge_is_idempotent(spark, tmp_path):
    st = changes.State(spark, str(tmp_path), "k", ["at"])
    b = lambda *rows: spark.createDataFrame(list(rows), "k string, at int, v string")
    st.merge(b(("a", 1, "x"), ("a", 2, "y")), 0)
    for _ in range(2):
        st.merge(b(("a", 1, "old"), ("b", 1, "z")), 1)
    assert {tuple(r) for r in st.read().collect()} == {("a", 2, "y"), ("b", 1, "z")}
    # a restart goes on from what is written, and only the parts that are touched are written anew
    again = changes.State(spark, str(tmp_path), "k", ["at"])
    again.merge(b(("c", 1, "n"), ("b", 3, "zz")), 2)
    again.merge(b().limit(0), 3)
    assert {tuple(r) for r in changes.State(spark, str(tmp_path), "k", ["at"]).read().collect()} == {("a", 2, "y"), ("b", 3, "zz"), ("c", 1, "n")}
    assert len(os.listdir(tmp_path / "batch=2")) <= 4  # two parts, _SUCCESS and its checksum


def test_change_stream_filters_and_applies(spark, tmp_path):
    schema = "path string, kind string, at timestamp"
    spark.createDataFrame([("a.rs", "Modify", None), ("a.rs", "Create", None), ("x/target/b.rs", "Modify", None), ("c.rs", "Access", None), ("d.md", "Modify", None), ("gone.rs", "Remove", None)], schema).write.parquet(str(tmp_path / "in"))
    said = {}

    def batch(df, _):
        text = lambda p: p.withColumn("text", F.when(F.col("path") == "a.rs", "fn a() {}"))
        changes.apply_changes(spark, df, text, lambda x: said.update(index=[r.path for r in x.collect()]), lambda x: said.update(forget=[r.path for r in x.collect()]))

    q = changes.change_stream(spark, str(tmp_path / "in"), schema).writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert said == {"index": ["a.rs"], "forget": ["gone.rs"]}
