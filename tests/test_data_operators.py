"""Orphan references, incremental runs and skew-safe aggregation: edge cases."""

from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from symgraph.operators import incremental, references, resolve, skew, traverse

T = lambda h: D(2025, 3, 1 + h // 24, h % 24)
E = "edge_id bigint, repo_id string, from_qname string, to_qname string, kind string, edge_source string, observed_at timestamp_ntz, ns string, key string"
R = "raw_id bigint, repo_id string, file_path string, from_qname string, to_raw string, kind string, edge_source string, line_no int, extracted_at timestamp_ntz"


def tables(spark, edges, raw=(), symbols=(), files=(), removed=()):
    e = spark.createDataFrame([(i, "r", a, b, k, "lsp", t, "clash", "clash") for i, a, b, k, t in edges], E)
    r = spark.createDataFrame([(i, "r", "p", "q", to, "calls", "lsp", 1, t) for i, to, t in raw], R)
    return e, r, spark.createDataFrame(list(symbols), "qualified_name string, indexed_at timestamp_ntz"), spark.createDataFrame(list(files), "path string, seen_at timestamp_ntz"), spark.createDataFrame(list(removed), "qualified_name string, removed_at timestamp_ntz")


def orphans(*t):
    return {(r.rel, r.row_id, r.side, r.state) for r in references.orphan_references(*t).collect()}


def test_orphans(spark):
    s = [("a/x::A", T(1)), ("a/x::B", T(50)), ("a/x::C", T(1)), ("a/x::C", T(30)), ("a/x::C", T(30))]
    t = tables(
        spark,
        [(1, "a/x::A", "a/x::B", "calls", T(49)), (2, "a/x::A", "a/x::B", "calls", T(50)), (3, "a/x", "a/x::A", "imports", T(1)), (4, None, "", "calls", T(5)), (5, "a/x::C", "no", "calls", T(20)), (6, "a/x::C", "a/x::C", "calls", T(30)), (7, "a/x::C", "a/x::A", "calls", T(10)), (8, "a/x::B", "no", "calls", None)],
        [(1, "b::c", T(1)), (2, "x/y::z", T(1)), (3, None, T(1)), (4, "a/x::A", T(0)), (5, "https://h/p", T(1)), (6, "a/x::", T(1))],
        s, [("a/x", T(1))], [("a/x::C", T(10)), ("a/x::C", T(10)), ("a/x::gone", T(1))],
    )
    assert orphans(*t) == {
        ("edges", 1, "to", "late"), ("edges", 4, "to", "missing"), ("edges", 5, "from", "deleted"), ("edges", 5, "to", "missing"), ("edges", 7, "from", "deleted"), ("edges", 8, "to", "missing"),
        ("raw_edges", 2, "to", "missing"), ("raw_edges", 4, "to", "late"),
    }


def test_orphans_of_empty_tables(spark):
    e, r, s, f, d = tables(spark, [(1, "a", "b", "calls", T(1))])
    assert orphans(e, r, s, f, d) == {("edges", 1, "from", "missing"), ("edges", 1, "to", "missing")}
    assert orphans(e.limit(0), r, s, f, d) == set()


def test_spans_end_with_the_next_indexing(spark):
    """Against brute force, with several removals and indexings on one day, at equal times and days apart."""
    import random

    rnd = random.Random(7)
    sym = [(f"k{rnd.randint(0, 5)}", T(rnd.randint(0, 200))) for _ in range(60)] + [("k0", None), ("never removed", T(1)), (None, T(1))]
    rem = [(f"k{rnd.randint(0, 6)}", T(rnd.randint(0, 200))) for _ in range(40)] + [("k1", None), (None, T(3))]
    s = spark.createDataFrame(sym * 2, "qualified_name string, indexed_at timestamp_ntz")
    r = spark.createDataFrame(rem, "qualified_name string, removed_at timestamp_ntz")
    want = {}
    for k, gone in rem:
        if k and gone:
            back = min((t for q, t in sym if q == k and t and t > gone), default=None)
            want[k, back] = min(gone, want.get((k, back), gone))
    assert {(x.key, x.back_at): x.gone_at for x in references.deleted_spans(s, r).collect()} == want


def test_due_records(spark):
    runs = spark.createDataFrame([("r", T(10), "ok"), ("r", T(10), "ok"), ("r", T(20), "failed"), ("r", T(20), "running"), ("never", T(1), "aborted")], "repo_id string, started_at timestamp_ntz, status string")
    f = "repo_id string, path string, content_hash string, extractor_version int, last_modified timestamp_ntz, seen_at timestamp_ntz"
    files = spark.createDataFrame([
        ("r", "same", "AB", 1, T(1), T(2)), ("r", "same", "ab", 1, T(3), T(12)), ("r", "new", "aa", 1, T(1), T(12)), ("r", "at cut", "aa", 1, T(1), T(10)), ("r", "version", "aa", 1, T(1), T(2)), ("r", "version", "aa", 2, T(1), T(12)),
        ("r", "late old", "bb", 1, T(5), T(6)), ("r", "late old", "aa", 1, T(1), T(15)), ("r", "null", None, 1, T(1), T(2)), ("never", "n", "aa", 1, T(1), T(1)), (None, "lost", "aa", 1, T(1), T(1)),
    ], f)
    s = "repo_id string, qualified_name string, body_hash string, indexed_at timestamp_ntz"
    symbols = spark.createDataFrame([("r", "s1", "h", T(1)), ("r", "s1", None, T(15)), ("r", "s2", "h", T(1)), ("r", "s2", "i", T(15)), ("r", "s3", None, T(1)), ("r", "s3", "h", T(15)), ("r", "s4", None, T(1)), ("r", "s5", None, T(15))], s)
    got = {tuple(r) for r in incremental.due_records(files, symbols, runs).collect()}
    assert got == {("files", "new"), ("files", "version"), ("files", "n"), ("files", "lost"), ("symbols", "s2"), ("symbols", "s3"), ("symbols", "s5")}
    assert incremental.due_records(files.limit(0), symbols.limit(0), runs.limit(0)).count() == 0


def test_manifest_survives_a_failure(spark, tmp_path):
    m = incremental.Manifest(spark, str(tmp_path), ["k"])
    listing = lambda *rows: spark.createDataFrame(list(rows), "k string, size bigint, checksum string")
    copy = lambda df: df.select("k", "checksum")
    assert m.run("b1", listing(("a", 1, "x"), (None, 2, "y")), copy) and not m.run("b1", listing(("z", 1, "z")), copy)

    def fails(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        m.run("b2", listing(("a", 1, "x"), (None, 2, "y"), ("c", 3, "z")), fails)
    # dies between the output and the commit
    real, m._commit = m._commit, fails
    with pytest.raises(RuntimeError):
        m.run("b2", listing(("a", 1, "x"), ("c", 3, "z")), copy)
    m._commit = real
    assert m.output().count() == 2
    assert m.run("b2", listing(("a", 1, "x2"), (None, 2, "y"), ("c", 3, "z")), copy)
    assert sorted((r.k or "", r.checksum) for r in m.output().collect()) == [("", "y"), ("a", "x"), ("a", "x2"), ("c", "z")]


def test_manifest_goes_back_and_forth(spark, tmp_path, monkeypatch):
    """A state that returns is a change; also after the newest rows were written anew."""
    monkeypatch.setattr(incremental, "COMPACT", 3)
    m = incremental.Manifest(spark, str(tmp_path), ["k"])
    one = lambda c: spark.createDataFrame([("a", 1, c), ("still", 1, "s")], "k string, size bigint, checksum string")
    for i, c in enumerate(["A", "B", "A", "A", "B", "A", "B"]):
        assert m.run(f"z{9 - i}", one(c), lambda df: df.select("k", "checksum"))
        done = [tuple(r) for r in m.output(f"z{9 - i}").collect()]
        assert sorted(done) == sorted([] if i == 3 else [("a", c)] + [("still", "s")] * (i == 0))
    assert m.committed() == [f"z{9 - i}" for i in range(7)]


def test_manifest_leaves_arrivals_during_a_run_to_the_next(spark, tmp_path):
    m, src = incremental.Manifest(spark, str(tmp_path / "m"), ["k"]), str(tmp_path / "src")
    add = lambda k: spark.createDataFrame([(k, 1, "x")], "k string, size bigint, checksum string").write.mode("append").parquet(src)
    listing = lambda: spark.read.schema("k string, size bigint, checksum string").parquet(src)
    add("a")

    def grows(todo):
        add("b")
        return todo.select("k")

    assert m.run("1", listing(), grows) and [r.k for r in m.output("1").collect()] == ["a"]
    assert m.run("2", listing(), lambda t: t.select("k")) and [r.k for r in m.output("2").collect()] == ["b"]


def test_files_of_a_folder_are_listed(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x").write_bytes(b"abc")
    r = incremental.list_files(spark, str(tmp_path / "in")).first()
    assert (r["size"], r["checksum"][:8]) == (3, "ba7816bf")


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_skew_aggregate(spark, parts):
    rows = [("hot", "k", f"v{i % 37}", i) for i in range(600)] + [("hot", "k", "same", 1000 + i) for i in range(300)] + [(None, "k", None, 2000), (None, "k", "v", 2001), ("cold", None, "v", 2002), ("cold", "k", "v", 2003)]
    df = spark.createDataFrame(rows, "a string, b string, v string, pid bigint").repartition(5)
    got = {(r.a, r.b): (r.n_rows, r.n_values) for r in skew.skew_aggregate(df, ["a", "b"], "v", "pid", parts).collect()}
    assert got == {("hot", "k"): (900, 38), (None, "k"): (2, 1), ("cold", None): (1, 1), ("cold", "k"): (1, 1)}
    assert skew.skew_aggregate(df.limit(0), ["a", "b"], "v", "pid", parts).count() == 0


def test_heavy_keys_split_over_partitions(spark):
    df = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), F.lit("one value").alias("v"), "id")
    states = skew.partial_states(df, ["k"], "v", "id", 8)
    assert states.filter("k = 'hot'").count() > 1
    per = skew.skew_aggregate(df, ["k"], "v", "id", 8)
    assert tuple(per.filter("k = 'hot'").select("n_rows", "n_values").first()) == (6667, 1)
    assert [r.k for r in skew.heavy_keys(per, ["k"], 0.3).collect()] == ["hot"]


def test_partitions_follow_the_size(spark, tmp_path, monkeypatch):
    """With a hundred times less room a partition there are more of them, and none holds much more than its share,
    though one key holds a third of all rows."""
    from symgraph import session

    path = str(tmp_path / "rows")
    spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") % 101).cast("string").alias("v"), "id").write.parquet(path)
    df = spark.read.parquet(path)
    few = session.parts(df.select("k", "v", "id"))
    monkeypatch.setattr(session, "PARTITION_BYTES", session.PARTITION_BYTES // 2000)
    many = session.parts(df.select("k", "v", "id"))
    assert few == int(spark.conf.get("spark.sql.shuffle.partitions")) and many > 12
    per_part = skew.partial_states(df, ["k"], "v", "id").groupBy("pid").agg(F.sum("n_rows").alias("n")).collect()
    assert len(per_part) > 12 and max(r.n for r in per_part) < 3 * 60_000 / len(per_part)
    hot = skew.skew_aggregate(df, ["k"], "v", "id").filter("k = 'hot'").first()
    assert (hot.n_rows, hot.n_values) == (20_000, 101) and hot.n_parts > 3


def test_traversal(spark):
    e = spark.createDataFrame([("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("a", "d", "calls"), ("d", "c", "calls"), ("x", "a", "uses_type")], "from_qname string, to_qname string, kind string")
    one = lambda n: spark.createDataFrame([(n,)], "node string")
    assert {tuple(r) for r in traverse.blast_radius(e, one("c"), 9).collect()} == {("b", 1), ("d", 1), ("a", 2)}
    assert [tuple(r) for r in traverse.shortest_path(e, "a", "c").collect()] == [(0, "a"), (1, "b"), (2, "c")]
    assert traverse.shortest_path(e, "a", "x").count() == 0
    assert [tuple(r) for r in traverse.shortest_path(e, "a", "a").collect()] == [(0, "a")]
    pairs = e.filter("kind = 'calls'").selectExpr("from_qname AS src", "to_qname AS dst")
    assert {tuple(r) for r in traverse.bfs(pairs, one("a"), None, until="d").collect()} == {("a", 0), ("b", 1), ("d", 1)}
    assert {tuple(r) for r in traverse.context(e, one("x"), 1).collect()} == {("x", 0), ("a", 1)}


def test_containing_and_refine(spark):
    s = spark.createDataFrame([("f::outer", "f", 1, 400), ("f::inner", "f", 100, 120), ("f::other", "f", 100, 120)], "qualified_name string, file_path string, start_line int, end_line int")
    sites = spark.createDataFrame([(1, "f", 110), (2, "f", 300), (3, "f", 500), (4, "g", 1)], "site int, file_path string, line int")
    assert {tuple(r) for r in resolve.containing(sites, s).collect()} == {(1, "f::inner"), (2, "f::outer")}
    edge = "from_qname string, to_qname string, kind string, edge_source string"
    got = resolve.refine(spark.createDataFrame([("a", "b", "calls", "tree_sitter")], edge), spark.createDataFrame([("a", "b", "calls", "lsp")], edge))
    assert got.first()["edge_source"] == "lsp" and got.count() == 1


@pytest.mark.parametrize("block", [2048, 100])
def test_wide_commits_keep_their_pairs(spark, monkeypatch, block):
    """Two commits of 1001 items and a small one that meets them."""
    from math import exp

    from symgraph.operators import derived

    monkeypatch.setattr(derived, "PAIR_BLOCK", block)
    wide = spark.range(1001).selectExpr("id AS item")
    day = lambda d: F.to_date(F.lit(f"2025-01-0{d}")).alias("at")
    changes = wide.select(F.lit(1).alias("commit_id"), "item", day(1)).unionByName(wide.select(F.lit(2).alias("commit_id"), "item", day(2))).unionByName(wide.filter("item < 2").select(F.lit(3).alias("commit_id"), "item", day(3)))
    got = derived.co_change(changes).groupBy("n", F.col("last_seen").cast("string").alias("last"), "weight").count().collect()
    w = [exp(-0.01 * k) for k in range(3)]
    assert {(r.n, r["last"], r.weight, r["count"]) for r in got} == {(3, "2025-01-03", round(sum(w), 6), 1), (2, "2025-01-02", round(w[1] + w[2], 6), 1001 * 1000 // 2 - 1)}
