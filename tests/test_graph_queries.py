"""Every registered query that has SQL, on the smallest tables."""

import oracle
import pytest

from symgraph.plans import registry


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_sql(spark, con, sf, name):
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert registry.queries()[name](spark, sf).columns
        return
    ok, said = oracle.compare(spark, con, sf, registry.queries()[name], sql)
    assert ok, said


def test_tests_are_followed_to_the_end(spark, tmp_path):
    """Five calls and a cycle beyond the test, and a second test that joins half way."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    names = ["t1", "t2", "a", "b", "c", "d", "e"]
    pq.write_table(pa.table({"qualified_name": names, "indexed_at": [1] * 7, "kind": ["function"] * 7, "file_path": ["r/tests/t.rs"] * 2 + ["r/src/x.rs"] * 5}), tmp_path / "symbols.parquet")
    calls = [("t1", "a"), ("a", "b"), ("b", "c"), ("c", "d"), ("d", "e"), ("e", "b"), ("t2", "c")]
    pq.write_table(pa.table({"from_qname": [a for a, _ in calls], "kind": ["calls"] * 7, "to_qname": [b for _, b in calls], "observed_at": [1] * 7, "edge_id": list(range(7)), "edge_source": ["parser"] * 7}), tmp_path / "edges.parquet")
    query = registry.queries()["tested_by_all"]
    assert {tuple(r) for r in query(spark, str(tmp_path)).select("test", "target").collect()} == {("t1", x) for x in "abcde"} | {("t2", x) for x in "bcde"}
    ok, said = oracle.compare(spark, oracle.views(str(tmp_path)), str(tmp_path), query, registry.oracle_sql()["tested_by_all"])
    assert ok, said


def _reach(calls, tests):
    found = set()
    for t in tests:
        seen, todo = {t}, [t]
        while todo:
            at = todo.pop()
            new = {b for a, b in calls if a == at} - seen
            seen |= new
            todo += new
        found |= {(x, t) for x in seen - {t}}
    return found


@pytest.mark.parametrize("bound", [0, 3, 1000])
def test_hubs_cover_what_a_walk_finds(spark, bound):
    """Two cycles, one below the other, tests inside, above, beside and without calls; and no hub kept at all."""
    from symgraph.operators import traverse

    ring = lambda p: [(f"{p}{i}", f"{p}{(i + 1) % 9}") for i in range(9)]
    calls = ring("a") + ring("b") + ring("c") + [("a2", "b4"), ("b7", "leaf"), ("c3", "leaf"), ("leaf", "end"), ("t0", "a0"), ("t1", "a5"), ("t2", "b0"), ("t3", "t2"), ("t4", "leaf"), ("t5", "c1"), ("t5", "b1"), ("t6", "t6"), ("end", "end")]
    tests = [f"t{i}" for i in range(8)] + ["a3"]
    edges = spark.createDataFrame([(a, "calls", b) for a, b in calls + calls[:5]] + [("t7", "uses_type", "a0"), ("t7", "calls", None)], "from_qname string, kind string, to_qname string")
    got = [tuple(r) for r in traverse.tested_by_all(edges, spark.createDataFrame([(t,) for t in [*tests, "t0"]], "node string"), bound).collect()]
    assert len(got) == len(set(got))
    assert set(got) == _reach(calls, tests)


def test_pairs_of_a_cycle_are_no_rows_before_the_result(spark, monkeypatch):
    """300 tests into a cycle of 60: 18,000 pairs, of which few are written."""
    from symgraph.operators import traverse

    written, write = [], traverse.materialize_counted

    def counted(df, name, *where):
        out = write(df, name, *where)
        written.append(out[1])
        return out

    monkeypatch.setattr(traverse, "materialize_counted", counted)
    calls = [(f"n{i}", f"n{(i + k) % 60}") for i in range(60) for k in (1, 7, 20)] + [(f"t{i}", f"n{i % 60}") for i in range(300)]
    edges = spark.createDataFrame([(a, "calls", b) for a, b in calls], "from_qname string, kind string, to_qname string")
    found = traverse.tested_by_all(edges, spark.createDataFrame([(f"t{i}",) for i in range(300)], "node string"), 500)
    assert found.count() == 300 * 60
    assert sum(written) < 6000
