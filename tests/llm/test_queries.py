"""Every registered query of the subpackage runs over the smallest tables and has the columns asked for."""

import pytest

from symgraph.llm import queries

FOUND = {"p1_found": ["path"], "p2_found": ["path"], "p6_found": ["qname_a", "qname_b"], "p7_found": ["qualified_name"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_a", "doc_b"]}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs(spark, sf, name):
    df = queries.QUERIES[name](spark, sf)
    rows = df.collect()
    if name in FOUND:
        assert df.columns == FOUND[name]
    if name.endswith("_found"):
        assert len(rows) == len({tuple(r) for r in rows})


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, sf, con, name):
    import oracle

    same, why = oracle.compare(spark, con, sf, queries.QUERIES[name], queries.ORACLES[name])
    assert same, why
