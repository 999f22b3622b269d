"""p6 against brute force."""

import numpy as np
import pytest

from symgraph.llm import neighbors

SCHEMA = "qualified_name string, embedding array<float>, e string, code string"


def table(spark, vectors):
    return spark.createDataFrame([(k, [float(x) for x in v] if v is not None else None, "x", "y") for k, v in vectors], SCHEMA)


def brute(vectors, k, least):
    ids = sorted(i for i, _ in vectors)
    x = dict(vectors)
    m = np.array([np.asarray(x[i], float) / np.linalg.norm(x[i]) for i in ids])
    c = m @ m.T
    np.fill_diagonal(c, -2)
    out = {}
    for r, i in enumerate(ids):
        order = sorted(range(len(ids)), key=lambda j: (-round(c[r, j], 6), ids[j]))[:k]
        out[i] = [ids[j] for j in order if c[r, j] >= least]
    return out


@pytest.mark.parametrize(("cell_block", "per_cell"), [(4096, 64), (7, 64), (4096, 0.002)])
def test_near_vectors_are_found(spark, monkeypatch, cell_block, per_cell):
    """Also in blocks of a cell, and in cells as fine as for a thousand times more vectors."""
    monkeypatch.setattr(neighbors, "CELL_BLOCK", cell_block)
    monkeypatch.setattr(neighbors, "PER_CELL", per_cell)
    rnd = np.random.default_rng(3)
    vs = []
    for c in range(60):
        centre = rnd.standard_normal(64)
        for j in range(rnd.integers(1, 7)):
            vs.append((f"q{c:02}_{j}", (centre + 0.1 * rnd.standard_normal(64)) * 10.0 ** rnd.integers(-3, 4)))
    odd = [("null", None), ("zero", np.zeros(64)), ("short", np.ones(32)), ("nan", np.full(64, np.nan)), ("inf", np.full(64, np.inf))]
    got = {}
    for r in neighbors.nearest(table(spark, vs + odd), "qualified_name", "embedding", 64, k=4, min_cosine=0.9).collect():
        got.setdefault(r.id, []).append((r.rank, r.neighbor))
    want = {k: v for k, v in brute(vs, 4, 0.9).items() if v}
    hits = sum(len({n for _, n in got.get(k, [])} & set(v)) for k, v in want.items())
    assert hits >= 0.99 * sum(map(len, want.values()))
    assert not set(got) & {k for k, _ in odd}
    assert all(len(v) <= 4 for v in got.values())


def test_copies_are_neighbours_and_ties_go_by_name(spark):
    rnd = np.random.default_rng(4)
    v = rnd.standard_normal(64).astype(np.float32)
    vs = [(f"c{i:02}", v * 2.0 ** (i % 3)) for i in range(30)] + [("other", rnd.standard_normal(64))]
    got = {}
    for r in neighbors.nearest(table(spark, vs), "qualified_name", "embedding", 64, k=3, min_cosine=0.9).collect():
        got.setdefault(r.id, {})[r.rank] = r.neighbor
    assert got["c00"] == {1: "c01", 2: "c02", 3: "c03"} and got["c20"] == {1: "c00", 2: "c01", 3: "c02"} and "other" not in got


def test_cells_follow_the_collection():
    assert [neighbors.finer(n, 64, True) for n in (1, 1 << 20, (1 << 20) + 1, 1 << 24, 1 << 30)] == [0, 0, 1, 8, 64] and neighbors.finer(1 << 30, 64, False) == 0
    x = np.random.default_rng(9).standard_normal((2000, 64)).astype(np.float32)
    wide, fine = (max(np.bincount(c[:, 0]).max() for _, c in neighbors.cells(x, 2, 3, 7, True, third)) for third in (0, 64))
    assert fine < wide and all(c.shape == (2000, 6) for _, c in neighbors.cells(x, 2, 6, 7, True, 4))


@pytest.mark.parametrize(("tables", "probes"), [(10, 12), (3, 30)])
def test_recall_of_all_neighbours(spark, sf, tables, probes):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    asked = df.filter("vec_id % 100 = 0").select("vec_id")
    want = brute(rows, 10, -1)
    got = {}
    for r in neighbors.nearest(df, "vec_id", "embedding", 64, k=10, joint=False, tables=tables, probes=probes, queries=asked).collect():
        got.setdefault(r.id, set()).add(r.neighbor)
    assert np.mean([len(got[i] & set(want[i])) / 10 for i in got]) >= 0.9 and len(got) == 5


def test_empty_and_single(spark):
    assert neighbors.nearest(table(spark, [("a", np.ones(64))]).limit(0), "qualified_name", "embedding", 64).count() == 0
    assert neighbors.nearest(table(spark, [("a", np.ones(64))]), "qualified_name", "embedding", 64).count() == 0


@pytest.mark.parametrize("spread", [0.2, 0.1])
def test_dense_groups_keep_their_nearest(spark, spread):
    """A group of 3000 vectors with mean cosines of 0.96 and 0.99, among others."""
    rnd = np.random.default_rng(5)
    centre = rnd.standard_normal(64)
    centre /= np.linalg.norm(centre)
    vs = [(f"g{i:04}", centre + spread * rnd.standard_normal(64) / 8) for i in range(3000)] + [(f"o{i:04}", rnd.standard_normal(64)) for i in range(500)]
    df = table(spark, vs)
    asked = df.filter("qualified_name LIKE 'g%0'").limit(300).select("qualified_name")
    want = brute([(i, np.asarray(v, np.float32).astype(float)) for i, v in vs], 10, -1)
    got = {}
    for r in neighbors.nearest(df, "qualified_name", "embedding", 64, k=10, joint=False, tables=10, probes=12, queries=asked).collect():
        got.setdefault(r.id, set()).add(r.neighbor)
    assert len(got) == 300
    assert np.mean([len(got[i] & set(want[i])) / 10 for i in got]) >= 0.99


@pytest.mark.parametrize("fine", [False, True])
def test_codes_bound_the_angle(fine):
    rnd = np.random.default_rng(6)
    x = np.concatenate([rnd.standard_normal((500, 64)), np.eye(64), np.eye(64) + 0.07]).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y, own = neighbors.decode(neighbors.encode(x, fine), 64, fine)
    angle = np.arctan2(np.linalg.norm(x - y, axis=1), np.linalg.norm(x + y, axis=1)) * 2
    assert (angle <= own).all() and (own <= angle + 4 * neighbors.ANGLE).all()
