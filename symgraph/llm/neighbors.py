"""Most similar vectors for every vector, by cross-polytope hashing.

Unit vectors are turned by a fast pseudo-rotation (three rounds of random signs and
a Hadamard transform) and assigned to the nearest signed axis. A table joins the
axes of one or two independent rotations, and from `PER_CELL` entries a cell on of a
third over as few of its axes as the collection asks for, so that cells don't grow
with it; each vector is stored once per table and looks into `probes` cells of it, the
nearest first by how little the second-best axes fall behind. Candidates are reranked
by exact cosine.

Vectors of the same direction (equal after scaling and rounding to `SAME` digits'
worth of float bits) are one entry with its members, so a large group of copies is
one row in the tables. Cells are worked on in blocks of bounded size: a heavy cell
is split into blocks of stored entries, and every query of the cell meets every
block, so nothing is dropped and no task holds an unbounded cell.

Defined results: vectors that are null, of another length, all zero or not finite
have no neighbours and are nobody's; a vector isn't its own neighbour; copies are
neighbours of each other with cosine 1; ties are settled by the id, the smaller
first; fewer than k others give fewer rows. Ids should be unique.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.session import PARTITION_BYTES, materialize

#: Stored entries of one cell met at once.
CELL_BLOCK = 4096
#: Entries of an average cell from which cells are made finer.
PER_CELL = 64
#: Ids in a list that goes to every executor instead of a shuffle of all vectors: some 10 MB.
BROADCAST_ROWS = 250_000
#: Coordinates of unit vectors are compared to this many binary digits for being copies.
SAME = 18
#: Units of the angle between a vector and its code, which every code carries, in radians.
ANGLE = 1 / 8192


@cache
def _signs(dim: int, tables: int, seed: int) -> np.ndarray:
    """(tables, 3 rotations, 3 rounds, padded dim) of +1 and -1; the third rotation's come last."""
    size = 1 << (dim - 1).bit_length()
    rng = np.random.default_rng(seed)
    both = rng.choice(np.array([-1, 1], np.float32), (tables, 2, 3, size))
    return np.concatenate([both, rng.choice(np.array([-1, 1], np.float32), (tables, 1, 3, size))], 1)


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, size = x.shape[1], 1
    while size < n:
        y = x.reshape(len(x), -1, 2, size)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(len(x), n)
        size *= 2
    return x / np.float32(np.sqrt(n))


def _axes(x: np.ndarray, signs: np.ndarray, top: int, among: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The `top` nearest signed axes of each row and how far each falls behind the first; of the first `among`
    axes of the rotated space if that is given."""
    size = signs.shape[1]
    y = np.zeros((len(x), size), np.float32)
    y[:, : x.shape[1]] = x
    for s in signs:
        y = _hadamard(y * s)
    y = y[:, :among]
    both = np.concatenate([y, -y], 1)
    top = min(top, both.shape[1] - 1)
    if top == 1:
        best = both.argmax(1)[:, None]
    else:
        best = np.argpartition(-both, top, 1)[:, :top]
        order = np.argsort(-np.take_along_axis(both, best, 1), 1, kind="stable")
        best = np.take_along_axis(best, order, 1)
    value = np.take_along_axis(both, best, 1)
    return best, (value[:, :1] - value) ** 2


def finer(entries: int, dim: int, joint: bool) -> int:
    """Axes of the third rotation, a power of two; 0 if the cells of the others are small enough."""
    cells_ = (2 << (dim - 1).bit_length()) ** (2 if joint else 1)
    need = entries / (PER_CELL * cells_)
    return 0 if not joint or need <= 1 else min(1 << (dim - 1).bit_length(), 1 << max(0, int(np.ceil(np.log2(need))) - 1))


def cells(x: np.ndarray, tables: int, probes: int, seed: int, joint: bool = True, third: int = 0) -> Iterator[tuple[int, np.ndarray]]:
    """Per table the cells of each row, nearest first: column 0 is where it is stored."""
    all_signs = _signs(x.shape[1], tables, seed)
    size = 2 * all_signs.shape[-1]
    top = max(2, min(size - 1, probes))
    for t in range(tables):
        a, da = _axes(x, all_signs[t, 0], top)
        if not joint:
            yield t, a[:, :probes]
            continue
        cell, cost = a, da
        for r, among in ((1, None), (2, third)):
            if among == 0:
                continue
            b, db = _axes(x, all_signs[t, r], top, among)
            cost = (cost[:, :, None] + db[:, None, :]).reshape(len(x), -1)
            cell = (cell[:, :, None] * size + b[:, None, :]).reshape(len(x), -1)
            pick = np.argsort(cost, 1, kind="stable")[:, : max(probes, 2)]
            cell, cost = np.take_along_axis(cell, pick, 1), np.take_along_axis(cost, pick, 1)
        yield t, cell[:, :probes]


def unit_vectors(df: DataFrame, key: str, vector: str, dim: int) -> DataFrame:
    """id, e, v: usable vectors scaled to length 1 (in double, kept as float), with their direction e: a hash
    of the rounded vector, equal for copies at any scale."""
    kind = df.schema[key].dataType.simpleString()
    odd = np.random.default_rng(11).integers(0, 1 << 63, dim, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            big = np.abs(x).max(1, initial=0)
            ok = np.flatnonzero(np.isfinite(big) & (big > 0))
            # scaled by the greatest first, so that squares neither vanish nor overflow
            x = x[ok] / big[ok, None]
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            h = (np.rint(x * (1 << SAME)).astype(np.int64).view(np.uint64) * odd).sum(1, dtype=np.uint64)
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))).view(np.int64)
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(ok) + 1, dtype=np.int32) * dim), pa.array(x.astype(np.float32).reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(ok)), pa.array(h), v], names=["id", "e", "v"])

    return df.filter(F.size(vector) == dim).select(key, vector).mapInArrow(run, f"id {kind}, e bigint, v array<float>")


def _small(df: DataFrame, rows: int) -> DataFrame:
    """With the hint to broadcast if it has at most so many rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def encode(x: np.ndarray, fine: bool) -> np.ndarray:
    """Rows of bytes: each vector in half bytes, an eighth of its size, or in bytes (fine), and in the last
    two the angle between the vector and what the code says, rounded up."""
    levels = 127 if fine else 7
    q = np.rint(x * levels / np.abs(x).max(1, keepdims=True))
    x, y = x.astype(np.float64), q.astype(np.float64)
    x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
    # by the chord: an arc cosine loses small angles
    angle = 2 * np.arcsin(np.minimum(np.linalg.norm(x - y, axis=1) / 2, 1))
    tail = (np.ceil(angle / ANGLE) + 1).astype("<u2").view(np.uint8).reshape(-1, 2)
    code = q.astype(np.int8).view(np.uint8) + np.uint8(levels + 1)
    if not fine and x.shape[1] % 2 == 0:
        code = code[:, ::2] | (code[:, 1::2] << 4)
    return np.concatenate([code, tail], 1)


def decode(code: np.ndarray, dim: int, fine: bool) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the codes, and how far (radians) the true ones may be from them."""
    angle = np.ascontiguousarray(code[:, -2:]).view("<u2").reshape(-1) * ANGLE
    code = code[:, :-2]
    if not fine and dim % 2 == 0:
        code = np.stack([code & 15, code >> 4], 2).reshape(len(code), dim)
    x = code.astype(np.float32) - (128 if fine else 8)
    return x / np.linalg.norm(x, axis=1, keepdims=True), angle


def _placed(entries: DataFrame, dim: int, tables: int, probes: int, seed: int, joint: bool, fine: bool, third: int) -> DataFrame:
    """Rows (place, role, e, code): an entry in the cell it is stored in and in those it looks into.
    place: table and cell. role: 0 stored, 1 stored and asking, 2 asking. code: see encode()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            code = encode(x, fine)
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(code.shape[1]), len(x), [None, pa.py_buffer(np.ascontiguousarray(code).tobytes())]).cast(pa.binary())
            asks = np.asarray(batch.column(2).to_numpy(zero_copy_only=False))
            for t, cell in cells(x, tables, probes, seed, joint, third):
                n, p = cell.shape
                # who doesn't ask is only stored
                here = np.ones((n, p), bool)
                here[~asks, 1:] = False
                row, probe = np.nonzero(here)
                take = pa.array(row)
                role = np.where(probe > 0, 2, asks[row].astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array((t << 24) + cell[row, probe].astype(np.int64)), pa.array(role), batch.column(0).take(take), packed.take(take)], names=["place", "role", "e", "code"])

    return entries.select("e", "v", "asks").mapInArrow(run, "place bigint, role bigint, e bigint, code binary")


def _meet(dim: int, k: int, min_cosine: float, fine: bool):
    """Blocks of cells, sorted with their stored entries first, to pairs (a, b) that may be near: all that
    can be among an asker's k nearest of the block and reach the least cosine.

    Angles are a metric, so a true angle lies within the two codes' own angles of that of the codes. The
    k-th nearest by the codes, at angle t, bounds the true k-th angle by t + own + the block's greatest
    angle; what lies beyond that by more than own + its own angle can't be among the k."""
    # rounding of a product of unit vectors in single precision
    slip = (dim + 8) * 2.0**-23

    def pairs(ids: np.ndarray, code: np.ndarray, own: np.ndarray, base_ids: np.ndarray, base: np.ndarray, base_own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c = code @ base.T
        c[ids[:, None] == base_ids[None, :]] = -2
        most = base_own.max()
        reach = np.full(len(ids), np.arccos(max(min_cosine, -1.0)))
        if c.shape[1] > k:
            kth = np.partition(c, c.shape[1] - k, 1)[:, -k].astype(np.float64)
            # an asker that is itself among the k has fewer than k others here: they are all kept
            reach = np.minimum(reach, np.arccos(np.clip(kth - slip, -1, 1)) + own + most)
        reach += own
        a, b = np.nonzero((c >= (np.cos(np.minimum(reach + most, np.pi)) - slip - 1e-7).astype(np.float32)[:, None]) & (c > -1.5))
        sure = c[a, b] >= np.cos(np.minimum(reach[a] + base_own[b], np.pi)) - slip - 1e-7
        return ids[a[sure]], base_ids[b[sure]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, stored_ids, stored, stored_own = None, [], [], []
        out: list[tuple[np.ndarray, np.ndarray]] = []
        waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush_cell() -> None:
            if stored_ids and waiting:
                base_ids, base, base_own = np.concatenate(stored_ids), np.concatenate(stored), np.concatenate(stored_own)
                for ids, code, own in waiting:
                    for i in range(0, len(ids), CELL_BLOCK):
                        out.append(pairs(ids[i : i + CELL_BLOCK], code[i : i + CELL_BLOCK], own[i : i + CELL_BLOCK], base_ids, base, base_own))
            waiting.clear()

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            key = batch.column(0).to_numpy()
            place, role = key >> 2, key & 3
            ids = batch.column(1).to_numpy()
            code, own = decode(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(n, -1), dim, fine)
            cut = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [n]])
            for b, e in zip(cut[:-1], cut[1:], strict=True):
                if place[b] != at:
                    flush_cell()
                    at, stored_ids, stored, stored_own = place[b], [], [], []
                if role[b] < 2:
                    stored_ids.append(ids[b:e])
                    stored.append(code[b:e])
                    stored_own.append(own[b:e])
                if role[b] > 0:
                    waiting.append((ids[b:e], code[b:e], own[b:e]))
                if role[b] == 2 and sum(len(i) for i, _, _ in waiting) > 4 * CELL_BLOCK:
                    flush_cell()
            if sum(len(x) for x, _ in out) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in out])), pa.array(np.concatenate([y for _, y in out]))], names=["a", "b"])
                out.clear()
        flush_cell()
        if sum(len(x) for x, _ in out):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x for x, _ in out])), pa.array(np.concatenate([y for _, y in out]))], names=["a", "b"])

    return run


def nearest(df: DataFrame, key: str, vector: str, dim: int, k: int = 10, tables: int = 4, probes: int = 3, seed: int = 7, joint: bool = True, min_cosine: float = -1.0, queries: DataFrame | None = None) -> DataFrame:
    """id, neighbor, cosine, rank: for every vector (or for those whose id is in queries) the k
    most similar others. min_cosine drops pairs below it after the exact rerank."""
    spark = df.sparkSession
    units = materialize(unit_vectors(df, key, vector, dim), "unit_vectors")
    members = units.select("e", "id")
    # a direction is stood for by its least id
    asked = members.join(queries.select(F.col(key).alias("id")), "id", "left_semi").select("e").distinct() if queries is not None else None
    heads = materialize(members.groupBy("e").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("copies")), "directions")
    several = heads.filter("copies > 1")
    others = materialize(members.join(several, "e").filter(F.col("id") > F.col("head")).select("id"), "copies")
    entries = units.join(_small(others, BROADCAST_ROWS), "id", "left_anti").select("e", "v")
    if asked is None:
        entries = entries.withColumn("asks", F.lit(True))
    else:
        entries = entries.join(asked.withColumn("asks", F.lit(True)), "e", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    # without a least cosine only the codes bound what is reranked, so they are finer
    fine = min_cosine <= -1
    n = heads.count()
    third = finer(n, dim, joint)
    # a finer cell is missed more often
    probes = probes * 2 if third else probes
    placed = _placed(entries, dim, tables, probes, seed, joint, fine, third)
    stored = _placed(entries.withColumn("asks", F.lit(False)), dim, tables, 1, seed, joint, fine, third)
    # a heavy cell's stored entries are spread over blocks; who asks goes to every block
    heavy = stored.groupBy("place").count().filter(F.col("count") > CELL_BLOCK).select(F.col("place").alias("h"), F.ceil(F.col("count") / CELL_BLOCK).cast("int").alias("blocks"))
    both = placed.join(heavy, F.col("place") == F.col("h"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    home = F.pmod(F.xxhash64("e"), F.col("blocks")).cast("int")
    spread = both.withColumn("block", F.explode(F.when(F.col("role") > 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(home))))
    # stored in one block of a heavy cell, who is stored elsewhere only asks here
    role = F.when(F.col("block") == home, F.col("role")).otherwise(F.lit(2).cast("long"))
    rows = spread.select(((F.col("place") * F.lit(1 << 22) + F.col("block")) * 4 + role).alias("key"), "e", "code")
    size = n * tables * (1 + (probes if asked is None else 0)) * (dim + 32)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PARTITION_BYTES))
    met = rows.repartition(parts, F.expr("shiftright(key, 2)")).sortWithinPartitions("key").mapInArrow(_meet(dim, k, min_cosine, fine), "a bigint, b bigint").distinct()
    # the exact rerank, on the pairs that are left
    met = materialize(met, "candidate_pairs")
    near = materialize(met.select(F.explode(F.array("a", "b")).alias("e")).distinct(), "near")
    kept = entries.select("e", "v").join(_small(near, BROADCAST_ROWS), "e", "left_semi")
    va, vb = kept.select(F.col("e").alias("a"), F.col("v").alias("va")), kept.select(F.col("e").alias("b"), F.col("v").alias("vb"))
    exact = met.join(va, "a").join(vb, "b").select("a", "b", F.aggregate(F.zip_with("va", "vb", lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x).alias("cosine")).filter(F.col("cosine") >= min_cosine)
    best = exact.withColumn("r", F.rank().over(Window.partitionBy("a").orderBy(F.desc("cosine")))).filter(F.col("r") <= k).drop("r")
    return _members_of(best, members, heads, k, queries, key)


def _members_of(best: DataFrame, members: DataFrame, entries: DataFrame, k: int, queries: DataFrame | None, key: str) -> DataFrame:
    """From entries to vectors: each member of a has the members of its neighbours and its own
    copies. Of an entry's members only the k + 1 least ids can be among anyone's k nearest."""
    least = members.withColumn("i", F.row_number().over(Window.partitionBy("e").orderBy("id"))).filter(F.col("i") <= k + 1).select(F.col("e").alias("b"), F.col("id").alias("neighbor"))
    askers = members.select(F.col("e").alias("a"), "id")
    if queries is not None:
        askers = askers.join(queries.select(F.col(key).alias("id")), "id", "left_semi")
    copies = entries.filter("copies > 1").select(F.col("e").alias("a"), F.col("e").alias("b"), F.lit(1.0).alias("cosine"))
    # per entry the k + 1 nearest vectors, the same for all its members but for themselves
    per_entry = best.unionByName(copies).join(least, "b").withColumn("i", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("cosine"), "neighbor"))).filter(F.col("i") <= k + 1).select("a", "neighbor", "cosine")
    pairs = askers.join(per_entry, "a").filter(F.col("id") != F.col("neighbor"))
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbor"))).filter(F.col("rank") <= k).select("id", "neighbor", "cosine", "rank")
