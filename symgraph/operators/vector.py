"""Exact vector search by cosine similarity, in double and JVM-side.

Vectors that are null, of another length, all zero or with null parts are nobody's
neighbour. Ties are settled by the key."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class EmbedderMismatch(Exception):
    """Graph and runtime name different embedders."""

    def __init__(self, graph: str, runtime: str):
        super().__init__(f"the graph was embedded by {graph}, the runtime has {runtime}")
        self.graph, self.runtime = graph, runtime


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def check_embedder(manifest: DataFrame, repo_id: str, identity: str, dimension: int) -> None:
    """Raises EmbedderMismatch; without a manifest row there is nothing to hold against."""
    row = manifest.filter(F.col("repo_id") == repo_id).select("embedder_identity", "embedder_dimension").first()
    if row is not None and (row[0], row[1]) != (identity, dimension):
        raise EmbedderMismatch(f"{row[0]}@{row[1]}", f"{identity}@{dimension}")


def usable(df: DataFrame, vector: str, dimension: int) -> DataFrame:
    return df.filter((F.size(vector) == dimension) & F.coalesce(norm(F.col(vector)) > 0, F.lit(False)))


def top_k(df: DataFrame, key: str, vector: str, query: list[float], k: int = 20) -> DataFrame:
    """key, score of the k most similar rows to one query vector: a scan and a TakeOrderedAndProject."""
    q = F.lit([float(x) for x in query])
    return usable(df, vector, len(query)).select(key, cosine(F.col(vector), q).alias("score")).orderBy(F.desc("score"), key).limit(k)


#: Rows and queries of one block, which meet in one matrix product.
ROW_BLOCK, QUERY_BLOCK = 20_000, 4_000


def batch_top_k(df: DataFrame, key: str, vector: str, queries: DataFrame, dimension: int, k: int = 5) -> DataFrame:
    """query_id, neighbor, score, rank: the k best rows for each query (query_id, query_vector), the query itself
    left out. A stated query set against all rows, in blocks: rows and queries are dealt to blocks by their
    number, and each pair of blocks is one task's matrix product in double, of which each query keeps its
    k best. Scores are compared to twelve decimals, so that copies tie; ties go by the key."""
    rows = df.filter(F.size(vector) == dimension).select(F.col(key).alias("key"), F.col(vector).alias("v"))
    asked = queries.filter(F.size("query_vector") == dimension).select("query_id", F.col("query_vector").alias("v"))
    n, m = rows.count(), asked.count()
    row_blocks, query_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-m // QUERY_BLOCK))
    every = lambda blocks: F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    left = rows.withColumn("i", F.pmod(F.xxhash64("key"), F.lit(row_blocks).cast("bigint"))).withColumn("j", every(query_blocks))
    right = asked.withColumn("j", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks).cast("bigint"))).withColumn("i", every(row_blocks))
    kinds = rows.schema["key"].dataType.simpleString(), asked.schema["query_id"].dataType.simpleString()

    def unit(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the usable vectors, and these scaled to length 1."""
        x = table.column("v").combine_chunks()
        x = np.asarray(x.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimension)
        size = np.linalg.norm(x, axis=1)
        ok = np.flatnonzero(np.isfinite(size) & (size > 0))
        return ok, x[ok] / size[ok, None]

    def meet(a: pa.Table, b: pa.Table) -> pa.Table:
        at, x = unit(a)
        to, q = unit(b)
        keys, ids = a.column("key").take(pa.array(at)), b.column("query_id").take(pa.array(to))
        names = np.array(keys.to_pylist(), dtype=object)
        order = np.argsort(names, kind="stable") if len(names) else np.empty(0, np.int64)
        names, x = names[order], x[order]  # by the key, so that the first of equals is the least
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for start in range(0, len(q), 500):
            c = np.round(q[start : start + 500] @ x.T, 12)
            for r, i in enumerate(range(start, min(len(q), start + 500))):
                near = c[r]
                if len(near) > k + 1:
                    near = np.flatnonzero(near >= np.partition(near, len(near) - k - 1)[len(near) - k - 1])
                else:
                    near = np.arange(len(near))
                near = near[np.argsort(-c[r][near], kind="stable")]
                near = near[[names[y] != ids[i].as_py() for y in near]][:k] if len(near) else near
                out.append((np.full(len(near), i), near, c[r][near]))
        i, y, s = (np.concatenate(z) if out else np.empty(0, np.int64) for z in (zip(*out, strict=True) if out else ((), (), ())))
        return pa.table({"query_id": ids.take(pa.array(i, pa.int64())), "key": keys.take(pa.array(order[y.astype(np.int64)], pa.int64())), "score": pa.array(s, pa.float64())})

    best = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(meet, f"query_id {kinds[1]}, key {kinds[0]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("key").alias("neighbor"), "score", "rank")
