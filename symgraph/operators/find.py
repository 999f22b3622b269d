"""Retrieval: vector seeds, one hop of the graph around them, reranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.operators import vector
from symgraph.operators.models import Embedder

#: Neighbours taken per seed, candidates in all, results.
FANOUT, CANDIDATES, RESULTS, SEEDS = 8, 200, 10, 50
#: Confidence is low if the best three all lie below the first and the ten span less than the second.
LOW_SCORE, LOW_SPREAD = 0.55, 0.05


def find(symbols: DataFrame, manifest: DataFrame, repo_id: str, embedder: Embedder, text: str, limit: int = 20) -> DataFrame:
    """qualified_name, score: the text is embedded, checked against the graph's embedder and searched for."""
    vector.check_embedder(manifest, repo_id, embedder.identity, embedder.dimension)
    return vector.top_k(symbols, "qualified_name", "embedding", embedder.embed([text])[0], limit)


def expand_one_hop(seeds: DataFrame, edges: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """seed, neighbor: undirected neighbours of each seed (node), the first by name up to the fanout, which
    is the feature's own bound."""
    s = seeds.select("node").distinct()
    out = edges.select(F.col("from_qname").alias("node"), F.col("to_qname").alias("neighbor"))
    both = out.unionByName(edges.select(F.col("to_qname").alias("node"), F.col("from_qname").alias("neighbor")))
    near = both.join(s, "node", "left_semi").filter("node <> neighbor").distinct()
    w = Window.partitionBy("node").orderBy("neighbor")
    return near.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= fanout).select(F.col("node").alias("seed"), "neighbor")


def candidates(seeds: DataFrame, expanded: DataFrame, scores: DataFrame, limit: int = CANDIDATES) -> DataFrame:
    """node, cosine, origin (vector, graph), via: seeds (node, cosine) and their neighbours, each once, seeds
    first. scores: node, cosine of any symbol."""
    s = seeds.select("node", "cosine", F.lit("vector").alias("origin"), F.lit(None).cast("string").alias("via"))
    g = expanded.groupBy(F.col("neighbor").alias("node")).agg(F.min("seed").alias("via")).join(scores, "node", "left").select("node", "cosine", F.lit("graph").alias("origin"), "via")
    every = s.unionByName(g.join(s.select("node"), "node", "left_anti"))
    return every.orderBy(F.desc("origin"), F.desc_nulls_last("cosine"), "node").limit(limit)


def reranked(cands: DataFrame, rerank: Column, k: int = RESULTS) -> DataFrame:
    """node, cosine, rerank, origin, reranker_degraded: best rerank first, ties by cosine. Where the reranker has
    no opinion on any candidate, the order is that of the cosine and the flag says so."""
    scored = cands.withColumn("rerank", rerank)
    degraded = scored.agg(F.count("rerank") == 0).scalar()
    return scored.withColumn("reranker_degraded", degraded).orderBy(F.desc_nulls_last("rerank"), F.desc_nulls_last("cosine"), "node").limit(k).select("node", "cosine", "rerank", "origin", "reranker_degraded")


def similar_symbols(vectors: DataFrame, edges: DataFrame, qname: str, query: list[float], k: int = RESULTS * 2) -> DataFrame:
    """node, cosine, jaccard: the k symbols (vectors: node, embedding) most similar to one of them by meaning, and
    the share of neighbours, whatever the direction, that they have in common with it."""
    near = vector.top_k(vectors.filter(F.col("node") != qname), "node", "embedding", query, k).withColumnRenamed("score", "cosine")
    both = edges.select(F.col("from_qname").alias("a"), F.col("to_qname").alias("b"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct()
    own = both.filter(F.col("a") == qname).select(F.col("b").alias("own"))
    of = both.join(near.select(F.col("node").alias("a")), "a", "left_semi").join(own, F.col("b") == F.col("own"), "left")
    counts = of.groupBy("a").agg(F.count("own").alias("shared"), F.count(F.lit(1)).alias("n"))
    total = own.agg(F.count(F.lit(1))).scalar()
    return near.join(counts, F.col("node") == F.col("a"), "left").select("node", "cosine", F.coalesce(F.col("shared") / (total + F.col("n") - F.col("shared")), F.lit(0.0)).alias("jaccard"))


def rerank_document(description: Column, signature: Column, body: Column) -> Column:
    """What a reranker reads: the description, else the signature, and the first 40 lines of the body."""
    return F.concat_ws("\n", F.coalesce(F.nullif(description, F.lit("")), signature), F.substring_index(body, "\n", 40))


def low_confidence(ranked: DataFrame) -> DataFrame:
    """query_id, fires; ranked: query_id, score, rank (from 1). Fewer than ten results have no spread to judge."""
    top3 = F.max(F.when(F.col("rank") <= 3, F.col("score")))
    spread = F.max(F.when(F.col("rank") == 1, F.col("score"))) - F.max(F.when(F.col("rank") == 10, F.col("score")))
    return ranked.groupBy("query_id").agg(F.coalesce((top3 < LOW_SCORE) & (spread < LOW_SPREAD), F.lit(False)).alias("fires"))
