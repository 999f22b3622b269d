"""Measures of retrieval and of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retrieval_metrics(ranked: DataFrame) -> DataFrame:
    """query_id, hit5, mrr, ndcg10; ranked: query_id, rank (from 1), relevant (boolean)."""
    rel = F.col("relevant").cast("int")
    gain = rel / F.log2(F.col("rank") + 1)
    # the best order of the relevant ones that were found
    per = ranked.groupBy("query_id").agg(F.coalesce(F.max(F.when(F.col("rank") <= 5, rel)), F.lit(0)).alias("hit5"), F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"), F.sum(F.when(F.col("rank") <= 10, gain)).alias("dcg"), F.sum(F.when(F.col("rank") <= 10, rel)).alias("n"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest("n", F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return per.select("query_id", F.col("hit5").cast("double").alias("hit5"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), F.when(F.col("n") > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg10"))


def summary(metrics: DataFrame) -> DataFrame:
    return metrics.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.avg(c), 6).alias(c) for c in ("hit5", "mrr", "ndcg10")])


def outcome_counters(outcomes: DataFrame) -> DataFrame:
    """considered, synthesized, skipped, failed; outcomes: status. Skipped are those described before."""
    return outcomes.agg(F.count(F.lit(1)).alias("considered"), *[F.count_if(F.col("status") == s).alias(s) for s in ("synthesized", "skipped", "failed")])


def latency(df: DataFrame, ms: str, keys: list[str]) -> DataFrame:
    """keys, mean_ms, p95_ms of durations; the percentile is exact and combined from counts of equal values."""
    return df.groupBy(*keys).agg(F.round(F.avg(ms), 3).alias("mean_ms"), F.round(F.percentile(ms, 0.95), 3).alias("p95_ms"))


def judged(results: DataFrame, corpus: DataFrame) -> DataFrame:
    """query_id, rank, relevant: results (query_id, node, rank) held against a corpus (query_id, target,
    alternates); the target and its alternates are relevant. Queries without results keep one row without rank."""
    c = corpus.select("query_id", F.concat(F.array("target"), F.coalesce("alternates", F.array().cast("array<string>"))).alias("good"))
    return c.join(results, "query_id", "left").select("query_id", "rank", F.coalesce(F.array_contains("good", F.col("node")), F.lit(False)).alias("relevant"))


def stats_rollup(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, level: counts for each prefix of the keys and in all; level is the number of keys left out."""
    levels = sum((F.grouping(k).cast("int") for k in keys), F.lit(0))
    return df.rollup(*keys).agg(F.count(F.lit(1)).alias("n"), levels.alias("level"))
