"""Registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.llm import bpe, funcdocs, handwritten, neighbors, packing, spans, syntax
from symgraph.sources.tables import table


def p1_reasons(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.not_handwritten(table(spark, d, "files"), table(spark, d, "documents"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_reasons(spark, d).select("path")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.repairs(table(spark, d, "documents"), search=syntax.SHALLOW).filter("cost > 0").select("path").distinct()


def p2_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Per file that doesn't parse: the least number of edits, where the first lies, the kind of damage, and whether
    the number of edits is exact (it always is) or a lower bound."""
    return syntax.repairs(table(spark, d, "documents")).filter("cost > 0").select("path", "cost", "first_edit", "damage", "n_tokens", "exact")


def p2_rates(spark: SparkSession, d: str) -> DataFrame:
    """Per repository and language, as last reported in files: source files and those that don't parse. Documents
    that files doesn't know count under their own repository and no language."""
    files = table(spark, d, "files").filter("path IS NOT NULL").groupBy("path").agg(F.max(F.struct("last_modified", "seen_at", "file_language", "repo_id")).alias("f")).select(F.col("path").alias("f_path"), F.col("f.repo_id").alias("f_repo"), "f.file_language")
    own = table(spark, d, "documents").filter("path IS NOT NULL").groupBy(F.col("path").alias("d_path")).agg(F.min("repo_id").alias("d_repo"))
    judged = syntax.repairs(table(spark, d, "documents"), search=syntax.SHALLOW).filter("cost IS NOT NULL").join(files, F.col("path") == F.col("f_path"), "left").join(own, F.col("path") == F.col("d_path"))
    return judged.groupBy(F.coalesce("f_repo", "d_repo").alias("repo_id"), "file_language").agg(F.count(F.lit(1)).alias("n_files"), F.count_if(F.col("cost") > 0).alias("n_broken")).withColumn("share", F.round(F.col("n_broken") / F.col("n_files"), 6))


def _latest_symbols(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """The latest row of each symbol: map-side combined, rows equal in time are equal throughout."""
    s = table(spark, d, "symbols").select("qualified_name", F.struct("indexed_at", *cols).alias("s"))
    return s.groupBy("qualified_name").agg(F.max_by("s", "s.indexed_at").alias("s")).select("qualified_name", *[f"s.{c}" for c in cols])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbors.nearest(_latest_symbols(spark, d, "embedding"), "qualified_name", "embedding", 64, k=10, min_cosine=0.9)
    return near.select(F.least("id", "neighbor").alias("qname_a"), F.greatest("id", "neighbor").alias("qname_b")).distinct()


def p6_neighbors(spark: SparkSession, d: str) -> DataFrame:
    """The 10 most similar symbols of each symbol whose hash is divisible by 100, against all symbols."""
    latest = _latest_symbols(spark, d, "embedding")
    asked = latest.filter(F.pmod(F.xxhash64("qualified_name"), F.lit(100)) == 0).select("qualified_name")
    return neighbors.nearest(latest, "qualified_name", "embedding", 64, k=10, joint=False, tables=3, probes=30, queries=asked).select(F.col("id").alias("qualified_name"), "neighbor", F.round("cosine", 6).alias("cosine"), "rank")


_FN = ("short_name", "kind", "file_path", "start_line", "signature", "jsdoc", "synthesized_description")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return funcdocs.found(_latest_symbols(spark, d, *_FN), table(spark, d, "documents")).select("qualified_name")


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    return funcdocs.pairs(_latest_symbols(spark, d, *_FN), table(spark, d, "documents"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_texts(table(spark, d, "documents"))


def p9_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_texts(table(spark, d, "documents"))


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p9_packing(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "documents"))


def p10_sets(spark: SparkSession, d: str) -> DataFrame:
    """Per set of documents that share a run: its members. The pairs of p10_found without making them."""
    return spans.shared_sets(table(spark, d, "documents")).select(F.concat_ws(":", "set_a", "set_b").alias("set_id"), F.col("doc").alias("doc_id"), "n")


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    """Per document: characters, characters that stand in other documents too, spans of them."""
    return spans.shared_share(table(spark, d, "documents"))


QUERIES = {"p1_found": p1_found, "p1_reasons": p1_reasons, "p2_found": p2_found, "p2_repairs": p2_repairs, "p2_rates": p2_rates, "p6_found": p6_found, "p6_neighbors": p6_neighbors, "p7_found": p7_found, "p7_pairs": p7_pairs, "p8_ids": p8_ids, "p9_packing": p9_packing, "p9_fill": p9_fill, "p10_found": p10_found, "p10_sets": p10_sets, "p10_shared": p10_shared}

_WINDOWS = "w AS (SELECT doc_id, i, hash(substr(text, i, 200)) AS h FROM documents, range(1, length(text) - 198) t(i) WHERE length(text) >= 200), s AS (SELECT * FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id)))"

ORACLES: dict[str, str] = {
    "p10_found": f"WITH {_WINDOWS}, u AS (SELECT DISTINCT doc_id, h FROM s) SELECT DISTINCT a.doc_id AS doc_a, b.doc_id AS doc_b FROM u a JOIN u b ON a.h = b.h AND a.doc_id < b.doc_id",
    "p10_shared": f"""WITH {_WINDOWS}, n AS (SELECT doc_id, i, coalesce(i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) > 200, true) AS new FROM s), g AS (SELECT doc_id, i, count(*) FILTER (new) OVER (PARTITION BY doc_id ORDER BY i) AS island FROM n),
    p AS (SELECT doc_id, island, max(i) - min(i) + 200 AS len FROM g GROUP BY ALL) SELECT d.doc_id, length(d.text) AS n_chars, coalesce(sum(len), 0)::BIGINT AS shared_chars, count(len) AS n_spans FROM documents d LEFT JOIN p USING (doc_id) GROUP BY d.doc_id, d.text""",
}
