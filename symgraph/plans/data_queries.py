"""Registered queries of the general data operators, with the SQL to hold them against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.operators import incremental, references, skew
from symgraph.sources.tables import table


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    return references.orphan_references(t("edges"), t("raw_edges"), t("symbols"), t("files"), t("removed_symbols"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("rel", "row_id", "side", "state")


def p3_rates(spark: SparkSession, d: str) -> DataFrame:
    return references.orphan_rates(_orphans(spark, d), table(spark, d, "edges"), table(spark, d, "raw_edges"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return incremental.due_records(table(spark, d, "files"), table(spark, d, "symbols"), table(spark, d, "index_runs"))


def p5_targets(spark: SparkSession, d: str) -> DataFrame:
    """Per target and kind: rows and different sources."""
    per = skew.skew_aggregate(table(spark, d, "edges"), ["to_qname", "kind"], "from_qname", "edge_id")
    return per.select("to_qname", "kind", "n_rows", F.col("n_values").alias("n_sources"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    per = skew.skew_aggregate(table(spark, d, "edges"), ["to_qname", "kind"], "from_qname", "edge_id")
    return skew.heavy_keys(per, ["to_qname", "kind"], 0.01).select("to_qname", "kind")


QUERIES = {"p3_found": p3_found, "p3_rates": p3_rates, "p4_found": p4_found, "p5_found": p5_found, "p5_targets": p5_targets}

_REFS = """
refs AS (
  SELECT 'edges' AS rel, edge_id AS row_id, 'from' AS side, CASE WHEN kind = 'imports' THEN 'file' ELSE 'symbol' END AS ns, from_qname AS key, observed_at AS tm FROM edges
  UNION ALL SELECT 'edges', edge_id, 'to', 'symbol', to_qname, observed_at FROM edges
  UNION ALL SELECT 'raw_edges', raw_id, 'to', 'symbol', to_raw, extracted_at FROM raw_edges WHERE regexp_matches(to_raw, '^(?s:.*)/(?s:.*)::[^:]+$')
), seen AS (
  SELECT 'symbol' AS ns, qualified_name AS key, indexed_at AS tm FROM symbols UNION ALL SELECT 'file', path, seen_at FROM files
), first AS (SELECT ns, key, min(tm) AS first_seen FROM seen GROUP BY ALL
), judged AS (
  SELECT r.*, CASE
    WHEN f.key IS NULL THEN 'missing'
    WHEN f.first_seen > r.tm THEN 'late'
    WHEN r.ns = 'symbol' AND EXISTS (SELECT 1 FROM removed_symbols d WHERE d.qualified_name = r.key AND d.removed_at <= r.tm
      AND NOT EXISTS (SELECT 1 FROM symbols s WHERE s.qualified_name = r.key AND s.indexed_at > d.removed_at AND s.indexed_at <= r.tm)) THEN 'deleted'
    END AS state
  FROM refs r LEFT JOIN first f ON f.ns = r.ns AND f.key = r.key WHERE r.key IS NOT NULL
)"""

ORACLES = {
    "p3_found": f"WITH {_REFS} SELECT DISTINCT rel, row_id, side, state FROM judged WHERE state IS NOT NULL",
    "p3_rates": f"""WITH {_REFS} SELECT rel, side, CAST(tm AS DATE) AS day, count(*) FILTER (state = 'missing') AS n_missing, count(*) FILTER (state = 'late') AS n_late,
      count(*) FILTER (state = 'deleted') AS n_deleted, count(*) AS n_refs FROM judged GROUP BY ALL""",
    "p4_found": """WITH cuts AS (SELECT repo_id, max(started_at) AS cut FROM index_runs WHERE status = 'ok' GROUP BY 1),
    f AS (SELECT path, last_modified, seen_at, lower(content_hash) || '|' || coalesce(CAST(extractor_version AS VARCHAR), '-') AS h, coalesce(seen_at <= cut, false) AS done
      FROM files LEFT JOIN cuts USING (repo_id) WHERE content_hash IS NOT NULL),
    fn AS (SELECT path, max(row(last_modified, seen_at, h)) AS s, max(row(last_modified, seen_at, h)) FILTER (done) AS p FROM f GROUP BY 1),
    y AS (SELECT qualified_name, indexed_at, body_hash, coalesce(indexed_at <= cut, false) AS done FROM symbols LEFT JOIN cuts USING (repo_id)),
    yn AS (SELECT qualified_name, max(row(indexed_at, body_hash)) FILTER (body_hash IS NOT NULL) AS s,
      max(row(indexed_at, body_hash)) FILTER (body_hash IS NOT NULL AND done) AS p, bool_or(done) AS any_done FROM y GROUP BY 1)
    SELECT 'files' AS rel, path AS rec_key FROM fn WHERE p IS NULL OR s[3] <> p[3]
    UNION ALL SELECT 'symbols', qualified_name FROM yn WHERE NOT any_done OR s[2] IS DISTINCT FROM p[2]""",
    "p5_found": "SELECT to_qname, kind FROM edges GROUP BY 1, 2 HAVING count(*) >= 0.01 * (SELECT count(*) FROM edges)",
    "p5_targets": "SELECT to_qname, kind, count(*) AS n_rows, count(DISTINCT from_qname) AS n_sources FROM edges GROUP BY 1, 2",
}
