"""Mutations of the graph as pure functions (old, delta) -> new, and the publishing of snapshots.

Merges are full outer joins on the key; which columns a mutation may touch is part of
it. Deltas may hold a key several times: the last by `ordinal` (or the given order) wins,
found by a map-side combined max_by."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph import schema as S


def last_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of the greatest order for each key; null keys are keys."""
    rest = [c for c in df.columns if c not in keys]
    s = df.select(*keys, F.struct(*rest).alias("s"), F.struct(*order).alias("o"))
    return s.groupBy(*keys).agg(F.max_by("s", "o").alias("s")).select(*keys, *[F.col("s")[c].alias(c) for c in rest]).select(*df.columns)


def latest_symbols(symbols: DataFrame) -> DataFrame:
    return last_per_key(symbols, ["qualified_name"], [F.col("indexed_at")])


def latest_where(log: DataFrame, condition: Column) -> DataFrame:
    """The latest rows that meet a condition, which reaches the scan: keys of rows that meet it are found first,
    and only their rows are grouped."""
    keys = log.filter(condition).select("qualified_name").distinct()
    return latest_symbols(log.join(keys, "qualified_name", "left_semi")).filter(condition)


def merge_edges(edges: DataFrame, order: list[Column]) -> DataFrame:
    """from_qname, kind, to_qname, edge_source: one edge per (from, kind, to), the source of the last."""
    return edges.groupBy("from_qname", "kind", "to_qname").agg(F.max_by("edge_source", F.struct(*order)).alias("edge_source"))


def with_endpoints(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """Edges of which both ends are symbols; others drop silently. The names are unique on the right,
    so both are semi joins; a heavy end is split by AQE."""
    q = symbols.select("qualified_name").distinct()
    return edges.join(q, F.col("from_qname") == F.col("qualified_name"), "left_semi").join(q, F.col("to_qname") == F.col("qualified_name"), "left_semi")


def _merge(old: DataFrame, new: DataFrame, key: str, take: dict[str, Column]) -> DataFrame:
    """Full outer merge; take: per column what a key in both or only in the delta gets. o and n are the sides."""
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return joined.select(*[F.coalesce(f"o.{key}", f"n.{key}").alias(key) if c == key else (F.when(F.col(f"n.{key}").isNotNull(), take[c]).otherwise(F.col(f"o.{c}")).alias(c) if c in take else F.col(f"o.{c}").alias(c)) for c in old.columns])


def upsert_symbols(old: DataFrame, delta: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Scalars are overwritten; a null body_hash keeps the stored one; description, its hash and the
    embedding are never touched."""
    new = last_per_key(delta, ["qualified_name"], [F.col(ordinal)])
    kept = ("qualified_name", "synthesized_description", "embedding", "description_source_hash")
    take = {c: F.col(f"n.{c}") for c in old.columns if c in new.columns and c not in kept}
    if "body_hash" in take:
        take["body_hash"] = F.coalesce("n.body_hash", "o.body_hash")
    return _merge(old, new, "qualified_name", take)


def prune_stale(symbols: DataFrame, touched: DataFrame, keep: DataFrame) -> DataFrame:
    """Without the symbols of touched files (file_path) that aren't kept (qualified_name)."""
    stale = symbols.join(touched.select("file_path").distinct(), "file_path", "left_semi").join(keep.select("qualified_name"), "qualified_name", "left_anti").select("qualified_name")
    return symbols.join(stale, "qualified_name", "left_anti")


def drop_dangling(edges: DataFrame, symbols: DataFrame, file_level: bool = True) -> DataFrame:
    """Edges whose ends still exist; edges of files (imports) stay if file_level."""
    kept = with_endpoints(edges, symbols)
    return kept.unionByName(edges.filter("kind = 'imports'").join(with_endpoints(edges, symbols).select("from_qname", "kind", "to_qname"), ["from_qname", "kind", "to_qname"], "left_anti")) if file_level else kept


def forget_files(symbols: DataFrame, edges: DataFrame, files: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, edges, files) without the files in gone (path), their symbols and the edges of these."""
    dead = symbols.join(gone.select(F.col("path").alias("file_path")), "file_path", "left_semi").select("qualified_name").distinct()
    d = lambda end: dead.select(F.col("qualified_name").alias(end))
    return symbols.join(gone.select(F.col("path").alias("file_path")), "file_path", "left_anti"), edges.join(d("from_qname"), "from_qname", "left_anti").join(d("to_qname"), "to_qname", "left_anti"), files.join(gone.select("path"), "path", "left_anti")


def replace_outgoing(edges: DataFrame, extracted: DataFrame, touched: DataFrame) -> DataFrame:
    """Edges that start in re-extracted files (path) give way to what was extracted from them now."""
    path = F.when(F.col("kind") == "imports", F.col("from_qname")).otherwise(F.expr("left(from_qname, length(from_qname) - length(substring_index(from_qname, '::', -1)) - 2)"))
    return edges.withColumn("__p", path).join(touched.select(F.col("path").alias("__p")).distinct(), "__p", "left_anti").drop("__p").unionByName(extracted)


def upsert_files(old: DataFrame, delta: DataFrame) -> DataFrame:
    return _merge(old, delta, "path", {c: F.col(f"n.{c}") for c in old.columns if c != "path"})


def unchanged_files(listing: DataFrame, stored: DataFrame, version: int = S.EXTRACTOR_VERSION) -> DataFrame:
    """path, unchanged: the hash and the extractor's version are those stored; unknown paths have changed."""
    st = stored.select(F.col("path").alias("s_path"), F.col("content_hash").alias("s_hash"), F.col("extractor_version").alias("s_version"))
    return listing.join(st, F.col("path") == F.col("s_path"), "left").select("path", F.coalesce((F.col("content_hash") == F.col("s_hash")) & (F.col("s_version") == version), F.lit(False)).alias("unchanged"))


def _update(symbols: DataFrame, delta: DataFrame, take: dict[str, Column]) -> DataFrame:
    s, n = symbols.alias("o"), delta.alias("n")
    return s.join(n, F.col("o.qualified_name") == F.col("n.qualified_name"), "left").select(*[F.when(F.col("n.qualified_name").isNotNull(), take[c]).otherwise(F.col(f"o.{c}")).alias(c) if c in take else F.col(f"o.{c}").alias(c) for c in symbols.columns])


def set_embedding_and_hash(symbols: DataFrame, delta: DataFrame) -> DataFrame:
    return _update(symbols, delta, {"embedding": F.col("n.embedding"), "body_hash": F.col("n.body_hash")})


def set_description_and_embedding(symbols: DataFrame, delta: DataFrame) -> DataFrame:
    """The description's source is the body as it is now."""
    return _update(symbols, delta, {"synthesized_description": F.col("n.synthesized_description"), "embedding": F.col("n.embedding"), "description_source_hash": F.col("o.body_hash")})


def clear_and_reembed(symbols: DataFrame, delta: DataFrame) -> DataFrame:
    null = F.lit(None).cast("string")
    return _update(symbols, delta, {"synthesized_description": null, "description_source_hash": null, "body_hash": F.col("n.body_hash"), "embedding": F.col("n.embedding")})


def described() -> Column:
    """Empty counts as unset."""
    return F.coalesce("synthesized_description", F.lit("")) != ""


def restamp(symbols: DataFrame, hashes: DataFrame) -> DataFrame:
    """New body hashes (qualified_name, body_hash): a description made from another body is cleared; one
    without a known source stays."""
    j = symbols.alias("o").join(hashes.alias("n"), F.col("o.qualified_name") == F.col("n.qualified_name"), "left")
    stale = F.coalesce(F.col("o.description_source_hash") != F.col("n.body_hash"), F.lit(False))
    out = {"body_hash": F.coalesce("n.body_hash", "o.body_hash"), "synthesized_description": F.when(~stale, F.col("o.synthesized_description")), "description_source_hash": F.when(~stale, F.col("o.description_source_hash"))}
    return j.select(*[out.get(c, F.col(f"o.{c}")).alias(c) for c in symbols.columns])


def clear_all_descriptions(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols without descriptions, one row n_cleared); embeddings stay."""
    null = F.lit(None).cast("string")
    return symbols.withColumns({"synthesized_description": null, "description_source_hash": null}), symbols.agg(F.count_if(described()).alias("n_cleared"))


def _needs_hash() -> Column:
    return described() & (F.coalesce("description_source_hash", F.lit("")) == "") & (F.coalesce("body_hash", F.lit("")) != "")


def backfill_source_hashes(symbols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(symbols with a source hash wherever a described body has one, one row n_updated)."""
    return symbols.withColumn("description_source_hash", F.when(_needs_hash(), F.col("body_hash")).otherwise(F.col("description_source_hash"))), symbols.agg(F.count_if(_needs_hash()).alias("n_updated"))


def write_manifest(old: DataFrame, new: DataFrame) -> DataFrame:
    return _merge(old, new, "repo_id", {c: F.col(f"n.{c}") for c in old.columns if c != "repo_id"})


def read_manifest(manifest: DataFrame, repo_id: str) -> DataFrame:
    """The repository's row, if all of it is there; else none."""
    cols = ("repo_id", "embedder_identity", "embedder_dimension", "schema_version", "last_indexed_at")
    whole = F.lit(True)
    for c in cols:
        whole = whole & F.col(c).isNotNull()
    return manifest.filter((F.col("repo_id") == repo_id) & whole).select(*cols)


class SchemaMismatch(Exception):
    pass


def check_schema_version(manifest: DataFrame, repo_id: str) -> None:
    """A graph of another version must be migrated or rebuilt. One row is looked at."""
    row = manifest.filter(F.col("repo_id") == repo_id).select("schema_version").first()
    if row and row["schema_version"] not in (None, S.SCHEMA_VERSION):
        raise SchemaMismatch(f"{repo_id} has schema version {row['schema_version']}, not {S.SCHEMA_VERSION}")


def applied_migrations(migrations: DataFrame, graph: str) -> DataFrame:
    """id of each migration applied to a graph. migrations: graph, id, applied_at."""
    return migrations.filter(F.col("graph") == graph).select("id").distinct()


def run_migrations(migrations: DataFrame, graph: str, steps: dict[str, object]) -> DataFrame:
    """Runs the steps (id to a function without arguments) that weren't applied to the graph yet, in their
    order, and returns the table with them. Tables need no indices, so steps change data only."""
    spark = migrations.sparkSession
    done = {r["id"] for r in applied_migrations(migrations, graph).filter(F.col("id").isin(*steps)).collect()} if steps else set()
    new = [i for i in steps if i not in done]
    for i in new:
        steps[i]()
    added = spark.createDataFrame([(graph, i) for i in new], "graph string, id string").withColumn("applied_at", F.current_timestamp().cast("timestamp_ntz"))
    return migrations.unionByName(added)


class Snapshots:
    """Versions of named tables in a folder; readers follow one pointer that is replaced in one step."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def current(self) -> str | None:
        fs, p = self._fs(f"{self.root}/versions")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        done = [n for n in names if n.endswith(".json")]
        return done[-1][:-5] if done else None

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{table}/{self.current()}")

    def publish(self, tables: dict[str, DataFrame]) -> str:
        last = self.current()
        version = f"{int(last.split('-')[0]) + 1 if last else 1:08d}-{uuid.uuid4().hex[:8]}"
        for name, df in tables.items():
            df.write.parquet(f"{self.root}/{name}/{version}")
        fs, tmp = self._fs(f"{self.root}/versions/.{version}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(sorted(tables)).encode()))
        out.close()
        if not fs.rename(tmp, self._fs(f"{self.root}/versions/{version}.json")[1]):
            raise OSError(f"can't publish {version}")
        return version

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the newest versions; readers of these are not disturbed."""
        fs, p = self._fs(f"{self.root}/versions")
        done = sorted(s.getPath().getName()[:-5] for s in fs.listStatus(p) if s.getPath().getName().endswith(".json")) if fs.exists(p) else []
        for version in done[: max(0, len(done) - keep)]:
            for t in ("symbols", "edges", "files", "manifest"):
                fs.delete(self._fs(f"{self.root}/{t}/{version}")[1], True)
            fs.delete(self._fs(f"{self.root}/versions/{version}.json")[1], False)
