"""Scanning a tree of source files, and indexing it into a graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions.text import body_hash, body_slice, content_hash, excluded, language_of, lines
from symgraph.operators import resolve, store
from symgraph.operators.extract.run import edges_of, extract_files, symbols_of
from symgraph.operators.models import Embedder, embed_column
from symgraph.schema import EXTRACTOR_VERSION


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path (relative to root), text, file_language, content_hash, last_modified of every source file below
    root. Folders of builds and dependencies, other extensions and files that aren't UTF-8 are left
    out; the filters on the path come before contents are read."""
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base)
    full = F.regexp_replace("path", "^[a-z]+:/*", "/")
    path = F.regexp_replace(full, f"^.*?\\Q{base.split(':', 1)[-1].lstrip('/')}\\E/", "")
    kept = raw.withColumn("rel", path).filter(~excluded(F.concat(F.lit("/"), F.col("rel"))) & language_of("rel").isNotNull() & F.is_valid_utf8("content"))
    text = F.col("content").cast("string")
    return kept.select(F.col("rel").alias("path"), text.alias("text"), language_of("rel").alias("file_language"), content_hash(text).alias("content_hash"), F.col("modificationTime").cast("timestamp_ntz").alias("last_modified"))


def scan_paths(spark: SparkSession, root: str, paths: DataFrame) -> DataFrame:
    """The state of the given paths (relative) below root: as scan() gives it, with null text for those that
    aren't there any more or are left out."""
    return paths.select("path").distinct().join(scan(spark, root), "path", "left")


def changed(files: DataFrame, stored: DataFrame) -> DataFrame:
    """Files whose hash or extractor version isn't the stored one."""
    same = store.unchanged_files(files, stored).filter("unchanged").select("path")
    return files.join(same, "path", "left_anti")


def extracted(files: DataFrame, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame]:
    """(symbols with body_hash and, if there is an embedder, embedding; edges whose bare targets were looked
    for in their file) of scanned files (path, text). Of several declarations of one name the last wins, before
    its body is hashed."""
    raw = extract_files(files)
    syms = store.last_per_key(symbols_of(raw), ["qualified_name"], [F.col("ordinal")]).drop("ordinal")
    texts = files.select(F.col("path").alias("file_path"), lines("text").alias("ls"))
    bodies = syms.join(texts, "file_path").withColumn("body", body_slice("ls", "start_line", "end_line")).withColumn("body_hash", body_hash("signature", "body"))
    if embedder is not None:
        bodies = embed_column(bodies.withColumn("__t", F.concat_ws("\n\n", "signature", "body")), embedder, "__t").drop("__t")
    edges = resolve.same_file(edges_of(raw), syms).select("from_qname", F.col("to_resolved").alias("to_qname"), "kind", "edge_source").distinct()
    return bodies.drop("ls", "body"), edges


def records(files: DataFrame) -> DataFrame:
    """What is kept of a file after it was indexed."""
    return files.select("path", "file_language", "content_hash", "last_modified", F.lit(EXTRACTOR_VERSION).alias("extractor_version"))


def index(files: DataFrame, embedder: Embedder | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(symbols, edges, file records) of scanned files, from nothing. Edges are those both of whose ends are
    symbols, and imports, which stay at the level of files."""
    syms, edges = extracted(files, embedder)
    return syms, store.drop_dangling(edges, syms), records(files)


def lsp_edges(spark: SparkSession, path: str) -> DataFrame:
    """Edges of a language server, as JSON lines of from, to, kind, source; lines of other form are left out."""
    raw = spark.read.schema("`from` string, `to` string, kind string, source string").json(path)
    return raw.filter("`from` IS NOT NULL AND `to` IS NOT NULL AND kind IS NOT NULL").select(F.col("from").alias("from_qname"), F.col("to").alias("to_qname"), "kind", F.coalesce("source", F.lit("lsp")).alias("edge_source"))
