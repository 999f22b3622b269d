"""Record types. `from`, `to`, `name`, `language` and `source` are keywords of SQL and carry longer names."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _B = T.StringType(), T.IntegerType(), T.BooleanType()

SYMBOL = T.StructType([
    T.StructField("repo_id", _S), T.StructField("qualified_name", _S), T.StructField("short_name", _S), T.StructField("kind", _S), T.StructField("file_path", _S), T.StructField("start_line", _I), T.StructField("end_line", _I),
    T.StructField("signature", _S), T.StructField("exported", _B), T.StructField("jsdoc", _S), T.StructField("synthesized_description", _S), T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("body_hash", _S), T.StructField("description_source_hash", _S), T.StructField("indexed_at", T.TimestampNTZType()),
])
EDGE = T.StructType([T.StructField("from_qname", _S), T.StructField("to_qname", _S), T.StructField("kind", _S), T.StructField("edge_source", _S)])
FILE = T.StructType([T.StructField("path", _S), T.StructField("file_language", _S), T.StructField("content_hash", _S), T.StructField("last_modified", T.TimestampNTZType()), T.StructField("extractor_version", _I)])
MANIFEST = T.StructType([T.StructField("repo_id", _S), T.StructField("embedder_identity", _S), T.StructField("embedder_dimension", _I), T.StructField("schema_version", _I), T.StructField("last_indexed_at", T.TimestampNTZType())])

#: What pattern queries return of a symbol.
SYMBOL_COLS = ["qualified_name", "kind", "file_path", "start_line", "end_line", "signature", "exported"]

# fixed values: the kinds of symbols and edges, and where edges come from
SYMBOL_KINDS = "function method class interface type component hook constant module struct enum trait impl static".split()
EDGE_KINDS = "calls imports implements references uses_type defines extends re_exports co_changed tested_by modified_in".split()
EDGE_SOURCES = "tree_sitter lsp derived".split()
SCHEMA_VERSION = 1
EXTRACTOR_VERSION = 1
