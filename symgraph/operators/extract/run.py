"""File texts to symbols and edges, distributed by file."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.functions.text import language_of, short_name
from symgraph.operators.extract import lexer, rust, typescript
from symgraph.session import spread

_SYMBOL = pa.struct([("name", pa.string()), ("kind", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32()), ("signature", pa.string()), ("exported", pa.bool_())])
_EDGE = pa.struct([("from", pa.string()), ("to", pa.string()), ("kind", pa.string()), ("line", pa.int32())])
_DDL = "path string, symbols array<struct<name: string, kind: string, start_line: int, end_line: int, signature: string, exported: boolean>>, edges array<struct<from: string, to: string, kind: string, line: int>>"


def extract(path: str, text: str) -> tuple[list[dict], list[dict]]:
    family = lexer.family_of(path)
    return (rust if family == lexer.RUST else typescript).extract(path, text)


def extract_files(files: DataFrame) -> DataFrame:
    """path, symbols, edges of each source file (path, text); files without text or language are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [extract(p.as_py(), t.as_py()) for p, t in zip(batch.column(0), batch.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s for s, _ in out], pa.list_(_SYMBOL)), pa.array([e for _, e in out], pa.list_(_EDGE))], names=["path", "symbols", "edges"])

    source = files.filter(language_of("path").isNotNull() & F.col("text").isNotNull()).select("path", "text")
    return spread(source, "path").mapInArrow(run, _DDL)


def symbols_of(extracted: DataFrame) -> DataFrame:
    """One row per declaration in the order of its file: ordinal counts within the file."""
    s = extracted.select("path", F.posexplode("symbols").alias("ordinal", "s"))
    q = F.concat("path", F.lit("::"), F.replace(F.col("s.name"), F.lit("`"), F.lit("_")))
    return s.select(q.alias("qualified_name"), short_name(q).alias("short_name"), F.col("s.kind").alias("kind"), F.col("path").alias("file_path"), "s.start_line", "s.end_line", "s.signature", "s.exported", "ordinal")


def edges_of(extracted: DataFrame) -> DataFrame:
    e = extracted.select("path", F.explode("edges").alias("e"))
    return e.select(F.col("path").alias("file_path"), F.col("e.from").alias("from_qname"), F.col("e.to").alias("to_raw"), F.col("e.kind").alias("kind"), F.lit("tree_sitter").alias("edge_source"), F.col("e.line").alias("line_no"))
