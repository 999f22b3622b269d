"""Pattern queries over symbols and edges. Results are sets of the seven symbol columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.functions.text import empty_as_null
from symgraph.operators.store import described
from symgraph.schema import SYMBOL_COLS, SYMBOL_KINDS


def named(name: str) -> Column:
    """By short or by qualified name."""
    return (F.col("short_name") == F.lit(name)) | (F.col("qualified_name") == F.lit(name))


def _ends(edges: DataFrame, kind: str, known: DataFrame, known_end: str, wanted: DataFrame, wanted_end: str) -> DataFrame:
    """Symbols at one end of edges whose other end is in `known`. The selective side filters the edges
    first, and the names that are left are made unique before they meet the symbols."""
    k = known.select(F.col("qualified_name").alias(known_end))
    names = edges.filter(F.col("kind") == kind).join(k, known_end, "left_semi").select(F.col(wanted_end).alias("qualified_name")).distinct()
    return wanted.join(names, "qualified_name", "left_semi").select(*SYMBOL_COLS)


def callers(symbols: DataFrame, edges: DataFrame, name: str, known: DataFrame | None = None) -> DataFrame:
    """known: the symbols of that name, where they are found by a shorter way than by filtering all. Edges may
    repeat, here and below."""
    return _ends(edges, "calls", symbols.filter(named(name)) if known is None else known, "to_qname", symbols, "from_qname")


def callees(symbols: DataFrame, edges: DataFrame, name: str, known: DataFrame | None = None) -> DataFrame:
    return _ends(edges, "calls", symbols.filter(named(name)) if known is None else known, "from_qname", symbols, "to_qname")


def definers(symbols: DataFrame, name: str) -> DataFrame:
    return symbols.filter(named(name)).select(*SYMBOL_COLS)


def imports(symbols: DataFrame, edges: DataFrame, path: str, known: DataFrame | None = None) -> DataFrame:
    """Symbols that import something of the file: symbol level."""
    return _ends(edges, "imports", symbols.filter(F.col("file_path") == path) if known is None else known, "to_qname", symbols, "from_qname")


def importing_files(symbols: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """path: files that import a symbol of the file. File-level imports start at a path."""
    target = symbols.filter(F.col("file_path") == path).select(F.col("qualified_name").alias("to_qname"))
    return edges.filter("kind = 'imports'").join(target, "to_qname", "left_semi").select(F.col("from_qname").alias("path")).distinct()


def dangling_imports(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """path, n_dangling: imports per file whose target is no symbol."""
    q = symbols.select(F.col("qualified_name").alias("to_qname"))
    return edges.filter("kind = 'imports'").join(q, "to_qname", "left_anti").groupBy(F.col("from_qname").alias("path")).agg(F.count(F.lit(1)).alias("n_dangling"))


def uses(symbols: DataFrame, edges: DataFrame, type_qname: str) -> DataFrame:
    return _ends(edges, "uses_type", symbols.filter(F.col("qualified_name") == type_qname), "to_qname", symbols, "from_qname")


def implements(symbols: DataFrame, edges: DataFrame, interface_qname: str) -> DataFrame:
    return _ends(edges, "implements", symbols.filter(F.col("qualified_name") == interface_qname), "to_qname", symbols, "from_qname")


def synthesis_context(symbols: DataFrame, edges: DataFrame, wanted: DataFrame, n: int = 3) -> DataFrame:
    """qualified_name, side, neighbor, signature: up to n callers and n callees of each wanted symbol, the
    first by name. The cap is the feature: a prompt has room for few."""
    calls = edges.filter("kind = 'calls'").select("from_qname", "to_qname").distinct()
    w = wanted.select("qualified_name")
    sides = []
    for side, own, other in (("caller", "to_qname", "from_qname"), ("callee", "from_qname", "to_qname")):
        near = calls.join(w.select(F.col("qualified_name").alias(own)), own, "left_semi").select(F.col(own).alias("qualified_name"), F.col(other).alias("neighbor"))
        sides.append(near.join(symbols.select(F.col("qualified_name").alias("neighbor"), "signature"), "neighbor").withColumn("side", F.lit(side)))
    order = Window.partitionBy("qualified_name", "side").orderBy("neighbor")
    return sides[0].unionByName(sides[1]).withColumn("i", F.row_number().over(order)).filter(F.col("i") <= n).select("qualified_name", "side", "neighbor", "signature")


def list_for_synthesis(symbols: DataFrame, all_symbols: bool = False, limit: int | None = None) -> DataFrame:
    """Undescribed symbols, or all; the first by name if there is a limit, which is the caller's budget."""
    out = symbols.select(*SYMBOL_COLS, described().alias("has_description"))
    out = out if all_symbols else out.filter("NOT has_description")
    return out if limit is None else out.orderBy("qualified_name").limit(limit)


def decoded(symbols: DataFrame) -> DataFrame:
    """Rows that are symbols: of a known kind, with a name, a file, lines and a signature; others drop."""
    whole = F.col("qualified_name").isNotNull() & F.col("file_path").isNotNull() & F.col("start_line").isNotNull() & F.col("end_line").isNotNull() & F.col("signature").isNotNull()
    return symbols.filter(F.col("kind").isin(*SYMBOL_KINDS) & whole)


def all_imports(symbols: DataFrame, edges: DataFrame, path: str) -> DataFrame:
    """importer, level: the symbols and the files that import something of a file, in one relation."""
    by_symbol = imports(symbols, edges, path).select(F.col("qualified_name").alias("importer"), F.lit("symbol").alias("level"))
    return by_symbol.unionByName(importing_files(symbols, edges, path).select(F.col("path").alias("importer"), F.lit("file").alias("level"))).distinct()


def stale_descriptions(symbols: DataFrame) -> DataFrame:
    """Described from a body that isn't the stored one; an unknown body or source isn't stale."""
    src = F.coalesce("description_source_hash", F.lit(""))
    return symbols.filter(described() & (src != "") & (F.col("description_source_hash") != F.col("body_hash"))).select("qualified_name", "body_hash", "description_source_hash")


def describe(symbols: DataFrame) -> DataFrame:
    return symbols.select("qualified_name", *[empty_as_null(c).alias(c) for c in ("synthesized_description", "body_hash", "description_source_hash")])


def source_hashes(symbols: DataFrame, names: DataFrame) -> DataFrame:
    """qualified_name, description_source_hash of the named symbols that have one."""
    return symbols.filter(F.coalesce("description_source_hash", F.lit("")) != "").join(names.select("qualified_name").distinct(), "qualified_name", "left_semi").select("qualified_name", "description_source_hash")
