"""Names to symbols: within a file, across files, and by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def same_file(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """edges (file_path, to_raw, ...) with to_resolved: a bare name becomes the symbol of that short name in
    the same file, the first by name if there are several; anything with `::` or `/` stays."""
    names = symbols.groupBy(F.col("file_path").alias("s_path"), F.col("short_name").alias("s_name")).agg(F.min("qualified_name").alias("s_qname"))
    bare = ~(F.col("to_raw").contains("::") | F.col("to_raw").contains("/"))
    on = (F.col("file_path") == F.col("s_path")) & (F.col("to_raw") == F.col("s_name")) & bare
    return edges.join(names, on, "left").select(*edges.columns, F.coalesce("s_qname", "to_raw").alias("to_resolved"))


#: Lines of a file in one block of the range join.
LINES = 64


def containing(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """site, qualified_name: the innermost symbol around each site (site, file_path, line); of equally
    short ones the first by name. Sites outside any symbol are left out.

    Spans are dealt to blocks of lines, so that the join is on file and block: a file with
    very many symbols is many keys."""
    spans = symbols.filter("start_line IS NOT NULL AND end_line >= start_line").select("file_path", "qualified_name", "start_line", "end_line", F.explode(F.sequence(F.floor(F.col("start_line") / LINES), F.floor(F.col("end_line") / LINES))).alias("block"))
    s = sites.select("site", F.col("file_path").alias("p"), "line", F.floor(F.col("line") / LINES).alias("b"))
    hit = s.join(spans, (F.col("p") == F.col("file_path")) & (F.col("b") == F.col("block")) & F.col("line").between(F.col("start_line"), F.col("end_line")))
    return hit.groupBy("site").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("len"), "qualified_name")).alias("m")).select("site", "m.qualified_name")


#: The ways to resolve a reference, the surest first.
STRATEGIES = ["qualified", "same_file", "imported", "re_export", "receiver", "same_repo", "generic", "placeholder"]


def cross_file(raw: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """raw_id, to_resolved, strategy of each raw edge (raw_id, repo_id, file_path, to_raw).

    qualified: the text is a symbol's qualified name. same_file: a symbol of that short name in the
    file. imported: one in a file that this file imports from. re_export: one that a symbol of such a file
    re-exports. receiver: the text is a receiver and a name, and a method of the file or of one it imports
    from has that name. same_repo and generic: one in the repository or anywhere, if it is the only one.
    placeholder: nothing; the text stays. The surest wins, then the name."""
    text = F.trim("to_raw")
    refs = raw.filter(F.coalesce(text, F.lit("")) != "").select("raw_id", F.col("repo_id").alias("r_repo"), F.col("file_path").alias("r_path"), text.alias("ref"))
    # each reference text is resolved once per file, however often it stands there
    distinct = refs.select("r_repo", "r_path", "ref").distinct()
    sym = symbols.select("qualified_name", "short_name", "repo_id", "file_path", "kind").distinct()
    found = lambda df, way: df.select("r_repo", "r_path", "ref", F.lit(STRATEGIES.index(way)).alias("rank"), F.col("qualified_name").alias("q"))
    qualified = found(distinct.join(sym, F.col("ref") == F.col("qualified_name")), "qualified")
    own = found(distinct.join(sym, (F.col("r_path") == F.col("file_path")) & (F.col("ref") == F.col("short_name"))), "same_file")
    targets = edges.filter("kind = 'imports'").select(F.col("from_qname").alias("i_path"), F.col("to_qname").alias("i_target")).distinct()
    place = sym.select(F.col("qualified_name").alias("i_target"), F.col("file_path").alias("i_file"))
    files = targets.join(place, "i_target").select("i_path", "i_file").distinct()
    via = distinct.join(files, F.col("r_path") == F.col("i_path"))
    imported = found(via.join(sym, (F.col("i_file") == F.col("file_path")) & (F.col("ref") == F.col("short_name"))), "imported")
    again = edges.filter("kind = 're_exports'").select(F.col("from_qname").alias("i_target"), F.col("to_qname").alias("qualified_name")).distinct()
    passed = again.join(place.withColumnRenamed("i_file", "x_file"), "i_target").join(sym.select("qualified_name", "short_name"), "qualified_name").select("x_file", "short_name", "qualified_name").distinct()
    re_export = found(via.join(passed, (F.col("i_file") == F.col("x_file")) & (F.col("ref") == F.col("short_name"))), "re_export")
    # a receiver and a name, as in `a.b` or `A::b`; paths are none
    method = F.regexp_extract("ref", r"^[^/]*(?:\.|::)([^./:]+)$", 1)
    called = distinct.withColumn("m", method).filter("m <> ''")
    methods = sym.filter("kind = 'method'")
    here = found(called.join(methods, (F.col("r_path") == F.col("file_path")) & (F.col("m") == F.col("short_name"))), "receiver")
    there = found(called.join(files, F.col("r_path") == F.col("i_path")).join(methods, (F.col("i_file") == F.col("file_path")) & (F.col("m") == F.col("short_name"))), "receiver")
    in_repo = sym.groupBy("repo_id", "short_name").agg(F.count(F.lit(1)).alias("n"), F.min("qualified_name").alias("qualified_name")).filter("n = 1")
    repo = found(distinct.join(in_repo, (F.col("r_repo") == F.col("repo_id")) & (F.col("ref") == F.col("short_name"))), "same_repo")
    anywhere = sym.groupBy("short_name").agg(F.count(F.lit(1)).alias("n"), F.min("qualified_name").alias("qualified_name")).filter("n = 1")
    generic = found(distinct.join(anywhere, F.col("ref") == F.col("short_name")), "generic")
    ranked = distinct.select("r_repo", "r_path", "ref", F.lit(STRATEGIES.index("placeholder")).alias("rank"), F.col("ref").alias("q"))
    for way in (qualified, own, imported, re_export, here, there, repo, generic):
        ranked = ranked.unionByName(way)
    best = ranked.groupBy("r_repo", "r_path", "ref").agg(F.min(F.struct("rank", "q")).alias("m"))
    names = F.element_at(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("m.rank") + 1)
    return refs.join(best, ["r_repo", "r_path", "ref"]).select("raw_id", F.col("m.q").alias("to_resolved"), names.alias("strategy"))


def by_position(raw: DataFrame, places: DataFrame, symbols: DataFrame) -> DataFrame:
    """raw_id, to_resolved, edge_source of references (raw_id, to_raw, edge_source): where a language server has
    placed a definition (places: raw_id, def_path, def_line) inside a symbol, that symbol; else the text as it is."""
    sites = places.select(F.col("raw_id").alias("site"), F.col("def_path").alias("file_path"), F.col("def_line").alias("line"))
    hit = containing(sites, symbols).select(F.col("site").alias("__r"), F.col("qualified_name").alias("__q"))
    return raw.join(hit, F.col("raw_id") == F.col("__r"), "left").select("raw_id", F.coalesce("__q", "to_raw").alias("to_resolved"), F.when(F.col("__q").isNotNull(), "lsp").otherwise(F.col("edge_source")).alias("edge_source"))


def refine(parsed: DataFrame, resolved: DataFrame) -> DataFrame:
    """Edges of a resolver (same columns) after the parser's: of one (from, kind, to) the later wins."""
    both = parsed.withColumn("__o", F.lit(0)).unionByName(resolved.withColumn("__o", F.lit(1)))
    w = Window.partitionBy("from_qname", "kind", "to_qname").orderBy(F.desc("__o"))
    return both.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__o")
