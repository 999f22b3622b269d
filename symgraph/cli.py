"""python -m symgraph.cli VERB ...: index a tree into a store, describe its symbols, and ask it."""

from __future__ import annotations

import argparse
import os
import sys
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.operators import find, models, patterns, store, vector
from symgraph.plans.graph import Graph
from symgraph.plans.passthrough import raw_query
from symgraph.session import drop_intermediates, local_session
from symgraph.sources import config, scan, sinks

ASK = ("callers", "callees", "definers", "imports", "uses", "implements")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="symgraph")
    p.add_argument("--store", default=".symgraph")
    p.add_argument("--repo-id", default="default")
    p.add_argument("--config", help="the user's configuration file")
    p.add_argument("--stubs", action="store_true", help="deterministic stand-ins for the models")
    p.add_argument("--json", action="store_true")
    sub = p.add_subparsers(dest="verb", required=True)
    v = sub.add_parser("index", help="bring the graph up to a tree")
    v.add_argument("root")
    v.add_argument("--force-cold-rebuild", action="store_true")
    v.add_argument("--since", help="look only at files changed at or after this time, forget none")
    v.add_argument("--file", action="append", help="look only at this file of the tree, forget none")
    v.add_argument("--resolved", help="edges of a language server, as JSON lines")
    v = sub.add_parser("watch", help="index a tree, then follow change events (path, kind, at) that arrive as Parquet files")
    v.add_argument("root")
    v.add_argument("--events", required=True)
    v.add_argument("--once", action="store_true", help="stop when all that is there has been read")
    v = sub.add_parser("synthesize", help="describe symbols that have no description")
    v.add_argument("root")
    v.add_argument("--limit", type=int)
    v.add_argument("--force", action="store_true")
    v.add_argument("--refresh-hashes-only", action="store_true")
    v = sub.add_parser("set-description")
    v.add_argument("name")
    v.add_argument("text")
    v = sub.add_parser("list-for-synthesis")
    v.add_argument("--all", action="store_true")
    v.add_argument("--limit", type=int)
    sub.add_parser("stale")
    sub.add_parser("manifest")
    v = sub.add_parser("query", help="SQL over {symbols}, {edges}, {files} and {manifest}")
    v.add_argument("text")
    for verb in (*ASK, "describe"):
        sub.add_parser(verb).add_argument("name")
    v = sub.add_parser("find")
    v.add_argument("text")
    v.add_argument("--limit", type=int, default=20)
    v.add_argument("--rerank", action="store_true", help="with neighbours, by the configured reranker")
    v.add_argument("--root", help="the tree, so that the reranker reads bodies")
    return p


def embedder_of(c: dict, stubs: bool) -> models.Embedder:
    e = c["embedder"]
    return models.HashEmbedder() if stubs else models.HttpEmbedder(c["endpoint"], e["model"], e["dimension"])


def synthesizer_of(c: dict, stubs: bool) -> models.Synthesizer | None:
    if stubs:
        return models.FirstLineSynthesizer()
    return models.HttpSynthesizer(c["endpoint"], c["synthesizer"]) if c["synthesizer"] not in (None, "off") else None


def reranker_of(c: dict, stubs: bool) -> models.Reranker | None:
    if stubs:
        return models.OverlapReranker()
    return models.HttpReranker(c["endpoint"], c["reranker"], c["concurrency"]) if c["reranker"] else None


def watch(spark: SparkSession, graph: Graph, root: str, events: str, embedder: models.Embedder, once: bool) -> int:
    """The whole tree first, so that what changed before the stream began is not missed; then batches."""
    from symgraph.streaming import changes

    n = graph.index(scan.scan(spark, root), embedder)
    stream = changes.change_stream(spark, events, "path string, kind string, at timestamp")
    seen: list[int] = []

    def batch(df: DataFrame, _: int) -> None:
        changes.apply_changes(spark, df, lambda paths: scan.scan_paths(spark, root, paths), lambda files: seen.append(graph.changes(files, embedder)), graph.forget)

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{graph.snapshots.root}/offsets").trigger(**({"availableNow": True} if once else {"processingTime": "2 seconds"})).start()
    q.awaitTermination()
    return n + sum(seen)


def main(args: list[str] | None = None) -> int:
    try:
        code = _run(parser().parse_args(args))
        drop_intermediates(local_session())
        return code
    except (vector.EmbedderMismatch, store.SchemaMismatch) as x:
        print(f"{x}; index --force-cold-rebuild starts anew", file=sys.stderr)
        return 1


def _run(a: argparse.Namespace) -> int:
    c = config.load(getattr(a, "root", None) or ".", a.config, dict(os.environ))
    embedder = embedder_of(c, a.stubs)
    spark = local_session()
    graph = Graph(spark, a.store, a.repo_id)
    if a.verb in ("index", "watch"):
        return _index(a, spark, graph, embedder)
    if graph.snapshots.current() is None:
        print("nothing is indexed yet", file=sys.stderr)
        return 1
    t = graph.tables()
    s, e = t["symbols"], t["edges"]
    as_symbols = sinks.symbols_json if a.json else sinks.symbols_text
    if a.verb == "synthesize":
        if a.refresh_hashes_only:
            print(f"{graph.refresh_hashes()} hashes refreshed")
            return 0
        synthesizer = synthesizer_of(c, a.stubs)
        if synthesizer is None:
            print("no synthesizer is configured", file=sys.stderr)
            return 1
        print(" ".join(f"{k}={v}" for k, v in graph.describe(scan.scan(spark, a.root), synthesizer, embedder, limit=a.limit, force=a.force).items()))
        return 0
    if a.verb == "set-description":
        return _known(graph.set_description(a.name, a.text, embedder), a.name)
    if a.verb == "find" and a.rerank:
        texts = scan.scan(spark, a.root) if a.root else None
        out = graph.find(a.text, embedder, reranker_of(c, a.stubs), texts, a.limit).select(F.to_json(F.struct("*")).alias("value"))
    elif a.verb == "find":
        found = find.find(s, t["manifest"], a.repo_id, embedder, a.text, a.limit)
        out = (sinks.hits_json if a.json else sinks.hits_text)(s.join(found, "qualified_name").orderBy(F.desc("score"), "qualified_name"))
    elif a.verb == "describe":
        out = patterns.describe(s.filter(F.col("qualified_name") == a.name)).select(F.to_json(F.struct("*")).alias("value"))
    elif a.verb == "list-for-synthesis":
        out = as_symbols(patterns.list_for_synthesis(s, a.all, a.limit))
    elif a.verb == "stale":
        out = patterns.stale_descriptions(s).select(F.to_json(F.struct("*")).alias("value"))
    elif a.verb == "manifest":
        out = t["manifest"].select(F.to_json(F.struct("*")).alias("value"))
    elif a.verb == "query":
        out = raw_query(spark, a.text, **t).select(F.to_json(F.struct("*")).alias("value"))
    elif a.verb == "definers":
        out = as_symbols(patterns.definers(s, a.name))
    else:
        out = as_symbols(getattr(patterns, a.verb)(s, e, a.name))
    n = 0
    for row in out.toLocalIterator():
        print(row["value"])
        n += 1
    return _known(a.verb != "describe" or n > 0, getattr(a, "name", ""))


def _index(a: argparse.Namespace, spark: SparkSession, graph: Graph, embedder: models.Embedder) -> int:
    if a.verb == "watch":
        n = watch(spark, graph, a.root, a.events, embedder, a.once)
    else:
        files = scan.scan(spark, a.root)
        if a.since:
            files = files.filter(F.col("last_modified") >= F.lit(datetime.fromisoformat(a.since)).cast("timestamp_ntz"))
        if a.file:
            files = files.filter(F.col("path").isin(*a.file))
        resolved = scan.lsp_edges(spark, a.resolved) if a.resolved else None
        n = graph.index(files, embedder, resolved, force=a.force_cold_rebuild, whole=not (a.since or a.file))
    print(f"{n} files indexed")
    return 0


def _known(ok: bool, name: str) -> int:
    if not ok:
        print(f"no symbol {name}; names are <path>::<name>", file=sys.stderr)
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main())
