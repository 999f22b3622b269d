"""A graph in a folder: indexed step by step, described, asked.

An index run extracts and embeds only files whose hash or extractor version isn't the stored one. Their symbols
are upserted, so that descriptions stay unless the body they were made from has changed; symbols that are gone
from a touched file are pruned; edges of touched files are replaced; files that are gone are forgotten with all
that hangs on them. What is extracted is written once, since embedding costs more than anything else. All
tables of a run become visible in one step, and a run that finds nothing to do publishes nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph import schema as S
from symgraph.functions.text import body_slice, lines, synthesis_prompt
from symgraph.operators import evaluate, find, models, patterns, resolve, store, vector
from symgraph.operators.models import Embedder, Reranker, Synthesizer
from symgraph.session import materialize
from symgraph.sources import scan

#: Neighbours per side shown to a synthesizer; candidates that are described at query time.
NEIGHBORS, AT_QUERY = 3, 5

Tables = dict[str, DataFrame]


def empty(spark: SparkSession) -> Tables:
    graph_symbol = [f for f in S.SYMBOL if f.name not in ("repo_id", "jsdoc", "indexed_at")]
    return {"symbols": spark.createDataFrame([], type(S.SYMBOL)(graph_symbol)), "edges": spark.createDataFrame([], S.EDGE), "files": spark.createDataFrame([], S.FILE), "manifest": spark.createDataFrame([], S.MANIFEST)}


def _record(spark: SparkSession, repo_id: str, embedder: Embedder) -> DataFrame:
    row = spark.createDataFrame([(repo_id, embedder.identity, embedder.dimension, S.SCHEMA_VERSION)], "repo_id string, embedder_identity string, embedder_dimension int, schema_version int")
    return row.withColumn("last_indexed_at", F.current_timestamp().cast("timestamp_ntz"))


def reindex(old: Tables, changed: DataFrame, gone: DataFrame, embedder: Embedder | None, resolved: DataFrame | None = None) -> Tables:
    """symbols, edges and files after the changed files (path, text, file_language, content_hash, last_modified)
    and without those in gone (path). resolved: edges of a language server, which win over the parser's."""
    symbols, edges, files = store.forget_files(old["symbols"], old["edges"], old["files"], gone)
    syms, found = scan.extracted(changed, embedder)
    syms, found = materialize(syms, "new_symbols"), materialize(found, "new_edges")
    touched = changed.select("path")
    symbols = store.upsert_symbols(symbols, syms.drop("body_hash", "embedding").withColumn("ordinal", F.lit(0)))
    symbols = store.prune_stale(symbols, touched.withColumnRenamed("path", "file_path"), syms)
    symbols = store.restamp(symbols, syms.select("qualified_name", "body_hash"))
    if embedder is not None:
        symbols = store.set_embedding_and_hash(symbols, syms.select("qualified_name", "embedding", "body_hash"))
    edges = store.replace_outgoing(edges, found, touched)
    if resolved is not None:
        edges = resolve.refine(edges, resolved)
    return {"symbols": symbols, "edges": store.drop_dangling(edges, symbols), "files": store.upsert_files(files, scan.records(changed))}


def describe(tables: Tables, texts: DataFrame, synthesizer: Synthesizer, embedder: Embedder, limit: int | None = None, force: bool = False, wanted: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(symbols with new descriptions and their embeddings, one row of counts: considered, synthesized, skipped,
    failed). texts: path, text. Undescribed symbols, or all by force, or those wanted (qualified_name); a
    symbol whose model call fails or says nothing is counted and left as it is."""
    symbols, edges = tables["symbols"], tables["edges"]
    of = symbols if wanted is None else symbols.join(wanted.select("qualified_name").distinct(), "qualified_name", "left_semi")
    todo = patterns.list_for_synthesis(of, all_symbols=force, limit=limit).withColumn("has_description", F.lit(False))
    answered = materialize(models.synthesize(prompts(todo, symbols, edges, texts), synthesizer), "answers")
    made = models.embed_column(answered.filter("status = 'synthesized'").select("qualified_name", "synthesized_description"), embedder, "synthesized_description")
    return store.set_description_and_embedding(symbols, materialize(made, "descriptions")), evaluate.outcome_counters(answered)


def prompts(todo: DataFrame, symbols: DataFrame, edges: DataFrame, texts: DataFrame) -> DataFrame:
    """todo with its prompt. texts: path, text; a symbol without text is described from its signature."""
    near = patterns.synthesis_context(symbols, edges, todo, NEIGHBORS)
    side = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("neighbor", "signature"))))
    per = near.groupBy(F.col("qualified_name").alias("__q")).agg(side("caller").alias("__cr"), side("callee").alias("__ce"))
    ls = texts.filter("path IS NOT NULL").select(F.col("path").alias("__p"), lines("text").alias("__ls"))
    both = todo.join(ls, F.col("file_path") == F.col("__p"), "left").join(per, F.col("qualified_name") == F.col("__q"), "left")
    none = F.array().cast("array<struct<neighbor: string, signature: string>>")
    prompt = synthesis_prompt("qualified_name", "signature", body_slice("__ls", "start_line", "end_line"), F.coalesce("__cr", none), F.coalesce("__ce", none))
    return both.select(*todo.columns, prompt.alias("prompt"))


class Graph:
    """A graph of one repository in a folder of snapshots."""

    def __init__(self, spark: SparkSession, root: str, repo_id: str):
        self.spark, self.repo_id, self.snapshots = spark, repo_id, store.Snapshots(spark, root)

    def tables(self) -> Tables:
        if self.snapshots.current() is None:
            return empty(self.spark)
        return {t: self.snapshots.read(t) for t in ("symbols", "edges", "files", "manifest")}

    def index(self, files: DataFrame, embedder: Embedder, resolved: DataFrame | None = None, force: bool = False, whole: bool = True) -> int:
        """Brings the graph up to the scanned files and returns how many of them were indexed. force forgets what
        is stored; whole says that files which aren't listed are gone."""
        old = empty(self.spark) if force else self.tables()
        if not force:
            store.check_schema_version(old["manifest"], self.repo_id)
            vector.check_embedder(old["manifest"], self.repo_id, embedder.identity, embedder.dimension)
        changed = materialize(scan.changed(files, old["files"]), "changed")
        gone = old["files"].join(files.select("path"), "path", "left_anti").select("path")
        return self._apply(old, changed, gone if whole else gone.limit(0), embedder, resolved, force)

    def _apply(self, old: Tables, changed: DataFrame, gone: DataFrame, embedder: Embedder, resolved: DataFrame | None, force: bool = False) -> int:
        gone = materialize(gone, "gone")
        n = changed.count()
        if not n and gone.isEmpty() and resolved is None and not force:
            return 0
        new = reindex(old, changed, gone, embedder, resolved)
        self._publish({**new, "manifest": store.write_manifest(old["manifest"], _record(self.spark, self.repo_id, embedder))})
        return n

    def _publish(self, tables: Tables) -> None:
        self.snapshots.publish(tables)
        self.snapshots.vacuum()

    def changes(self, files: DataFrame, embedder: Embedder) -> int:
        """Indexes those of some changed files whose content is new; no other is forgotten."""
        return self.index(files, embedder, whole=False)

    def forget(self, paths: DataFrame) -> None:
        """Forgets files (path) that are gone; those that were never known change nothing."""
        old = self.tables()
        gone = materialize(old["files"].join(paths.select("path"), "path", "left_semi").select("path"), "gone")
        if not gone.isEmpty():
            s, e, f = store.forget_files(old["symbols"], old["edges"], old["files"], gone)
            self._publish({**old, "symbols": s, "edges": e, "files": f})

    def describe(self, texts: DataFrame, synthesizer: Synthesizer, embedder: Embedder, **options) -> dict:
        old = self.tables()
        symbols, counts = describe(old, texts, synthesizer, embedder, **options)
        row = counts.first().asDict()
        if row["synthesized"]:
            self._publish({**old, "symbols": symbols})
        return row

    def set_description(self, qname: str, text: str, embedder: Embedder) -> bool:
        """False if there is no such symbol."""
        old = self.tables()
        if old["symbols"].filter(F.col("qualified_name") == qname).isEmpty():
            return False
        one = self.spark.createDataFrame([(qname, text, [float(x) for x in embedder.embed([text])[0]])], "qualified_name string, synthesized_description string, embedding array<float>")
        self._publish({**old, "symbols": store.set_description_and_embedding(old["symbols"], one)})
        return True

    def refresh_hashes(self) -> int:
        """Descriptions without a known source take the body as it is now; how many."""
        old = self.tables()
        symbols, n = store.backfill_source_hashes(old["symbols"])
        count = n.first()["n_updated"]
        if count:
            self._publish({**old, "symbols": symbols})
        return count

    def find(self, text: str, embedder: Embedder, reranker: Reranker | None = None, texts: DataFrame | None = None, limit: int = find.RESULTS) -> DataFrame:
        """node, cosine, rerank, origin, reranker_degraded: the symbols nearest to a text and what is one edge away from
        them, reranked by their descriptions, signatures and, where there are texts (path, text), bodies. Without
        a reranker, or where it has no opinion at all, the order is that of the cosine."""
        t = self.tables()
        vector.check_embedder(t["manifest"], self.repo_id, embedder.identity, embedder.dimension)
        query = [float(x) for x in embedder.embed([text])[0]]
        scores = vector.usable(t["symbols"], "embedding", len(query)).select(F.col("qualified_name").alias("node"), vector.cosine(F.col("embedding"), F.lit(query)).alias("cosine"))
        seeds = scores.orderBy(F.desc("cosine"), "node").limit(find.SEEDS)
        cands = materialize(find.candidates(seeds, find.expand_one_hop(seeds, t["edges"]), scores), "candidates")
        if reranker is None:
            return find.reranked(cands, F.lit(None).cast("double"), limit)
        ls = None if texts is None else texts.filter("path IS NOT NULL").select(F.col("path").alias("__p"), lines("text").alias("__ls"))
        about = t["symbols"].join(cands.select(F.col("node").alias("qualified_name")), "qualified_name", "left_semi")
        about = about.withColumn("__ls", F.lit(None).cast("array<string>")) if ls is None else about.join(ls, F.col("file_path") == F.col("__p"), "left")
        document = find.rerank_document(F.col("synthesized_description"), F.col("signature"), body_slice("__ls", "start_line", "end_line"))
        asked = models.rerank_column(about.select("qualified_name", document.alias("document")), reranker, text, "document")
        opinions = materialize(asked.select(F.col("qualified_name").alias("node"), F.col("rerank").alias("opinion")), "opinions")
        return find.reranked(cands.join(opinions, "node", "left"), F.col("opinion"), limit)

    def describe_at_query(self, candidates: DataFrame, texts: DataFrame, synthesizer: Synthesizer, embedder: Embedder) -> dict:
        """Describes the first undescribed candidates (node, cosine) of a search, the most similar first, and keeps
        the descriptions; the search is then asked again."""
        old = self.tables()
        bare = candidates.join(old["symbols"].filter(~store.described()).select(F.col("qualified_name").alias("node")), "node", "left_semi")
        wanted = bare.orderBy(F.desc_nulls_last("cosine"), "node").limit(AT_QUERY).select(F.col("node").alias("qualified_name"))
        return self.describe(texts, synthesizer, embedder, wanted=materialize(wanted, "wanted"))
