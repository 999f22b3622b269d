"""Registered queries of the graph: relations, mutations, traversal, retrieval, reports; each with the SQL
to hold it against. Symbols are the latest rows, edges are merged to one per (from, kind, to)."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.functions import text as X
from symgraph.operators import derived, evaluate, find, models, patterns, personal, resolve, store, traverse, vector
from symgraph.operators.extract.run import edges_of, extract_files, symbols_of
from symgraph.plans import graph
from symgraph.plans.passthrough import raw_query
from symgraph.sources import scan
from symgraph.schema import SYMBOL_COLS, SYMBOL_KINDS
from symgraph.sources.tables import table

CORE = "tidepool/corelib/src/"
INFO, FAULT, PERSIST, WRAP, TICK = (CORE + x for x in ("log.rs::info", "error.rs::Fault", "store.rs::Persist", "error.rs::wrap_fault", "clock.rs::Tick"))
CUT = "2025-04-15"
COLS = ", ".join(SYMBOL_COLS)


def symbols(s: SparkSession, d: str, *cols: str) -> DataFrame:
    return store.latest_symbols(table(s, d, "symbols").select("qualified_name", "indexed_at", *[c for c in (cols or ("short_name", *SYMBOL_COLS[1:])) if c not in ("qualified_name", "indexed_at")]))


def known(s: SparkSession, d: str, condition) -> DataFrame:
    """The latest rows of the symbols that meet a condition, for lookups."""
    return store.latest_where(table(s, d, "symbols").select("qualified_name", "indexed_at", "short_name", *SYMBOL_COLS[1:]), condition)


def edge_log(s: SparkSession, d: str) -> DataFrame:
    """Edges as they are logged, for relations in which a repeated edge counts once anyway."""
    return table(s, d, "edges").select("from_qname", "kind", "to_qname")


def edges(s: SparkSession, d: str) -> DataFrame:
    return store.merge_edges(table(s, d, "edges"), [F.col("observed_at"), F.col("edge_id")])


def _one(s: SparkSession, *names: str) -> DataFrame:
    return s.createDataFrame([(n,) for n in names], "node string")


_SYM = "sym AS (SELECT * FROM symbols QUALIFY row_number() OVER (PARTITION BY qualified_name ORDER BY indexed_at DESC) = 1)"
_E = "e AS (SELECT from_qname, kind, to_qname, max(row(observed_at, edge_id, edge_source))[3] AS edge_source FROM edges GROUP BY ALL)"
_WITH = f"WITH RECURSIVE {_SYM}, {_E}"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None):
    def register(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


# ---- relations


@query("callers", f"{_WITH} SELECT DISTINCT {', '.join('a.' + c for c in SYMBOL_COLS)} FROM sym b JOIN e ON e.to_qname = b.qualified_name AND e.kind = 'calls' JOIN sym a ON a.qualified_name = e.from_qname WHERE b.short_name = 'info' OR b.qualified_name = 'info'")
def callers(s, d):
    return patterns.callers(symbols(s, d), edge_log(s, d), "info", known(s, d, patterns.named("info")))


@query("callees", f"{_WITH} SELECT DISTINCT {', '.join('b.' + c for c in SYMBOL_COLS)} FROM sym a JOIN e ON e.from_qname = a.qualified_name AND e.kind = 'calls' JOIN sym b ON b.qualified_name = e.to_qname WHERE a.short_name = '{INFO}' OR a.qualified_name = '{INFO}'")
def callees(s, d):
    return patterns.callees(symbols(s, d), edge_log(s, d), INFO, known(s, d, patterns.named(INFO)))


@query("definers", f"{_WITH} SELECT {COLS} FROM sym WHERE short_name = 'info' OR qualified_name = 'info'")
def definers(s, d):
    return patterns.definers(known(s, d, patterns.named("info")), "info")


@query("imports", f"{_WITH} SELECT DISTINCT {', '.join('a.' + c for c in SYMBOL_COLS)} FROM sym b JOIN e ON e.to_qname = b.qualified_name AND e.kind = 'imports' JOIN sym a ON a.qualified_name = e.from_qname WHERE b.file_path = '{CORE}log.rs'")
def imports(s, d):
    return patterns.imports(symbols(s, d), edge_log(s, d), CORE + "log.rs", known(s, d, F.col("file_path") == CORE + "log.rs"))


@query("imports_files", f"{_WITH} SELECT DISTINCT e.from_qname AS path FROM sym b JOIN e ON e.to_qname = b.qualified_name AND e.kind = 'imports' WHERE b.file_path = '{CORE}log.rs'")
def imports_files(s, d):
    return patterns.importing_files(known(s, d, F.col("file_path") == CORE + "log.rs"), edge_log(s, d), CORE + "log.rs")


@query("imports_dangling", f"{_WITH} SELECT from_qname AS path, count(*) AS n_dangling FROM e WHERE kind = 'imports' AND to_qname NOT IN (SELECT qualified_name FROM sym) GROUP BY 1")
def imports_dangling(s, d):
    return patterns.dangling_imports(edges(s, d), symbols(s, d, "short_name"))


@query("uses", f"{_WITH} SELECT DISTINCT {', '.join('a.' + c for c in SYMBOL_COLS)} FROM e JOIN sym a ON a.qualified_name = e.from_qname WHERE e.kind = 'uses_type' AND e.to_qname = '{FAULT}' AND '{FAULT}' IN (SELECT qualified_name FROM sym)")
def uses(s, d):
    return patterns.uses(symbols(s, d), edge_log(s, d), FAULT)


@query("implements", f"{_WITH} SELECT {', '.join('a.' + c for c in SYMBOL_COLS)} FROM e JOIN sym a ON a.qualified_name = e.from_qname WHERE e.kind = 'implements' AND e.to_qname = '{PERSIST}' AND '{PERSIST}' IN (SELECT qualified_name FROM sym)")
def implements(s, d):
    return patterns.implements(symbols(s, d), edge_log(s, d), PERSIST)


_CTX = """ctx AS (SELECT to_qname AS qualified_name, 'caller' AS side, from_qname AS neighbor FROM e WHERE kind = 'calls' UNION SELECT from_qname, 'callee', to_qname FROM e WHERE kind = 'calls'),
ctx3 AS (SELECT c.qualified_name, side, neighbor, n.signature FROM ctx c JOIN sym s ON s.qualified_name = c.qualified_name JOIN sym n ON n.qualified_name = c.neighbor
QUALIFY row_number() OVER (PARTITION BY c.qualified_name, side ORDER BY neighbor) <= 3)"""


@query("synthesis_context", f"{_WITH}, {_CTX} SELECT * FROM ctx3")
def synthesis_context(s, d):
    sym = symbols(s, d)
    return patterns.synthesis_context(sym, edge_log(s, d), sym)


@query("list_for_synthesis", f"{_WITH} SELECT {COLS}, false AS has_description FROM sym WHERE coalesce(synthesized_description, '') = ''")
def list_for_synthesis(s, d):
    return patterns.list_for_synthesis(symbols(s, d, *SYMBOL_COLS, "synthesized_description"))


@query(
    "imports_all",
    f"{_WITH}, i AS (SELECT DISTINCT e.from_qname AS importer FROM sym b JOIN e ON e.to_qname = b.qualified_name AND e.kind = 'imports' WHERE b.file_path = '{CORE}log.rs') SELECT importer, 'file' AS level FROM i UNION ALL SELECT importer, 'symbol' FROM i WHERE importer IN (SELECT qualified_name FROM sym)",
)
def imports_all(s, d):
    return patterns.all_imports(symbols(s, d), edges(s, d), CORE + "log.rs")


@query("decode_or_drop", f"{_WITH} SELECT {COLS} FROM sym WHERE kind IN ({', '.join(repr(k) for k in SYMBOL_KINDS)}) AND {' AND '.join(c + ' IS NOT NULL' for c in ('qualified_name', 'file_path', 'start_line', 'end_line', 'signature'))}")
def decode_or_drop(s, d):
    return patterns.decoded(symbols(s, d)).select(*SYMBOL_COLS)


@query("synthesis_work_list", f"{_WITH} SELECT {COLS}, false AS has_description FROM sym WHERE coalesce(synthesized_description, '') = '' ORDER BY qualified_name LIMIT 25")
def synthesis_work_list(s, d):
    return patterns.list_for_synthesis(symbols(s, d, *SYMBOL_COLS, "synthesized_description"), limit=25)


# ---- edges and symbols as merged tables


@query("edge_merge_dedup", f"{_WITH} SELECT * FROM e")
def edge_merge_dedup(s, d):
    return edges(s, d)


@query("edge_endpoint_semi", f"{_WITH} SELECT e.* FROM e WHERE from_qname IN (SELECT qualified_name FROM sym WHERE exported) AND to_qname IN (SELECT qualified_name FROM sym WHERE exported)")
def edge_endpoint_semi(s, d):
    return store.with_endpoints(edges(s, d), symbols(s, d, "exported").filter("exported"))


@query("prune_stale", f"{_WITH} SELECT qualified_name, file_path FROM sym WHERE NOT (repo_id LIKE 'tidepool-%' AND NOT exported)")
def prune_stale(s, d):
    sym = symbols(s, d, "repo_id", "file_path", "exported")
    return store.prune_stale(sym, sym.filter("repo_id LIKE 'tidepool-%'"), sym.filter("exported")).select("qualified_name", "file_path")


@query(
    "forget_file",
    f"""{_WITH}, dead AS (SELECT qualified_name FROM sym WHERE file_path LIKE '%/tests/%'), n AS (SELECT repo_id, count(*) AS n_symbols FROM sym WHERE file_path NOT LIKE '%/tests/%' GROUP BY 1),
    k AS (SELECT split_part(from_qname, '/', 1) AS repo, count(*) AS n_edges FROM e WHERE from_qname NOT IN (FROM dead) AND to_qname NOT IN (FROM dead) GROUP BY 1)
    SELECT repo_id, n_symbols, n_edges FROM n JOIN k ON k.repo = regexp_replace(repo_id, '-[0-9a-f]+$', '')""",
)
def forget_file(s, d):
    sym, files = symbols(s, d, "repo_id", "file_path"), table(s, d, "files").select("path").distinct()
    gone = sym.filter("file_path LIKE '%/tests/%'").select(F.col("file_path").alias("path")).distinct()
    sym2, e2, _ = store.forget_files(sym, edges(s, d), files, gone)
    k = e2.groupBy(F.substring_index("from_qname", "/", 1).alias("repo")).agg(F.count(F.lit(1)).alias("n_edges"))
    n = sym2.groupBy("repo_id").agg(F.count(F.lit(1)).alias("n_symbols"))
    return n.join(k, F.regexp_replace("repo_id", "-[0-9a-f]+$", "") == F.col("repo")).select("repo_id", "n_symbols", "n_edges")


@query("ends_with", f"{_WITH} SELECT qualified_name FROM sym WHERE ends_with(file_path, 'log.rs')")
def ends_with(s, d):
    return known(s, d, F.col("file_path").endswith("log.rs")).select("qualified_name")


@query("edges_refined", "SELECT from_qname, kind, to_qname, CASE WHEN bool_or(edge_source = 'lsp') THEN 'lsp' ELSE 'tree_sitter' END AS edge_source FROM edges WHERE edge_source IN ('lsp', 'tree_sitter') GROUP BY 1, 2, 3")
def edges_refined(s, d):
    """Edges of the parser, then those of language servers."""
    of = lambda source: table(s, d, "edges").filter(F.col("edge_source") == source).select("from_qname", "kind", "to_qname", "edge_source").distinct()
    return resolve.refine(of("tree_sitter"), of("lsp"))


_FILE_HALF = "SELECT path, max(row(last_modified, seen_at, content_hash, extractor_version)) AS s FROM files WHERE path IS NOT NULL AND content_hash IS NOT NULL AND extractor_version IS NOT NULL AND seen_at {} '2025-04-15' GROUP BY 1"


@query("upsert_files", f"WITH o AS ({_FILE_HALF.format('<')}), n AS ({_FILE_HALF.format('>=')}) SELECT coalesce(n.path, o.path) AS path, coalesce(n.s[3], o.s[3]) AS content_hash, coalesce(n.s[4], o.s[4]) AS extractor_version FROM o FULL JOIN n ON o.path = n.path")
def upsert_files(s, d):
    f = table(s, d, "files").filter("path IS NOT NULL AND content_hash IS NOT NULL AND extractor_version IS NOT NULL").select("path", "content_hash", "extractor_version", "last_modified", "seen_at")
    half = lambda c: store.last_per_key(f.filter(c), ["path"], [F.col(x) for x in ("last_modified", "seen_at", "content_hash", "extractor_version")]).select("path", "content_hash", "extractor_version")
    cut = F.lit(CUT).cast("timestamp_ntz")
    return store.upsert_files(half(F.col("seen_at") < cut), half(F.col("seen_at") >= cut))


@query("manifest_write", "SELECT repo_id, CASE WHEN repo_id LIKE 'tidepool-%' THEN 'other/model' ELSE embedder_identity END AS embedder_identity, embedder_dimension FROM index_manifest")
def manifest_write(s, d):
    m = table(s, d, "index_manifest")
    return store.write_manifest(m, m.filter("repo_id LIKE 'tidepool-%'").withColumn("embedder_identity", F.lit("other/model"))).select("repo_id", "embedder_identity", "embedder_dimension")


@query("embeddings_set", f"{_WITH} SELECT qualified_name, CASE WHEN exported THEN [1.0, 2.0]::FLOAT[] ELSE embedding END AS embedding, CASE WHEN exported THEN 'h' ELSE body_hash END AS body_hash FROM sym")
def embeddings_set(s, d):
    sym = symbols(s, d, "exported", "embedding", "body_hash")
    delta = sym.filter("exported").select("qualified_name", F.array(F.lit(1.0), F.lit(2.0)).cast("array<float>").alias("embedding"), F.lit("h").alias("body_hash"))
    return store.set_embedding_and_hash(sym, delta).select("qualified_name", "embedding", "body_hash")


_HALVES = f"""WITH o AS (SELECT * FROM symbols WHERE indexed_at < '{CUT}' QUALIFY row_number() OVER (PARTITION BY qualified_name ORDER BY indexed_at DESC) = 1),
n AS (SELECT * FROM symbols WHERE indexed_at >= '{CUT}' QUALIFY row_number() OVER (PARTITION BY qualified_name ORDER BY indexed_at DESC) = 1)"""


def _halves(s, d):
    t = table(s, d, "symbols").select("qualified_name", *SYMBOL_COLS[1:], "body_hash", "synthesized_description", "description_source_hash", "indexed_at")
    cut = F.lit(CUT).cast("timestamp_ntz")
    old, new = t.filter(F.col("indexed_at") < cut), t.filter(F.col("indexed_at") >= cut)
    return store.latest_symbols(old), new


@query(
    "upsert_merge",
    f"""{_HALVES} SELECT coalesce(n.qualified_name, o.qualified_name) AS qualified_name, {', '.join(f'CASE WHEN n.qualified_name IS NULL THEN o.{c} ELSE n.{c} END AS {c}' for c in SYMBOL_COLS[1:])},
    coalesce(n.body_hash, o.body_hash) AS body_hash, o.synthesized_description FROM o FULL JOIN n ON o.qualified_name = n.qualified_name""",
)
def upsert_merge(s, d):
    old, new = _halves(s, d)
    return store.upsert_symbols(old, new.withColumn("ordinal", F.col("indexed_at"))).select(*SYMBOL_COLS, "body_hash", "synthesized_description")


@query(
    "staleness_transition",
    f"""{_HALVES} SELECT o.qualified_name, CASE WHEN o.description_source_hash <> n.body_hash THEN NULL ELSE o.synthesized_description END AS synthesized_description,
    CASE WHEN o.description_source_hash <> n.body_hash THEN NULL ELSE o.description_source_hash END AS description_source_hash, coalesce(n.body_hash, o.body_hash) AS body_hash
    FROM o LEFT JOIN n ON o.qualified_name = n.qualified_name""",
)
def staleness_transition(s, d):
    old, new = _halves(s, d)
    return store.restamp(old, store.latest_symbols(new).select("qualified_name", "body_hash")).select("qualified_name", "synthesized_description", "description_source_hash", "body_hash")


_TOLD = "coalesce(synthesized_description, '') <> ''"


def _described(s, d):
    return symbols(s, d, "synthesized_description", "body_hash", "description_source_hash")


@query("stale_descriptions", f"{_WITH} SELECT qualified_name, body_hash, description_source_hash FROM sym WHERE {_TOLD} AND coalesce(description_source_hash, '') <> '' AND description_source_hash <> body_hash")
def stale_descriptions(s, d):
    return patterns.stale_descriptions(_described(s, d))


@query("backfill_hashes", f"{_WITH} SELECT count(*) AS n_updated FROM sym WHERE {_TOLD} AND coalesce(description_source_hash, '') = '' AND coalesce(body_hash, '') <> ''")
def backfill_hashes(s, d):
    return store.backfill_source_hashes(_described(s, d))[1]


@query("clear_descriptions", f"{_WITH} SELECT count(*) AS n_cleared FROM sym WHERE {_TOLD}")
def clear_descriptions(s, d):
    return store.clear_all_descriptions(_described(s, d))[1]


@query("describe", f"{_WITH} SELECT qualified_name, nullif(synthesized_description, '') AS synthesized_description, nullif(body_hash, '') AS body_hash, nullif(description_source_hash, '') AS description_source_hash FROM sym")
def describe(s, d):
    return patterns.describe(_described(s, d))


@query("source_hash_batch", f"{_WITH} SELECT qualified_name, description_source_hash FROM sym WHERE coalesce(description_source_hash, '') <> '' AND qualified_name IN (SELECT to_qname FROM edges)")
def source_hash_batch(s, d):
    return patterns.source_hashes(_described(s, d), table(s, d, "edges").select(F.col("to_qname").alias("qualified_name")))


# ---- texts


@query("content_hash_dedup", "SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS keeper FROM documents WHERE text IS NOT NULL GROUP BY 1")
def content_hash_dedup(s, d):
    docs = table(s, d, "documents").filter("text IS NOT NULL")
    return docs.groupBy(X.content_hash("text").alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keeper"))


@query(
    "unchanged_files",
    """WITH f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY path ORDER BY last_modified DESC, seen_at DESC, content_hash DESC NULLS LAST, extractor_version DESC NULLS LAST) = 1)
    SELECT d.path, coalesce(sha256(d.text) = lower(f.content_hash) AND f.extractor_version = 1, false) AS unchanged FROM documents d LEFT JOIN f ON d.path = f.path WHERE d.path IS NOT NULL""",
)
def unchanged_files(s, d):
    f = table(s, d, "files")
    stored = store.last_per_key(f.select("path", "content_hash", "extractor_version", "last_modified", "seen_at"), ["path"], [F.col(c) for c in ("last_modified", "seen_at", "content_hash", "extractor_version")])
    docs = table(s, d, "documents").filter("path IS NOT NULL").select("path", X.content_hash("text").alias("content_hash"))
    return store.unchanged_files(docs, stored.withColumn("content_hash", F.lower("content_hash")))


_LINES = r"CASE WHEN text = '' THEN [] ELSE string_split(regexp_replace(replace(text, chr(13) || chr(10), chr(10)), '\n$', ''), chr(10)) END"
_BODY = f"""body AS (SELECT s.qualified_name, s.signature, s.start_line AS a, least(s.end_line, len(ls)) - s.start_line + 1 AS n, ls FROM sym s JOIN (SELECT path, {_LINES} AS ls FROM documents WHERE path IS NOT NULL) d ON d.path = s.file_path),
sliced AS (SELECT qualified_name, signature, n, CASE WHEN a >= 1 AND n >= 1 THEN array_to_string(list_slice(ls, a, a + least(n, 60) - 1), chr(10)) || CASE WHEN n > 60 THEN chr(10) || '{X.TRUNCATED}' ELSE '' END END AS body FROM body)"""


def _bodies(s, d, *cols):
    docs = table(s, d, "documents").filter("path IS NOT NULL").select("path", X.lines("text").alias("ls"))
    sym = symbols(s, d, "short_name", "file_path", "start_line", "end_line", "signature", *cols)
    return sym.join(docs, F.col("file_path") == F.col("path")).withColumn("body", X.body_slice("ls", "start_line", "end_line"))


@query("body_slice", f"{_WITH}, {_BODY} SELECT qualified_name, sha256(signature || chr(10) || chr(10) || body) AS body_hash FROM sliced")
def body_slice(s, d):
    return _bodies(s, d).select("qualified_name", X.body_hash("signature", "body").alias("body_hash"))


_WS = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _trim(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


@query("signature_line", f"SELECT doc_id, {_trim('string_split(text, chr(10))[1]')} AS signature FROM documents")
def signature_line(s, d):
    return table(s, d, "documents").select("doc_id", X.signature_line("text").alias("signature"))


@query("short_name", "SELECT raw_id, CASE WHEN to_raw LIKE '%::%' THEN list_last(string_split(to_raw, '::')) ELSE list_last(string_split(to_raw, '.')) END AS short FROM raw_edges")
def short_name(s, d):
    return table(s, d, "raw_edges").select("raw_id", X.short_name("to_raw").alias("short"))


@query("repo_id", "SELECT DISTINCT path, list_last(string_split(path, '/')) || '-' || left(sha256(path), 8) AS id FROM files WHERE path IS NOT NULL")
def repo_id(s, d):
    return table(s, d, "files").filter("path IS NOT NULL").select("path", X.repo_id("path").alias("id")).distinct()


_CLEAN1 = _trim("synthesized_description")


@query(
    "clean_description",
    f"""{_WITH}, t AS (SELECT qualified_name, {_CLEAN1} AS t FROM sym), u AS (SELECT qualified_name, CASE WHEN t LIKE 'Description:%' OR t LIKE 'description:%' THEN {_trim('substr(t, 13)')} ELSE t END AS u FROM t)
    SELECT qualified_name, CASE WHEN u LIKE '"%"' AND length(u) >= 2 THEN substr(u, 2, length(u) - 2) ELSE u END AS cleaned FROM u""",
)
def clean_description(s, d):
    return symbols(s, d, "synthesized_description").select("qualified_name", X.clean_description("synthesized_description").alias("cleaned"))


@query(
    "synthesis_prompt",
    f"""{_WITH}, {_CTX}, {_BODY}, near AS (SELECT qualified_name, string_agg('- ' || neighbor || ': ' || coalesce(signature, ''), chr(10) ORDER BY neighbor) FILTER (side = 'caller') AS cr, string_agg('- ' || neighbor || ': ' || coalesce(signature, ''), chr(10) ORDER BY neighbor) FILTER (side = 'callee') AS ce FROM ctx3 GROUP BY 1)
    SELECT s.qualified_name, sha256('Say in one to three plain sentences what this symbol does and what it is for, and nothing else.' || chr(10) || chr(10) || 'Symbol: ' || s.qualified_name || chr(10) || 'Signature: ' || coalesce(s.signature, '') || chr(10)
    || coalesce('Body:' || chr(10) || b.body || chr(10), '') || coalesce('Called by:' || chr(10) || cr || chr(10), '') || coalesce('Calls:' || chr(10) || ce || chr(10), '') || chr(10) || 'Description:') AS prompt_hash
    FROM sym s LEFT JOIN sliced b USING (qualified_name) LEFT JOIN near USING (qualified_name)""",
)
def synthesis_prompt(s, d):
    sym = symbols(s, d)
    return graph.prompts(sym.select(*SYMBOL_COLS), sym, edge_log(s, d), table(s, d, "documents")).select("qualified_name", F.sha2("prompt", 256).alias("prompt_hash"))


@query("rerank_prompt", "SELECT doc_id, sha256('Query: where are conflicts resolved' || chr(10) || 'Document: ' || left(text, 1500) || chr(10) || 'Relevant (yes/no):') AS prompt_hash FROM documents")
def rerank_prompt(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(X.rerank_prompt(F.lit("where are conflicts resolved"), "text"), 256).alias("prompt_hash"))


_REPLY = "CASE doc_id % 6 WHEN 0 THEN 'yes' WHEN 1 THEN ' Yes. It does' WHEN 2 THEN 'no' WHEN 3 THEN 'NO!!' WHEN 4 THEN 'maybe' ELSE text END"


@query("rerank_parse", f"WITH r AS (SELECT doc_id, lower(regexp_replace(regexp_extract({_trim(_REPLY)}, '^\\S*'), '[^\\pL\\p{{Nd}}]+$', '')) AS w FROM documents) SELECT doc_id, CASE w WHEN 'yes' THEN 1.0::DOUBLE WHEN 'no' THEN 0.0::DOUBLE END AS score FROM r")
def rerank_parse(s, d):
    return table(s, d, "documents").select("doc_id", X.parse_rerank(F.expr(_REPLY)).alias("score"))


@query(
    "extension_dispatch",
    r"""SELECT DISTINCT path, CASE WHEN regexp_matches(path, '\.(ts|tsx|js|jsx|mts|cts)$') THEN 'typescript' WHEN path LIKE '%.rs' THEN 'rust' END AS lang, regexp_matches(path, '/(target|node_modules|\.git)/') AS excluded FROM files WHERE path IS NOT NULL""",
)
def extension_dispatch(s, d):
    return table(s, d, "files").filter("path IS NOT NULL").select("path", X.language_of("path").alias("lang"), X.excluded("path").alias("excluded")).distinct()


# ---- extraction over the texts, held against the log of symbols


@query("extract_symbols", f"{_WITH} SELECT qualified_name, short_name, {', '.join(SYMBOL_COLS[1:])} FROM sym")
def extract_symbols(s, d):
    """What is extracted from the documents, of the names that the log knows too."""
    found = store.last_per_key(symbols_of(extract_files(table(s, d, "documents").filter("path IS NOT NULL"))), ["qualified_name"], [F.col("ordinal")])
    return found.join(table(s, d, "symbols").select("qualified_name").distinct(), "qualified_name", "left_semi").select("qualified_name", "short_name", *SYMBOL_COLS[1:])


@query("extract_edges", None)
def extract_edges(s, d):
    """Edges as they stand in the texts; the raw edges of the test data do not come from these texts."""
    return edges_of(extract_files(table(s, d, "documents").filter("path IS NOT NULL")))


@query("index_documents", f"{_WITH}, {_BODY} SELECT qualified_name, kind, sha256(signature || chr(10) || chr(10) || body) AS body_hash FROM sliced JOIN (SELECT qualified_name, kind FROM sym) USING (qualified_name)")
def index_documents(s, d):
    """Symbols of an index from nothing, with the hashes of their bodies, of the names that the log knows too."""
    found = scan.extracted(table(s, d, "documents").filter("path IS NOT NULL AND text IS NOT NULL").select("path", "text"))[0]
    return found.join(table(s, d, "symbols").select("qualified_name").distinct(), "qualified_name", "left_semi").select("qualified_name", "kind", "body_hash")


_STORED = """fl AS (SELECT * FROM files WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY last_modified DESC, seen_at DESC, content_hash DESC NULLS LAST, extractor_version DESC NULLS LAST) = 1),
src AS (SELECT path, text FROM documents WHERE text IS NOT NULL AND regexp_matches(path, '[.](rs|ts|tsx|js|jsx|mts|cts)$')),
ch AS (SELECT path FROM src LEFT JOIN fl USING (path) WHERE NOT coalesce(sha256(text) = lower(content_hash) AND extractor_version = 1, false)), gone AS (SELECT path FROM fl WHERE path NOT IN (SELECT path FROM src))"""


@query(
    "reindex",
    f"""{_WITH}, {_BODY}, {_STORED}, h AS (SELECT sliced.qualified_name, sha256(sliced.signature || chr(10) || chr(10) || sliced.body) AS h FROM sliced JOIN sym USING (qualified_name) WHERE file_path IN (FROM ch)),
    o AS (SELECT * FROM sym WHERE file_path NOT IN (FROM gone))
    SELECT o.qualified_name, coalesce(h, o.body_hash) AS body_hash, CASE WHEN description_source_hash <> h THEN NULL ELSE synthesized_description END AS synthesized_description, CASE WHEN description_source_hash <> h THEN NULL ELSE description_source_hash END AS description_source_hash
    FROM o LEFT JOIN h ON h.qualified_name = o.qualified_name""",
)
def reindex(s, d):
    """The logs as the stored graph, the documents as the tree: hashes and descriptions after an index run, of
    the symbols that were stored."""
    old = symbols(s, d, "short_name", *SYMBOL_COLS[1:], "synthesized_description", "embedding", "body_hash", "description_source_hash").drop("indexed_at")
    f = table(s, d, "files").filter("path IS NOT NULL")
    order = [F.col(c) for c in ("last_modified", "seen_at", "content_hash", "extractor_version")]
    stored = store.last_per_key(f.select("path", "file_language", F.lower("content_hash").alias("content_hash"), "last_modified", "extractor_version", "seen_at"), ["path"], order).drop("seen_at")
    docs = table(s, d, "documents").filter("path IS NOT NULL AND text IS NOT NULL").filter(X.language_of("path").isNotNull())
    tree = docs.select("path", "text", X.language_of("path").alias("file_language"), X.content_hash("text").alias("content_hash"), F.lit(None).cast("timestamp_ntz").alias("last_modified"))
    gone = stored.join(tree.select("path"), "path", "left_anti").select("path")
    new = graph.reindex({"symbols": old, "edges": edges(s, d), "files": stored}, scan.changed(tree, stored), gone, None)["symbols"]
    return new.join(old.select("qualified_name"), "qualified_name", "left_semi").select("qualified_name", "body_hash", "synthesized_description", "description_source_hash")


@query("files_indexed", f"WITH {_STORED} SELECT count(*) AS n_files FROM ch")
def files_indexed(s, d):
    f = table(s, d, "files").filter("path IS NOT NULL")
    order = [F.col(c) for c in ("last_modified", "seen_at", "content_hash", "extractor_version")]
    stored = store.last_per_key(f.select("path", F.lower("content_hash").alias("content_hash"), "last_modified", "extractor_version", "seen_at"), ["path"], order)
    tree = table(s, d, "documents").filter("path IS NOT NULL AND text IS NOT NULL").filter(X.language_of("path").isNotNull()).select("path", X.content_hash("text").alias("content_hash"))
    return scan.changed(tree, stored).agg(F.count(F.lit(1)).alias("n_files"))


@query("manifest_read", "SELECT * FROM index_manifest WHERE repo_id LIKE 'tidepool-%' AND COLUMNS(*) IS NOT NULL")
def manifest_read(s, d):
    m = table(s, d, "index_manifest")
    return store.read_manifest(m, m.filter("repo_id LIKE 'tidepool-%'").agg(F.min("repo_id")).scalar())


@query("raw_query", "SELECT kind, count(*) AS n FROM edges WHERE observed_at >= '2025-04-15' GROUP BY kind")
def passthrough(s, d):
    return raw_query(s, "SELECT kind, count(*) AS n FROM {edges} WHERE observed_at >= CAST(:cut AS timestamp_ntz) GROUP BY kind", {"cut": CUT}, edges=table(s, d, "edges"))


@query("edge_labels", "SELECT DISTINCT kind, CASE WHEN kind IN ('calls', 'imports', 'implements', 'references', 'uses_type', 'defines', 'extends', 're_exports', 'co_changed', 'tested_by', 'modified_in') THEN upper(kind) END AS label, true AS back FROM edges")
def edge_labels(s, d):
    e = table(s, d, "edges").select("kind").distinct().withColumn("label", X.edge_label("kind"))
    return e.withColumn("back", X.edge_kind("label").eqNullSafe(F.col("kind")))


@query("last_seen_unix", "SELECT path, max(epoch_us(seen_at)) // 1000000 AS seen FROM files GROUP BY 1")
def last_seen_unix(s, d):
    return table(s, d, "files").groupBy("path").agg(F.floor(F.max(F.unix_micros(F.col("seen_at").cast("timestamp"))) / 1_000_000).alias("seen"))


@query("run_latency", "SELECT repo_id, round(avg(ms), 3) AS mean_ms, round(quantile_cont(ms, 0.95), 3) AS p95_ms FROM (SELECT repo_id, epoch_ms(finished_at)::DOUBLE - epoch_ms(started_at) AS ms FROM index_runs WHERE finished_at IS NOT NULL) GROUP BY 1")
def run_latency(s, d):
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp")).cast("double")
    runs = table(s, d, "index_runs").filter("finished_at IS NOT NULL").select("repo_id", (ms("finished_at") - ms("started_at")).alias("ms"))
    return evaluate.latency(runs, "ms", ["repo_id"])


@query("trim_quotes", r"""SELECT raw_id, regexp_replace(regexp_replace(to_raw, '^"+|"+$', '', 'g'), '^''+|''+$', '', 'g') AS bare FROM raw_edges""")
def trim_quotes(s, d):
    return table(s, d, "raw_edges").select("raw_id", X.trim_quotes("to_raw").alias("bare"))


@query("defang", "SELECT doc_id, sha256(replace(text, '`', '_')) AS h FROM documents")
def defang(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(X.defang("text"), 256).alias("h"))


@query("memory_tier", "SELECT DISTINCT p_size, CASE WHEN p_size IS NULL THEN 'balanced' WHEN p_size < 12 THEN 'minimal' WHEN p_size < 24 THEN 'balanced' ELSE 'max' END AS tier FROM part")
def memory_tier(s, d):
    """Part sizes stand for gigabytes."""
    return table(s, d, "part").select("p_size", X.tier("p_size").alias("tier")).distinct()


@query("rerank_documents", f"{_WITH}, {_BODY} SELECT s.qualified_name, sha256(coalesce(nullif(s.synthesized_description, ''), s.signature) || chr(10) || array_to_string(string_split(body, chr(10))[1:40], chr(10))) AS h FROM sliced JOIN sym s USING (qualified_name) WHERE body IS NOT NULL")
def rerank_documents(s, d):
    b = _bodies(s, d, "synthesized_description").filter("body IS NOT NULL")
    return b.select("qualified_name", F.sha2(find.rerank_document(F.col("synthesized_description"), F.col("signature"), F.col("body")), 256).alias("h"))


# ---- resolution


@query(
    "symbol_containing",
    f"{_WITH} SELECT raw_id, s.qualified_name FROM raw_edges r JOIN sym s ON s.file_path = r.file_path AND r.line_no BETWEEN s.start_line AND s.end_line QUALIFY row_number() OVER (PARTITION BY raw_id ORDER BY s.end_line - s.start_line, s.qualified_name) = 1",
)
def symbol_containing(s, d):
    sites = table(s, d, "raw_edges").select(F.col("raw_id").alias("site"), "file_path", F.col("line_no").alias("line"))
    return resolve.containing(sites, symbols(s, d)).select(F.col("site").alias("raw_id"), "qualified_name")


@query(
    "same_file_resolve",
    f"""{_WITH} SELECT raw_id, CASE WHEN to_raw LIKE '%::%' OR to_raw LIKE '%/%' THEN to_raw ELSE coalesce((SELECT min(qualified_name) FROM sym s WHERE s.file_path = r.file_path AND s.short_name = r.to_raw), to_raw) END AS to_resolved FROM raw_edges r""",
)
def same_file_resolve(s, d):
    return resolve.same_file(table(s, d, "raw_edges").select("raw_id", "file_path", "to_raw"), symbols(s, d)).select("raw_id", "to_resolved")


@query(
    "cross_file_resolve",
    f"""{_WITH}, r AS (SELECT raw_id, repo_id, file_path, trim(to_raw) AS ref FROM raw_edges WHERE coalesce(trim(to_raw), '') <> ''), u AS (SELECT DISTINCT repo_id, file_path, ref FROM r),
    f AS (SELECT DISTINCT e.from_qname AS i_path, s.file_path AS i_file FROM e JOIN sym s ON s.qualified_name = e.to_qname WHERE e.kind = 'imports'),
    one AS (SELECT repo_id, short_name, min(qualified_name) AS q FROM sym GROUP BY 1, 2 HAVING count(*) = 1), lone AS (SELECT short_name, min(qualified_name) AS q FROM sym GROUP BY 1 HAVING count(*) = 1),
    x AS (SELECT DISTINCT a.file_path AS x_file, b.short_name, b.qualified_name FROM e JOIN sym a ON a.qualified_name = e.from_qname JOIN sym b ON b.qualified_name = e.to_qname WHERE e.kind = 're_exports'),
    m AS (SELECT *, regexp_extract(ref, '^[^/]*(?:[.]|::)([^./:]+)$', 1) AS meth FROM u),
    c AS (SELECT u.*, 0 AS rk, s.qualified_name AS q FROM u JOIN sym s ON s.qualified_name = ref
      UNION ALL SELECT u.*, 1, s.qualified_name FROM u JOIN sym s ON s.file_path = u.file_path AND s.short_name = ref
      UNION ALL SELECT u.*, 2, s.qualified_name FROM u JOIN f ON f.i_path = u.file_path JOIN sym s ON s.file_path = f.i_file AND s.short_name = ref
      UNION ALL SELECT u.*, 3, x.qualified_name FROM u JOIN f ON f.i_path = u.file_path JOIN x ON x.x_file = f.i_file AND x.short_name = ref
      UNION ALL SELECT m.* EXCLUDE meth, 4, s.qualified_name FROM m JOIN sym s ON s.kind = 'method' AND s.short_name = meth AND (s.file_path = m.file_path OR s.file_path IN (SELECT i_file FROM f WHERE f.i_path = m.file_path))
      UNION ALL SELECT u.*, 5, one.q FROM u JOIN one ON one.repo_id = u.repo_id AND one.short_name = ref
      UNION ALL SELECT u.*, 6, lone.q FROM u JOIN lone ON lone.short_name = ref UNION ALL SELECT u.*, 7, ref FROM u),
    b AS (SELECT repo_id, file_path, ref, min(row(rk, q)) AS m FROM c GROUP BY 1, 2, 3)
    SELECT raw_id, m[2] AS to_resolved, ['qualified', 'same_file', 'imported', 're_export', 'receiver', 'same_repo', 'generic', 'placeholder'][m[1] + 1] AS strategy FROM r JOIN b USING (repo_id, file_path, ref)""",
)
def cross_file_resolve(s, d):
    sym = symbols(s, d, "repo_id", *SYMBOL_COLS, "short_name")
    return resolve.cross_file(table(s, d, "raw_edges"), sym, edge_log(s, d))


# ---- vectors

_COS = "list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) / sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[])))"


def _embeddings(s, d):
    return table(s, d, "embeddings")


@query("vector_topk", f"SELECT vec_id, round({_COS.format(a='e.embedding', b='q.embedding')}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, vec_id LIMIT 20")
def vector_topk(s, d):
    q = _embeddings(s, d).filter("vec_id = 0").first()["embedding"]
    return vector.top_k(_embeddings(s, d), "vec_id", "embedding", q, 20).select("vec_id", F.round("score", 6).alias("score"))


def _topk_sql(k: int) -> str:
    return f"""knn AS (SELECT q.vec_id AS query_id, e.vec_id AS neighbor, round({_COS.format(a='e.embedding', b='q.embedding')}, 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COS.format(a='e.embedding', b='q.embedding')} DESC, e.vec_id) AS rank
    FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0 QUALIFY rank <= {k})"""


def _asked(s, d, k):
    e = _embeddings(s, d)
    return vector.batch_top_k(e, "vec_id", "embedding", e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector")), 64, k).withColumn("score", F.round("score", 6))


@query("similar", f"WITH {_topk_sql(5)} SELECT query_id, neighbor, score, rank FROM knn")
def similar(s, d):
    return _asked(s, d, 5)


@query("low_confidence", f"WITH {_topk_sql(10)} SELECT query_id, coalesce(max(score) FILTER (rank <= 3) < 0.55 AND max(score) FILTER (rank = 1) - max(score) FILTER (rank = 10) < 0.05, false) AS fires FROM knn GROUP BY 1")
def low_confidence(s, d):
    return find.low_confidence(_asked(s, d, 10))


@query(
    "eval_metrics",
    f"""WITH {_topk_sql(10)}, r AS (SELECT k.query_id, k.rank, (a.label = b.label)::INT AS rel FROM knn k JOIN embeddings a ON a.vec_id = k.query_id JOIN embeddings b ON b.vec_id = k.neighbor),
    p AS (SELECT query_id, max(rel) FILTER (rank <= 5) AS hit5, min(rank) FILTER (rel = 1) AS first, sum(rel / log2(rank + 1)) AS dcg, sum(rel)::INT AS n FROM r GROUP BY 1)
    SELECT count(*) AS queries, round(avg(hit5::DOUBLE), 6) AS hit5, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg(CASE WHEN n > 0 THEN dcg / list_sum(list_transform(range(1, n + 1), lambda i: 1.0::DOUBLE / log2(i + 1))) ELSE 0 END), 6) AS ndcg10 FROM p""",
)
def eval_metrics(s, d):
    labels = _embeddings(s, d).select("vec_id", "label")
    r = _asked(s, d, 10).join(labels.withColumnsRenamed({"vec_id": "query_id", "label": "ql"}), "query_id").join(labels.withColumnsRenamed({"vec_id": "neighbor", "label": "nl"}), "neighbor")
    return evaluate.summary(evaluate.retrieval_metrics(r.select("query_id", "rank", (F.col("ql") == F.col("nl")).alias("relevant"))))


# ---- traversal

_CALLS = "c AS (SELECT DISTINCT from_qname AS src, to_qname AS dst FROM e WHERE kind = 'calls')"


@query("blast_radius", f"{_WITH}, {_CALLS}, b AS (SELECT '{WRAP}' AS node, 0 AS depth UNION SELECT c.src, depth + 1 FROM b JOIN c ON c.dst = b.node WHERE depth < 3) SELECT node, min(depth) AS depth FROM b GROUP BY 1 HAVING min(depth) > 0")
def blast_radius(s, d):
    return traverse.blast_radius(edge_log(s, d), _one(s, WRAP), 3)


@query(
    "context_hops",
    f"{_WITH}, u AS (SELECT from_qname AS src, to_qname AS dst FROM e UNION SELECT to_qname, from_qname FROM e), b AS (SELECT '{TICK}' AS node, 0 AS depth UNION SELECT u.dst, depth + 1 FROM b JOIN u ON u.src = b.node WHERE depth < 2) SELECT node, min(depth) AS depth FROM b GROUP BY 1",
)
def context_hops(s, d):
    return traverse.context(edge_log(s, d), _one(s, TICK), 2)


_FAR = f"far AS (SELECT '{INFO}' AS node, 0 AS depth UNION SELECT c.src, depth + 1 FROM far JOIN c ON c.dst = far.node WHERE depth < 3), start AS (SELECT min(node) AS node FROM (SELECT node, min(depth) AS depth FROM far GROUP BY 1) WHERE depth = (SELECT max(depth) FROM (SELECT min(depth) AS depth FROM far GROUP BY node)))"


def _far(s, d):
    """The first of the symbols farthest from INFO within three calls."""
    r = traverse.bfs(traverse.reverse(traverse._calls(edge_log(s, d))), _one(s, INFO), 3)
    row = r.orderBy(F.desc("depth"), "node").first()
    return row["node"]


@query(
    "shortest_path",
    f"{_WITH}, {_CALLS}, {_FAR}, p AS (SELECT [node] AS path FROM start UNION ALL SELECT list_append(path, c.dst) FROM p JOIN c ON c.src = list_last(path) WHERE len(path) < 4), best AS (SELECT path FROM p WHERE list_last(path) = '{INFO}' ORDER BY len(path), path LIMIT 1) SELECT (i - 1)::INT AS hop, path[i] AS node FROM best, range(1, 5) t(i) WHERE i <= len(path)",
)
def shortest_path(s, d):
    return traverse.shortest_path(edge_log(s, d), _far(s, d), INFO)


@query(
    "surface",
    f"{_WITH}, {_CALLS}, {_FAR}, b AS (SELECT node, 0 AS depth FROM start UNION SELECT c.dst, depth + 1 FROM b JOIN c ON c.src = b.node WHERE depth < 4 AND (depth = 0 OR b.node NOT IN (SELECT qualified_name FROM sym WHERE exported))) SELECT node, min(depth) AS depth FROM b GROUP BY 1",
)
def surface(s, d):
    return traverse.surface(edge_log(s, d), symbols(s, d, "exported"), _one(s, _far(s, d)), 4)


_ENTRY = "exported AND kind = 'function' AND repo_id NOT LIKE 'tidepool-%'"


@query("dead", f"{_WITH}, {_CALLS}, b AS (SELECT qualified_name AS node FROM sym WHERE {_ENTRY} UNION SELECT c.dst FROM b JOIN c ON c.src = b.node) SELECT qualified_name FROM sym WHERE qualified_name NOT IN (SELECT node FROM b)")
def dead(s, d):
    sym = symbols(s, d, "exported", "kind", "repo_id")
    return traverse.dead(edge_log(s, d), sym, sym.filter(_ENTRY).select(F.col("qualified_name").alias("node")))


_TEST = "kind = 'function' AND file_path LIKE '%/tests/%'"


@query("tested_by", f"{_WITH}, {_CALLS}, b AS (SELECT qualified_name AS test, qualified_name AS node, 0 AS depth FROM sym WHERE {_TEST} UNION SELECT test, c.dst, depth + 1 FROM b JOIN c ON c.src = b.node WHERE depth < 2) SELECT DISTINCT node AS target, test FROM b WHERE node <> test")
def tested_by(s, d):
    return traverse.tested_by(edge_log(s, d), symbols(s, d, "kind", "file_path").filter(_TEST).select(F.col("qualified_name").alias("node")), 2)


@query("tested_by_all", f"{_WITH}, {_CALLS}, b AS (SELECT qualified_name AS test, qualified_name AS node FROM sym WHERE {_TEST} UNION SELECT test, c.dst FROM b JOIN c ON c.src = b.node) SELECT DISTINCT node AS target, test FROM b WHERE node <> test")
def tested_by_all(s, d):
    return traverse.tested_by(edge_log(s, d), symbols(s, d, "kind", "file_path").filter(_TEST).select(F.col("qualified_name").alias("node")))


@query("tests_of", f"{_WITH} SELECT DISTINCT to_qname AS qualified_name FROM e WHERE kind = 'tested_by' AND from_qname = '{WRAP}' AND to_qname IN (SELECT qualified_name FROM sym)")
def tests_of(s, d):
    return derived.tests_of(edge_log(s, d), symbols(s, d, "kind"), WRAP)


# ---- history: orders are commits, their parts what was changed


def _changes(s, d):
    li, o = table(s, d, "lineitem").select("l_orderkey", "l_partkey"), table(s, d, "orders").select("o_orderkey", "o_orderdate")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("commit_id"), F.col("l_partkey").alias("item"), F.col("o_orderdate").alias("at"))


_CH = "ch AS (SELECT DISTINCT o_orderkey AS commit_id, l_partkey AS item, o_orderdate AS at_ FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(
    "co_change",
    f"WITH {_CH}, m AS (SELECT max(at_) AS newest FROM ch) SELECT x.item AS a, y.item AS b, count(*) AS n, max(x.at_) AS last_seen, round(sum(exp(-0.01 * date_diff('day', CAST(x.at_ AS DATE), CAST(newest AS DATE)))), 6) AS weight FROM ch x JOIN ch y ON x.commit_id = y.commit_id AND x.item < y.item, m GROUP BY 1, 2 HAVING count(*) >= 2",
)
def co_change(s, d):
    return derived.co_change(_changes(s, d))


@query("modified_in", f"WITH {_CH} SELECT item, count(DISTINCT commit_id) AS n_commits, max(at_) AS last FROM ch GROUP BY 1")
def modified_in(s, d):
    return derived.modified_in(_changes(s, d))


@query("recent", "WITH c AS (SELECT l_partkey AS item, o_orderdate AS t FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT item, count(*) AS n FROM c WHERE date_diff('day', CAST(t AS DATE), CAST((SELECT max(t) FROM c) AS DATE)) <= 90 GROUP BY 1")
def recent(s, d):
    return derived.recent(_changes(s, d), 90)


@query("canonical", "SELECT p_type, min(p_partkey) AS exemplar, count(*) AS n FROM part GROUP BY p_type, p_name QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY count(*) DESC, p_name) = 1")
def canonical(s, d):
    return derived.canonical(table(s, d, "part"), "p_type", "p_name", "p_partkey")


@query(
    "co_change_recent",
    f"WITH {_CH}, big AS (SELECT commit_id, max(at_) AS c_at FROM ch GROUP BY 1 HAVING count(*) > 1 ORDER BY c_at DESC, commit_id DESC LIMIT 200), m AS (SELECT max(at_) AS newest FROM ch), k AS (SELECT ch.* FROM ch JOIN big USING (commit_id)) SELECT x.item AS a, y.item AS b, count(*) AS n, max(x.at_) AS last_seen, round(sum(exp(-0.01 * date_diff('day', CAST(x.at_ AS DATE), CAST(newest AS DATE)))), 6) AS weight FROM k x JOIN k y ON x.commit_id = y.commit_id AND x.item < y.item, m GROUP BY 1, 2",
)
def co_change_recent(s, d):
    """Pairs of the last 200 commits, which is the feature's window."""
    return derived.co_change(_changes(s, d), least=1, commits=200)


def _log(s, d):
    """The log of upserts as history: each upsert changes its symbol."""
    return table(s, d, "symbols").select(F.col("qualified_name").alias("item"), F.col("indexed_at").alias("at"))


@query(
    "recent_near",
    f"{_WITH}, near AS (SELECT '{TICK}' AS q UNION SELECT to_qname FROM e WHERE from_qname = '{TICK}' UNION SELECT from_qname FROM e WHERE to_qname = '{TICK}') SELECT qualified_name AS item, count(*) AS n FROM symbols WHERE qualified_name IN (FROM near) AND date_diff('day', CAST(indexed_at AS DATE), CAST((SELECT max(indexed_at) FROM symbols) AS DATE)) <= 30 GROUP BY 1",
)
def recent_near(s, d):
    return derived.recent_near(_log(s, d), edge_log(s, d), TICK, 30)


@query("modified_in_lines", f"{_WITH} SELECT s.qualified_name, count(DISTINCT CAST(extracted_at AS DATE)) AS n_commits, max(CAST(extracted_at AS DATE)) AS last FROM raw_edges r JOIN sym s ON s.file_path = r.file_path AND r.line_no <= s.end_line AND r.line_no + 2 >= s.start_line GROUP BY 1")
def modified_in_lines(s, d):
    """Raw edges stand for hunks of three lines, their days for commits."""
    hunks = table(s, d, "raw_edges").select(F.to_date("extracted_at").alias("commit_id"), F.to_date("extracted_at").alias("at"), "file_path", F.col("line_no").alias("first_line"), (F.col("line_no") + 2).alias("last_line"))
    return derived.modified_in_lines(hunks, symbols(s, d))


@query("canonical_symbols", f"{_WITH} SELECT short_name, min(qualified_name) AS exemplar, count(*) AS n FROM sym WHERE body_hash IS NOT NULL GROUP BY short_name, body_hash QUALIFY row_number() OVER (PARTITION BY short_name ORDER BY count(*) DESC, body_hash) = 1")
def canonical_symbols(s, d):
    return derived.canonical(symbols(s, d, "short_name", "body_hash").filter("body_hash IS NOT NULL"), "short_name", "body_hash", "qualified_name")


@query(
    "retrievals_used",
    "WITH a AS (SELECT to_qname AS node, CAST(observed_at AS DATE) AS day FROM edges WHERE kind = 'references') SELECT node, count(*) AS n_retrieved, count(*) FILTER (EXISTS (SELECT 1 FROM symbols s WHERE s.qualified_name = node AND CAST(s.indexed_at AS DATE) BETWEEN day AND day + 3)) AS n_used FROM a GROUP BY 1",
)
def retrievals_used(s, d):
    """References stand for retrievals, upserts for changes."""
    log = table(s, d, "edges").filter("kind = 'references'").select(F.col("to_qname").alias("node"), F.col("observed_at").alias("at"))
    return personal.retrievals_used(log, _log(s, d))


@query(
    "conventions",
    f"""{_WITH}, st AS (SELECT repo_id, kind, CASE WHEN regexp_matches(short_name, '^[a-z][a-z0-9]*(_[a-z0-9]+)*$') THEN CASE WHEN contains(short_name, '_') THEN 'snake' ELSE 'lower' END WHEN regexp_matches(short_name, '^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$') THEN 'upper'
    WHEN regexp_matches(short_name, '^[a-z][A-Za-z0-9]*$') THEN 'camel' WHEN regexp_matches(short_name, '^[A-Z][A-Za-z0-9]*$') THEN 'pascal' ELSE 'mixed' END AS style FROM sym), g AS (SELECT repo_id, kind, style, count(*) AS n FROM st GROUP BY ALL)
    SELECT repo_id, kind, style, n, round(n / sum(n) OVER (PARTITION BY repo_id, kind), 6) AS share FROM g QUALIFY row_number() OVER (PARTITION BY repo_id, kind ORDER BY n DESC, style) = 1""",
)
def conventions(s, d):
    return personal.conventions(symbols(s, d, "repo_id", "kind", "short_name"))


# ---- retrieval over symbols: the seed vector is that of the first symbol with a usable one

_OK = "len(embedding) = 64 AND list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])) > 0"
_SEEDS = f"v AS (SELECT qualified_name AS node, embedding FROM sym WHERE {_OK}), q AS (SELECT embedding AS qe FROM v ORDER BY node LIMIT 1), sc AS (SELECT node, round({_COS.format(a='embedding', b='qe')}, 6) AS cosine FROM v, q), seeds AS (SELECT * FROM sc ORDER BY cosine DESC, node LIMIT 50)"
_HOP = "u AS (SELECT from_qname AS seed, to_qname AS neighbor FROM e UNION SELECT to_qname, from_qname FROM e), hop AS (SELECT seed, neighbor FROM u WHERE seed IN (SELECT node FROM seeds) AND seed <> neighbor QUALIFY row_number() OVER (PARTITION BY seed ORDER BY neighbor) <= 8)"
_CAND = "cand AS (SELECT node, cosine, 'vector' AS origin FROM seeds UNION ALL SELECT DISTINCT neighbor, sc.cosine, 'graph' FROM hop LEFT JOIN sc ON sc.node = neighbor WHERE neighbor NOT IN (SELECT node FROM seeds)), top AS (SELECT * FROM cand ORDER BY origin DESC, cosine DESC NULLS LAST, node LIMIT 200)"


def _seeds(s, d):
    v = vector.usable(symbols(s, d, "embedding").select(F.col("qualified_name").alias("node"), "embedding"), "embedding", 64)
    q = F.lit(v.orderBy("node").first()["embedding"])
    scores = v.select("node", F.round(vector.cosine(F.col("embedding"), q), 6).alias("cosine"))
    return scores.orderBy(F.desc("cosine"), "node").limit(find.SEEDS), scores


@query("expand_one_hop", f"{_WITH}, {_SEEDS}, {_HOP} SELECT * FROM hop")
def expand_one_hop(s, d):
    return find.expand_one_hop(_seeds(s, d)[0], edge_log(s, d))


def _tier4(s, d, rerank):
    seeds, scores = _seeds(s, d)
    return find.reranked(find.candidates(seeds, find.expand_one_hop(seeds, edge_log(s, d)), scores), rerank)


@query("tier4_find", f"{_WITH}, {_SEEDS}, {_HOP}, {_CAND} SELECT node, cosine, round((length(node) % 7) / 7.0::DOUBLE, 6) AS rerank, origin, false AS reranker_degraded FROM top ORDER BY rerank DESC, cosine DESC NULLS LAST, node LIMIT 10")
def tier4_find(s, d):
    return _tier4(s, d, F.round((F.length("node") % 7) / F.lit(7.0), 6))


@query("degraded_find", f"{_WITH}, {_SEEDS}, {_HOP}, {_CAND} SELECT node, cosine, NULL::DOUBLE AS rerank, origin, true AS reranker_degraded FROM top ORDER BY cosine DESC NULLS LAST, node LIMIT 10")
def degraded_find(s, d):
    return _tier4(s, d, F.lit(None).cast("double"))


@query(
    "similar_symbols",
    f"""{_WITH}, {_SEEDS}, me AS (SELECT node AS q FROM v ORDER BY node LIMIT 1), u AS (SELECT from_qname AS a, to_qname AS b FROM e WHERE from_qname <> to_qname UNION SELECT to_qname, from_qname FROM e WHERE from_qname <> to_qname),
    own AS (SELECT b FROM u WHERE a = (FROM me)), c AS (SELECT node, cosine FROM sc WHERE node <> (FROM me) ORDER BY cosine DESC, node LIMIT 20)
    SELECT node, cosine, coalesce(round(count(*) FILTER (u.b IN (FROM own)) / ((SELECT count(*) FROM own) + count(u.b) FILTER (u.b NOT IN (FROM own)))::DOUBLE, 6), 0) AS jaccard FROM c LEFT JOIN u ON u.a = c.node GROUP BY ALL""",
)
def similar_symbols(s, d):
    v = vector.usable(symbols(s, d, "embedding").select(F.col("qualified_name").alias("node"), "embedding"), "embedding", 64)
    me = v.orderBy("node").first()
    return find.similar_symbols(v, edge_log(s, d), me["node"], me["embedding"]).withColumn("cosine", F.round("cosine", 6)).withColumn("jaccard", F.round("jaccard", 6))


@query(
    "cross_file_positions",
    f"""{_WITH}, df AS (SELECT raw_id, s.file_path AS p, s.start_line AS l FROM raw_edges r JOIN sym s ON s.qualified_name = r.to_raw),
    hit AS (SELECT raw_id, s.qualified_name AS q FROM df JOIN sym s ON s.file_path = p AND l BETWEEN s.start_line AND s.end_line QUALIFY row_number() OVER (PARTITION BY raw_id ORDER BY s.end_line - s.start_line, s.qualified_name) = 1)
    SELECT raw_id, coalesce(q, to_raw) AS to_resolved, CASE WHEN q IS NULL THEN edge_source ELSE 'lsp' END AS edge_source FROM raw_edges LEFT JOIN hit USING (raw_id)""",
)
def cross_file_positions(s, d):
    """Where a raw edge names a symbol, the symbol's file and first line stand for what a language server says."""
    sym, raw = symbols(s, d), table(s, d, "raw_edges")
    places = raw.join(sym.select(F.col("qualified_name").alias("to_raw"), F.col("file_path").alias("def_path"), F.col("start_line").alias("def_line")), "to_raw").select("raw_id", "def_path", "def_line")
    return resolve.by_position(raw.select("raw_id", "to_raw", "edge_source"), places, sym)


# ---- reports and events


@query("outcome_counters", f"{_WITH} SELECT count(*) AS considered, count(*) FILTER (NOT {_TOLD} AND coalesce(signature, '') <> '') AS synthesized, count(*) FILTER ({_TOLD}) AS skipped, count(*) FILTER (NOT {_TOLD} AND coalesce(signature, '') = '') AS failed FROM sym")
def outcome_counters(s, d):
    todo = patterns.list_for_synthesis(symbols(s, d, *SYMBOL_COLS, "synthesized_description"), all_symbols=True).withColumn("prompt", F.concat(F.lit("Signature: "), "signature"))
    return evaluate.outcome_counters(models.synthesize(todo, models.FirstLineSynthesizer()))


@query("stats_rollup", "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, (grouping(event_type) + grouping(CAST(ts AS DATE)))::INT AS level FROM events GROUP BY ROLLUP (event_type, CAST(ts AS DATE))")
def stats_rollup(s, d):
    return evaluate.stats_rollup(table(s, d, "events").select("event_type", F.to_date("ts").alias("day")), ["event_type", "day"])


def _debounce(seconds: int, s, d):
    from symgraph.streaming.changes import debounce

    return debounce(table(s, d, "events"), "ts", "user_id", f"{seconds} seconds").select("tick", "user_id", "n")


for _n, _s in (("debounce_events", 2), ("debounce_events_1h", 3600)):
    query(_n, f"SELECT time_bucket(INTERVAL '{_s} seconds', ts) AS tick, user_id, count(*) AS n FROM events GROUP BY 1, 2")(partial(_debounce, _s))


@query("stream_incremental", "SELECT user_id, max(row(ts, event_id, event_type))[3] AS last_event_type FROM events GROUP BY 1")
def stream_incremental(s, d):
    from symgraph.streaming.changes import last_states

    return last_states(s, d)
