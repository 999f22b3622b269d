"""Scalar functions as Column expressions: names, slices, hashes, prompts. Nulls stay null
unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from symgraph.schema import EDGE_KINDS

# fixed values: lines of a body that are kept, what stands for the rest, characters shown to a reranker
BODY_LINES = 60
TRUNCATED = "// ... (body truncated)"
RERANK_CHARS = 1500


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def short_name(q: Column | str) -> Column:
    """After the last `::`, else after the last `.`, else all of it."""
    q = _c(q)
    return F.when(q.contains("::"), F.substring_index(q, "::", -1)).otherwise(F.substring_index(q, ".", -1))


def defang(x: Column | str) -> Column:
    """Backticks become underscores, so that a name never ends a quoted identifier."""
    return F.replace(_c(x), F.lit("`"), F.lit("_"))


def trim_unicode(x: Column | str) -> Column:
    """Without white space of any script at both ends; Spark's own trim knows the space only."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def lines(text: Column | str) -> Column:
    """Lines without their ends: \\n or \\r\\n, and no empty line after a final end."""
    t = F.replace(_c(text), F.lit("\r\n"), F.lit("\n"))
    body = F.when(t.endswith("\n"), F.left(t, F.length(t) - 1)).otherwise(t)
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(body, "\n", -1))


def body_slice(ls: Column | str, start: Column | str, end: Column | str, limit: int = BODY_LINES) -> Column:
    """Lines start to end (from 1, both inclusive) of an array of lines, at most `limit` of them and then a
    mark; null for no lines or an empty range. Texts are split once, before they meet their symbols."""
    ls, start, end = _c(ls), _c(start), _c(end)
    n = F.least(end, F.size(ls)) - start + 1
    head = F.array_join(F.slice(ls, start, F.greatest(F.least(n, F.lit(limit)), F.lit(0))), "\n")
    return F.when((start >= 1) & (n >= 1), F.when(n > limit, F.concat(head, F.lit("\n" + TRUNCATED))).otherwise(head))


def content_hash(text: Column | str) -> Column:
    return F.sha2(_c(text), 256)


def body_hash(signature: Column | str, body: Column | str) -> Column:
    return F.sha2(F.concat(_c(signature), F.lit("\n\n"), _c(body)), 256)


def signature_line(text: Column | str) -> Column:
    """The first line, trimmed."""
    return trim_unicode(F.substring_index(_c(text), "\n", 1))


def repo_id(path: Column | str) -> Column:
    """Last part of the path, a dash, eight digits of the whole path's hash."""
    path = _c(path)
    return F.concat_ws("-", F.element_at(F.split(path, "/"), -1), F.left(F.sha2(path, 256), F.lit(8)))


def language_of(path: Column | str) -> Column:
    """By the extension, case-sensitive; null for anything that isn't a source file."""
    ext = F.regexp_extract(_c(path), r"\.([^./]+)$", 1)
    return F.when(ext.isin("ts", "tsx", "js", "jsx", "mts", "cts"), "typescript").when(ext == "rs", "rust")


def excluded(path: Column | str) -> Column:
    """Whether a path lies in a folder that scans leave out."""
    return _c(path).rlike("/(target|node_modules|\\.git)/")


def clean_description(text: Column | str) -> Column:
    """A model's answer without its label and one pair of quotes."""
    t = trim_unicode(text)
    t = F.when(t.startswith("Description:") | t.startswith("description:"), trim_unicode(F.substr(t, F.lit(13)))).otherwise(t)
    quoted = t.startswith('"') & t.endswith('"') & (F.length(t) >= 2)
    return F.when(quoted, F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)


def empty_as_null(x: Column | str) -> Column:
    return F.nullif(_c(x), F.lit(""))


def synthesis_prompt(qname: Column | str, signature: Column | str, body: Column | str, callers: Column, callees: Column) -> Column:
    """Instruction and sections; the body and the neighbours are left out where there are none. callers, callees:
    arrays of (neighbor, signature)."""

    def part(title: str, x: Column) -> Column:
        return F.coalesce(F.concat(F.lit(title), x, F.lit("\n")), F.lit(""))

    def listed(title: str, xs: Column) -> Column:
        lines_ = F.array_join(F.transform(xs, lambda s: F.concat(F.lit("- "), s["neighbor"], F.lit(": "), F.coalesce(s["signature"], F.lit("")))), "\n")
        return part(title, F.when(F.size(xs) > 0, lines_))

    return F.concat(
        F.lit("Say in one to three plain sentences what this symbol does and what it is for, and nothing else.\n\nSymbol: "), F.coalesce(_c(qname), F.lit("")), F.lit("\nSignature: "), F.coalesce(_c(signature), F.lit("")), F.lit("\n"),
        part("Body:\n", _c(body)), listed("Called by:\n", callers), listed("Calls:\n", callees), F.lit("\nDescription:"),
    )


def rerank_prompt(query: Column | str, document: Column | str) -> Column:
    return F.concat(F.lit("Query: "), _c(query), F.lit("\nDocument: "), F.left(_c(document), F.lit(RERANK_CHARS)), F.lit("\nRelevant (yes/no):"))


def parse_rerank(reply: Column | str) -> Column:
    """1 for yes, 0 for no by the first word, null (no opinion) for anything else."""
    word = F.lower(F.regexp_replace(F.element_at(F.split(trim_unicode(reply), r"\s+"), 1), r"[^\p{L}\p{Nd}]+$", ""))
    return F.when(word == "yes", 1.0).when(word == "no", 0.0)


def edge_label(kind: Column | str) -> Column:
    """The upper-case name of an edge kind; null for anything that is none."""
    return F.when(_c(kind).isin(*EDGE_KINDS), F.upper(_c(kind)))


def edge_kind(label: Column | str) -> Column:
    """The kind of an upper-case name; null for anything that is none."""
    return F.when(F.lower(_c(label)).isin(*EDGE_KINDS) & (F.upper(_c(label)) == _c(label)), F.lower(_c(label)))


def trim_quotes(x: Column | str) -> Column:
    """Without double quotes, then without single quotes, at both ends."""
    return F.regexp_replace(F.regexp_replace(_c(x), '^"+|"+$', ""), "^'+|'+$", "")


# fixed values: memory tiers by GB, and the models of each
def tier(gb: Column | str) -> Column:
    gb = _c(gb)
    return F.when(gb.isNull(), "balanced").when(gb < 12, "minimal").when(gb < 24, "balanced").otherwise("max")
