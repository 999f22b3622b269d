"""Functions paired with their documentation.

Source texts are lexed and their structural tokens exploded into rows (brackets, ends of
statements, heads of functions, comments). A running sum over a text's rows gives the
depth at each; among the rows of one depth, a head is followed by the opening and the
closing brace of its body (gaps and islands), or by the end of a statement if it has
none. A lag window attaches the comment right before a head. The functions found this way
are the rows: they are joined to the symbols by path, name and line, and a symbol whose
function isn't in its file's text is no row.

Documentation is the attached comment, the symbol's jsdoc or its synthesized description.
Whether one tells something is measured, not looked up: its lines are written with `§` for
the words of the function's own name and signature and `#` for numbers, and a line that
stands so over many different names (a share `COMMON_LINE` of all functions, three at
least) says nothing about any of them: tags with bare names, placeholders, notes to tools
or about authors, replies of a model that failed. Words that stand over as many names as
a share `COMMON_WORD` of all functions carry less than three bits; of the others `WORDS` different ones must be
left. Code fences, markup and commented-out code are told by their form.

Defined results: null and empty documentation is trivial; symbols of files without text,
and functions without a body, are no rows; several rows of a symbol count as the latest;
null texts have no functions; of functions of one name on one line the first counts. In
a corpus of a few functions no line can be common but by three names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.operators.extract import lexer as L
from symgraph.session import materialize, spread

#: Different words beyond name, signature and common ones that make documentation tell something.
WORDS = 2
#: Share of the functions over whose different names a line stands that says nothing about any of them, and names at least.
COMMON_LINE, COMMON_LEAST = 1e-4, 3
#: Share of the functions over whose different names a word of less than three bits stands.
COMMON_WORD = 1 / 8
#: Rows of a list that goes to every executor; a longer one is shuffled.
BROADCAST_ROWS = 250_000

# a line of code: a statement, or what ends like one
CODE_LINE = r"^\s*(?:(?:let|const|var|return|if|for|while|import|use|pub|fn|function|match|else|await|switch|case|throw)\b.*[;{}(,]\s*$|.*[;{}]\s*$|[\w.$]+\(.*\)\s*;?\s*$|[\w.$\[\]]+\s*[-+*/|&]?=\s*\S.*$|\}.*$)"


def structure(docs: DataFrame) -> DataFrame:
    """path, pos, line, kind, name: the structural tokens of each source text. kind: ( ) { } ; head doc."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, pos, line, kind, name = [], [], [], [], []
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                for p, (ln, k, nm) in enumerate(_telling(structural(text, L.family_of(batch.column(0)[i].as_py())))):
                    rows.append(i), pos.append(p), line.append(ln), kind.append(k), name.append(nm)
                if len(rows) > 50_000 or (i + 1 == batch.num_rows and rows):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(pos, pa.int32()), pa.array(line, pa.int32()), pa.array(kind, pa.string()), pa.array(name, pa.string())], names=["path", "pos", "line", "kind", "name"])
                    rows, pos, line, kind, name = [], [], [], [], []

    source = docs.filter(F.col("path").rlike("\\.(" + "|".join(L.EXTENSIONS) + ")$") & F.col("text").isNotNull())
    return spread(source.select("path", "text"), "path").mapInArrow(run, "path string, pos int, line int, kind string, name string")


def _telling(tokens: Iterator[tuple[int, str, str | None]]) -> list[tuple[int, str, str | None]]:
    """Without parentheses that hold nothing and ends of statements right after others, which change neither a
    depth nor what follows a head. Comments that are no documentation stay, without their text."""
    out: list[tuple[int, str, str | None]] = []
    for t in tokens:
        last = out[-1][1] if out else ""
        if t[1] == ")" and last == "(":
            out.pop()
        elif t[1] == "doc" and not t[2].startswith(("/**", "///")):
            out.append((t[0], "doc", None))
        elif t[1] != ";" or last != ";":
            out.append(t)
    return out


_STOPS = frozenset(["{", "}", ";"])
#: After these a brace in a return type opens an object type, not the body.
_TYPE_OPENS = frozenset(": | & < , [ ( => ? extends is keyof typeof readonly".split())
#: With these a head without body and semicolon has ended.
_TYPE_ENDS = frozenset("= const let var class interface enum import export if for while return switch".split())
_MODIFIERS = frozenset("async static get set public private protected readonly override abstract declare export default *".split())


def structural(text: str, family: str) -> Iterator[tuple[int, str, str | None]]:
    """(line, kind, name or comment) in order; lines of one comment block are one comment. Braces of object
    types between a head and its body (type parameters, return type) count as parentheses."""
    toks = L.tokens(text, family)
    line = 1 + text.count("\n", 0, L.body_start(text))
    doc: list[str] = []
    doc_line = doc_end = 0
    before = ";"  # the last token that isn't a modifier
    rust = family == L.RUST
    waits = False  # for the name of a function
    word, word_line = "", 0  # a name that may be a method's
    part, open_ = "", 0  # of a signature: head, params, after (them), type; and brackets open there
    prev = cur = ""
    for t in toks:
        c = t[0]
        if c.isspace():
            line += t.count("\n")
            continue
        if t.startswith(("//", "/*")):
            if doc and line > doc_end + 1:
                yield doc_line, "doc", "\n".join(doc)
                doc = []
            if not doc:
                doc_line = line
            doc.append(t)
            line += t.count("\n")
            doc_end = line
            continue
        if doc:
            yield doc_line, "doc", "\n".join(doc)
            doc = []
        prev, cur = cur, t
        if part == "after":
            part = "type" if t == ":" else ""
        elif part == "type" and not open_ and t in _TYPE_ENDS:
            part = ""
        if c in "(){};" and len(t) == 1:
            if word and c == "(":
                yield word_line, "head", word
                if not open_:
                    part = "head"
            word = ""
            waits = False
            if part and not open_ and (c in "});" or (part == "type" and c == "{" and prev not in _TYPE_OPENS)):
                part = ""
            elif part in ("head", "type") and c == ";":
                continue
            elif part and c in "({":
                if part == "head" and not open_ and c == "(":
                    part = "params"
                open_ += 1
                c = "(" if part != "params" else c
            elif part and c in ")}":
                open_ -= 1
                c = ")" if part != "params" else c
                if part == "params" and not open_:
                    part = "after"
            yield line, c, None
            before = c
        elif t in ("fn", "function"):
            waits = True
            before = t
        elif c.isalpha() or c in "_$#":
            if waits:
                yield line, "head", t
                if not rust and not open_:
                    part = "head"
                waits = False
                word = ""
            elif not rust and before in _STOPS and t not in _MODIFIERS and t not in L.TS_KEYWORDS:
                word, word_line = t, line
                before = t
            elif t in _MODIFIERS and before in _STOPS:
                word, word_line = t, line
            else:
                word = ""
                before = t
        elif c == "<" and word:
            pass
        else:
            if t != "*" or before not in _STOPS:
                word = "" if c not in "<>,:" else word
                before = t if not word else before
            line += t.count("\n")
    if doc:
        yield doc_line, "doc", "\n".join(doc)


def functions(tokens: DataFrame) -> DataFrame:
    """path, name, start_line, end_line, comment (documentation right before it) of each function with a body."""
    text = Window.partitionBy("path").orderBy("pos")
    step = F.when(F.col("kind").isin("{", "("), 1).when(F.col("kind").isin("}", ")"), -1).otherwise(0)
    deep = tokens.withColumn("depth", F.sum(step).over(text.rowsBetween(Window.unboundedPreceding, 0)))
    # the row before that isn't a parenthesis: `pub(crate)` may stand between comment and head
    seen = F.last(F.when(~F.col("kind").isin("(", ")"), F.struct("kind", "name")), ignorenulls=True).over(text.rowsBetween(Window.unboundedPreceding, -1))
    attached = deep.withColumn("before", seen).withColumn("comment", F.when((F.col("kind") == "head") & (F.col("before.kind") == "doc"), F.col("before.name")))
    # a body's braces lie one level below its head; an end of statement ends a head without body
    level = F.when(F.col("kind") == "{", F.col("depth")).otherwise(F.col("depth") + 1)
    island = Window.partitionBy("path", "level").orderBy("pos")
    body = attached.filter(F.col("kind").isin("head", "{", "}", ";")).withColumn("level", level)
    found = body.withColumn("next", F.lead("kind").over(island)).withColumn("end_line", F.lead("line", 2).over(island)).withColumn("last", F.lead("kind", 2).over(island))
    ok = (F.col("kind") == "head") & (F.col("next") == "{") & (F.col("last") == "}")
    return found.filter(ok).select("path", "name", F.col("line").alias("start_line"), "end_line", "comment")


def _words(text: Column) -> Column:
    """Words in lower case; names are cut at case and underscore, scripts without spaces into pairs; a
    number is `#`."""
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"([\p{Ll}\p{Nd}])(\p{Lu})", "$1 $2"), "_", " "), r"\p{Nd}+", " # ")
    return F.regexp_extract_all(F.lower(cut), F.lit(r"([\p{IsHan}\p{IsHiragana}\p{IsKatakana}]{1,2}|[\p{L}\p{M}]+|#)"), F.lit(1))


def plain_lines(doc: Column) -> Column:
    """The lines of documentation without comment markers, code fences with what they enclose, markup,
    tags' names and commented-out code."""
    text = F.regexp_replace(doc, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"(?m)^[ \t]*#!?\[doc\s*=\s*\"(.*)\"\][ \t]*$", "$1")
    text = F.regexp_replace(text, r"(?s)```.*?(```|$)", " ")
    text = F.regexp_replace(text, r"(?m)^[ \t]*(?:/\*[*!]?|//[/!]?|\*+/|\*(?!/)(?=\s|$|\*))+[ \t]?|\*+/[ \t]*$", "")
    text = F.regexp_replace(text, r"(?s)<!--.*?-->|<[^<>\n]{0,200}>|\{@\w+[^}\n]*\}", " ")
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(CODE_LINE))
    return F.transform(lines, lambda x: F.regexp_replace(x, r"^\s*@[\w-]+", " "))


def _slotted(line: Column, own: Column) -> Column:
    """The line's words with § for those of the function itself, also where they are inflected."""
    mine = lambda w: F.exists(own, lambda o: (o == w) | ((F.length(o) > 2) & w.startswith(o)) | ((F.length(w) > 3) & o.startswith(w)))
    words = F.array_join(F.transform(_words(line), lambda w: F.when(mine(w), "§").otherwise(w)), " ")
    return F.regexp_replace(words, r"§( §)+", "§")


def _small(df: DataFrame) -> DataFrame:
    """With the hint to broadcast if it is short; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def telling_words(rows: DataFrame, key: str, name: str, docs: list[str], about: Column) -> DataFrame:
    """key, n_<doc>: different telling words of each documentation column. Rows without any have no row
    here. name: what must differ for a line to be common."""
    n = rows.count()
    texts = rows.select(key, F.xxhash64(name).alias("n"), F.filter(F.array_distinct(_words(about)), lambda w: w != "#").alias("own"), F.explode(F.array(*[F.struct(F.lit(d).alias("doc"), F.col(d).alias("text")) for d in docs])).alias("d"))
    lines = texts.filter("d.text <> ''").select(key, "n", "own", "d.doc", F.explode(plain_lines(F.col("d.text"))).alias("line"))
    slotted = lines.select(key, "n", "doc", _slotted(F.col("line"), F.col("own")).alias("line")).filter(F.col("line").rlike("[^§# ]"))
    units = materialize(slotted.select(key, "n", "doc", F.xxhash64("line").alias("unit"), F.filter(F.array_distinct(F.split("line", " ")), lambda w: ~w.isin("§", "#") & ((F.length(w) > 1) | w.rlike(r"[\p{IsHan}]"))).alias("words")), "doc_lines")
    # at most 1 / COMMON_LINE lines a line of an average function: short, but counted all the same
    common = units.select("unit", "n").distinct().groupBy("unit").count().filter(F.col("count") >= max(COMMON_LEAST, COMMON_LINE * n)).select("unit")
    told = units.join(_small(common), "unit", "left_anti")
    # words of less than three bits: at most 8 times as many as an average function has words
    frequent = units.select("n", F.explode("words").alias("w")).distinct().groupBy("w").count().filter(F.col("count") >= max(COMMON_LEAST, COMMON_WORD * n)).agg(F.collect_list("w")).scalar()
    words = lambda d: F.size(F.array_except(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("doc") == d, F.col("words"))))), frequent))
    return told.groupBy(key).agg(*[words(d).alias(f"n_{d}") for d in docs])


SOURCES = ["comment", "jsdoc", "synthesized_description"]


def documented(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """qualified_name, kind, signature, file_path, start_line, end_line, documentation, doc_source, n_comment,
    n_jsdoc, n_synthesized_description (telling words) of each function or method that is found in the
    texts and has telling documentation: the attached comment, else jsdoc, else the description.
    symbols: latest rows."""
    fn = symbols.filter(F.col("kind").isin("function", "method"))
    found = functions(structure(docs)).groupBy(F.col("path").alias("f_path"), F.col("name").alias("f_name"), F.col("start_line").alias("f_line")).agg(F.min("end_line").alias("end_line"), F.min("comment").alias("comment"))
    on = (F.col("file_path") == F.col("f_path")) & (F.col("short_name") == F.col("f_name")) & (F.col("start_line") == F.col("f_line"))
    cols = ["qualified_name", "short_name", "kind", "signature", "file_path", "start_line", "end_line", *SOURCES]
    paired = materialize(found.join(fn, on).select(*cols), "functions")
    counted = telling_words(paired, "qualified_name", "short_name", SOURCES, F.concat_ws(" ", "short_name", "signature")).withColumnRenamed("qualified_name", "c_name")
    source = F.coalesce(*[F.when(F.col(f"n_{d}") >= WORDS, d) for d in SOURCES])
    documentation = F.coalesce(*[F.when(F.col("doc_source") == d, F.col(d)) for d in SOURCES])
    both = paired.join(counted, F.col("qualified_name") == F.col("c_name")).withColumn("doc_source", source).filter("doc_source IS NOT NULL")
    return both.withColumn("documentation", documentation).select(*[c for c in cols if c not in SOURCES and c != "short_name"], "documentation", "doc_source", *[f"n_{d}" for d in SOURCES])


def found(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """Those whose jsdoc or description tells something, whatever the comment says."""
    return documented(symbols, docs).filter((F.col("n_jsdoc") >= WORDS) | (F.col("n_synthesized_description") >= WORDS))


def pairs(symbols: DataFrame, docs: DataFrame) -> DataFrame:
    """qualified_name, signature, code, documentation, doc_source: code is the function's lines."""
    told = documented(symbols, docs)
    per_file = told.groupBy("file_path").agg(F.collect_list(F.struct("qualified_name", "signature", "documentation", "doc_source", "start_line", "end_line")).alias("fns"))
    text = docs.filter("path IS NOT NULL AND text IS NOT NULL").groupBy("path").agg(F.min("text").alias("text"))
    lines = F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")
    joined = per_file.join(text, F.col("file_path") == F.col("path")).withColumn("lines", lines).select("lines", F.explode("fns").alias("f"))
    code = F.array_join(F.slice("lines", F.col("f.start_line"), F.col("f.end_line") - F.col("f.start_line") + 1), "\n")
    return joined.select("f.qualified_name", "f.signature", code.alias("code"), "f.documentation", "f.doc_source")
