"""Generated, minified or vendored source files, and data saved as code.

Every text leaves one row of evidence: a hash of its tokens (comments and white space
aside, so that a changed notice or another layout makes no difference), whether a
notice in its leading comments says who made it, and measures of its layout. Merkle
hashes are then computed bottom-up over the directory trees, level by level up to their roots: a
directory's hash is made of those of its children, files and directories, names aside, by sums
that don't depend on their order and are combined map side, so that no directory is gathered in
one place. A subtree (a file counts as one) that different repositories share is vendored code if
they are unrelated. They are taken to be where `UNRELATED` of them or more hold it, which is more
than a project and its forks and moves; or where any copy shows a foreign origin: a notice in one
of its files, or a place where package managers put dependencies. Copies between fewer
repositories that show none are moves of their own code and make no case. Only the files of the
shared subtree itself are marked.

The other rules look at one file:
- a notice of a generator in the leading comments, or a build product's folder or name;
- minified or bundled: hardly any white space between the tokens of a longer text;
- put out by a tool: top-level definitions numbered one after the other;
- data: nearly all tokens that aren't punctuation are literals, or one literal without
  words fills the file.

Defined results: a null text has only its path; an empty one is hand-written; paths are
judged once however often they repeat; a null path is no file. Words about generation or
vendoring outside the leading comments, and folders that merely sound like it, count for
nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symgraph.operators.extract import lexer as L
from symgraph.session import materialize, spread

# places where tools put what they make, and package managers what they fetch
BUILD_DIRS = ["generated", "__generated__", "gen", "dist", "target", "out", "static", "assets"]
BUILD_NAMES = ["min", "gen", "autogen", "generated", "g", "pb", "designer", "bundle"]
DEPENDENCY_DIRS = ["node_modules", "vendor", "third_party", "3rdparty", "deps", "external"]

# what notices of generators and of third parties say
GENERATOR_NOTICE = re.compile(
    r"@generated\b|code generated by|<auto-generated|\bautogenerated\b|\bauto-?generated (?:by|from|file|code)|machine-written|generated (?:from|by) \S+|automatically (?:produced|generated|created)"
    r"|do not (?:edit|modify)(?: this file| by hand| manually| directly)?\s*(?:[.!;,(\[{#]|\*/|$)|changes will be (?:overwritten|lost)|(?:manual|hand) (?:edits|changes) (?:are|will be) (?:lost|overwritten)"
    r"|(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)|nicht (?:von hand )?(?:bearbeiten|ändern)|(?:généré|produit) automatiquement|ne pas (?:modifier|éditer)|(?:generado|producido) automáticamente|no (?:editar|modificar)\b",
    re.IGNORECASE | re.MULTILINE,
)
ORIGIN_NOTICE = re.compile(r"third[- ]party|upstream:|local copy of|vendored (?:from|copy)|copied from", re.IGNORECASE)
#: Characters of code from which a text can be minified, the share of white space beneath which it is, and
#: the characters a line holds on average.
MINIFIED_LEAST, MINIFIED_SPACE, MINIFIED_LINE = 80, 0.085, 100
#: Share of literals among the tokens that aren't punctuation, and literals at least, of data.
DATA_SHARE, DATA_LEAST = 0.8, 12
#: A literal without words of this length, with this share of the text, is data.
BLOB_LEAST, BLOB_SHARE = 120, 0.6
#: Numbered definitions at least, and the share of all top-level ones that are numbered in order.
NUMBERED_LEAST, NUMBERED_SHARE = 3, 0.8
#: Tokens from which a text that others share is more than a common phrase.
SHARED_LEAST = 12
#: Repositories that hold a subtree from which it is nobody's own, whatever it says.
UNRELATED = 5

_DEFINITION = {
    L.RUST: re.compile(r"^(?:#\[[^\]\n]*\] )?(?:pub(?:\([a-z]+\))? )?(?:async )?(?:const|static|struct|enum|fn|type|trait|impl(?:<[^>\n]*>)?)\b([^\n{(=;:]*)", re.MULTILINE),
    L.TS: re.compile(r"^(?:exports\.(\w+) = |(?:export )?(?:default )?(?:declare )?(?:abstract )?(?:async )?(?:var|let|const|function|class|interface|type|enum) (\w+))", re.MULTILINE),
}


def leading_comments(toks: list[str]) -> str:
    """The comments before the first token of code; documentation of that code included."""
    out = []
    for t in toks:
        if t.isspace():
            continue
        if not t.startswith(("//", "/*")) or t.startswith(("///", "//!")):
            if t.startswith(("///", "//!")):
                continue
            break
        out.append(t)
    return "\n".join(out)


def numbered(text: str, family: str) -> bool:
    """Whether top-level definitions are numbered in their order."""
    right = total = 0
    for m in _DEFINITION[family].finditer(text):
        name = next((g for g in m.groups() if g), "")
        # the first number in a name, where names have several parts
        n = re.search(r"\d+", name)
        if n is not None and int(n.group()) == total:
            right += 1
        elif n is not None:
            n = re.search(r"(\d+)\W*$", name)
            right += n is not None and int(n.group(1)) == total
        total += 1
    return total >= NUMBERED_LEAST and right >= NUMBERED_SHARE * total


def evidence(path: str, text: str | None) -> tuple[int, int, bool, str | None]:
    """(token hash, tokens, origin notice, what the text alone shows or None)."""
    if not text:
        return 0, 0, False, None
    family = L.family_of(path)
    toks = L.tokens(text, family)
    code = [t for t in toks if not t.isspace() and not t.startswith(("//", "/*"))]
    h = int.from_bytes(blake2b("\x00".join(code).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)
    head = leading_comments(toks)
    origin = ORIGIN_NOTICE.search(head) is not None
    return h, len(code), origin, _shape(text, code, toks, head, family)


def _shape(text: str, code: list[str], toks: list[str], head: str, family: str) -> str | None:
    if GENERATOR_NOTICE.search(head):
        return "generated"
    if not code:
        return None
    space = sum(len(t) for t in toks if t.isspace())
    literals = words = blob = 0
    for t in code:
        c = t[0]
        if c in "\"'`" and len(t) > 1 and not (family == L.RUST and c == "'" and t[-1] != "'"):
            literals += 1
            if len(t) > BLOB_LEAST and (not re.search(r"\s", t) or t[1:3] in ("[{", "{\"", "[[", "[\"")):
                blob = max(blob, len(t))
        elif c.isdigit() or (c == "." and len(t) > 1 and t[1].isdigit()):
            literals += 1
        elif c.isalpha() or c in "_$":
            words += 1
    chars = sum(map(len, code))
    if blob >= BLOB_SHARE * chars or (literals >= DATA_LEAST and literals >= DATA_SHARE * (literals + words)):
        return "data"
    quoted = sum(len(t) for t in code if t[0] in "\"'`")
    code_lines = 1 + sum(t.count("\n") for t in toks if t.isspace())
    if chars - quoted >= MINIFIED_LEAST and space <= MINIFIED_SPACE * (chars - quoted) and chars >= MINIFIED_LINE * code_lines:
        return "minified"
    if numbered(text, family):
        return "generated"
    return None


def file_evidence(docs: DataFrame) -> DataFrame:
    """path, repo_id, h, n_tokens, origin, shape: one row per source file with a path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [evidence(p.as_py(), t.as_py()) for p, t in zip(batch.column(0), batch.column(2), strict=True)]
            cols = list(zip(*got, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.bool_()), pa.array(cols[3], pa.string())],
                names=["path", "repo_id", "h", "n_tokens", "origin", "shape"],
            )

    source = docs.filter(is_source(F.col("path"))).select("path", "repo_id", "text")
    return spread(source, "path").mapInArrow(run, "path string, repo_id string, h bigint, n_tokens int, origin boolean, shape string")


def is_source(path: Column) -> Column:
    return path.rlike("\\.(" + "|".join(L.EXTENSIONS) + ")$")


def in_dependency_dir(path: Column) -> Column:
    return path.rlike("(^|/)(" + "|".join(DEPENDENCY_DIRS) + ")/")


def in_build_place(path: Column) -> Column:
    return path.rlike("(^|/)(" + "|".join(BUILD_DIRS) + ")/") | path.rlike("\\.(" + "|".join(BUILD_NAMES) + ")\\.[a-z]+$")


def _parent(path: Column | str) -> Column:
    """The folder a path lies in; null at the top."""
    p = F.col(path) if isinstance(path, str) else path
    return F.nullif(F.regexp_replace(p, "/?[^/]*$", ""), F.lit(""))


def _above(path: str) -> Column:
    """The path itself and all folders above it."""
    return F.expr(f"transform(sequence(1, size(split({path}, '/'))), i -> array_join(slice(split({path}, '/'), 1, i), '/'))")


def merkle(leaves: DataFrame) -> DataFrame:
    """node, repo_id, h, marked, long of every subtree: the files (path, repo_id, h, marked, long) and all folders
    above them. A folder is marked, or long enough to be no chance, if any of its children is.

    One aggregate per level, the deepest first; the number of levels is that of the longest path."""
    files = materialize(leaves.filter("path IS NOT NULL").select(F.col("path").alias("node"), "repo_id", F.xxhash64(F.lit("file"), "h").alias("h"), "marked", "long", F.size(F.split("path", "/")).alias("depth")), "leaves")
    deepest = files.agg(F.max("depth")).first()[0] or 1
    every, folders = files.drop("depth"), None
    for depth in range(deepest, 1, -1):
        children = files.filter(F.col("depth") == depth).drop("depth")
        if folders is not None:
            children = children.unionByName(folders)
        parents = children.groupBy(_parent("node").alias("node"), "repo_id").agg(F.expr("bit_xor(xxhash64(h, 1))").alias("x"), F.sum(F.xxhash64("h", F.lit(2)).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"), F.max("marked").alias("marked"), F.max("long").alias("long"))
        folders = materialize(parents.filter("node IS NOT NULL").select("node", "repo_id", F.xxhash64(F.lit("folder"), "x", "s", "n").alias("h"), "marked", "long"), "folders")
        every = every.unionByName(folders)
    return every


def vendored(leaves: DataFrame) -> DataFrame:
    """path of each file that lies in a subtree which unrelated repositories share. leaves: path, repo_id, h,
    n_tokens, origin (a notice). Texts of few tokens are part of their folders, but no case by themselves."""
    known = leaves.filter("path IS NOT NULL").groupBy("path", "repo_id", "h").agg(F.max("n_tokens").alias("n_tokens"), F.max("origin").alias("marked")).withColumn("long", F.col("n_tokens") >= SHARED_LEAST)
    # a folder none of whose files is long enough is shared by chance; a dependency folder says what it holds, and
    # nothing about the folders around it
    nodes = merkle(known).filter("long").withColumn("marked", F.col("marked") | in_dependency_dir(F.concat("node", F.lit("/"))))
    held = nodes.groupBy("h", "repo_id").agg(F.max("marked").alias("marked"))
    shared = held.groupBy("h").agg(F.count(F.lit(1)).alias("repos"), F.max("marked").alias("foreign")).filter((F.col("repos") > 1) & (F.col("foreign") | (F.col("repos") >= UNRELATED))).select("h")
    hit = nodes.join(shared, "h", "left_semi").select("node").distinct()
    # a file is its own subtree and part of all those above it
    return known.select("path", F.explode(_above("path")).alias("node")).join(hit, "node", "left_semi").select("path").distinct()


def not_handwritten(files: DataFrame, docs: DataFrame) -> DataFrame:
    """path, reason (generated, minified, data or vendored) of each source path of files that nobody
    wrote by hand for its repository."""
    ev = materialize(file_evidence(docs), "file_evidence").withColumn("marked", F.col("origin") | in_dependency_dir(F.col("path")))
    copies = vendored(ev).withColumn("copied", F.lit(True))
    alone = ev.filter("path IS NOT NULL").groupBy("path").agg(F.max("shape").alias("shape"), F.max("marked").alias("marked"))
    listed = files.filter(is_source(F.col("path"))).select("path").distinct()
    place = F.when(in_build_place(F.col("path")), "generated")
    reason = F.when(F.coalesce(F.col("copied"), F.col("marked"), F.lit(False)) | in_dependency_dir(F.col("path")), "vendored").otherwise(F.coalesce("shape", place))
    return listed.join(alone, "path", "left").join(copies, "path", "left").select("path", reason.alias("reason")).filter("reason IS NOT NULL")
