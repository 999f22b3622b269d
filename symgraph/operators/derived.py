"""Edges and reports derived from history: co-change, modification, recency, tests, canonical forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Items of a commit paired in one block.
PAIR_BLOCK = 2048


def co_change(changes: DataFrame, least: int = 2, decay: float = 0.01, commits: int | None = None) -> DataFrame:
    """a, b, n, last_seen, weight of symbols (item) changed together (commit_id, at), a < b, n >= least.
    weight: sum of exp(-decay * days before the newest change). commits: only the last so many.

    The items of a wide commit are dealt to blocks and every item meets every block, so that no task makes
    all its pairs and none is lost."""
    ch = changes.select("commit_id", "item", "at").distinct()
    size = ch.groupBy("commit_id").agg(F.count(F.lit(1)).alias("size"), F.max("at").alias("c_at")).filter("size > 1")
    if commits is not None:
        size = size.orderBy(F.desc("c_at"), F.desc("commit_id")).limit(commits)
    newest = ch.agg(F.max("at")).scalar()
    kept = ch.join(size.select("commit_id", "c_at", F.ceil(F.col("size") / PAIR_BLOCK).cast("int").alias("blocks")), "commit_id")
    a = kept.select("commit_id", "c_at", F.pmod(F.hash("item"), F.col("blocks")).alias("block"), F.col("item").alias("a"))
    b = kept.select("commit_id", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("item").alias("b"))
    pairs = a.join(b, ["commit_id", "block"]).filter("a < b")
    age = F.datediff(newest, "c_at")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("c_at").alias("last_seen"), F.round(F.sum(F.exp(-F.lit(decay) * age)), 6).alias("weight")).filter(F.col("n") >= least)


def modified_in(changes: DataFrame) -> DataFrame:
    """item, n_commits, last."""
    return changes.groupBy("item").agg(F.countDistinct("commit_id").alias("n_commits"), F.max("at").alias("last"))


def recent(changes: DataFrame, days: int) -> DataFrame:
    """item, n: changes within so many days of the newest one."""
    newest = changes.agg(F.max("at")).scalar()
    return changes.filter(F.datediff(newest, "at") <= days).groupBy("item").agg(F.count(F.lit(1)).alias("n"))


def recent_near(changes: DataFrame, edges: DataFrame, qname: str, days: int) -> DataFrame:
    """item, n: recent changes of a symbol and of what is one edge away from it, in either direction."""
    out = edges.filter(F.col("from_qname") == qname).select(F.col("to_qname").alias("item"))
    into = edges.filter(F.col("to_qname") == qname).select(F.col("from_qname").alias("item"))
    near = out.unionByName(into).unionByName(edges.sparkSession.createDataFrame([(qname,)], "item string")).distinct()
    newest = changes.agg(F.max("at")).scalar()
    return changes.filter(F.datediff(newest, "at") <= days).join(near, "item", "left_semi").groupBy("item").agg(F.count(F.lit(1)).alias("n"))


#: Lines of a file in one block of the range join.
LINES = 64


def modified_in_lines(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """qualified_name, n_commits, last of the symbols whose lines a hunk (commit_id, at, file_path, first_line,
    last_line) touches. Both sides are dealt to blocks of lines, so that no file is one key; a pair that
    meets in several blocks counts once, since commits are counted."""
    blocks = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / LINES), F.floor(F.col(b) / LINES))).alias("block")
    s = symbols.filter("start_line IS NOT NULL AND end_line >= start_line").select(F.col("file_path").alias("p"), "qualified_name", "start_line", "end_line", blocks("start_line", "end_line")).withColumnRenamed("block", "b")
    h = hunks.filter("last_line >= first_line").select("commit_id", "at", "file_path", "first_line", "last_line", blocks("first_line", "last_line")).distinct()
    hit = h.join(s, (F.col("p") == F.col("file_path")) & (F.col("b") == F.col("block")) & (F.col("first_line") <= F.col("end_line")) & (F.col("last_line") >= F.col("start_line")))
    return hit.groupBy("qualified_name").agg(F.countDistinct("commit_id").alias("n_commits"), F.max("at").alias("last"))


def canonical(df: DataFrame, group: str, form: Column | str, member: str) -> DataFrame:
    """group, exemplar, n: the most frequent form in each group, and of its members the first; ties by form."""
    f = F.col(form) if isinstance(form, str) else form
    per = df.groupBy(group, f.alias("form")).agg(F.count(F.lit(1)).alias("n"), F.min(member).alias("exemplar"))
    w = Window.partitionBy(group).orderBy(F.desc("n"), "form")
    return per.withColumn("r", F.row_number().over(w)).filter("r = 1").select(group, "exemplar", "n")


def tests_of(edges: DataFrame, symbols: DataFrame, qname: str) -> DataFrame:
    """qualified_name of the tests of a symbol, by tested_by edges."""
    t = edges.filter((F.col("kind") == "tested_by") & (F.col("from_qname") == qname)).select(F.col("to_qname").alias("qualified_name")).distinct()
    return symbols.select("qualified_name").distinct().join(t, "qualified_name", "left_semi")
