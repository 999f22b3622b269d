"""What a graph learns from its use: logs of retrievals held against changes, conventions of repositories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def retrievals_used(log: DataFrame, changes: DataFrame, days: int = 3) -> DataFrame:
    """node, n_retrieved, n_used: retrievals (node, at) and those of them after which the node was changed (item, at)
    on the same or one of the next days. Both sides are reduced to days per node before they meet, so that
    a node that is retrieved all the time is as many rows as there are days."""
    asked = log.groupBy("node", F.to_date("at").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    marks = changes.filter("at IS NOT NULL").select("item", F.to_date("at").alias("d")).distinct()
    marks = marks.select(F.col("item").alias("m_node"), F.explode(F.sequence(F.date_sub("d", days), F.col("d"))).alias("m_day")).distinct()
    both = asked.join(marks, (F.col("node") == F.col("m_node")) & (F.col("day") == F.col("m_day")), "left")
    return both.groupBy("node").agg(F.sum("n").alias("n_retrieved"), F.sum(F.when(F.col("m_day").isNotNull(), F.col("n")).otherwise(0)).alias("n_used"))


def naming(name: str) -> Column:
    """The style of a name: lower, snake, upper, camel, pascal or mixed."""
    c = F.col(name)
    return F.when(c.rlike("^[a-z][a-z0-9]*(_[a-z0-9]+)*$"), F.when(c.contains("_"), "snake").otherwise("lower")).when(c.rlike("^[A-Z][A-Z0-9]*(_[A-Z0-9]+)*$"), "upper").when(c.rlike("^[a-z][A-Za-z0-9]*$"), "camel").when(c.rlike("^[A-Z][A-Za-z0-9]*$"), "pascal").otherwise("mixed")


def conventions(symbols: DataFrame) -> DataFrame:
    """repo_id, kind, style, n, share: how a repository writes the names of each kind of symbol, the most frequent style;
    ties go by its name."""
    per = symbols.groupBy("repo_id", "kind", naming("short_name").alias("style")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("repo_id", "kind")
    ranked = per.withColumn("r", F.row_number().over(w.orderBy(F.desc("n"), "style"))).withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6))
    return ranked.filter("r = 1").select("repo_id", "kind", "style", "n", "share")
