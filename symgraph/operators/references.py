"""References to records that do not exist.

Keys (symbols and files) are dictionary-encoded as integers. Per key range and
period, the keys referenced and the keys certainly alive form bitmaps; a bitmap is
kept as its non-zero 64-bit words, one row each, so empty ranges cost nothing. In
each range a running OR over the periods gives the parents alive since an earlier
period; reference AND-NOT parent leaves the bits that may be orphans, which are
decoded to (key, period). Only references with a surviving (key, period) are then
held against the exact times.

Certainly alive: the key's first occurrence lies in an earlier period and it was
never removed. Everything else (never there, first seen in the same or a later
period, ever removed) survives the AND-NOT and is decided exactly, so the bitmaps
are a filter without loss.

Defined results: a null reference is none; an empty one refers to the empty name.
A reference without a time is 'missing' if its target never occurs and nothing
otherwise. Repeated rows come out each under its own row id. Empty tables give an
empty result (or, without targets, all references as missing).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symgraph.session import materialize

#: Keys per range of the dictionary, as a power of two: what one window numbers.
RANGE_BITS = 15
#: Rows of one (key, period) from which a reference counts as heavy: 1 / HEAVY of all
#: rows. There are at most HEAVY such pairs, which bounds what is broadcast.
HEAVY = 1000


def _period(t: Column) -> Column:
    return F.datediff(t, F.lit("1970-01-01").cast("date"))


def references(edges: DataFrame, raw_edges: DataFrame) -> DataFrame:
    """rel, row_id, side, ns, key, at: all references; ns is 'file' for the from side of imports."""
    e = edges.select(
        F.col("edge_id").alias("row_id"),
        F.col("observed_at").alias("at"),
        F.explode(
            F.array(
                F.struct(F.lit("from").alias("side"), F.when(F.col("kind") == "imports", "file").otherwise("symbol").alias("ns"), F.col("from_qname").alias("key")),
                F.struct(F.lit("to").alias("side"), F.lit("symbol").alias("ns"), F.col("to_qname").alias("key")),
            )
        ).alias("r"),
    ).select(F.lit("edges").alias("rel"), "row_id", "r.side", "r.ns", "r.key", "at")
    path = F.expr("substring_index(to_raw, '::', -1)")
    qualified = F.col("to_raw").contains("::") & (F.length(path) > 0) & F.expr("left(to_raw, length(to_raw) - length(substring_index(to_raw, '::', -1)) - 2)").contains("/")
    r = raw_edges.filter(qualified).select(F.lit("raw_edges").alias("rel"), F.col("raw_id").alias("row_id"), F.lit("to").alias("side"), F.lit("symbol").alias("ns"), F.col("to_raw").alias("key"), F.col("extracted_at").alias("at"))
    return e.unionByName(r).filter(F.col("key").isNotNull())


def targets(symbols: DataFrame, files: DataFrame, removed: DataFrame) -> DataFrame:
    """ns, key, first_seen, is_removed: one row per target that occurs."""
    s = symbols.select(F.lit("symbol").alias("ns"), F.col("qualified_name").alias("key"), F.col("indexed_at").alias("seen"), F.lit(False).alias("rm"), F.lit(True).alias("is"))
    f = files.select(F.lit("file").alias("ns"), F.col("path").alias("key"), F.col("seen_at").alias("seen"), F.lit(False).alias("rm"), F.lit(True).alias("is"))
    d = removed.select(F.lit("symbol").alias("ns"), F.col("qualified_name").alias("key"), F.lit(None).cast("timestamp_ntz").alias("seen"), F.lit(True).alias("rm"), F.lit(False).alias("is"))
    both = s.unionByName(f).unionByName(d).filter(F.col("key").isNotNull())
    return both.groupBy("ns", "key").agg(F.min("seen").alias("first_seen"), F.max("rm").alias("is_removed"), F.max("is").alias("occurs")).filter("occurs").drop("occurs")


def deleted_spans(symbols: DataFrame, removed: DataFrame) -> DataFrame:
    """key, gone_at, back_at: from each removal to the next indexing after it (null: none).

    Equal spans are merged. Only names that were ever removed are looked at. A removal meets the times of its
    own day; of later days it meets only the first time of each, of which a window takes the next, so that
    a name with very many rows is as many rows as there are days."""
    rm = removed.select(F.col("qualified_name").alias("key"), F.col("removed_at").alias("gone_at")).filter("key IS NOT NULL AND gone_at IS NOT NULL").distinct().withColumn("day", F.to_date("gone_at"))
    seen = symbols.select(F.col("qualified_name").alias("key"), F.col("indexed_at").alias("seen")).join(rm.select("key"), "key", "left_semi").filter("seen IS NOT NULL").distinct().withColumn("day", F.to_date("seen"))
    firsts = seen.groupBy("key", "day").agg(F.min("seen").alias("first")).unionByName(rm.select("key", "day", F.lit(None).cast("timestamp_ntz").alias("first")).distinct())
    after = Window.partitionBy("key").orderBy("day").rowsBetween(1, Window.unboundedFollowing)
    later = firsts.groupBy("key", "day").agg(F.min("first").alias("first")).withColumn("later", F.min("first").over(after)).select("key", "day", "later")
    same = rm.join(seen.select("key", "day", "seen"), ["key", "day"]).filter("seen > gone_at").groupBy("key", "gone_at").agg(F.min("seen").alias("same"))
    back = rm.join(later, ["key", "day"]).join(same, ["key", "gone_at"], "left").withColumn("back_at", F.coalesce("same", "later"))
    return back.groupBy("key", "back_at").agg(F.min("gone_at").alias("gone_at")).select("key", "gone_at", "back_at")


def dictionary(keys: DataFrame, buckets: int) -> DataFrame:
    """Adds `id`: a dense integer inside the key's range, the range above it. A key's id
    depends on its range's keys alone, so a task that runs again gives the same ids."""
    b = F.pmod(F.xxhash64("ns", "key"), F.lit(buckets))
    w = Window.partitionBy("__b").orderBy("ns", "key")
    return keys.withColumn("__b", b).withColumn("id", F.col("__b") * F.lit(1 << 40) + F.row_number().over(w) - 1).drop("__b")


def _bit(idc: str) -> Column:
    return F.expr(f"shiftleft(1L, cast({idc} & 63 AS int))")


def orphan_bits(key_periods: DataFrame, targets_: DataFrame, buckets: int) -> DataFrame:
    """ns, key, period, n_refs, first_seen, is_removed of every (key, period) whose bit survives
    reference AND-NOT parent. key_periods: ns, key, period, n_refs."""
    t = targets_.select("ns", "key", F.lit(None).cast("int").alias("period"), F.lit(0).cast("long").alias("n_refs"), "first_seen", "is_removed", F.lit(True).alias("occurs"))
    k = key_periods.select("ns", "key", "period", "n_refs", F.lit(None).cast("timestamp_ntz").alias("first_seen"), F.lit(None).cast("boolean").alias("is_removed"), F.lit(False).alias("occurs"))
    # one grouping gives the dictionary and, with each key, the periods that refer to it: at
    # most as many as there are periods, however many rows the key has
    keys = t.unionByName(k).groupBy("ns", "key").agg(
        F.collect_list(F.when(F.col("period").isNotNull(), F.struct("period", "n_refs"))).alias("refs"),
        F.min("first_seen").alias("first_seen"),
        F.coalesce(F.max("is_removed"), F.lit(False)).alias("is_removed"),
        F.max("occurs").alias("occurs"),
    ).filter(F.size("refs") > 0)
    # used twice, so written once
    ids = materialize(dictionary(keys, buckets), "reference_dictionary")
    sure = F.when(F.col("occurs") & ~F.col("is_removed"), _period(F.col("first_seen")))
    marks = F.concat(F.transform("refs", lambda r: F.struct(r["period"].alias("period"), F.lit(True).alias("ref"))), F.filter(F.array(F.struct(sure.alias("period"), F.lit(False).alias("ref"))), lambda m: m["period"].isNotNull()))
    words = (
        ids.select("id", F.explode(marks).alias("m"))
        .groupBy(F.expr("shiftright(id, 6)").alias("word"), F.col("m.period").alias("period"))
        .agg(F.bit_or(F.when(F.col("m.ref"), _bit("id")).otherwise(F.lit(0).cast("long"))).alias("ref_bits"), F.bit_or(F.when(~F.col("m.ref"), _bit("id")).otherwise(F.lit(0).cast("long"))).alias("born_bits"))
    )
    before = Window.partitionBy("word").orderBy("period").rowsBetween(Window.unboundedPreceding, -1)
    left = words.withColumn("alive", F.coalesce(F.expr("bit_or(born_bits)").over(before), F.lit(0).cast("long"))).select("word", "period", F.expr("ref_bits & ~alive").alias("bits")).filter("bits <> 0")
    decoded = left.select("period", F.col("word"), F.explode(F.expr("filter(sequence(0, 63), i -> (shiftright(bits, i) & 1L) = 1L)")).alias("i")).select((F.col("word") * 64 + F.col("i")).alias("id"), "period")
    per_period = ids.select("id", "ns", "key", "first_seen", "is_removed", "occurs", F.explode("refs").alias("r")).select("id", "ns", "key", "first_seen", "is_removed", "occurs", F.col("r.period").alias("period"), F.col("r.n_refs").alias("n_refs"))
    return per_period.join(decoded, ["id", "period"], "left_semi").drop("id")


def orphan_references(edges: DataFrame, raw_edges: DataFrame, symbols: DataFrame, files: DataFrame, removed: DataFrame, buckets: int | None = None) -> DataFrame:
    """rel, row_id, side, key, at, state of each reference without a target at its time."""
    spark = edges.sparkSession
    # references without a time: period -1, before all others
    refs = references(edges, raw_edges).withColumn("period", F.coalesce(_period(F.col("at")), F.lit(-1)))
    # two numbers; ranges follow that of the keys, which needn't be exact
    total, n = refs.agg(F.count(F.lit(1)), F.approx_count_distinct(F.xxhash64("ns", "key"), 0.05)).first()
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // (1 << RANGE_BITS)))
    key_periods = refs.groupBy("ns", "key", "period").agg(F.count(F.lit(1)).alias("n_refs"))
    bits = orphan_bits(key_periods, targets(symbols, files, removed), buckets)
    bits = bits.withColumn("heavy", F.col("n_refs") * HEAVY >= F.lit(total)).select(F.col("ns").alias("b_ns"), F.col("key").alias("b_key"), F.col("period").alias("b_period"), "first_seen", "is_removed", "occurs", "heavy")
    bits = materialize(bits, "orphan_bits")
    on = reduce(lambda a, b: a & b, [F.col(c) == F.col(f"b_{c}") for c in ("ns", "key", "period")])
    # heavy pairs, at most HEAVY, go to the rows; all other pairs hold under a thousandth
    # of the rows each, and meet theirs in a shuffle
    heavy = F.broadcast(bits.filter("heavy"))
    some = refs.join(heavy, on, "inner").unionByName(refs.join(bits.filter("NOT heavy"), on, "inner"))
    spans = deleted_spans(symbols, removed).select(F.col("key").alias("d_key"), "gone_at", "back_at")
    missing, late = ~F.col("occurs"), F.col("first_seen") > F.col("at")
    sure = some.filter(missing | F.coalesce(late, F.lit(False))).select("rel", "row_id", "side", "key", "at", F.when(missing, "missing").otherwise("late").alias("state"))
    # a span holds a reference at its time from gone_at on, up to but not at back_at: an
    # indexing at exactly that time counts as before it
    maybe = some.filter("is_removed AND occurs AND first_seen <= at AND ns = 'symbol'").select("rel", "row_id", "side", "key", "at")
    gone = (F.col("key") == F.col("d_key")) & (F.col("gone_at") <= F.col("at")) & (F.col("back_at").isNull() | (F.col("at") < F.col("back_at")))
    deleted = maybe.join(spans, gone, "left_semi").withColumn("state", F.lit("deleted"))
    return sure.unionByName(deleted)


def orphan_rates(orphans: DataFrame, edges: DataFrame, raw_edges: DataFrame) -> DataFrame:
    """rel, side, day, n_missing, n_late, n_deleted, n_refs per table, side and day."""
    day = F.to_date("at")
    all_refs = references(edges, raw_edges).groupBy("rel", "side", day.alias("day")).agg(F.count(F.lit(1)).alias("n_refs"))
    bad = orphans.groupBy("rel", "side", day.alias("day")).agg(*[F.count_if(F.col("state") == s).alias(f"n_{s}") for s in ("missing", "late", "deleted")])
    zero = F.lit(0).cast("long")
    b = bad.select(F.col("rel").alias("b_rel"), F.col("side").alias("b_side"), F.col("day").alias("b_day"), "n_missing", "n_late", "n_deleted")
    on = (F.col("rel") == F.col("b_rel")) & (F.col("side") == F.col("b_side")) & F.col("day").eqNullSafe(F.col("b_day"))
    return all_refs.join(b, on, "left").select("rel", "side", "day", *[F.coalesce(c, zero).alias(c) for c in ("n_missing", "n_late", "n_deleted")], "n_refs")
