"""Multi-hop traversal: breadth first, one join per level.

Each level joins the frontier with the edges, takes the distinct new nodes and removes
those visited by an anti join. The frontier is written to the shared checkpoint folder
per level, so the plan stays short and a lost executor costs one level. Depth is bounded
by the caller or ends with an empty frontier."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.session import materialize, materialize_counted


def bfs(edges: DataFrame, seeds: DataFrame, depth: int | None, stop: DataFrame | None = None, until: str | None = None) -> DataFrame:
    """node, depth: least number of steps from any seed (node) along edges (src, dst). Nodes in stop are
    reached but not gone on from (seeds are); once the node `until` is reached, no further level is.
    Self loops and cycles are harmless."""
    pairs = edges.select("src", "dst").distinct()
    if depth is None or depth > 1:
        pairs = materialize(pairs, "bfs_edges")  # read once per level
    visited = materialize(seeds.select("node").distinct().withColumn("depth", F.lit(0)), "bfs")
    frontier, level = visited, 0
    while depth is None or level < depth:
        level += 1
        start = frontier.select("node")
        if stop is not None and level > 1:
            start = start.join(stop.select("node"), "node", "left_anti")
        step = pairs.join(start.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier, n, met = materialize_counted(step.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(level)), "bfs", F.col("node") == F.lit(until))
        if not n:
            break
        visited = visited.unionByName(frontier)
        if met:
            break
    return visited


def _calls(edges: DataFrame, kind: str = "calls") -> DataFrame:
    return edges.filter(F.col("kind") == kind).select(F.col("from_qname").alias("src"), F.col("to_qname").alias("dst"))


def reverse(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def blast_radius(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """Transitive callers with their least depth, seeds left out."""
    return bfs(reverse(_calls(edges)), seeds, depth).filter("depth > 0")


def context(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Neighbourhood whatever the kind and the direction, seeds included at depth 0."""
    pairs = edges.select(F.col("from_qname").alias("src"), F.col("to_qname").alias("dst"))
    return bfs(pairs.unionByName(reverse(pairs)), seeds, depth)


def shortest_path(edges: DataFrame, start: str, goal: str, depth: int = 8) -> DataFrame:
    """hop, node of a shortest path along calls; of several the least by names, hop by hop. No path, no
    rows. Levels are found forwards; the path is then read backwards from the goal, so that each level
    carries nodes and not paths."""
    spark = edges.sparkSession
    pairs = materialize(_calls(edges).distinct(), "bfs_edges")
    levels = bfs(pairs, spark.createDataFrame([(start,)], "node string"), depth, until=goal)
    end = levels.filter(F.col("node") == goal).first()
    if end is None:
        return spark.createDataFrame([], "hop int, node string")
    # nodes on some shortest path, from the goal down to the start
    on = [spark.createDataFrame([(goal,)], "node string")]
    for d in range(end["depth"] - 1, -1, -1):
        at = levels.filter(F.col("depth") == d).select("node")
        before = pairs.join(on[-1].select(F.col("node").alias("dst")), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
        on.append(materialize(at.join(before, "node", "left_semi"), "path"))
    on.reverse()
    # one node per hop: the path's length, not the data, bounds this loop
    path = [start]
    for layer in on[1:]:
        nxt = pairs.filter(F.col("src") == path[-1]).join(layer.select(F.col("node").alias("dst")), "dst", "left_semi").agg(F.min("dst").alias("n")).first()["n"]
        path.append(nxt)
    return spark.createDataFrame(list(enumerate(path)), "hop int, node string")


def surface(edges: DataFrame, symbols: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """Callees expanded until exported symbols, which are boundaries."""
    return bfs(_calls(edges), seeds, depth, symbols.filter("exported").select(F.col("qualified_name").alias("node")))


def dead(edges: DataFrame, symbols: DataFrame, entries: DataFrame, depth: int | None = None) -> DataFrame:
    """qualified_name of symbols that no entry (node) reaches along calls."""
    reached = bfs(_calls(edges), entries, depth).select(F.col("node").alias("qualified_name"))
    return symbols.select("qualified_name").distinct().join(reached, "qualified_name", "left_anti")


def tested_by(edges: DataFrame, tests: DataFrame, depth: int | None = None) -> DataFrame:
    """target, test: what each test (node) reaches along calls, within depth if given, else until nothing new
    is reached. The walk carries its test."""
    if depth is None:
        return tested_by_all(edges, tests)
    pairs = materialize(_calls(edges).distinct(), "bfs_edges")
    seen = materialize(tests.select(F.col("node").alias("test"), F.col("node").alias("node")).distinct(), "tested")
    frontier, level = seen, 0
    while level < depth:
        level += 1
        step = frontier.select("test", F.col("node").alias("src")).join(pairs, "src").select("test", F.col("dst").alias("node")).distinct()
        frontier, n, _ = materialize_counted(step.join(seen, ["test", "node"], "left_anti"), "tested")
        if not n:
            break
        seen = seen.unionByName(frontier)
    return seen.filter("node <> test").select(F.col("node").alias("target"), "test")


# ---- what tests reach, without limit: pairs grow as tests times nodes, so most are never rows before the result

#: Hubs of a round at most: one bit each of a mask.
HUBS = 63
#: Names in a block of tests or targets, and rows that two blocks make at most (about). Names of both fit a Parquet
#: dictionary, and all targets of a block meet the tests in one order, which compresses.
BLOCK, BLOCK_ROWS = 4096, 8_000_000
#: Rows of a frontier up to which it is broadcast, so that the edges aren't shuffled for it.
BROADCAST_ROWS = 100_000
#: Levels after which the masks found so far are written as one table, which keeps plans short.
LEVELS = 8


def _frontier(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def _numbered(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """name, id of all that calls or is called, and src, dst as ids. Ids are hashes under the first seed by which no
    two names have the same."""
    names = materialize(calls.select(F.col("src").alias("name")).unionByName(calls.select(F.col("dst").alias("name"))).distinct(), "names")
    for seed in count():
        ids = names.select("name", F.xxhash64(F.lit(seed), "name").alias("id"))
        if ids.groupBy("id").count().filter("count > 1").isEmpty():
            break
    return ids, materialize(calls.select(*[F.xxhash64(F.lit(seed), c).alias(c) for c in ("src", "dst")]).distinct(), "bfs_edges")


def _hubs(pairs: DataFrame, met: DataFrame, frontier: DataFrame) -> list[int]:
    """Nodes to try as hubs: of those that most tests have just reached the one that most tests have met, then those
    that most others have, as long as these are a quarter of the first's. So parts of a graph that share no
    tests have hubs each, and one part has few. Any choice gives the same result."""
    top = frontier.groupBy("node").count().join(pairs.select(F.col("src").alias("node")), "node", "left_semi")
    nodes = [r["node"] for r in top.orderBy(F.desc("count"), "node").limit(HUBS).collect()]
    if not nodes:
        return []
    bits = F.broadcast(met.sparkSession.createDataFrame([(x, 1 << i) for i, x in enumerate(nodes)], "node long, bit long"))
    by = met.join(bits, "node").groupBy("test").agg(F.bit_or("bit").alias("bits")).groupBy("bits").count()
    left = {r["bits"]: r["count"] for r in by.orderBy(F.desc("count")).limit(100_000).collect()}
    hubs: list[int] = []
    first = 0
    while True:
        n = [sum(k for m, k in left.items() if m >> i & 1) for i in range(len(nodes))]
        best = max(range(len(nodes)), key=n.__getitem__)
        first = first or n[best]
        if not n[best] or n[best] * 4 < first:
            return hubs
        hubs.append(nodes[best])
        left = {m: k for m, k in left.items() if not m >> best & 1}


def _marks(pairs: DataFrame, hubs: list[int]) -> DataFrame:
    """node, f, b: masks of the hubs that reach a node and of those it reaches, all hubs at once: a level passes on
    the bits that were new in the last."""
    front = materialize(pairs.sparkSession.createDataFrame([(h, 1 << i, 1 << i) for i, h in enumerate(hubs)], "node long, f long, b long"), "marks")
    marks, n, masks = front, len(hubs), [F.bit_or("f").alias("f"), F.bit_or("b").alias("b")]
    for level in count(1):
        front = _frontier(front, n)
        ahead = pairs.join(front.filter("f <> 0").select(F.col("node").alias("src"), "f"), "src").select(F.col("dst").alias("node"), "f", F.lit(0).cast("long").alias("b"))
        back = pairs.join(front.filter("b <> 0").select(F.col("node").alias("dst"), "b"), "dst").select(F.col("src").alias("node"), F.lit(0).cast("long").alias("f"), "b")
        known = marks.groupBy("node").agg(F.bit_or("f").alias("kf"), F.bit_or("b").alias("kb"))
        step = ahead.unionByName(back).groupBy("node").agg(*masks).join(known, "node", "left")
        step = step.select("node", *[F.expr(f"{c} & ~coalesce(k{c}, 0L)").alias(c) for c in ("f", "b")]).filter("f <> 0 OR b <> 0")
        front, n, _ = materialize_counted(step, "marks")
        if not n:
            return materialize(marks.groupBy("node").agg(*masks), "marks")
        marks = marks.unionByName(front)
        if level % LEVELS == 0:
            marks = materialize(marks.groupBy("node").agg(*masks), "marks")


def _worth(marks: DataFrame, starts: DataFrame, hubs: list[int], least: float) -> int:
    """Mask of the hubs to keep: the largest number of pairs (tests that reach it, times what it reaches) first, then
    those that add more than the least number to each hub kept before. What it adds to a hub that reaches it or that
    it reaches is known from the numbers of either."""
    def bits(c, i):
        return F.expr(f"shiftright({c}, {i}) & 1L")

    n = range(len(hubs))
    tests = marks.join(starts.select(F.col("test").alias("node")), "node", "left_semi").agg(*[F.sum(bits("b", i)) for i in n]).first()
    nodes = marks.agg(*[F.sum(bits("f", i)) for i in n]).first()
    from_ = {r["node"]: r["f"] for r in marks.filter(F.col("node").isin(hubs)).collect()}
    t, d = [x or 0 for x in tests], [x or 0 for x in nodes]
    kept: list[int] = []
    for i in sorted(n, key=lambda i: -t[i] * d[i]):
        adds = [t[i] * d[i]]
        for j in kept:
            if from_[hubs[i]] >> j & 1:  # j reaches i: all that i reaches, j reaches
                adds.append((t[i] - t[j]) * d[i])
            if from_[hubs[j]] >> i & 1:
                adds.append(t[i] * (d[i] - d[j]))
        if min(adds) > least:
            kept.append(i)
    return sum(1 << i for i in kept)


def _uncovered(pairs: DataFrame, covers: list[DataFrame]) -> DataFrame:
    """test, node without the pairs that a common hub covers."""
    for m in covers:
        pairs = pairs.join(m.filter("b <> 0").select(F.col("node").alias("test"), "b"), "test", "left").join(m.filter("f <> 0").select("node", "f"), "node", "left")
        pairs = pairs.filter("coalesce(b & f, 0L) = 0").select("test", "node")
    return pairs


def _blocks(named: DataFrame, size: int, name: str) -> DataFrame:
    """name, and the masks and part of its block: names of equal masks, about as many as size."""
    k = materialize(named.groupBy("masks").agg(F.ceil(F.count(F.lit(1)) / size).alias("k")), "blocks")
    return named.join(k, "masks").select(F.col("name").alias(name), F.col("masks").alias(f"{name}_masks"), F.pmod(F.xxhash64("name"), F.col("k")).alias(f"{name}_part"))


def _covered(ids: DataFrame, starts: DataFrame, covers: list[DataFrame]) -> DataFrame:
    """target, test of all pairs that a common hub covers, each once: blocks of names whose masks meet are units, and
    names join by unit."""
    spark = ids.sparkSession

    def named(c, of):
        for i, m in enumerate(covers):
            of = of.join(m.filter(f"{c} <> 0").select(F.col("node").alias("id"), F.col(c).alias(f"m{i}")), "id", "left")
        of = of.select("name", F.array(*[F.coalesce(f"m{i}", F.lit(0).cast("long")) for i in range(len(covers))]).alias("masks"))
        return materialize(of.filter("exists(masks, x -> x <> 0)"), "named")

    tests = named("b", ids.join(starts.select(F.col("test").alias("id")), "id", "left_semi"))
    size = BLOCK_ROWS // max(1, min(tests.count(), BLOCK))
    tests, targets = _blocks(tests, BLOCK, "test"), _blocks(named("f", ids), max(1, min(BLOCK, size)), "target")
    t, x = ["test_masks", "test_part"], ["target_masks", "target_part"]
    units = tests.select(t).distinct().crossJoin(targets.select(x).distinct())
    units = units.filter("exists(zip_with(test_masks, target_masks, (x, y) -> x & y), x -> x <> 0)").withColumn("unit", F.monotonically_increasing_id())
    units, n, _ = materialize_counted(units, "units")
    parts = max(1, min(n, 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    tests = tests.join(units.select(*t, "unit"), t).select("unit", "test").repartition(parts, "unit")
    targets = targets.join(units.select(*x, "unit"), x).select("unit", "target").repartition(parts, "unit")
    # a table of a unit's tests in memory, at most some BLOCK names of each unit of a partition
    return targets.join(tests.hint("shuffle_hash"), "unit").filter("target <> test").select("target", "test")


def tested_by_all(edges: DataFrame, tests: DataFrame, bound: int | None = None) -> DataFrame:
    """As tested_by() without depth. Whenever more than `bound` pairs were met since it began or last did so, the
    walk looks for hubs, the nodes that most tests have just reached: a test that reaches a hub reaches all that the
    hub does, so these pairs are two lists of names and not walked. What no hub covers is walked pair by pair to its
    end, so hubs decide the work and not the result."""
    calls = _calls(edges).filter("src <> dst")
    ids, pairs = _numbered(calls)
    if bound is None:
        bound = max(pairs.count() // 8, 100_000)
    starts = ids.join(tests.select(F.col("node").alias("name")).distinct(), "name", "left_semi").select(F.col("id").alias("test"))
    starts = materialize(starts.join(pairs.select(F.col("src").alias("test")), "test", "left_semi"), "tests")
    rest = frontier = starts.select("test", F.col("test").alias("node"))
    covers: list[DataFrame] = []
    n, met = rest.count(), 0
    while True:
        step = pairs.withColumnRenamed("src", "node").join(_frontier(frontier, n), "node").select("test", F.col("dst").alias("node")).distinct()
        frontier, n, _ = materialize_counted(_uncovered(step.join(rest, ["test", "node"], "left_anti"), covers), "tested")
        if not n:
            break
        rest, met = rest.unionByName(frontier), met + n
        if met > bound:
            met = 0
            hubs = _hubs(pairs, rest, frontier)
            marks = _marks(pairs, hubs) if hubs else None
            if hubs and (keep := _worth(marks, starts, hubs, bound / (HUBS + 1))):
                marks = materialize(marks.select("node", *[F.col(c).bitwiseAND(F.lit(keep)).alias(c) for c in ("f", "b")]).filter("f <> 0 OR b <> 0"), "marks")
                covers.append(marks)
                rest, frontier = (materialize(_uncovered(x, [marks]), "tested") for x in (rest, frontier))
    walked = rest.filter("node <> test")
    for c, name in (("node", "target"), ("test", "test")):
        walked = walked.join(ids.select(F.col("id").alias(c), F.col("name").alias(f"{name}_name")), c)
    walked = walked.select(F.col("target_name").alias("target"), F.col("test_name").alias("test"))
    return walked.unionByName(_covered(ids, starts, covers)) if covers else walked
