"""Long exact spans shared between records.

Every window of `span` characters (code points) has a minimiser: the least hash of
the `k`-mers in it. Consecutive windows of a text with the same minimiser make a
super-k-mer: one packed string of window + run - 1 characters that stands for all
of them. Equal windows have equal minimisers, so they meet in the minimiser's
bucket, where their hashes are sorted and counted.

1. super_kmers: per text (minimiser, start, number of windows), no text yet.
2. Minimisers met in one document only are dropped (a map-side combined count);
   only what is left is cut out of the texts, as packed strings.
3. Equal strings of a bucket are one class: a string travels once per map task,
   however many documents hold it; who holds it is kept apart, as (class, document).
4. Each bucket sorts the windows of its classes. Windows in several classes give
   sets of classes; equal sets are one. Of a bucket with very many classes the windows'
   hashes are sent instead of the strings, and counted by aggregates that are combined
   map side, so that neither the bucket nor a window that all of it shares is in one task.
5. Sets become sets of documents. Sets with the same documents are merged by a
   signature before any pair is made; pairs are made in blocks of bounded size.

Windows, classes and sets are told apart by hashes of 128 bits.

Defined results: null and short texts share nothing; the characters count as
stored, so case, spaces and line ends matter; several equal spans of two documents
give one pair; a passage that a document only repeats within itself is not shared;
repeated rows of one doc_id are that one document. Other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symgraph.session import materialize, spread

SPAN = 200
KMER = 96
#: Characters worked on at once in a worker.
BLOCK = 1 << 20
#: Classes of one minimiser in one task; a bucket with more is counted by its windows' hashes.
BUCKET = 50_000
#: Documents of a set paired in one block.
PAIR_BLOCK = 2048

_B1 = 0x9E3779B97F4A7C15
_B2 = 0xC2B2AE3D27D4EB4F
_MASK = (1 << 64) - 1


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def rolling(codes: np.ndarray, length: int, base: int) -> np.ndarray:
    """Hash of codes[i : i + length] for each i, by doubling: log2(length) vector steps."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    power, size = codes.astype(np.uint64) * np.uint64(base) + np.uint64(1), 1
    done, have = None, 0
    while True:
        if length & size:
            part = power[have : have + n]
            done = part if done is None else done * np.uint64(pow(base, size, 1 << 64)) + part
            have += size
        if have == length:
            return done
        power = power[:-size] * np.uint64(pow(base, size, 1 << 64)) + power[size:]
        size *= 2


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    n, size = len(h) - width + 1, 1
    while size * 2 <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[:n], h[width - size : width - size + n])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _runs(codes: np.ndarray, ends: np.ndarray, span: int, k: int) -> tuple[np.ndarray, ...]:
    """(minimiser, text, start in codes, windows) of each super-k-mer. ends: of the texts in codes."""
    if len(codes) < span:
        return (np.empty(0, np.int64),) * 4
    least = sliding_min(_mix(rolling(codes, k, _B1)), span - k + 1)
    owner = np.searchsorted(ends, np.arange(len(least)), side="right")
    inside = np.arange(len(least)) + span <= ends[owner]
    first = np.ones(len(least), bool)
    first[1:] = (least[1:] != least[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first & inside)
    # a run ends where the next begins, or where its text has no more windows
    stop = np.minimum(np.append(np.flatnonzero(first), len(least))[np.searchsorted(np.flatnonzero(first), at, side="right")], ends[owner[at]] - span + 1)
    return least[at].view(np.int64), owner[at], at, stop - at


def super_kmers(docs: DataFrame, key: str, text: str, span: int, k: int) -> DataFrame:
    """mz, key, start, n_windows."""
    kind = docs.schema[key].dataType.simpleString()

    def blocks(batch: pa.RecordBatch) -> Iterator[list[tuple[int, int, np.ndarray]]]:
        """Lists of (row, offset, codes); long texts in blocks that overlap by span - 1."""
        group: list[tuple[int, int, np.ndarray]] = []
        size = 0
        for row in range(batch.num_rows):
            s = batch.column(1)[row].as_py()
            if s is None or len(s) < span:
                continue
            codes = _codes(s)
            for offset in range(0, len(codes) - span + 1, BLOCK):
                piece = codes[offset : offset + BLOCK + span - 1]
                group.append((row, offset, piece))
                size += len(piece)
                if size >= BLOCK:
                    yield group
                    group, size = [], 0
        if group:
            yield group

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in blocks(batch):
                ends = np.cumsum([len(c) for _, _, c in group])
                mz, owner, at, n = _runs(np.concatenate([c for _, _, c in group]), ends, span, k)
                rows = np.array([r for r, _, _ in group])[owner]
                shift = np.array([o for _, o, _ in group]) - np.append(0, ends[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(mz), batch.column(0).take(pa.array(rows)), pa.array((at + shift[owner]).astype(np.int32)), pa.array(n.astype(np.int32))], names=["mz", key, "start", "n"])

    return spread(docs.select(key, text), key).mapInArrow(run, f"mz bigint, `{key}` {kind}, start int, n int")


def packed_strings(docs: DataFrame, runs: DataFrame, key: str, text: str, span: int) -> DataFrame:
    """mz, h, key, start, n, s: the runs cut out of their texts. h tells strings of a bucket apart."""
    kind = docs.schema[key].dataType.simpleString()
    per_doc = runs.groupBy(key).agg(F.collect_list(F.struct("mz", "start", "n")).alias("runs"))
    joined = docs.select(key, text).join(per_doc, key).select(key, text, F.col("runs.mz").alias("mz"), F.col("runs.start").alias("start"), F.col("runs.n").alias("n"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, mzs, hs, starts, ns, out, size = [], [], [], [], [], [], 0
            for row in range(batch.num_rows):
                s = batch.column(1)[row].as_py()
                for mz, start, n in zip(*(batch.column(c)[row].as_py() for c in (2, 3, 4)), strict=True):
                    piece = s[start : start + n + span - 1]
                    rows.append(row), mzs.append(mz), starts.append(start), ns.append(n), out.append(piece)
                    hs.append(int.from_bytes(blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True))
                    size += len(piece)
                if size > 4 * BLOCK or row + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(mzs, pa.int64()), pa.array(hs, pa.int64()), batch.column(0).take(pa.array(rows, pa.int64())), pa.array(starts, pa.int32()), pa.array(ns, pa.int32()), pa.array(out, pa.string())], names=["mz", "h", key, "start", "n", "s"])
                    rows, mzs, hs, starts, ns, out, size = [], [], [], [], [], [], 0

    return joined.mapInArrow(cut, f"mz bigint, h bigint, `{key}` {kind}, start int, n int, s string")


#: Shared windows: rows (set_a, set_b, mz, h) name the classes that share one, rows (mz, h, lo, hi) the shared
#: stretches of each class's string.
COUNTED = "set_a bigint, set_b bigint, mz bigint, h bigint, lo int, hi int"
_NAMES = ["set_a", "set_b", "mz", "h", "lo", "hi"]
_KINDS = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32())


def _window_hashes(strings: list[str], span: int) -> tuple[np.ndarray, ...]:
    """(index of the string, start in it, two hashes) of all windows."""
    codes = [_codes(s) for s in strings]
    lengths = np.array([len(c) for c in codes])
    ends = np.cumsum(lengths)
    every = np.concatenate(codes)
    h1, h2 = rolling(every, span, _B1), rolling(every, span, _B2)
    owner = np.searchsorted(ends, np.arange(len(h1)), side="right")
    at = np.flatnonzero(np.arange(len(h1)) + span <= ends[owner])
    return owner[at], at - (ends - lengths)[owner[at]], h1[at], h2[at]


def _shared(chunk: list[tuple], span: int) -> pa.RecordBatch:
    """Counts the windows of whole buckets. chunk: (mz, h, lo, hi, s); lo, hi: the least and the greatest
    document of the class."""
    cls, pos, h1, h2 = _window_hashes([c[4] for c in chunk], span)
    order = np.lexsort((cls, h2, h1))
    cls, pos, h1, h2 = cls[order], pos[order], h1[order], h2[order]
    group = np.empty(0, np.int64)
    if len(cls):
        new = np.append(True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]))
        group, start = np.cumsum(new) - 1, np.flatnonzero(new)
        lo, hi = np.array([c[2] for c in chunk]), np.array([c[3] for c in chunk])
        # shared if two different documents have the window
        keep = (np.minimum.reduceat(lo[cls], start) < np.maximum.reduceat(hi[cls], start))[group]
        cls, pos, group = cls[keep], pos[keep], group[keep]
    if not len(cls):
        return pa.RecordBatch.from_arrays([pa.array([], k) for k in _KINDS], names=_NAMES)
    keys = np.array([(c[0], c[1]) for c in chunk], np.int64).reshape(-1, 2)
    # each class once in each window's set
    once = np.append(True, (cls[1:] != cls[:-1]) | (group[1:] != group[:-1]))
    c1, g1 = cls[once], group[once]
    start = np.flatnonzero(np.append(True, g1[1:] != g1[:-1]))
    size = np.diff(np.append(start, len(c1)))
    ident = keys[:, 0].view(np.uint64) * np.uint64(_B1) ^ _mix(keys[:, 1].view(np.uint64))
    sign = lambda base: _mix(np.add.reduceat(_mix(ident * np.uint64(base) + np.uint64(base >> 7))[c1], start) + size.astype(np.uint64))
    ids = np.stack([sign(_B1), sign(_B2)], 1)
    _, pick = np.unique(ids, axis=0, return_index=True)
    member = np.concatenate([np.arange(start[p], start[p] + size[p]) for p in pick])
    of = np.repeat(pick, size[pick])
    n = len(member)
    # runs of shared windows in each class, for coverage
    order = np.lexsort((pos, cls))
    w, p = cls[order], pos[order]
    at = np.flatnonzero(np.append(True, (w[1:] != w[:-1]) | (p[1:] != p[:-1] + 1)))
    owner, end = w[at], p[np.append(at[1:], len(w)) - 1]
    none, is_run = np.zeros(len(at), np.int64), np.append(np.zeros(n, bool), np.ones(len(at), bool))
    columns = [np.append(ids[of, 0].view(np.int64), none), np.append(ids[of, 1].view(np.int64), none), np.append(keys[c1[member], 0], keys[owner, 0]), np.append(keys[c1[member], 1], keys[owner, 1]), np.append(np.zeros(n), p[at]).astype(np.int32), np.append(np.zeros(n), end + span).astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c, k, mask=m) for c, k, m in zip(columns, _KINDS, (is_run, is_run, None, None, ~is_run, ~is_run), strict=True)], names=_NAMES)


def _count_by_hash(classes: DataFrame, span: int) -> DataFrame:
    """As _shared, for classes (mz, h, lo, hi, s) of buckets too large for a task: each window's hash is a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                cls, pos, h1, h2 = _window_hashes(part.column(4).to_pylist(), span)
                take = pa.array(cls)
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(take) for c in range(4)), pa.array(pos.astype(np.int32)), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["mz", "h", "lo", "hi", "pos", "w1", "w2"])

    windows = materialize(classes.select("mz", "h", "lo", "hi", "s").mapInArrow(run, "mz bigint, h bigint, lo bigint, hi bigint, pos int, w1 bigint, w2 bigint"), "heavy_windows")
    # a class that holds a window twice has it once in the window's set
    once = windows.groupBy("mz", "w1", "w2", "h").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    total = lambda seed: F.xxhash64(F.sum(F.xxhash64("h", F.lit(seed)).cast("decimal(38,0)")), F.expr(f"bit_xor(xxhash64(h, {seed}, 1))"), F.count(F.lit(1)), "mz")
    per = once.groupBy("mz", "w1", "w2").agg(F.min("lo").alias("a"), F.max("hi").alias("b"), total(3).alias("set_a"), total(5).alias("set_b")).filter("a <> b").drop("a", "b")
    per = materialize(per, "shared_hashes")
    first = per.groupBy("mz", "set_a", "set_b").agg(F.min(F.struct("w1", "w2")).alias("w")).select("mz", "set_a", "set_b", "w.w1", "w.w2")
    null = lambda kind: F.lit(None).cast(kind)
    sets = windows.select("mz", "w1", "w2", "h").join(first, ["mz", "w1", "w2"]).select("set_a", "set_b", "mz", "h", null("int").alias("lo"), null("int").alias("hi")).distinct()
    # a string has few windows, however many share them
    shared = windows.join(per.select("mz", "w1", "w2"), ["mz", "w1", "w2"], "left_semi").select("mz", "h", "pos").distinct()
    island = F.col("pos") - F.row_number().over(Window.partitionBy("mz", "h").orderBy("pos"))
    runs = shared.withColumn("island", island).groupBy("mz", "h", "island").agg(F.min("pos").alias("lo"), (F.max("pos") + span).cast("int").alias("hi"))
    return sets.unionByName(runs.select(null("bigint").alias("set_a"), null("bigint").alias("set_b"), "mz", "h", "lo", "hi"))


def count_windows(strings: DataFrame, key: str, span: int) -> DataFrame:
    """The shared windows of all buckets; columns as in COUNTED."""
    classes = strings.groupBy("mz", "h").agg(F.first("s").alias("s"), F.min(F.xxhash64(key)).alias("lo"), F.max(F.xxhash64(key)).alias("hi"))
    # at most (strings / BUCKET) heavy buckets, each one number; Spark broadcasts them only if they are small
    heavy = materialize(strings.groupBy("mz").agg(F.approx_count_distinct("h", 0.05).alias("classes")).filter(F.col("classes") > BUCKET).select("mz"), "heavy_buckets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = [], 0
        for batch in batches:
            for c in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if size > BLOCK and c[0] != chunk[-1][0]:
                    yield _shared(chunk, span)
                    chunk, size = [], 0
                chunk.append(c)
                size += len(c[4])
        if chunk:
            yield _shared(chunk, span)

    if heavy.isEmpty():
        light, rest = classes, None
    else:
        light, rest = classes.join(heavy, "mz", "left_anti"), _count_by_hash(classes.join(heavy, "mz", "left_semi"), span)
    counted = light.select("mz", "h", "lo", "hi", "s").repartition("mz").sortWithinPartitions("mz", "h").mapInArrow(run, COUNTED)
    return counted if rest is None else counted.unionByName(rest)


def shared_windows(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, k: int = KMER) -> tuple[DataFrame, DataFrame]:
    """(counted windows, members): members has mz, h, key, start, n of each packed string."""
    runs = materialize(super_kmers(docs.filter(F.length(text) >= span), key, text, span, k), "super_kmers")
    met = runs.groupBy("mz").agg(F.min(key).alias("a"), F.max(key).alias("b")).filter("a <> b").select("mz")
    several = runs.join(met, "mz", "left_semi")
    strings = materialize(packed_strings(docs, several, key, text, span), "packed_strings")
    return materialize(count_windows(strings, key, span), "shared_windows"), strings.drop("s")


def shared_sets(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, k: int = KMER) -> DataFrame:
    """set_a, set_b, doc, n: the different sets of at least two documents that share a window, one row per document
    in each; n is the set's size. All links between documents follow from them without any pair."""
    counted, members = shared_windows(docs, key, text, span, k)
    ids = ["set_a", "set_b"]
    held = counted.filter("set_a IS NOT NULL").select(*ids, "mz", "h").join(members.select("mz", "h", F.col(key).alias("doc")).distinct(), ["mz", "h"]).select(*ids, "doc").distinct()
    signed = held.groupBy(*ids).agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc").cast("decimal(38,0)")).alias("s1"), F.expr("bit_xor(xxhash64(doc, 7))").alias("s2"))
    kept = signed.filter("n > 1").groupBy("n", "s1", "s2").agg(F.min(F.struct(*ids)).alias("s")).select("s.*", "n")
    return held.join(kept, ids)


def shared_pairs(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, k: int = KMER) -> DataFrame:
    """doc_a < doc_b of every two documents with an equal run of at least `span` characters."""
    sets = shared_sets(docs, key, text, span, k).withColumn("blocks", F.ceil(F.col("n") / PAIR_BLOCK).cast("int"))
    a = sets.select("set_a", "set_b", F.pmod(F.hash("doc"), F.col("blocks")).alias("block"), F.col("doc").alias("doc_a"))
    b = sets.select("set_a", "set_b", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("doc").alias("doc_b"))
    return a.join(b, ["set_a", "set_b", "block"]).filter("doc_a < doc_b").select("doc_a", "doc_b").distinct()


def shared_share(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN, k: int = KMER) -> DataFrame:
    """key, n_chars, shared_chars, n_spans: how much of each text stands in other documents too."""
    counted, members = shared_windows(docs, key, text, span, k)
    pieces = counted.filter("set_a IS NULL").select("mz", "h", "lo", "hi").join(members, ["mz", "h"]).select(key, (F.col("start") + F.col("lo")).alias("lo"), (F.col("start") + F.col("hi")).alias("hi")).distinct()
    # gaps and islands: a piece begins a new span if it begins after all pieces before it end
    w = Window.partitionBy(key).orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    spans = pieces.withColumn("new", F.coalesce((F.col("lo") > before).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(w)).groupBy(key, "island").agg((F.max("hi") - F.min("lo")).alias("len"))
    per_doc = spans.groupBy(key).agg(F.sum("len").alias("shared_chars"), F.count(F.lit(1)).alias("n_spans")).withColumnRenamed(key, "__key")
    return docs.select(key, F.length(text).alias("n_chars")).join(per_doc, F.col(key) == F.col("__key"), "left").select(key, F.col("n_chars").cast("long"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))
