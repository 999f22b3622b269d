"""Processing only new or changed records.

A manifest names what was processed: the record's key, its size and its checksum,
by batch. A run lists the input, anti-joins the listing against the newest manifest
row of each key, writes what is left once under its batch identifier, derives the
output and the manifest's rows from that one written list, and commits both by
creating one file. A run that dies before the commit leaves nothing a later run
would see: the same batch identifier overwrites the same folders, so a repeated run
neither skips nor repeats a record, and what arrives during a run is left to the next.

Defined results: a null key, size or checksum is a value like any other; a key listed
several times with one checksum is processed as often as it is listed; a record that
goes back to an earlier state has changed; an empty listing commits an empty batch.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.session import ensure_checkpoint_dir, materialize

#: Batches after which the newest row of each key is written anew, so that reading the manifest costs keys, not runs.
COMPACT = 16


def pending(listing: DataFrame, manifest: DataFrame, on: list[str]) -> DataFrame:
    """Rows of the listing that the manifest doesn't hold. Columns are joined null-safe:
    a null key or checksum is a value like any other."""
    m = manifest.select(*[F.col(c).alias(f"__m_{c}") for c in on])
    cond = None
    for c in on:
        one = F.col(c).eqNullSafe(F.col(f"__m_{c}"))
        cond = one if cond is None else cond & one
    return listing.join(m, cond, "left_anti")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, size, checksum of every file below a folder: the listing of input that lies in files."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return raw.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("checksum"))


def newest(df: DataFrame, keys: list[str], order: list[Column], keep: dict[str, Column]) -> DataFrame:
    """One row per key, that of the greatest order; map-side combined, so a key with a
    third of all rows is one state per task. Rows equal in order are settled by the
    kept values themselves, so the result doesn't depend on arrival."""
    s = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], *[c.alias(k) for k, c in keep.items()])
    return df.groupBy(*keys).agg(F.max(s).alias("s")).select(*keys, *[F.col(f"s.{k}").alias(k) for k in keep])


class Manifest:
    """A manifest and its outputs in a shared folder.

    <root>/todo/batch=<id>/ holds what a batch found to do, as long as it runs; <root>/out/batch=<id>/
    what it made of it; <root>/manifest/batch=<id>/ the records it processed;
    <root>/commits/<number>.<id> says that they are whole. Only committed batches are read, in
    the order of their numbers. The commit creates one empty file, which either exists or not.
    <root>/newest/<number>/ is the newest row of each key up to that commit."""

    def __init__(self, spark: SparkSession, root: str, key: list[str]):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        """Names in a folder with one entry per run: a bounded list."""
        fs, p = self._fs(f"{self.root}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _delete(self, folder: str) -> None:
        fs, p = self._fs(f"{self.root}/{folder}")
        fs.delete(p, True)

    def committed(self) -> list[str]:
        """Identifiers of the batches in the order of their commits."""
        return [n.split(".", 1)[1] for n in self._names("commits")]

    def read(self, like: DataFrame) -> DataFrame:
        """key, size, checksum: the newest committed row of each key; empty before the first batch."""
        cols = [*self.key, "size", "checksum"]
        commits = self._names("commits")
        base = max((n for n in self._names("newest") if n.isdigit() and self._fs(f"{self.root}/newest/{n}/_SUCCESS")[0].exists(self._fs(f"{self.root}/newest/{n}/_SUCCESS")[1])), default="")
        parts = [self.spark.read.parquet(f"{self.root}/newest/{base}").select(*cols, F.lit(0).alias("__n"))] if base else []
        for i, n in enumerate(c for c in commits if not base or c.split(".", 1)[0] > base):
            parts.append(self.spark.read.parquet(f"{self.root}/manifest/batch={n.split('.', 1)[1]}").select(*cols, F.lit(i + 1).alias("__n")))
        if not parts:
            return like.select(*cols).limit(0)
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        if len(parts) == 1 and base:
            return rows.select(*cols)
        # rows of one batch and key are settled by their values, so the result doesn't depend on order
        return newest(rows, self.key, [F.col("__n")], {"checksum": F.col("checksum"), "size": F.col("size")}).select(*cols)

    def record(self, batch: str, processed: DataFrame) -> bool:
        """Takes over what was processed before or elsewhere (key, size, checksum) as a batch without output."""
        if batch in self.committed():
            return False
        processed.select(*self.key, "size", "checksum").write.mode("overwrite").parquet(f"{self.root}/manifest/batch={batch}")
        self._commit(batch)
        return True

    def run(self, batch: str, listing: DataFrame, process: Callable[[DataFrame], DataFrame]) -> bool:
        """listing: key columns, size, checksum and whatever process needs. False if
        this batch was committed before; then nothing is done. The listing is evaluated once."""
        if batch in self.committed():
            return False
        path = f"{self.root}/todo/batch={batch}"
        pending(listing, self.read(listing), [*self.key, "size", "checksum"]).write.mode("overwrite").parquet(path)
        todo = self.spark.read.schema(listing.schema).parquet(path)
        process(todo).write.mode("overwrite").parquet(f"{self.root}/out/batch={batch}")
        todo.select(*self.key, "size", "checksum").write.mode("overwrite").parquet(f"{self.root}/manifest/batch={batch}")
        self._commit(batch)
        self._delete(f"todo/batch={batch}")
        if len(self._names("commits")) % COMPACT == 0:
            self.compact(listing)
        return True

    def compact(self, like: DataFrame) -> None:
        """Writes the newest row of each key under the last commit's number; older ones of these go."""
        last = self._names("commits")[-1].split(".", 1)[0]
        old = self._names("newest")
        self.read(like).write.mode("overwrite").parquet(f"{self.root}/newest/{last}")
        for n in old:
            if n != last:
                self._delete(f"newest/{n}")

    def _commit(self, batch: str) -> None:
        number = max((int(n.split(".", 1)[0]) for n in self._names("commits")), default=0) + 1
        fs, p = self._fs(f"{self.root}/commits/{number:08d}.{batch}")
        if not fs.createNewFile(p):
            raise OSError(f"can't commit batch {batch}")

    def output(self, *batches: str) -> DataFrame | None:
        """What the given batches (or all) made, those that are committed."""
        done = [b for b in self.committed() if not batches or b in batches]
        return self.spark.read.parquet(*[f"{self.root}/out/batch={b}" for b in done if self._fs(f"{self.root}/out/batch={b}")[0].exists(self._fs(f"{self.root}/out/batch={b}")[1])]) if done else None


# ---- the project's logs as listing and manifest


def last_good_cut(index_runs: DataFrame) -> DataFrame:
    """repo_id, cut: the start of the last good run; repositories without one have no row."""
    return index_runs.filter(F.col("status") == "ok").groupBy("repo_id").agg(F.max("started_at").alias("cut"))


def _with_cut(df: DataFrame, index_runs: DataFrame, arrival: str) -> DataFrame:
    """Adds `processed`. The cuts are one row per repository; a repository with a third
    of all rows would make a heavy join key, so the side goes out whole where Spark
    finds it small enough and AQE splits the key where not."""
    cuts = last_good_cut(index_runs).withColumnRenamed("repo_id", "__repo")
    return df.join(cuts, F.col("repo_id") == F.col("__repo"), "left").withColumn("processed", F.coalesce(F.col(arrival) <= F.col("cut"), F.lit(False)))


def file_states(files: DataFrame, index_runs: DataFrame) -> DataFrame:
    """Of the FileRecords: the newest state of each path, and the newest state that a
    good run has processed. Checksum: content_hash in lower case with the extractor's
    version; rows without a hash are ignored, paths may be null (one key)."""
    rows = _with_cut(files.filter(F.col("content_hash").isNotNull()), index_runs, "seen_at")
    checksum = F.concat_ws("|", F.lower("content_hash"), F.coalesce(F.col("extractor_version").cast("string"), F.lit("-")))
    order = F.struct(F.col("last_modified").alias("a"), F.col("seen_at").alias("b"), checksum.alias("checksum"))
    both = rows.groupBy(F.col("path").alias("rec_key")).agg(F.max(order).alias("s"), F.max(F.when(F.col("processed"), order)).alias("p"))
    return _states(both, F.col("p").isNotNull())


def symbol_states(symbols: DataFrame, index_runs: DataFrame) -> DataFrame:
    """Of the symbol upserts: the last non-null body_hash of each qualified_name, and that
    of the processed rows. A symbol processed without any hash while none exists yet
    has nothing new; it is listed and manifested with a null checksum."""
    rows = _with_cut(symbols, index_runs, "indexed_at")
    has = F.col("body_hash").isNotNull()
    order = F.struct(F.col("indexed_at").alias("a"), F.col("body_hash").alias("checksum"))
    both = rows.groupBy(F.col("qualified_name").alias("rec_key")).agg(F.max(F.when(has, order)).alias("s"), F.max(F.when(has & F.col("processed"), order)).alias("p"), F.max("processed").alias("any"))
    return _states(both, F.col("any"))


def _states(both: DataFrame, seen: Column) -> DataFrame:
    return both.select("rec_key", F.col("s.checksum").alias("checksum"), seen.alias("seen"), F.col("p.checksum").alias("processed"))


def next_run(files: DataFrame, symbols: DataFrame, index_runs: DataFrame) -> tuple[Manifest, str]:
    """A manifest in the shared folder that holds what the good runs have processed, and the batch that has
    run after it over everything listed now. Its output: rel, rec_key, once each. The logs carry no sizes
    of their records; they are null in listing and manifest alike."""
    manifest = Manifest(files.sparkSession, f"{ensure_checkpoint_dir(files.sparkSession).rstrip('/')}/manifest-{uuid.uuid4().hex}", ["rel", "rec_key"])
    both = file_states(files, index_runs).withColumn("rel", F.lit("files")).unionByName(symbol_states(symbols, index_runs).withColumn("rel", F.lit("symbols")))
    states = materialize(both.withColumn("size", F.lit(None).cast("long")), "log_states")
    manifest.record("good-runs", states.filter("seen").select("rel", "rec_key", "size", F.col("processed").alias("checksum")))
    manifest.run("next", states.select("rel", "rec_key", "size", "checksum"), lambda todo: todo.select("rel", "rec_key"))
    return manifest, "next"


def due_records(files: DataFrame, symbols: DataFrame, index_runs: DataFrame) -> DataFrame:
    """rel, rec_key of everything the next run of each repository has to process, once each."""
    manifest, batch = next_run(files, symbols, index_runs)
    return manifest.output(batch).select("rel", "rec_key")
