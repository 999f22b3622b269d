"""The change stream: fixed ticks that report each path once, and micro-batches merged into a state.

A tick is a fixed interval, not a pause in the activity, so ticks are tumbling windows."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symgraph.session import ensure_checkpoint_dir, materialize

# fixed values: kinds of file events that count
KINDS = ["Modify", "Create", "Remove"]


def debounce(events: DataFrame, at: str, path: str, tick: str = "2 seconds") -> DataFrame:
    """tick (its start), path, n: each path once per tick, with its number of events. Batch or stream."""
    return events.groupBy(F.window(at, tick).alias("w"), F.col(path)).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("tick"), path, "n")


def change_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 256) -> DataFrame:
    """Events (path, kind, at) as files arrive; the files taken per trigger are the back-pressure."""
    from symgraph.functions.text import excluded

    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return raw.filter(F.col("kind").isin(*KINDS) & ~excluded("path"))


class State:
    """A keyed state in a folder, in parts by a hash of the key. A batch writes anew only the parts it touches, each
    under its own number, and then one file that names the part versions which are valid after it. A
    batch that is run again writes the same versions again, so replays change nothing; a restart reads the
    newest of these files. The list of parts is bounded by `parts`."""

    def __init__(self, spark: SparkSession, root: str, key: str, order: list[str], parts: int = 64):
        self.spark, self.root, self.key, self.order, self.parts = spark, root.rstrip("/"), key, order, parts

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def valid(self, before: int | None = None) -> dict[int, int]:
        """part to batch, after the newest batch (before a given one)."""
        fs, p = self._fs(f"{self.root}/valid")
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        done = [n for n in names if n.endswith(".json") and (before is None or int(n[:-5]) < before)]
        if not done:
            return {}
        return {int(k): v for k, v in json.loads(self.spark.read.text(f"{self.root}/valid/{done[-1]}", wholetext=True).first()[0]).items()}

    def _read(self, valid: dict[int, int]) -> DataFrame:
        paths = [f"{self.root}/batch={b}/part={p}" for p, b in valid.items()]
        return self.spark.read.option("basePath", self.root).parquet(*paths).drop("batch", "part")

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        rest = [c for c in batch.columns if c != self.key]
        part = F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")
        own = batch.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("s")).select(self.key, *[F.col(f"s.{c}").alias(c) for c in rest])
        own = materialize(own, "batch_newest")
        touched = [r[0] for r in own.select(part.alias("p")).distinct().collect()]
        if not touched:
            return
        valid = self.valid(batch_id)
        rows = own
        if have := {p: b for p, b in valid.items() if p in touched}:
            rows = rows.unionByName(self._read(have))
        newest = rows.groupBy(self.key).agg(F.max_by(F.struct(*rest), F.struct(*self.order)).alias("s")).select(self.key, *[F.col(f"s.{c}").alias(c) for c in rest], part.alias("part"))
        newest.repartition(min(len(touched), self.parts), "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/batch={batch_id}")
        fs, tmp = self._fs(f"{self.root}/valid/.{batch_id}.tmp")
        out = fs.create(tmp, True)
        out.write(bytearray(json.dumps(valid | dict.fromkeys(touched, batch_id)).encode()))
        out.close()
        to = self._fs(f"{self.root}/valid/{batch_id:012d}.json")[1]
        fs.delete(to, False)
        if not fs.rename(tmp, to):
            raise OSError(f"can't commit batch {batch_id}")

    def read(self) -> DataFrame | None:
        """The state after the newest batch; None before the first."""
        valid = self.valid()
        return self._read(valid) if valid else None


def last_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, last_event_type: the events table replayed as a stream, merged batch by batch, until
    everything there has been read."""
    root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    source = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(source).schema
    # a file source wants a folder: one named by pattern if the table is a single file
    folder = source if os.path.isdir(source.removeprefix("file:")) else f"{sf_dir}/events.parque[t]"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder).select("user_id", "ts", "event_id", "event_type")
    state = State(spark, f"{root}/state", "user_id", ["ts", "event_id"])
    q = stream.writeStream.foreachBatch(state.merge).option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start()
    q.awaitTermination()
    merged = state.read()
    return (spark.createDataFrame([], "user_id bigint, event_type string") if merged is None else merged).select("user_id", F.col("event_type").alias("last_event_type"))


def apply_changes(spark: SparkSession, changes: DataFrame, read_text, index, forget) -> None:
    """One micro-batch of debounced paths: unsupported ones are skipped, those with text are indexed, those
    without are forgotten. read_text(paths) -> (path, text or null); index and forget take DataFrames."""
    from symgraph.functions.text import language_of

    paths = changes.select("path").distinct().filter(language_of("path").isNotNull())
    seen = read_text(paths)
    index(seen.filter("text IS NOT NULL"))
    forget(seen.filter("text IS NULL").select("path"))
