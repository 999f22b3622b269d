"""Session helpers: a tuned local session, the shared checkpoint folder, sizes."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", memory: str = "12g", partitions: int = 8) -> SparkSession:
    """A session for tests and benches; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("symgraph")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster
    names one; a temporary folder only where it is unset and everything runs on
    this machine (local tests)."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    folder = named or tempfile.mkdtemp(prefix="symgraph-checkpoint-")
    sc.setCheckpointDir(folder)
    return folder


#: Bytes of a scan that one partition of an explicit repartitioning should hold.
PARTITION_BYTES = 64 << 20


def parts(df: DataFrame) -> int:
    """Partitions for an explicit repartitioning of df: as the session says, and more where the optimizer
    expects more bytes than these should hold."""
    expected = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    fit = -(-expected // PARTITION_BYTES) if expected < 1 << 60 else 1  # unknown sizes count as huge
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), fit)


_written: list[str] = []


def drop_intermediates(spark: SparkSession) -> None:
    """Deletes what materialize() has written in this session. For when results have been written: what reads
    the intermediates can't be asked again."""
    jvm = spark._jvm
    while _written:
        p = jvm.org.apache.hadoop.fs.Path(_written.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate once into the shared checkpoint folder and read it back, so
    that several uses and lost executors don't compute it again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, name: str, where: Column | None = None) -> tuple[DataFrame, int, int]:
    """As materialize(), with the number of rows and of those that meet a condition, which are counted while
    they are written."""
    seen = Observation()
    n = F.count(F.lit(1)).alias("n")
    out = materialize(df.observe(seen, n, (F.count(F.lit(1)) if where is None else F.count_if(where)).alias("m")), name)
    return out, seen.get["n"], seen.get["m"]


def spread(df: DataFrame, key: str) -> DataFrame:
    """Before long work in Python: over all cores, where a scan has fewer partitions than there are cores
    (one small file); a scan with enough of them stays as it is and nothing is shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
