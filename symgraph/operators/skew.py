"""Per-key results when a few keys hold most rows.

The rows are range partitioned on (key, secondary, tie) with sampled quantiles, so
a heavy key spreads over as many partitions as its share asks for and no partition
holds much more than any other. Each partition scans its sorted rows once and
leaves one partial state for each key in it: the number of rows, the number of
different secondary values, and the first and last of them. States of one key from
neighbouring partitions are stitched: a secondary value that ends one partition
and begins the next is counted once. A key has at most one state per partition, so
stitching moves few rows whatever the skew.

Defined results: a null key part is a key of its own; null secondary values count
as rows, not as different values; repeated rows count each time; an empty table
gives no keys. Columns of the input other than those named play no part, so
clashing names are harmless.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symgraph.session import parts


def _changed(col: pa.Array) -> pa.Array:
    """For each row but the first, whether it differs from the one before; nulls equal nulls."""
    a, b = col.slice(1), col.slice(0, len(col) - 1)
    ne = pc.fill_null(pc.not_equal(a, b), False)
    return pc.or_(ne, pc.xor(pc.is_null(a), pc.is_null(b)))


def _states(keys: list[str]):
    """Arrow batches of one sorted partition to one state per run of a key.

    A run that goes on in the next batch is carried, so a state is whole within
    the partition and memory holds one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried: dict | None = None
        pid = None
        schema = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if pid is None:
                pid = batch.column("__pid")[0].as_py()
                schema = pa.schema([(k, batch.schema.field(k).type) for k in keys] + [("pid", pa.int64()), ("n_rows", pa.int64()), ("n_values", pa.int64()), ("first_value", pa.string()), ("last_value", pa.string())])
            key_change = pa.array([True]) if n == 1 else pa.concat_arrays([pa.array([True]), _any([_changed(batch.column(k)) for k in keys])])
            value = batch.column("__value")
            value_change = pa.array([True]) if n == 1 else pa.concat_arrays([pa.array([True]), pc.or_(key_change.slice(1), _changed(value))])
            new_value = pc.and_(value_change, pc.is_valid(value))
            starts = pc.indices_nonzero(key_change).to_numpy().tolist()
            counts = new_value.to_numpy(zero_copy_only=False).astype("int64").cumsum()
            out: list[dict] = []
            for i, s in enumerate(starts):
                e = starts[i + 1] if i + 1 < len(starts) else n
                state = {k: batch.column(k)[s].as_py() for k in keys}
                state |= {"pid": pid, "n_rows": e - s, "n_values": int(counts[e - 1] - (counts[s - 1] if s else 0)), "first_value": value[s].as_py(), "last_value": value[e - 1].as_py()}
                if carried is not None:
                    if i == 0 and all(carried[k] == state[k] for k in keys):
                        state = _stitch(carried, state)
                    else:
                        out.append(carried)
                carried = state
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
        if carried is not None:
            yield pa.RecordBatch.from_pylist([carried], schema=schema)

    return run


def _any(masks: list[pa.Array]) -> pa.Array:
    out = masks[0]
    for m in masks[1:]:
        out = pc.or_(out, m)
    return out


def _stitch(a: dict, b: dict) -> dict:
    """Two states of one key, b right after a. Nulls sort first, so a null first
    value of b says nothing about the values before the end of a."""
    same = a["last_value"] is not None and a["last_value"] == b["first_value"]
    return b | {"n_rows": a["n_rows"] + b["n_rows"], "n_values": a["n_values"] + b["n_values"] - same, "first_value": a["first_value"]}


def partial_states(df: DataFrame, keys: list[str], value: str, tie: str | None = None, partitions: int | None = None) -> DataFrame:
    """One row per key and range partition that holds some of the key's rows.

    value: the secondary order, whose different values are counted. tie: a column
    that makes the order total, so that even one (key, value) pair may be split."""
    order = [*keys, "__value"] + (["__tie"] if tie else [])
    cols = [*keys, F.col(value).cast("string").alias("__value")] + ([F.col(tie).alias("__tie")] if tie else [])
    narrow = df.select(*cols)
    n = partitions or parts(narrow)
    ranged = narrow.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the partition's number goes in before Python, where it isn't known
    ranged = ranged.select(*keys, "__value", F.spark_partition_id().alias("__pid"))
    fields = {f.name: f for f in df.schema.fields}
    schema = T.StructType([fields[k] for k in keys] + [T.StructField("pid", T.LongType()), T.StructField("n_rows", T.LongType()), T.StructField("n_values", T.LongType()), T.StructField("first_value", T.StringType()), T.StructField("last_value", T.StringType())])
    return ranged.mapInArrow(_states(keys), schema)


def skew_aggregate(df: DataFrame, keys: list[str], value: str, tie: str | None = None, partitions: int | None = None) -> DataFrame:
    """keys, n_rows, n_values (exact number of different values), n_parts."""
    states = partial_states(df, keys, value, tie, partitions)
    w = Window.partitionBy(*keys).orderBy("pid")
    joint = F.coalesce(F.lag("last_value").over(w) == F.col("first_value"), F.lit(False))
    return (
        states.withColumn("joint", joint.cast("long"))
        .groupBy(*keys)
        .agg(F.sum("n_rows").alias("n_rows"), (F.sum("n_values") - F.sum("joint")).alias("n_values"), F.count(F.lit(1)).alias("n_parts"))
    )


def heavy_keys(per_key: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Keys that hold at least `share` of all rows; per_key has n_rows. The total is
    one number, summed over the per-key rows."""
    total = per_key.agg(F.sum("n_rows")).scalar()
    return per_key.filter(F.col("n_rows") >= total * F.lit(share)).select(*keys, "n_rows")
