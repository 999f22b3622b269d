"""Filling containers of one fixed capacity with items of varying length.

Hierarchical packing over context sizes C, C/2, C/4 and so on: an item belongs to the tier
of the smallest context window that holds it, tier i for (C / 2^(i+1), C / 2^i], the last for
all shorter ones. Tiers are packed one after the other, the longest first. A container of
tier i has room for 2^i windows of C / 2^i and takes as many items of its tier, longest
first; the gaps of its windows together are then filled from the shorter tiers, by the
longest that fits, and only where these have nothing left by further items of its own tier.
An item over the capacity is the only one split: its full pieces are containers of their
own, its rest is an item like any other. Containers are dealt to step groups so that groups
carry about the same cost (the sum of squared piece lengths, which is what attention within
pieces costs).

The corpus is packed in shards of about `SHARD_TOKENS` and at most about `SHARD_ITEMS` items,
by a hash of the id and of the row: a shard is a bounded number of items however the corpus
grows and however often an id repeats, and wastes less than one container per tier more
than packing everything at once would.

Defined results: null and empty texts are items of length 0; they take no room and
lie at the start of their shard's first container. Repeated rows are items of
their own. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symgraph.session import materialize

CAPACITY = 4096
TIERS = 5
#: Containers in one step group.
STEP = 8
SHARD_TOKENS = 16_000_000
SHARD_ITEMS = 1_000_000


class _Sizes:
    """How many items of each length are left, with the greatest length at most x in
    nearly constant time: lengths that run out point to the next shorter one."""

    def __init__(self, sizes: np.ndarray, capacity: int):
        self.left = np.bincount(sizes, minlength=capacity + 1).tolist()
        self.left[0] = 0
        self.down = list(range(capacity + 1))
        for s in range(1, capacity + 1):
            if not self.left[s]:
                self.down[s] = s - 1

    def at_most(self, x: int) -> int:
        down = self.down
        while down[x] != x:
            down[x] = down[down[x]]
            x = down[x]
        return x

    def take(self, s: int) -> None:
        self.left[s] -= 1
        if not self.left[s]:
            self.down[s] = s - 1


def fill(sizes: np.ndarray, capacity: int, tiers: int = TIERS) -> tuple[list[list[int]], list[int]]:
    """Lengths of each container in the order of packing, and the tier it was opened for; all sizes are 1
    to capacity."""
    have, out, opened = _Sizes(sizes, capacity), [], []
    for tier in range(tiers):
        window = capacity >> tier
        shorter = capacity >> (tier + 1) if tier + 1 < tiers else 0
        while have.at_most(window) > shorter:
            gap, one = capacity, []

            def put(s: int) -> int:
                one.append(s)  # noqa: B023
                have.take(s)
                return s

            for _ in range(1 << tier):
                if (s := have.at_most(min(gap, window))) <= shorter:
                    break
                gap -= put(s)
            while s := have.at_most(min(gap, shorter)) or have.at_most(gap):
                gap -= put(s)
            out.append(one)
            opened.append(tier)
    return out, opened


def tier_of(n: np.ndarray, capacity: int, tiers: int) -> np.ndarray:
    """The tier of the smallest context window that holds so many tokens."""
    return sum((n <= capacity >> i for i in range(1, tiers)), np.zeros(len(n), int))


def pack_shard(pdf: pd.DataFrame, capacity: int, tiers: int, step: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable").reset_index(drop=True)
    n = pdf.n_tokens.to_numpy(np.int64)
    full = n // capacity
    rest = n - full * capacity
    rest_at = np.flatnonzero((rest > 0) | (n == 0))
    rest_at = rest_at[np.argsort(-rest[rest_at], kind="stable")]
    sizes = rest[rest_at]
    pos = rest_at[sizes > 0]
    containers, opened = fill(sizes[sizes > 0], capacity, tiers)
    # items of one length are interchangeable: hand them out in the order of their ids
    flat = np.array([s for one in containers for s in one], np.int64)
    which = np.repeat(np.arange(len(containers)), [len(o) for o in containers]) if containers else np.empty(0, np.int64)
    offset = np.concatenate([np.cumsum([0, *o[:-1]]) for o in containers]) if containers else np.empty(0, np.int64)
    by_size = np.argsort(-flat, kind="stable")
    item = np.empty(len(flat), np.int64)
    item[by_size] = pos
    row = np.concatenate([item, np.repeat(np.arange(len(n)), full), np.flatnonzero(n == 0)])
    k = len(containers)
    whole = int(full.sum())
    whole_piece = np.arange(whole) - np.repeat(np.cumsum(full) - full, full)
    zero = int((n == 0).sum())
    out = pd.DataFrame({
        "doc_id": pdf.doc_id.to_numpy()[row],
        "piece": np.concatenate([full[item], whole_piece, np.zeros(zero, np.int64)]).astype(np.int32),
        "start_token": np.concatenate([full[item] * capacity, whole_piece * capacity, np.zeros(zero, np.int64)]),
        "n_tokens": np.concatenate([flat, np.full(whole, capacity), np.zeros(zero, np.int64)]),
        "container": np.concatenate([which, k + np.arange(whole), np.zeros(zero, np.int64)]),
        "at": np.concatenate([offset, np.zeros(whole + zero, np.int64)]),
    })
    out["tier"] = tier_of(out.n_tokens.to_numpy(), capacity, tiers).astype(np.int32)
    total = max(1, k + whole)
    context = np.full(total, capacity, np.int64)
    context[:k] >>= np.array(opened, np.int64)
    out["context"] = context[out.container]
    # deal the containers, dearest first, forth and back over the groups
    cost = np.bincount(out.container, weights=out.n_tokens.to_numpy(float) ** 2, minlength=total)
    groups = -(-total // step)
    turn, place = np.divmod(np.arange(total), groups)
    group = np.empty(total, np.int64)
    group[np.argsort(-cost, kind="stable")] = np.where(turn % 2 == 0, place, groups - 1 - place)
    out["step_group"] = group[out.container]
    return out


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, tiers: int = TIERS, step: int = STEP, shard_tokens: int = SHARD_TOKENS, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """key, piece, start_token, n_tokens, container, at, tier, context, step_group: one row per piece; context is
    the size of the windows its container was opened for. container and step_group count within the
    shard; with the shard's number above they are unique."""
    kind = sizes.schema[key].dataType.simpleString()
    # written, because the rows' numbers below must be the same when a lost task runs again
    rows = materialize(sizes.select(F.col(key).alias("doc_id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n_tokens")), "sizes")
    # two numbers, whatever the corpus
    total = rows.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("t"), F.count(F.lit(1)).alias("n")).first()
    shards = max(1, round(total["t"] / shard_tokens), -(-total["n"] // shard_items))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pack_shard(pdf[["doc_id", "n_tokens"]], capacity, tiers, step)
        shard = int(pdf.shard.iloc[0]) << 32
        out["container"] += shard
        out["step_group"] += shard
        return out

    sharded = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(shards)))
    schema = f"doc_id {kind}, piece int, start_token bigint, n_tokens bigint, container bigint, at bigint, tier int, context bigint, step_group bigint"
    return sharded.groupBy("shard").applyInPandas(one, schema).withColumnRenamed("doc_id", key)


def pack_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    from symgraph.llm.bpe import count_tokens

    return pack(count_tokens(docs, key, text), key, **options)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """containers, tokens, filled (share of all room), groups, worst_group (its cost against the mean)."""
    per = packed.groupBy("container", "step_group").agg(F.sum("n_tokens").alias("n"), F.sum(F.col("n_tokens").cast("double") * F.col("n_tokens")).alias("cost"))
    group = per.groupBy("step_group").agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("n"), F.sum("cost").alias("cost"))
    return group.agg(F.sum("containers").alias("containers"), F.sum("n").alias("tokens"), F.round(F.sum("n") / (F.sum("containers") * capacity), 4).alias("filled"), F.count(F.lit(1)).alias("groups"), F.round(F.max("cost") / F.avg("cost"), 3).alias("worst_group"))
