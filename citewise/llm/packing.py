"""Filling containers of fixed capacity with whole items."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEMS_PER_GROUP = 20_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, bins numbered from 0 as they open; sizes from 1 to capacity, taken in the given order.

    open[g] counts open bins with g left. An item of size s goes where the sum over g of open[g]**2 becomes smallest:
    out of gap g into gap g - s, or from a new bin into gap capacity - s; full bins count nothing. Ties go to an open
    bin before a new one, then to the smallest gap, then to the bin that came to that gap last.
    """
    count = np.zeros(capacity + 1, np.int64)
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins = np.empty(len(sizes), np.int64)
    opened, least = 0, capacity
    far = np.iinfo(np.int64).max
    for i, s in enumerate(sizes.tolist()):
        new = 2 * int(count[capacity - s]) + 1 if s < capacity else 0
        best, gap = far, 0
        low = max(s, least)
        if low < capacity:
            have = count[low:capacity]
            change = 2 * (count[low - s : capacity - s] - have) + 2
            if low == s:
                change[0] = 1 - 2 * have[0]
            change[have == 0] = far
            at = int(change.argmin())
            best, gap = int(change[at]), low + at
        if best <= new:
            b = stacks[gap].pop()
            count[gap] -= 1
            left = gap - s
        else:
            b, left = opened, capacity - s
            opened += 1
        if left:
            stacks[left].append(b)
            count[left] += 1
            least = min(least, left)
        bins[i] = b
    return bins


def pack_group(keys: np.ndarray, pieces: np.ndarray, sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bins of one group's items: decreasing sizes, ties by key and piece; items of size 0 join bins in turn."""
    order = np.lexsort((pieces, keys, -sizes))
    some = order[sizes[order] > 0]
    none = order[sizes[order] == 0]
    bins = np.empty(len(sizes), np.int64)
    bins[some] = sum_of_squares(sizes[some], capacity)
    bins[none] = np.arange(len(none)) % max(1, int(bins[some].max()) + 1 if len(some) else 1)
    return bins


def pack(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens", n_items: int | None = None, per_group: int = ITEMS_PER_GROUP) -> DataFrame:
    """Assign every item to a container of capacity: key, piece, start, n_tokens, container, fill.

    sizes: one row per item with a long key and a size; n_items: its number of rows if known (else it is counted).
    An item above the capacity, and no other, is split: full pieces, each a container of its own, and a rest that is
    packed as an item. start is the piece's first unit within its item, fill the container's used units. Null and
    negative sizes are 0; items of size 0 go to some container as well. Rows of the same key are items of their own.

    Pieces go to groups of about per_group items by a hash of key and piece; a group is packed by itself by
    sum_of_squares over decreasing sizes, which leaves a few open bins a group: so groups don't depend on each other,
    and their number grows with the items while a group's work doesn't. sizes is evaluated once and shuffled once.
    """
    n_items = sizes.count() if n_items is None else n_items
    groups = max(1, math.ceil(n_items / per_group))
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    last = F.greatest(F.ceil(F.col("n") / capacity) - 1, F.lit(0))
    rows = sizes.select(F.col(key).cast("long").alias("key"), n.alias("n")).select("key", "n", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))).alias("piece"))
    pieces = rows.select("key", "piece", F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).cast("long").alias("n"), F.pmod(F.xxhash64("key", "piece"), F.lit(groups)).alias("group"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy()
        bins = pack_group(pdf["key"].to_numpy(), pdf["piece"].to_numpy(), n, capacity)
        fill = np.bincount(bins, weights=n).astype(np.int64)
        name = f"{pdf['group'].iloc[0]}:"
        return pd.DataFrame({"key": pdf["key"], "piece": pdf["piece"], "start": pdf["piece"] * capacity, "n_tokens": n, "container": [f"{name}{b}" for b in bins.tolist()], "fill": fill[bins]})

    packed = pieces.groupBy("group").applyInPandas(run, "key long, piece long, start long, n_tokens long, container string, fill long")
    return packed.withColumnRenamed("key", key)
