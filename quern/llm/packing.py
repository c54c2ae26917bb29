"""Filling containers of fixed capacity (queries p7_).

Documents are spread over blocks by a hash, each block a few hundred containers
large, so no group grows with the data. In a block, multiway differencing keeps
partial partitions into k windows: the two with the widest imbalance are joined
with opposed order, the fullest window of one meeting the emptiest of the
other, until one partition is left whose windows are nearly equal. k starts at
the least number that can hold the block and rises while a window exceeds the
capacity.

Only a document larger than the capacity is split: all its pieces but the last
fill a container each. Defined results: documents without tokens are left out,
repeated rows are packed as often as they occur, equal sizes are taken in order
of key, an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import staged

#: Containers that a block is meant to fill. Larger blocks leave less room at their end and cost more per item.
BLOCK_CONTAINERS = 256


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The window of each item and the windows' sums, by multiway differencing into k windows."""
    n = len(sizes)
    after = np.full(n, -1)
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray] | None] = []
    heap = []
    for i, size in enumerate(sizes.tolist()):
        heap.append((-size, i))
        parts.append(None)
    heapq.heapify(heap)

    def part(i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sums in falling order, with each window's first and last item."""
        if i < n:
            sums, first, last = np.zeros(k, np.int64), np.full(k, -1), np.full(k, -1)
            sums[0], first[0], last[0] = sizes[i], i, i
            return sums, first, last
        own, parts[i] = parts[i], None
        return own

    if n == 1:
        parts.append(part(0))
    while len(heap) > 1:
        a, b = part(heapq.heappop(heap)[1]), part(heapq.heappop(heap)[1])
        sums, first, last = a[0] + b[0][::-1], a[1].copy(), a[2].copy()
        other_first, other_last = b[1][::-1], b[2][::-1]
        both = (first >= 0) & (other_first >= 0)
        after[last[both]] = other_first[both]
        last[both] = other_last[both]
        alone = (first < 0) & (other_first >= 0)
        first[alone], last[alone] = other_first[alone], other_last[alone]
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        parts.append((sums, first[order], last[order]))
        heapq.heappush(heap, (-int(sums[0] - sums[-1]), len(parts) - 1))
    _, first, _ = parts[-1]
    window = np.zeros(n, np.int64)
    for w, i in enumerate(first.tolist()):
        while i >= 0:
            window[i] = w
            i = int(after[i])
    return window, np.bincount(window, sizes, k).astype(np.int64)


def bundles(sizes: np.ndarray, window: np.ndarray, k: int, pairs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, size, item, second item or -1) of what can be exchanged: nothing, an item, or two near each other in a window."""
    n = len(sizes)
    none = np.full(k, -1)
    parts = [(np.arange(k), np.zeros(k, np.int64), none, none), (window, sizes, np.arange(n), np.full(n, -1))]
    order = np.argsort(window, kind="stable")
    for shift in (1, 2) if pairs else ():
        a, b = order[:-shift], order[shift:]
        together = window[a] == window[b]
        a, b = a[together], b[together]
        parts.append((window[a], sizes[a] + sizes[b], a, b))
    return tuple(np.concatenate(column) for column in zip(*parts))


def settle(sizes: np.ndarray, window: np.ndarray, sums: np.ndarray, capacity: int) -> bool:
    """Level windows above the capacity: the fullest exchanges one item, or else one or two, with another window, so that the fuller of the two is least."""
    for _ in range(20 * len(sums)):
        over = int(np.argmax(sums))
        if sums[over] <= capacity:
            return True
        for pairs in (False, True):
            where, size, one, two = bundles(sizes, window, len(sums), pairs)
            own, others = np.flatnonzero(where == over), np.flatnonzero(where != over)
            gain = size[own][:, None] - size[others]
            fuller = np.maximum(sums[over] - gain, sums[where[others]] + gain)
            x, y = divmod(int(np.argmin(fuller)), len(others))
            if fuller[x, y] < sums[over]:
                break
        else:
            return False
        given, taken = own[x], others[y]
        to = where[taken]
        for bundle, place in ((given, to), (taken, over)):
            window[[i for i in (one[bundle], two[bundle]) if i >= 0]] = place
        sums[over] -= gain[x, y]
        sums[to] += gain[x, y]
    return False


def fill(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, no window above the capacity, by as few windows as differencing reaches."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    k = max(-(-int(sizes.sum()) // capacity), int((sizes > capacity / 2).sum()), 1)
    step, failed = 1, k - 1
    while True:
        window, sums = differencing(sizes, k)
        if settle(sizes, window, sums, capacity):
            break
        failed, k, step = k, min(len(sizes), k + step), step * 2
    while k - failed > 1:
        middle = (k + failed) // 2
        tried, sums = differencing(sizes, middle)
        if settle(sizes, tried, sums, capacity):
            k, window = middle, tried
        else:
            failed = middle
    return window


def packed(counts: DataFrame, key: str, size: str, capacity: int = 2048, block_containers: int = BLOCK_CONTAINERS) -> DataFrame:
    """Places of documents or pieces: (``key``, piece, first_token, n_tokens, container, place, at).

    ``counts`` has a document's ``size`` in tokens. ``container`` is unique over
    all blocks, ``place`` is the order in the container and ``at`` the first
    token's position there. One shuffle, of three numbers a piece.
    """
    counts = staged(counts.select(F.col(key).alias("key"), F.col(size).cast("long").alias("size")).where(F.col("size") > 0), "sizes")
    total = counts.agg(F.sum("size")).first()[0] or 0
    blocks = max(1, round(total / (capacity * block_containers)))
    pieces = counts.select(
        "key", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / capacity).cast("long") - 1)).alias("piece")
    ).select(
        "key", "piece", (F.col("piece") * capacity).alias("first_token"), F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("piece") * capacity).alias("n_tokens"),
        F.pmod(F.xxhash64("key", "piece"), F.lit(blocks)).alias("block"),
    )

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["key", "piece"], kind="stable").reset_index(drop=True)
        sizes = rows["n_tokens"].to_numpy()
        full = sizes == capacity
        window = np.zeros(len(rows), np.int64)
        window[full] = np.arange(full.sum())
        window[~full] = full.sum() + fill(sizes[~full], capacity)
        order = np.argsort(window, kind="stable")
        rows, window, sizes = rows.iloc[order], window[order], sizes[order]
        start = np.flatnonzero(np.diff(window, prepend=-1))
        group = np.cumsum(np.diff(window, prepend=-1) != 0) - 1
        before = np.cumsum(sizes) - sizes
        return pd.DataFrame({
            "key": rows["key"].to_numpy(), "piece": rows["piece"].to_numpy(), "first_token": rows["first_token"].to_numpy(), "n_tokens": sizes,
            "container": rows["block"].to_numpy() * (1 << 24) + group, "place": np.arange(len(rows)) - start[group], "at": before - before[start][group],
        })

    kind = counts.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece long, first_token long, n_tokens long, container long, place long, at long"
    # Differencing is worth many tasks where the three numbers a piece aren't: the number is given, so it isn't coalesced by bytes.
    tasks = min(blocks, max(int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-blocks // 64)))
    return pieces.repartition(tasks, "block").groupBy("block").applyInPandas(place, schema).withColumnRenamed("key", key)
