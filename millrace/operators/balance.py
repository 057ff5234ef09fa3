"""Balanced partitions of sequences over workers: largest differencing, greedy, dynamic micro-batches.

A batch is one group (its size is a training batch's, a parameter); batches run side by side.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grouped import streamed_groups
from .ordering import micro_batch_rank


def workload(length: Column) -> Column:
    """Relative cost of a sequence: 24576 n + n^2."""
    return F.lit(24576) * length + length * length


def differencing(sizes: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """k parts of indices by the largest differencing method; with ``equal`` all parts have the same number of items.

    Ties go by sum, then number of items, then the items themselves, so the result is the same everywhere.
    """
    if k < 1 or len(sizes) < k or (equal and len(sizes) % k):
        raise ValueError(f"{len(sizes)} items do not make {k}{' equal' if equal else ''} parts")
    order = sorted((size, i) for i, size in enumerate(sizes))
    groups = [order[a : a + k] for a in range(0, len(order), k)] if equal else [[x] for x in order]
    heap: list[tuple] = []
    for n, group in enumerate(groups):
        parts = sorted([(s, 1, ((i, s),)) for s, i in group] + [(0, 0, ())] * (k - len(group)), reverse=True)
        heapq.heappush(heap, _state(parts, n))
    n = len(groups)
    while len(heap) > 1:
        first, second = heapq.heappop(heap)[-1], heapq.heappop(heap)[-1]
        merged = [(a[0] + b[0], a[1] + b[1], a[2] + b[2]) for a, b in zip(first, reversed(second), strict=True)]
        heapq.heappush(heap, _state(sorted(merged, reverse=True), n))
        n += 1
    return [sorted(i for i, _ in items) for _, _, items in heap[0][-1]]


def _state(parts: list[tuple], n: int) -> tuple:
    top = parts[0]
    return (-(top[0] - parts[-1][0]), -top[0], -top[1], tuple((-i, -s) for i, s in top[2]), n, parts)


def greedy(sizes: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Each item, in input order, to the first of the lightest parts (with room, if parts are equal)."""
    room = len(sizes) // k
    parts: list[list[int]] = [[] for _ in range(k)]
    sums = [0] * k
    for i, size in enumerate(sizes):
        open_ = [p for p in range(k) if not equal or len(parts[p]) < room]
        best = min(open_, key=lambda p: sums[p])
        parts[best].append(i)
        sums[best] += size
    return parts


def balanced(rows: DataFrame, batch: str, idx: str, size: str, k: int, equal: bool = False, method: str = "differencing") -> DataFrame:
    """rows with ``part`` (0..k-1) of their batch; parts are ordered as the method leaves them."""
    choose = {"differencing": differencing, "greedy": greedy}[method]

    def run(group: list[tuple]) -> list[tuple]:
        part = {i: n for n, items in enumerate(choose([int(size_) for *_, size_ in group], k, equal)) for i in items}
        return [(*row, part[i]) for i, row in enumerate(group)]

    plain = rows.select(batch, idx, size)
    return streamed_groups(plain, batch, idx, run, ", ".join(f"{c} {t}" for c, t in plain.dtypes) + ", part int")


def ceil_div(a: Column, b: Column | int) -> Column:
    """The least whole number of times ``b`` that covers ``a``."""
    return F.ceil(a / b).cast("long")


def round_up(a: Column, b: Column | int) -> Column:
    """``a``, or the next multiple of ``b``."""
    return ceil_div(a, b) * b


def group_balanced(rows: DataFrame, batch: str, idx: str, length: str, uid: str, k: int) -> DataFrame:
    """rows with ``part``: neighbouring rows of one ``uid`` stay together, and each part has as many of these groups, by
    largest differencing on the groups' workloads. Groups must be at least k and divide into k parts."""

    def run(group: list[tuple]) -> list[tuple]:
        whole, costs = [0], []
        for n, row in enumerate(group):
            cost = 24576 * int(row[2]) + int(row[2]) ** 2
            if n and row[3] == group[n - 1][3]:
                whole.append(whole[-1])
                costs[-1] += cost
            else:
                whole += [whole[-1] + 1] if n else []
                costs.append(cost)
        part = {g: p for p, items in enumerate(differencing(costs, k, equal=True)) for g in items}
        return [(*row, part[g]) for row, g in zip(group, whole, strict=True)]

    plain = rows.select(batch, idx, length, uid)
    return streamed_groups(plain, batch, idx, run, ", ".join(f"{c} {t}" for c, t in plain.dtypes) + ", part int")


def balanced_batch(rows: DataFrame, batch: str, idx: str, length: str, k: int, mode: str = "sequence", uid: str | None = None, mini: int | None = None) -> DataFrame:
    """rows with ``part`` and ``place``, the zig-zag order by workload inside a part.

    Modes: 'sequence' balances workloads over equal parts, 'group' keeps the rows of a ``uid`` together, 'minibatch'
    balances inside each run of ``mini`` rows, so that those keep their members.
    """
    if mode == "group":
        parted = group_balanced(rows, batch, idx, length, uid, k)
    else:
        cut_up = rows.withColumn("_run", F.struct(batch, F.floor((F.row_number().over(Window.partitionBy(batch).orderBy(idx)) - 1) / mini)).cast("string") if mode == "minibatch" else F.col(batch).cast("string"))
        parted = balanced(cut_up.withColumn("_cost", workload(F.col(length).cast("long"))), "_run", idx, "_cost", k, equal=True)
        parted = cut_up.select(batch, idx, length, "_run").join(parted.select("_run", idx, "part"), ["_run", idx]).drop("_run")
    inside = Window.partitionBy(batch, "part")
    rank = F.row_number().over(inside.orderBy(F.desc(length), idx)) - 1
    return parted.withColumn("place", micro_batch_rank(rank, F.count(F.lit(1)).over(inside)))


def micro_batches(rows: DataFrame, batch: str, idx: str, length: str, max_tokens: int, least: int = 1, multiple: int = 1) -> DataFrame:
    """rows with ``micro`` batch and ``place`` in its zig-zag order by workload.

    Their number is that of the tokens over ``max_tokens``, at least ``least``, rounded up to ``multiple`` and at most
    the number of rows.
    """

    def run(group: list[tuple]) -> list[tuple]:
        lengths = [int(n) for *_, n in group]
        if max(lengths) > max_tokens:
            raise ValueError("a sequence is longer than a micro-batch")
        k = max(least, math.ceil(sum(lengths) / max_tokens))
        k = min(len(lengths), math.ceil(k / multiple) * multiple)
        costs = [24576 * n + n * n for n in lengths]
        parts = sorted(differencing(costs, k), key=lambda p: (sum(costs[i] for i in p), p), reverse=True)
        parts = parts[::2][::-1] + parts[1::2]
        return [(*group[i], m, place) for m, part in enumerate(parts) for place, i in enumerate(part)]

    plain = rows.select(batch, idx, length)
    return streamed_groups(plain, batch, idx, run, ", ".join(f"{c} {t}" for c, t in plain.dtypes) + ", micro int, place int")


def restore_order(rows: DataFrame, original: DataFrame, key: str, position: str) -> DataFrame:
    """rows with the position they had before reordering (the inverse permutation is a join)."""
    return rows.join(original.select(key, position), key)


def imbalance(rows: DataFrame, batch: str, part: str, size: str) -> DataFrame:
    """(batch, min, max, diff) of the parts' sums."""
    sums = rows.groupBy(batch, part).agg(F.sum(size).alias("s"))
    return sums.groupBy(batch).agg(F.min("s").alias("min"), F.max("s").alias("max"), (F.max("s") - F.min("s")).alias("diff"))
