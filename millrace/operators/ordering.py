"""Stable positions, seeded orders, sampling and batch reshaping over rows that have a key.

A global position never comes from one window over all rows: rows are range-partitioned by the order, counted per
partition (a bounded table), and numbered inside their partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import cut, small_side


def global_row_index(rows: DataFrame, order: list[str | Column], out: str = "row_idx") -> DataFrame:
    """0-based position of each row in the given (total) order."""
    columns = [F.col(c) if isinstance(c, str) else c for c in order]
    parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(rows.withColumns({f"_o{k}": c for k, c in enumerate(columns)}).repartitionByRange(parts, *columns).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    before = counts.select("_part", (F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*(_direction(c, k) for k, c in enumerate(order))))
    numbered = ranged.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + place - 1)
    return numbered.drop("_part", "_before", *(f"_o{k}" for k in range(len(columns))))


def _direction(order: str | Column, k: int) -> Column:
    return F.col(f"_o{k}") if isinstance(order, str) else order


def seeded_key(seed: int, key: str) -> Column:
    """The sampling contract: order by md5 of 'seed:key', the same on every engine."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement in seeded order (a top-n, so nothing is gathered); all rows if there are fewer."""
    return rows.orderBy(seeded_key(seed, key), key).limit(n)


#: Which sources each pair of corpora is made of.
PAIRS = {"mmsd2_docmsu": ("mmsd2", "docmsu"), "mmsd2_sarcnet": ("mmsd2", "sarcnet"), "docmsu_sarcnet": ("docmsu", "sarcnet")}


def pairwise_groups(rows: DataFrame, key: str, source: str, seed: int = 42, pairs: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(group, place, ...): one seeded order of all rows, projected into groups of two sources each.

    A row is in every group that has its source, at its place in the common order; its key must be unique.
    """
    pairs = pairs or PAIRS
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    checked = rows.join(counts, key).withColumn(key, F.when(F.col("_n") > 1, F.raise_error(F.lit("key in two rows")).cast(rows.schema[key].dataType)).otherwise(F.col(key))).drop("_n")
    ordered = global_row_index(checked.withColumn("_order", seeded_key(seed, key)), ["_order", key], "place").drop("_order")
    groups = F.array(*(F.when(F.col(source).isin(*names), F.lit(g)) for g, names in pairs.items()))
    return ordered.withColumn("group", F.explode(F.array_compact(groups)))


def stratified_sample(rows: DataFrame, key: str, strata: list[str], quotas: DataFrame, seed: int = 42) -> DataFrame:
    """The first ``quota`` rows of each stratum in seeded order, with ``selection_index`` from 1.

    ``quotas`` has the strata columns and ``quota``. A stratum with fewer rows than its quota raises. Only rows under an
    upper bound of the quota's hash share are ranked, so a stratum of any size costs its quota.
    """
    counts = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("_have"))
    wanted = quotas.join(counts, strata, "left").withColumn("_have", F.coalesce("_have", F.lit(0)))
    short = F.raise_error(F.concat(F.lit("too few rows in stratum "), F.concat_ws("/", *strata)))
    wanted = wanted.withColumn("quota", F.when(F.col("_have") < F.col("quota"), short.cast("int")).otherwise(F.col("quota")))
    # a cut 8 standard deviations above the quota's share: fewer rows than the quota below it is out of the question
    share = (F.col("quota") + 8 * F.sqrt(F.col("quota")) + 16) / F.col("_have")
    order = seeded_key(seed, key)
    near = rows.join(small_side(cut(wanted), 1_000_000), strata).where(F.conv(F.substring(order, 1, 8), 16, 10).cast("double") / 4294967296.0 < share)
    ranked = near.withColumn("selection_index", F.row_number().over(Window.partitionBy(*strata).orderBy(order, F.col(key))))
    return ranked.where("selection_index <= quota").drop("quota", "_have")


def resample(rows: DataFrame, key: str, weight: Column, n: int, seed: int = 42) -> DataFrame:
    """n draws with replacement by weight (inverse CDF): each draw's point is found by a range of cumulative weight.

    Cumulative weights are summed by bucket first; a draw is joined to its bucket, then to its row. Output: row columns
    and ``draw`` (0..n-1). Rows of weight 0, or null weight, are never drawn.
    """
    weighted = rows.withColumn("_w", weight.cast("double")).where("_w > 0").withColumn("_b", F.expr(f"pmod(xxhash64({key}), 512)"))
    sums = weighted.groupBy("_b").agg(F.sum("_w").alias("_s"))
    upto = F.sum("_s").over(Window.orderBy("_b"))  # at most 512 rows
    edges = sums.select("_b", (upto - F.col("_s")).alias("_lo"), upto.alias("_hi"), F.sum("_s").over(Window.partitionBy(F.lit(0))).alias("_all"))
    inside = weighted.join(F.broadcast(edges), "_b").withColumn("_to", F.col("_lo") + F.sum("_w").over(Window.partitionBy("_b").orderBy(key)))
    inside = inside.withColumn("_from", F.col("_to") - F.col("_w"))
    point = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("draw"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), point.alias("_u"))
    placed = draws.join(F.broadcast(edges), (F.col("_u") * F.col("_all") >= F.col("_lo")) & (F.col("_u") * F.col("_all") < F.col("_hi")))
    placed = placed.select("draw", "_b", (F.col("_u") * F.col("_all")).alias("_at"))
    hit = placed.join(inside.drop("_lo", "_hi", "_all"), "_b").where("_at >= _from and _at < _to")
    return hit.drop("_b", "_at", "_from", "_to", "_w")


def first_rows_by(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The n rows that come first by ``order`` (a top-n)."""
    return rows.orderBy(order).limit(n)


def take_at(indexed: DataFrame, positions: DataFrame, row_idx: str = "row_idx") -> DataFrame:
    """Rows at listed positions (``pos`` order, ``row_idx`` repeats allowed)."""
    return positions.join(indexed, row_idx)


def slice_rows(indexed: DataFrame, start: int, end: int | None, step: int = 1, row_idx: str = "row_idx") -> DataFrame:
    """start:end:step of the positions, by arithmetic on them."""
    at = F.col(row_idx)
    keep = (at >= start) & ((at - start) % step == 0)
    return indexed.where(keep if end is None else keep & (at < end))


def chunk_of(row_idx: Column, total: int, chunks: int) -> Column:
    """Number of the equal chunk a position falls in; raises when the rows do not divide."""
    if total % chunks:
        raise ValueError(f"{total} rows do not divide into {chunks} chunks")
    return F.floor(row_idx / (total // chunks)).cast("int")


def micro_batch_rank(rank: Column, count: Column) -> Column:
    """Zig-zag place of a rank: odd ranks backwards first, then the even ones, so that neighbours stay alike."""
    half = F.ceil(count / 2)
    return F.when(rank % 2 == 0, half - 1 - rank / 2).otherwise(half + (rank - 1) / 2).cast("int")


def pad_to_multiple(indexed: DataFrame, size: int, row_idx: str = "row_idx") -> DataFrame:
    """Rows cycled from the start until their number is a multiple of ``size``; ``is_pad`` marks the added ones."""
    total = indexed.count()
    pad = math.ceil(total / size) * size - total if total else 0
    if not pad:
        return indexed.withColumn("is_pad", F.lit(False))
    extra = indexed.sparkSession.range(pad).select((F.col("id") % total).alias(row_idx), (F.col("id") + total).alias("_new"))
    added = indexed.join(F.broadcast(extra), row_idx).withColumn(row_idx, F.col("_new")).drop("_new")
    return indexed.withColumn("is_pad", F.lit(False)).unionByName(added.withColumn("is_pad", F.lit(True)))


def repeat_rows(indexed: DataFrame, times: int, interleave: bool = True, row_idx: str = "row_idx") -> DataFrame:
    """Each row ``times`` times: next to each other (interleave) or as tiled copies; ``out_idx`` is the new position."""
    copied = indexed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if interleave:
        return copied.withColumn("out_idx", F.col(row_idx) * times + F.col("copy"))
    return copied.withColumn("out_idx", F.col("copy") * indexed.count() + F.col(row_idx))


def runs(rows: DataFrame, partition: list[str], order: list[str], value: str) -> DataFrame:
    """Gaps and islands: ``run_no`` of consecutive equal values and ``in_run`` (from 0), in order inside a partition."""
    w = Window.partitionBy(*partition).orderBy(*order)
    fresh = rows.withColumn("_new", F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1)))
    fresh = fresh.withColumn("_new", F.when(F.row_number().over(w) == 1, 1).otherwise(F.col("_new"))).withColumn("run_no", F.sum("_new").over(w))
    inner = Window.partitionBy(*partition, "run_no").orderBy(*order)
    return fresh.withColumn("in_run", F.row_number().over(inner) - 1).drop("_new")
