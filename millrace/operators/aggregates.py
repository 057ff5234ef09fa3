"""Masked and grouped aggregates shared by the rollout operators.

Everything is a plain ``groupBy`` with partial aggregation; group statistics go back to rows by a join, never by an
unbounded window, so one group may hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordering import global_row_index

EPS = 1e-8


def masked_sum(value: Column, mask: Column) -> Column:
    """Sum of value x mask where the mask is not 0; values outside it (NaN too) count for nothing. No valid row: 0."""
    return F.coalesce(F.sum(F.when(mask != 0, value * mask)), F.lit(0.0))


def masked_mean(value: Column, mask: Column) -> Column:
    """Masked sum over the mask's sum plus 1e-8. No valid row: 0."""
    return masked_sum(value, mask) / (F.coalesce(F.sum(mask), F.lit(0)) + F.lit(EPS))


def masked_stats(rows: DataFrame, value: str, mask: str) -> DataFrame:
    """One row (mean, var): masked mean and unbiased masked variance in two passes; raises unless the mask has two."""
    v, m = F.col(value), F.col(mask)
    mean = rows.agg(masked_mean(v, m).alias("mean"), F.sum(m).alias("n"))
    both = rows.crossJoin(F.broadcast(mean))  # one row against all
    var = both.groupBy("mean", "n").agg(masked_mean((v - F.col("mean")) ** 2, m).alias("biased"))
    bad = F.raise_error(F.lit("masked variance needs a mask of at least two"))
    return var.select("mean", F.when(F.col("n") > 1, F.col("biased") * F.col("n") / (F.col("n") - 1)).otherwise(bad.cast("double")).alias("var"))


def whiten(rows: DataFrame, value: str, mask: str, out: str, shift_mean: bool = True) -> DataFrame:
    """(value - mean) / sqrt(var + 1e-8) over masked rows of the whole relation."""
    stats = masked_stats(rows, value, mask).select(F.col("mean").alias("_mean"), F.col("var").alias("_var"))
    white = (F.col(value) - F.col("_mean")) / F.sqrt(F.col("_var") + F.lit(EPS))
    return rows.crossJoin(F.broadcast(stats)).withColumn(out, white if shift_mean else white + F.col("_mean")).drop("_mean", "_var")  # one row


def group_stats(rows: DataFrame, group: str, value: str, floor: float = 0.0) -> DataFrame:
    """(group, n, mean, std) with the sample deviation; a group of one has mean 0 and deviation 1."""
    out = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    alone = F.col("n") == 1
    return out.select(group, "n", F.when(alone, 0.0).otherwise(F.col("mean")).alias("mean"), F.when(alone, 1.0).otherwise(F.greatest("std", F.lit(floor))).alias("std"))


def group_codes(rows: DataFrame, label: str, out: str = "code") -> DataFrame:
    """Labels as 0..G-1 in label order; nulls stay null. The distinct labels alone are ranked."""
    labels = rows.select(label).where(F.col(label).isNotNull()).distinct()
    return rows.join(global_row_index(labels, [label], out), label, "left")


def loss_mean(tokens: DataFrame, mode: str, loss: str = "loss", scale: float | None = None) -> DataFrame:
    """One row (loss): token losses (traj_id, loss, mask) reduced by one of the four modes.

    token-mean; seq-mean-token-sum; seq-mean-token-sum-norm (over ``scale``, default the longest trajectory);
    seq-mean-token-mean. Trajectories without valid tokens do not count; with none at all the loss is null.
    """
    v, m = F.col(loss), F.col("mask")
    if mode == "token-mean":
        return tokens.agg((masked_sum(v, m) / F.nullif(F.sum(m), F.lit(0))).alias("loss"))
    seqs = tokens.groupBy("traj_id").agg(masked_sum(v, m).alias("s"), F.sum(m).alias("m"), F.count(F.lit(1)).alias("width"))
    valid = F.col("m") > 0
    if mode in ("seq-mean-token-sum", "seq-mean-token-sum-norm"):
        mean = F.sum(F.when(valid, F.col("s"))) / F.nullif(F.count_if(valid), F.lit(0))
        return seqs.agg((mean if mode == "seq-mean-token-sum" else mean / (F.lit(scale) if scale else F.max("width"))).alias("loss"))
    if mode == "seq-mean-token-mean":
        return seqs.agg((F.sum(F.when(valid, F.col("s") / (F.col("m") + F.lit(EPS)))) / F.nullif(F.count_if(valid), F.lit(0))).alias("loss"))
    raise ValueError(f"unknown loss mode {mode}")
