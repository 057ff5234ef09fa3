"""Off-policy correction: thresholds, rejection masks, importance weights and their metrics.

Input tokens: traj_id, pos, mask, old_logp, rollout_logp. Sequence statistics come from one ``groupBy`` joined back.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregates import EPS, masked_mean, masked_sum

SAFE = 20.0
# The rejection options.
OPTIONS = tuple(f"{level}_{kind}" for level in ("token", "seq_sum", "seq_mean") for kind in ("k1", "k2", "k3")) + ("seq_max_k2", "seq_max_k3")


def is_threshold(spec: str | float) -> tuple[float, float | None]:
    """(upper, lower) of an importance threshold: a number, or 'low_high' for both."""
    if isinstance(spec, bool):
        raise ValueError("a threshold is a number or 'low_high'")
    parts = [float(x) for x in str(spec).split("_")]
    if len(parts) > 2 or any(not x > 0 for x in parts) or (len(parts) == 2 and parts[0] > parts[1]):
        raise ValueError(f"bad threshold {spec}")
    return (parts[-1], parts[0] if len(parts) == 2 else None)


def rs_thresholds(options: list[str], spec: str | float) -> dict[str, tuple[float | None, float]]:
    """(lower, upper) of each rejection option from one spec for all or one each, comma-separated.

    k1 options take 'low_high', or one number x for (1 / x, x); the others take an upper bound only.
    """
    if isinstance(spec, bool):
        raise ValueError("a threshold is a number or text")
    specs = [s.strip() for s in str(spec).split(",") if s.strip()]
    if len(specs) == 1:
        specs *= len(options)
    if len(specs) != len(options):
        raise ValueError("as many thresholds as options, or one")
    out: dict[str, tuple[float | None, float]] = {}
    for option, text in zip(options, specs, strict=True):
        upper, lower = is_threshold(text)
        if option.endswith("k1"):
            out[option] = (1 / upper if lower is None else lower, upper)
        elif lower is not None:
            raise ValueError(f"{option} takes an upper bound only")
        else:
            out[option] = (None, upper)
    return out


def _divergence(kind: str, log_ratio: Column) -> Column:
    safe = F.greatest(F.least(log_ratio, F.lit(SAFE)), F.lit(-SAFE))
    return {"k1": -safe, "k2": 0.5 * safe * safe, "k3": F.exp(safe) - 1 - safe}[kind]


def rejection_mask(tokens: DataFrame, options: str, threshold: str | float) -> DataFrame:
    """tokens with ``keep`` (0 or 1): the mask less everything that any option rejects.

    Options are comma-separated, repeats count once, unknown ones raise. A sequence without valid tokens keeps its
    (empty) mask.
    """
    names = list(dict.fromkeys(o.strip() for o in options.split(",") if o.strip()))
    if not names or any(n not in OPTIONS for n in names):
        raise ValueError(f"options must be among {', '.join(OPTIONS)}")
    limits = rs_thresholds(names, threshold)
    ratio = F.col("old_logp") - F.col("rollout_logp")
    kept, aggs = F.lit(True), []
    for name in names:
        level, kind = name.rsplit("_", 1)
        lower, upper = limits[name]
        value = _divergence(kind, ratio)
        if level == "token":
            stat = value
        else:
            m = F.col("mask")
            reduced = {"seq_sum": masked_sum(value, m), "seq_mean": masked_mean(value, m), "seq_max": F.coalesce(F.max(F.when(m != 0, value)), F.lit(0.0))}[level]
            aggs.append(reduced.alias(f"_{name}"))
            stat = F.col(f"_{name}")
        inside = (stat >= math.log(lower)) & (stat <= math.log(upper)) if kind == "k1" else stat <= upper
        kept = kept & inside
    rows = tokens.join(tokens.groupBy("traj_id").agg(*aggs), "traj_id") if aggs else tokens
    return rows.withColumn("keep", F.col("mask") * kept.cast("int")).drop(*(f"_{n}" for n in names))


def importance_weights(tokens: DataFrame, level: str = "token", threshold: str | float = 2.0, normalise: bool = False) -> DataFrame:
    """tokens with ``is_weight``: exp of the token's or sequence's log ratio on valid tokens.

    One number truncates at it; 'low_high' zeroes what lies outside. ``normalise`` divides by the batch mean.
    """
    upper, lower = is_threshold(threshold)
    ratio, m = F.col("old_logp") - F.col("rollout_logp"), F.col("mask")
    if level == "token":
        rows, log_ratio = tokens, ratio
    elif level == "sequence":
        rows = tokens.join(tokens.groupBy("traj_id").agg(masked_sum(ratio, m).alias("_seq")), "traj_id")
        log_ratio = F.col("_seq")
    else:
        raise ValueError("level is token or sequence")
    raw = F.exp(F.greatest(F.least(log_ratio, F.lit(SAFE)), F.lit(-SAFE))) * m
    weight = F.least(raw, F.lit(upper)) if lower is None else F.when((raw >= lower) & (raw <= upper), raw).otherwise(0.0)
    rows = rows.withColumns({"is_raw": raw, "is_weight": weight}).drop("_seq")
    if normalise:
        if level == "token":
            mean = rows.agg(masked_mean(F.col("is_weight"), m).alias("_mean"))
        else:
            seqs = rows.groupBy("traj_id").agg(masked_mean(F.col("is_weight"), m).alias("w"), (F.sum(m) > 0).alias("valid"))
            mean = seqs.agg((F.sum(F.when(F.col("valid"), F.col("w"))) / F.greatest(F.count_if("valid"), F.lit(1))).alias("_mean"))
        rows = rows.crossJoin(F.broadcast(mean)).withColumn("is_weight", F.when(F.col("_mean") > EPS, F.col("is_weight") / F.col("_mean")).otherwise(F.col("is_weight"))).drop("_mean")  # one row
    return rows


def weight_metrics(weighted: DataFrame, threshold: float = 2.0, lower: float | None = None) -> DataFrame:
    """One row of token and sequence statistics of importance weights (input of :func:`importance_weights`)."""
    low = 1 / threshold if lower is None else lower
    m, w, raw = F.col("mask"), F.col("is_weight"), F.col("is_raw")
    held = F.least(F.greatest(w, F.lit(0.0)), F.lit(threshold))
    tokens = weighted.agg(
        masked_mean(w, m).alias("mean"), F.max(F.when(m != 0, w)).alias("max"), F.min(F.when(m != 0, w)).alias("min"),
        masked_mean((raw > threshold).cast("double"), m).alias("fraction_high"), masked_mean((raw < low).cast("double"), m).alias("fraction_low"),
        masked_mean(held, m).alias("_h"), masked_mean(held * held, m).alias("_h2"), F.sum(m).alias("_n"),
    )
    seqs = weighted.groupBy("traj_id").agg(masked_mean(w, m).alias("s"))
    by_seq = seqs.agg(
        F.avg("s").alias("seq_mean"), F.coalesce(F.stddev_samp("s"), F.lit(0.0)).alias("seq_std"), F.max("s").alias("seq_max"), F.min("s").alias("seq_min"),
        F.max(F.abs(F.col("s") - 1)).alias("seq_max_deviation"), F.avg((F.col("s") > threshold).cast("double")).alias("seq_fraction_high"), F.avg((F.col("s") < low).cast("double")).alias("seq_fraction_low"),
    )
    both = tokens.crossJoin(F.broadcast(by_seq))  # one row each
    std = F.when(F.col("_n") > 1, F.sqrt(F.greatest(F.col("_h2") - F.col("_h") ** 2, F.lit(0.0)))).otherwise(0.0)
    return both.withColumns({"std": std, "eff_sample_size": (F.col("_h") + EPS) ** 2 / F.col("_h2")}).drop("_h", "_h2", "_n")


def offpolicy_metrics(tokens: DataFrame) -> DataFrame:
    """One row: perplexities of both policies, KL and k3 KL, perplexity ratio and differences, chi-square per token and sequence."""
    old, roll, m = F.col("old_logp"), F.col("rollout_logp"), F.col("mask")
    ratio = old - roll
    seqs = tokens.groupBy("traj_id").agg(masked_mean(old, m).alias("o"), masked_mean(roll, m).alias("r"), masked_sum(ratio, m).alias("s"))
    gap = F.col("r") - F.col("o")
    by_seq = seqs.agg(
        F.avg(F.exp(-F.col("o"))).alias("training_ppl"), F.avg(-F.col("o")).alias("training_log_ppl"), F.avg(F.exp(-F.col("r"))).alias("rollout_ppl"), F.avg(-F.col("r")).alias("rollout_log_ppl"),
        F.avg(gap).alias("log_ppl_diff"), F.avg(F.abs(gap)).alias("log_ppl_abs_diff"), F.max(gap).alias("log_ppl_diff_max"), F.min(gap).alias("log_ppl_diff_min"), F.avg(F.exp(gap)).alias("ppl_ratio"),
        (F.avg(F.exp(2 * F.greatest(F.least("s", F.lit(SAFE)), F.lit(-SAFE)))) - 1).alias("chi2_seq"),
    )
    safe = F.greatest(F.least(ratio, F.lit(SAFE)), F.lit(-SAFE))
    by_token = tokens.agg(masked_mean(-ratio, m).alias("kl"), masked_mean(F.exp(ratio) - ratio - 1, m).alias("k3_kl"), (masked_mean(F.exp(2 * safe), m) - 1).alias("chi2_token"))
    return by_seq.crossJoin(F.broadcast(by_token))  # one row each


def rejection_metrics(tokens: DataFrame, options: str, threshold: str | float) -> DataFrame:
    """A row per option: mean, max and min of its statistic over valid tokens or sequences, and the fraction rejected."""
    out: DataFrame | None = None
    for name in dict.fromkeys(o.strip() for o in options.split(",") if o.strip()):
        kept = rejection_mask(tokens, name, threshold if "," not in str(threshold) else str(threshold).split(",")[options.split(",").index(name)])
        value = _divergence(name.rsplit("_", 1)[1], F.col("old_logp") - F.col("rollout_logp"))
        m = F.col("mask")
        row = kept.agg(masked_mean(value, m).alias("mean"), F.max(F.when(m != 0, value)).alias("max"), F.min(F.when(m != 0, value)).alias("min"), masked_mean((F.col("keep") == 0).cast("double"), m).alias("rejected"))
        row = row.select(F.lit(name).alias("option"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def corrected(tokens: DataFrame, level: str = "token", threshold: str | float = 2.0, options: str | None = None, limits: str | float | None = None) -> DataFrame:
    """Weights and, if options are given, the rejection mask attached in one step (``is_weight``, ``mask``)."""
    rows = importance_weights(tokens, level, threshold)
    if options is None:
        return rows
    return rejection_mask(rows, options, limits).withColumn("mask", F.col("keep")).drop("keep")


def bypass(tokens: DataFrame) -> DataFrame:
    """Bypass mode: the rollout's log-probabilities stand in for the old ones."""
    return tokens.withColumn("old_logp", F.col("rollout_logp"))
