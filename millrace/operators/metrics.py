"""Evaluation metrics: classification, validation at N, timing, throughput and comparisons.

Classification rows have gold, pred and valid; everything is one conditional aggregate, then column algebra.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .aggregates import masked_mean

POS, NEG = "sarcastic", "non-sarcastic"
COUNTS = ("samples", "completed", "invalid", "tp", "tn", "fp", "fn_valid", "invalid_pos", "invalid_neg")
#: Names that the macro row averages.
RATES = ("accuracy", "valid_accuracy", "coverage", "precision", "recall", "f1", "specificity", "npv", "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "balanced_accuracy", "mcc", "kappa")


def _div(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(F.try_divide(a.cast("double"), b.cast("double")))


def classification_counts() -> list[Column]:
    """Aggregates over (gold, pred, valid): a row without a valid prediction is an invalid output of its gold class."""
    valid, gold, pred = F.coalesce(F.col("valid"), F.lit(False)), F.col("gold"), F.col("pred")
    return [
        F.count(F.lit(1)).alias("samples"), F.count_if(valid).alias("completed"), F.count_if(~valid).alias("invalid"),
        F.count_if(valid & (gold == POS) & (pred == POS)).alias("tp"), F.count_if(valid & (gold == NEG) & (pred == NEG)).alias("tn"),
        F.count_if(valid & (gold == NEG) & (pred == POS)).alias("fp"), F.count_if(valid & (gold == POS) & (pred == NEG)).alias("fn_valid"),
        F.count_if(~valid & (gold == POS)).alias("invalid_pos"), F.count_if(~valid & (gold == NEG)).alias("invalid_neg"),
    ]


def classification_rates(counts: DataFrame, invalid_in_support: bool = True) -> DataFrame:
    """Metric columns from the counts; dividing by zero gives 0.

    Invalid outputs count against accuracy and their class's recall. Without ``invalid_in_support`` (their gold labels
    unknown) they only count against accuracy. MCC and kappa use valid pairs only.
    """
    c = {n: F.col(n) for n in COUNTS}
    zero = F.lit(0)
    lost_pos, lost_neg = (c["invalid_pos"], c["invalid_neg"]) if invalid_in_support else (zero, zero)
    tp, tn, fp, fn = c["tp"], c["tn"], c["fp"], c["fn_valid"]
    sup_pos, sup_neg = tp + fn + lost_pos, tn + fp + lost_neg
    p_pos, r_pos, p_neg, r_neg = _div(tp, tp + fp), _div(tp, sup_pos), _div(tn, tn + fn), _div(tn, sup_neg)
    base = counts.withColumns(
        {
            "support_pos": sup_pos, "support_neg": sup_neg, "accuracy": _div(tp + tn, c["completed"] + c["invalid"]), "valid_accuracy": _div(tp + tn, c["completed"]), "coverage": _div(c["completed"], c["samples"]),
            "precision": p_pos, "recall": r_pos, "npv": p_neg, "specificity": r_neg, "micro_precision": _div(tp + tn, c["completed"]), "micro_recall": _div(tp + tn, c["completed"] + c["invalid"]),
        }
    )
    p, r, n, s = (F.col(x) for x in ("precision", "recall", "npv", "specificity"))
    base = base.withColumns({"f1": _div(2 * p * r, p + r), "f1_neg": _div(2 * n * s, n + s), "macro_precision": (p + n) / 2, "macro_recall": (r + s) / 2, "balanced_accuracy": (r + s) / 2})
    total = c["completed"]
    expected = _div((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp), total * total)
    observed = F.col("valid_accuracy")
    root = F.sqrt((tp + fp).cast("double") * (tp + fn) * (tn + fp) * (tn + fn))
    return base.withColumns(
        {
            "macro_f1": (F.col("f1") + F.col("f1_neg")) / 2, "weighted_f1": _div(F.col("f1") * sup_pos + F.col("f1_neg") * sup_neg, sup_pos + sup_neg),
            "mcc": F.when(root == 0, 0.0).otherwise(F.try_divide(tp.cast("double") * tn - fp.cast("double") * fn, root)),
            "kappa": F.when(expected == 1, 0.0).otherwise(F.try_divide(observed - expected, 1 - expected)),
        }
    )


def classification_report(rows: DataFrame) -> DataFrame:
    """Metrics by dataset, dataset and language (only where a dataset has several), and pooled; ``level`` says which.

    Rows: (dataset, language, gold, pred, valid). Null dataset and language count as 'na'.
    """
    named = rows.withColumns({"dataset": F.coalesce("dataset", F.lit("na")), "language": F.coalesce("language", F.lit("na"))})
    cube = named.groupingSets([["dataset", "language"], ["dataset"], []], "dataset", "language").agg(*classification_counts(), F.grouping_id().alias("g"), F.count_distinct("language").alias("langs"))
    several = F.max(F.when(F.col("g") == 1, F.col("langs"))).over(Window.partitionBy("dataset"))
    level = F.when(F.col("g") == 0, "subgroup").when(F.col("g") == 1, "dataset").otherwise("pooled")
    kept = cube.withColumn("_several", several).where((F.col("g") != 0) | (F.col("_several") > 1))
    return classification_rates(kept.withColumn("level", level).drop("g", "langs", "_several"))


def macro_row(report: DataFrame) -> DataFrame:
    """Mean of the rates over datasets with a completed sample."""
    return report.where("level = 'dataset' and completed > 0").agg(*(F.avg(r).alias(r) for r in RATES))


def status_rollup(rows: DataFrame, group: list[str]) -> DataFrame:
    """complete if all are; else paused if any is; else invalid_outputs."""
    every, paused = F.bool_and(F.col("status") == "complete"), F.bool_or(F.col("status") == "paused")
    return rows.groupBy(*group).agg(F.when(every, "complete").when(paused, "paused").otherwise("invalid_outputs").alias("status"))


def unpivot_delta(left: DataFrame, right: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    """(key, metric, left, right, delta) of each metric both sides have: a cross-role comparison."""
    long = lambda df, name: df.unpivot([key], metrics, "metric", name).where(F.col(name).isNotNull())
    return long(left, "left").join(long(right, "right"), [key, "metric"]).withColumn("delta", F.col("left") - F.col("right"))


def split_summary(rows: DataFrame) -> DataFrame:
    """Counts in total, by source:language and by source:language:label; null language is 'na'."""
    group = F.concat_ws(":", F.coalesce("source", F.lit("na")), F.coalesce("language", F.lit("na")))
    named = rows.select(group.alias("grp"), F.coalesce("label", F.lit("na")).alias("label"))
    return named.groupingSets([["grp", "label"], ["grp"], []], "grp", "label").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().cast("int").alias("level"))


def best_worst_at(values: DataFrame, keys: list[str], value: str = "val") -> DataFrame:
    """Expected best and worst of n draws with replacement, for n = 2, 4, ... up to each group's size, in closed form.

    Rows: one a response. Output: keys, responses, mean, std (population), n, best, best_std, worst, worst_std. With the
    sorted values x1..xN the best of n is the sum of x_i ((i/N)^n - ((i-1)/N)^n).
    """
    packed = values.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("x"), F.count(value).alias("responses"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    sizes = F.expr("if(responses <= 1, array(), array_distinct(concat(filter(transform(sequence(1, 40), i -> cast(pow(2, i) as bigint)), p -> p < responses), array(responses))))")
    rows = packed.withColumn("n", F.explode_outer(sizes))
    pick = "aggregate(transform(x, (v, i) -> {v} * (pow({hi}, n) - pow({lo}, n))), 0.0D, (s, y) -> s + y)"
    up = {"hi": "(i + 1) / responses", "lo": "i / responses"}
    down = {"hi": "(responses - i) / responses", "lo": "(responses - i - 1) / responses"}
    out = rows.withColumns({"best": F.expr(pick.format(v="v", **up)), "worst": F.expr(pick.format(v="v", **down)), "_b2": F.expr(pick.format(v="v * v", **up)), "_w2": F.expr(pick.format(v="v * v", **down))})
    spread = lambda second, first: F.sqrt(F.greatest(F.col(second) - F.col(first) ** 2, F.lit(0.0)))
    return out.withColumns({"best_std": spread("_b2", "best"), "worst_std": spread("_w2", "worst")}).drop("x", "_b2", "_w2")


def majority_value(rows: DataFrame, keys: list[str], vote: str, value: str, order: str) -> DataFrame:
    """(keys, val): the most frequent vote's first value; the vote seen first wins ties."""
    votes = rows.groupBy(*keys, vote).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct(F.col(order), F.col(value))).alias("f"))
    return votes.groupBy(*keys).agg(F.max(F.struct("c", (-F.col(f"f.{order}")).alias("o"), F.col(f"f.{value}").alias("v"))).alias("x")).select(*keys, F.col("x.v").alias("val"))


def bootstrap(rows: DataFrame, keys: list[str], value: str, n: int, draws: int = 1000, seed: int = 42) -> DataFrame:
    """(keys, best_mean, best_std, worst_mean, worst_std) of seeded resamples of n with replacement, a hash an index.

    A group is a prompt's responses; its draws are arrays of its row, not copies of it.
    """
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.col(value).cast("double"))).alias("x"))
    at = f"transform(sequence(1, {n}), i -> element_at(x, cast(1 + pmod(xxhash64({seed}, d, i, {', '.join(keys)}), size(x)) as int)))"
    drawn = packed.select(*keys, F.expr(f"transform(sequence(1, {draws}), d -> {at})").alias("s")).select(*keys, F.expr("transform(s, v -> array_max(v))").alias("b"), F.expr("transform(s, v -> array_min(v))").alias("w"))
    mean = lambda c: f"aggregate({c}, 0.0D, (a, v) -> a + v) / {draws}"
    first = drawn.withColumns({"best_mean": F.expr(mean("b")), "worst_mean": F.expr(mean("w"))})
    std = lambda c, m: F.expr(f"sqrt(aggregate({c}, 0.0D, (a, v) -> a + (v - {m}) * (v - {m})) / {draws})")
    return first.select(*keys, "best_mean", std("b", "best_mean").alias("best_std"), "worst_mean", std("w", "worst_mean").alias("worst_std"))


def validation_core(metrics: DataFrame) -> DataFrame:
    """``section`` of metric rows (var, name, n, top_n): val-core for the core variable's mean, majority and best at the
    largest n, else val-aux. The core variable is acc where there is one, else reward."""
    core = F.when(F.max((F.col("var") == "acc").cast("int")).over(Window.partitionBy("data_source")) == 1, "acc").otherwise("reward")
    top = F.col("name").rlike("^(mean|maj|best)") & (F.col("n") == F.col("top_n"))
    return metrics.withColumn("section", F.when((F.col("var") == core) & top, "val-core").otherwise("val-aux"))


def reduce_metric(rows: DataFrame, name: str = "name", value: str = "value") -> DataFrame:
    """(name, value): max where the name holds 'max', min where it holds 'min', else the mean."""
    n = F.col(name)
    pick = F.when(n.contains("max"), F.max(value)).when(n.contains("min"), F.min(value)).otherwise(F.avg(value))
    return rows.groupBy(name).agg(pick.alias(value))


def reduce_across_ranks(rows: DataFrame) -> DataFrame:
    """(name, kind, value) of (name, kind, step, rank, value): SUM and MEAN average over ranks a step, then reduce; MIN
    and MAX reduce everything."""
    steps = rows.groupBy("name", "kind", "step").agg(F.avg("value").alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    pick = F.when(F.col("kind") == "SUM", F.sum("m")).when(F.col("kind") == "MEAN", F.avg("m")).when(F.col("kind") == "MIN", F.min("lo")).otherwise(F.max("hi"))
    return steps.groupBy("name", "kind").agg(pick.alias("value"))


def step_metrics(rows: DataFrame) -> DataFrame:
    """(name, value) of (name, step, value, weight) by name rule: last for */step, average where the name holds 'mean' or
    'avg', sum for totals and times, extremes for max and min, else the weighted average."""
    n = F.col("name")
    weighted = F.try_divide(F.sum(F.col("value") * F.col("weight")), F.sum("weight"))
    pick = (
        F.when(n.rlike("(^|/)(global_)?step"), F.max_by("value", "step")).when(n.rlike("avg|mean"), F.avg("value")).when(n.rlike("sum|total|count|time|timing"), F.sum("value"))
        .when(n.contains("max"), F.max("value")).when(n.contains("min"), F.min("value")).otherwise(weighted)
    )
    return rows.groupBy("name").agg(pick.alias("value"))


def length_stats(trajectories: DataFrame, columns: list[str], limit: int | None = None) -> DataFrame:
    """One row of mean, max and min per column, the share of ``length`` at the limit and of length 0 (aborted)."""
    aggs = [f(c).alias(f"{c}_{n}") for c in columns for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))]
    if limit is not None:
        aggs.append(F.avg((F.col("length") >= limit).cast("double")).alias("clip_ratio"))
    return trajectories.agg(*aggs, F.avg((F.col("length") == 0).cast("double")).alias("aborted_ratio"))


def explained_variance(rows: DataFrame, ret: str, value: str) -> DataFrame:
    return rows.agg((1 - F.var_samp(F.col(ret) - F.col(value)) / (F.var_samp(ret) + 1e-5)).alias("explained_variance"))


def percentiles(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """avg, max, min and exact p50, p95, p99 by linear interpolation."""
    return rows.groupBy(*group).agg(F.avg(value).alias("avg"), F.max(value).alias("max"), F.min(value).alias("min"), *(F.percentile(value, p / 100).alias(f"p{p}") for p in (50, 95, 99)))


def partial_rollouts(rows: DataFrame, begin: str, end: str) -> DataFrame:
    """One row: rows that span versions, their share, the longest span, distinct versions at the end."""
    span = F.col(end) - F.col(begin)
    return rows.agg(F.count_if(span > 0).alias("partial"), F.avg((span > 0).cast("double")).alias("ratio"), F.max(span).alias("max_span"), F.count_distinct(end).alias("versions"))


def slowest(rows: DataFrame, group: list[str], value: str, key: str) -> DataFrame:
    """min, max, mean and the row key of the largest value (smallest key wins ties)."""
    return rows.groupBy(*group).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), (-F.max(F.struct(F.col(value), (-F.col(key)).alias("k"))).getField("k")).alias("slowest"))


def token_agreement(rows: DataFrame, a: str, b: str, mask: str) -> DataFrame:
    """One row: Pearson correlation of exp(a) and exp(b), mean, max and deviation of their absolute difference, valid rows only."""
    p, q = F.exp(a), F.exp(b)
    return rows.where(F.col(mask) != 0).agg(F.corr(p, q).alias("pearson"), F.avg(F.abs(p - q)).alias("diff_mean"), F.max(F.abs(p - q)).alias("diff_max"), F.stddev_samp(F.abs(p - q)).alias("diff_std"))


def variance_proxies(tokens: DataFrame, gradient_norm: float | None = None) -> DataFrame:
    """One row: signal, total power, noise, E[A^2] and E[W] from per-trajectory mean advantage and summed energy."""
    m = F.col("mask")
    energy = (1 - 2 * F.exp("old_logp") + F.col("sum_pi_sq")) * m
    seqs = tokens.groupBy("traj_id").agg(masked_mean(F.col("advantage"), m).alias("a"), F.sum(energy).alias("w"))
    signal = F.lit(gradient_norm**2 if gradient_norm is not None else 0.0)
    out = seqs.agg(F.avg(F.col("a") ** 2 * F.greatest("w", F.lit(0.0))).alias("total_power"), F.avg(F.col("a") ** 2).alias("expected_a_squared"), F.avg("w").alias("expected_w"), F.count(F.lit(1)).alias("n"))
    noise = F.greatest((F.col("total_power") - signal) / (F.col("n") - 1), F.lit(0.0)) if gradient_norm is not None else F.lit(0.0)
    return out.select(signal.alias("signal_strength"), "total_power", F.when(F.col("n") > 1, noise).otherwise(0.0).alias("pure_noise"), "expected_a_squared", "expected_w")


def throughput(tokens: Column, seconds: Column, devices: int) -> Column:
    return F.try_divide(tokens, seconds * devices)


def eval_by_source(rows: DataFrame, scores: str) -> DataFrame:
    """(data_source, score): mean over rows of the mean of each row's array of scores."""
    mean = F.aggregate(F.col(scores), F.lit(0.0), lambda s, x: s + x) / F.nullif(F.size(scores), F.lit(0))
    return rows.groupBy("data_source").agg(F.avg(mean).alias("score"))


def accept_ratios(rows: DataFrame, accepted: str, drafted: str, rounds: str) -> DataFrame:
    """One row: mean accept rate and length of speculative decoding; rows that drafted nothing count 0."""
    return rows.agg(F.avg(F.coalesce(F.try_divide(accepted, drafted), F.lit(0.0))).alias("accept_rate"), F.avg(F.coalesce(F.try_divide(accepted, rounds), F.lit(0.0))).alias("accept_length"))


