"""Group-relative advantage estimators over token tables.

Input: tokens (traj_id, uid, pos, reward, mask, ...). A trajectory's score is the unmasked sum of its rewards. Outcome
estimators give (traj_id, uid, advantage), spread over valid tokens by :func:`to_tokens`; the others give token rows.
Estimators are found by name in :data:`ESTIMATORS`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import cut

from .aggregates import group_stats, whiten
from .grouped import streamed_scan

ESTIMATORS: dict[str, Callable[..., DataFrame]] = {}


def estimator(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register an estimator under a name; a name can be taken once."""

    def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in ESTIMATORS:
            raise ValueError(f"estimator {name} exists")
        ESTIMATORS[name] = function
        return function

    return add


def trajectories(tokens: DataFrame) -> DataFrame:
    """(traj_id, uid, score, length) of each trajectory."""
    return tokens.groupBy("traj_id", "uid").agg(F.sum("reward").alias("score"), F.sum("mask").alias("length"))


def _grouped(tokens: DataFrame) -> DataFrame:
    scores = trajectories(tokens)
    return scores.join(group_stats(scores, "uid", "score"), "uid")


def to_tokens(tokens: DataFrame, outcome: DataFrame) -> DataFrame:
    """(traj_id, uid, pos, advantage) with each trajectory's advantage on its valid tokens and 0 elsewhere."""
    joined = tokens.select("traj_id", "pos", "mask").join(outcome, "traj_id")
    return joined.select("traj_id", "uid", "pos", (F.col("advantage") * F.col("mask")).alias("advantage"))


@estimator("grpo")
def grpo(tokens: DataFrame, by_std: bool = True, eps: float = 1e-6) -> DataFrame:
    """(score - mean) / (std + eps) in the group; a group of one keeps its raw score; without the std if asked."""
    lead = F.col("score") - F.col("mean")
    return _grouped(tokens).select("traj_id", "uid", (lead / (F.col("std") + eps) if by_std else lead).alias("advantage"))


ESTIMATORS["grpo_vectorized"] = grpo


@estimator("grpo_passk")
def grpo_passk(tokens: DataFrame, by_std: bool = True, eps: float = 1e-6) -> DataFrame:
    """The best trajectory of a group gets its lead over the second; the rest 0. Ties: the smallest id. Groups of one raise."""
    scores = trajectories(tokens)
    best = scores.groupBy("uid").agg(F.max(F.struct("score", (-F.col("traj_id")).alias("neg"))).alias("b"), F.count(F.lit(1)).alias("n"), F.stddev_samp("score").alias("std"))
    rest = scores.join(best, "uid").where(F.col("traj_id") != -F.col("b.neg")).groupBy("uid").agg(F.max("score").alias("second"))
    joined = scores.join(best.join(rest, "uid", "left"), "uid")
    few = F.raise_error(F.lit("pass@k needs two trajectories a group")).cast("double")
    lead = F.when(F.col("n") < 2, few).otherwise((F.col("score") - F.col("second")) / ((F.col("std") + eps) if by_std else F.lit(1.0)))
    return joined.select("traj_id", "uid", F.when(F.col("traj_id") == -F.col("b.neg"), lead).otherwise(0.0).alias("advantage"))


@estimator("rloo")
def rloo(tokens: DataFrame, alone: str = "score") -> DataFrame:
    """Score against the mean of the others; a group of one keeps its raw score (or 0, see rloo_vectorized)."""
    n = F.col("n")
    only = F.col("score") if alone == "score" else F.lit(0.0)
    return _grouped(tokens).select("traj_id", "uid", F.when(n > 1, F.try_divide(F.col("score") * n - F.col("mean") * n, n - 1)).otherwise(only).alias("advantage"))


@estimator("rloo_vectorized")
def rloo_vectorized(tokens: DataFrame) -> DataFrame:
    """As rloo, but a group of one gets 0."""
    return rloo(tokens, alone="zero")


@estimator("opo")
def opo(tokens: DataFrame) -> DataFrame:
    """Score less the length-weighted mean score of the group; a group of one keeps its raw score."""
    scores = trajectories(tokens)
    base = scores.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.sum(F.col("score") * F.col("length")), F.sum("length")).alias("base"))
    return scores.join(base, "uid").select("traj_id", "uid", (F.col("score") - F.when(F.col("n") > 1, F.col("base")).otherwise(0.0)).alias("advantage"))


@estimator("reinforce_plus_plus_baseline")
def reinforce_pp_baseline(tokens: DataFrame) -> DataFrame:
    """Score less the group mean on valid tokens, whitened over all of them. Token rows."""
    lead = _grouped(tokens).select("traj_id", "uid", (F.col("score") - F.col("mean")).alias("lead"))
    rows = tokens.select("traj_id", "pos", "mask").join(lead, "traj_id")
    white = whiten(rows, "lead", "mask", "white")
    return white.select("traj_id", "uid", "pos", (F.col("white") * F.col("mask")).alias("advantage"))


@estimator("gpg")
def gpg(tokens: DataFrame, f_norm: float = 1.0) -> DataFrame:
    """alpha (score - mean) / f_norm with alpha = trajectories over those with a score other than 0."""
    rows = _grouped(tokens)
    alpha = trajectories(tokens).agg((F.count(F.lit(1)) / F.greatest(F.lit(1), F.count_if(F.col("score") != 0))).alias("alpha"))
    return rows.crossJoin(F.broadcast(alpha)).select("traj_id", "uid", (F.col("alpha") * (F.col("score") - F.col("mean")) / f_norm).alias("advantage"))  # one row


@estimator("gdpo")
def gdpo(tokens: DataFrame, keys: tuple[str, ...] = ("reward", "value"), weights: tuple[float, ...] | None = None) -> DataFrame:
    """grpo per reward column, weighted and summed, then whitened over valid tokens. Token rows."""
    total: DataFrame | None = None
    for key, weight in zip(keys, weights or (1.0,) * len(keys), strict=True):
        part = grpo(tokens.withColumn("reward", F.col(key))).select("traj_id", "uid", (weight * F.col("advantage")).alias("a"))
        total = part if total is None else total.unionByName(part)
    summed = total.groupBy("traj_id", "uid").agg(F.sum("a").alias("lead"))
    white = whiten(tokens.select("traj_id", "pos", "mask").join(summed, "traj_id"), "lead", "mask", "white")
    return white.select("traj_id", "uid", "pos", (F.col("white") * F.col("mask")).alias("advantage"))


@estimator("remax")
def remax(tokens: DataFrame, baselines: DataFrame) -> DataFrame:
    """Masked return to go less the greedy rollout's reward (traj_id, baseline) on valid tokens. Token rows."""
    rows = tokens.withColumn("ret", return_to_go()).join(baselines, "traj_id", "left")
    return rows.select("traj_id", "uid", "pos", (F.col("ret") - F.coalesce("baseline", F.lit(0.0)) * F.col("mask")).alias("advantage"))


def _by_traj(descending: bool = False) -> Window:
    return Window.partitionBy("traj_id").orderBy(F.desc("pos") if descending else F.col("pos"))


def return_to_go() -> Column:
    """Sum of masked rewards from a token to its trajectory's end (a trajectory's length bounds the window)."""
    return F.sum(F.col("reward") * F.col("mask")).over(_by_traj(True).rowsBetween(Window.unboundedPreceding, 0))


def energy() -> Column:
    """Running sum of (1 - 2 pi + sum pi^2) over valid tokens."""
    return F.sum((1 - 2 * F.exp("old_logp") + F.col("sum_pi_sq")) * F.col("mask")).over(_by_traj().rowsBetween(Window.unboundedPreceding, 0))


@estimator("optimal_token_baseline")
def optimal_token_baseline(tokens: DataFrame, compact: bool = False, eps: float = 1e-8, zero_tail: bool = True) -> DataFrame:
    """Return to go less the energy-weighted mean return at the same position of the group. Token rows.

    Groups of one have no baseline. With ``zero_tail`` the single longest trajectory has none beyond the second
    longest. With ``compact`` positions count valid tokens only (the multi-turn variant).
    """
    place = F.sum("mask").over(_by_traj().rowsBetween(Window.unboundedPreceding, 0)) if compact else F.col("pos")
    rows = tokens.withColumn("ret", return_to_go()).withColumn("w", energy()).withColumn("at", place)
    valid = rows.where("mask <> 0")
    base = valid.groupBy("uid", "at").agg((F.sum(F.col("ret") * F.col("w")) / (F.sum("w") + eps)).alias("base"))
    lengths = tokens.groupBy("uid", "traj_id").agg(F.sum("mask").alias("len"))
    if compact:
        lengths = lengths.where("len > 0")
    top = lengths.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.max("len").alias("longest"))
    ties = lengths.join(top, "uid").groupBy("uid").agg(F.count_if(F.col("len") == F.col("longest")).alias("ties"), F.max(F.when(F.col("len") < F.col("longest"), F.col("len"))).alias("second"))
    shape = lengths.join(top, "uid").join(ties, "uid").select("traj_id", "n", ((F.col("ties") == 1) & (F.col("len") == F.col("longest"))).alias("lone"), "second")
    joined = rows.join(base, ["uid", "at"], "left").join(shape, "traj_id", "left")
    cut_off = F.col("lone") & (F.col("at") > F.col("second")) & F.lit(zero_tail)
    baseline = F.when((F.col("n") > 1) & ~F.coalesce(cut_off, F.lit(False)), F.coalesce("base", F.lit(0.0))).otherwise(0.0)
    return joined.select("traj_id", "uid", "pos", ((F.col("ret") - baseline) * F.col("mask")).alias("advantage"))


@estimator("tir_optimal_token_baseline")
def tir_optimal_token_baseline(tokens: DataFrame) -> DataFrame:
    return optimal_token_baseline(tokens, compact=True)


@estimator("gae")
def gae(tokens: DataFrame, gamma: float = 1.0, lam: float = 0.95) -> DataFrame:
    """Generalised advantage estimation; masked tokens carry the next value and advantage on. Token rows with
    ``advantage`` (whitened, unmasked) and ``ret`` (advantage before whitening plus value). Trajectories stream past from
    their last token to their first."""

    def step(state: tuple, mask: int, reward: float, value: float) -> tuple:
        return (reward + gamma * state[1] - value + gamma * lam * state[0], value) if mask else state

    plain = tokens.select("traj_id", "uid", "pos", F.col("mask").cast("int").alias("mask"), F.col("reward").cast("double").alias("reward"), F.col("value").cast("double").alias("value"))
    flat = streamed_scan(plain, "traj_id", "pos", ["mask", "reward", "value"], (0.0, 0.0), step, "adv", descending=True).withColumn("ret", F.col("adv") + F.col("value"))
    # written once: whitening reads it for the statistics and again for the rows
    return whiten(cut(flat), "adv", "mask", "advantage").select("traj_id", "uid", "pos", "advantage", "ret")


@estimator("reinforce_plus_plus")
def reinforce_pp(tokens: DataFrame, gamma: float = 0.9) -> DataFrame:
    """Discounted return, reset after masked tokens, whitened on valid ones. Token rows with ``advantage`` and ``ret``."""

    def step(state: tuple, mask: int, reward: float) -> tuple:
        ret = reward + gamma * state[1]
        return ret, ret * mask

    plain = tokens.select("traj_id", "uid", "pos", F.col("mask").cast("int").alias("mask"), F.col("reward").cast("double").alias("reward"))
    flat = streamed_scan(plain, "traj_id", "pos", ["mask", "reward"], (0.0, 0.0), step, "ret", descending=True)
    return whiten(cut(flat), "ret", "mask", "white").select("traj_id", "uid", "pos", (F.col("white") * F.col("mask")).alias("advantage"), "ret")


@estimator("multi_trajectory")
def multi_trajectory(outputs: DataFrame) -> DataFrame:
    """grpo on the last output of each session, given to all its outputs.

    ``outputs``: (session, uid, step, score). Output: (session, uid, step, advantage).
    """
    final = outputs.groupBy("session", "uid").agg(F.max(F.struct("step", "score")).alias("x")).select("session", "uid", F.col("x.score").alias("score"))
    led = final.join(group_stats(final, "uid", "score"), "uid").select("session", "uid", ((F.col("score") - F.col("mean")) / (F.col("std") + 1e-6)).alias("advantage"))
    return outputs.select("session", "uid", "step").join(led, ["session", "uid"])
