"""Per-token objective values over token tables: policy losses, KL estimators, value and entropy losses.

Input columns: traj_id, pos, mask, advantage, logp, old_logp (and what a loss names). A policy loss adds ``loss`` and,
where it has them, ``clipped`` and ``clipped_low`` flags per token; :func:`policy_metrics` reduces them. Forward values
only. Losses are found by name in :data:`LOSSES`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .aggregates import EPS, loss_mean, masked_mean
from .ordering import global_row_index, seeded_key

LOSSES: dict[str, Callable[..., DataFrame]] = {}


def policy_loss(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a loss under a name; a name can be taken once."""

    def add(function: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if name in LOSSES:
            raise ValueError(f"loss {name} exists")
        LOSSES[name] = function
        return function

    return add


def clamp(value: Column, low: float | None, high: float | None) -> Column:
    out = value if high is None else F.least(value, F.lit(float(high)))
    return out if low is None else F.greatest(out, F.lit(float(low)))


def _log_ratio(safe: bool = True) -> Column:
    ratio = F.col("logp") - F.col("old_logp")
    return clamp(ratio, -20, 20) if safe else ratio


@policy_loss("vanilla")
def vanilla(tokens: DataFrame, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> DataFrame:
    """Dual-clip PPO: the worse of the plain and the clipped surrogate, bounded by ``dual`` for negative advantages."""
    a, ratio = F.col("advantage"), F.exp(_log_ratio())
    plain, held, bound = -a * ratio, -a * clamp(ratio, 1 - low, 1 + high), -a * dual
    worse = F.greatest(plain, held)
    return tokens.withColumns(
        {"loss": F.when(a < 0, F.least(bound, worse)).otherwise(worse), "clipped": (held > plain).cast("double"), "clipped_low": ((worse > bound) & (a < 0)).cast("double"), "kl": -_log_ratio()}
    )


def _dppo(tokens: DataFrame, inside: Column, bound: float) -> DataFrame:
    ratio = F.exp(_log_ratio())
    valid = inside.cast("double")
    loss = -F.col("advantage") * clamp(ratio, None, bound) * F.col("logp") * valid
    return tokens.withColumns({"loss": loss, "clipped": 1 - valid, "clipped_low": (ratio > bound).cast("double") * valid, "kl": -_log_ratio()})


@policy_loss("dppo_tv")
def dppo_tv(tokens: DataFrame, low: float = 0.2, high: float = 0.2, bound: float = 20.0) -> DataFrame:
    """Tokens whose probability moved further than allowed in the advantage's direction are dropped."""
    moved = F.exp("logp") - F.exp("old_logp")
    return _dppo(tokens, F.when(F.col("advantage") > 0, moved <= high).otherwise(moved >= -low), bound)


@policy_loss("dppo_kl")
def dppo_kl(tokens: DataFrame, low: float = 0.2, high: float = 0.2, bound: float = 20.0) -> DataFrame:
    """As dppo_tv with the binary KL divergence of the two probabilities."""
    new, old = F.exp("logp"), F.exp("old_logp")
    divergence = old * (F.col("old_logp") - F.col("logp")) + (1 - old) * F.log((1 - old + EPS) / (1 - new + EPS))
    up, down = (divergence <= high) | (new <= old), (divergence <= low) | (new >= old)
    return _dppo(tokens, F.when(F.col("advantage") > 0, up).otherwise(down), bound)


@policy_loss("gspo")
def gspo(tokens: DataFrame, low: float = 0.0003, high: float = 0.0004) -> DataFrame:
    """One ratio a sequence: exp of the mean log ratio (at most 10), clipped. Reduced as seq-mean-token-mean."""
    ratio = F.col("logp") - F.col("old_logp")
    seq = tokens.groupBy("traj_id").agg((F.sum(ratio * F.col("mask")) / F.greatest(F.sum("mask"), F.lit(1))).alias("_seq"))
    a, s = F.col("advantage"), F.exp(clamp(F.col("_seq"), None, 10))
    plain, held = -a * s, -a * clamp(s, 1 - low, 1 + high)
    return tokens.join(seq, "traj_id").withColumns({"loss": F.greatest(plain, held), "clipped": (held > plain).cast("double"), "clipped_low": F.lit(0.0), "kl": -ratio}).drop("_seq")


@policy_loss("sapo")
def sapo(tokens: DataFrame, tau_pos: float = 1.0, tau_neg: float = 1.05) -> DataFrame:
    """A smooth gate in place of the clip: 4 / tau x sigmoid(tau (ratio - 1))."""
    tau = F.when(F.col("advantage") > 0, tau_pos).otherwise(tau_neg)
    gate = 4.0 / tau / (1 + F.exp(-tau * (F.exp(_log_ratio()) - 1)))
    return tokens.withColumns({"loss": -gate * F.col("advantage"), "clipped": F.lit(0.0), "clipped_low": F.lit(0.0), "kl": -_log_ratio()})


@policy_loss("gpg")
def gpg(tokens: DataFrame) -> DataFrame:
    return tokens.withColumn("loss", -F.col("logp") * F.col("advantage"))


@policy_loss("reinforce")
def reinforce(tokens: DataFrame) -> DataFrame:
    """-logp x advantage, weighted by ``is_weight`` where the tokens have one (the bypass mode's objective)."""
    weight = F.col("is_weight") if "is_weight" in tokens.columns else F.lit(1.0)
    return tokens.withColumns({"loss": -F.col("logp") * F.col("advantage") * weight, "kl": -_log_ratio(False)})


@policy_loss("cispo")
def cispo(tokens: DataFrame, low: float = 0.2, high: float = 0.2) -> DataFrame:
    ratio = F.exp(_log_ratio())
    held = clamp(ratio, 1 - low, 1 + high)
    return tokens.withColumns({"loss": -held * F.col("advantage") * F.col("logp"), "clipped": (ratio != held).cast("double"), "clipped_low": F.lit(0.0), "kl": -_log_ratio()})


def _covariance(tokens: DataFrame) -> DataFrame:
    """tokens with ``cov``: product of advantage and logp, each less its masked mean."""
    m = F.col("mask")
    means = tokens.agg(masked_mean(F.col("advantage"), m).alias("_ma"), masked_mean(F.col("logp"), m).alias("_ml"))
    both = tokens.crossJoin(F.broadcast(means))  # one row
    return both.withColumn("cov", (F.col("advantage") - F.col("_ma")) * (F.col("logp") - F.col("_ml"))).drop("_ma", "_ml")


def _count(tokens: DataFrame, ratio: float) -> int:
    return max(1, int(ratio * (tokens.agg(F.sum("mask").alias("n")).first()["n"] or 0)))


@policy_loss("kl_cov")
def kl_cov(tokens: DataFrame, key: str = "token_id", ratio: float = 0.0002, coef: float = 1.0) -> DataFrame:
    """The share ``ratio`` of valid tokens of highest covariance (ties: smallest key) gets coef x |log ratio| on top."""
    r = _log_ratio(False)
    rows = _covariance(tokens)
    ranked = global_row_index(rows.where("mask > 0").select(key, (-F.col("cov")).alias("_order")), ["_order", key])
    top = ranked.where(F.col("row_idx") < _count(tokens, ratio)).select(key, F.lit(1.0).alias("_top"))
    plain = -F.col("advantage") * F.exp(r)
    return rows.join(top, key, "left").withColumns({"loss": plain + F.coalesce("_top", F.lit(0.0)) * coef * F.abs(r), "kl": F.abs(r)}).drop("_top", "cov")


@policy_loss("clip_cov")
def clip_cov(tokens: DataFrame, key: str = "token_id", ratio: float = 0.0002, low: float = 0.2, high: float = 0.2, band: tuple[float, float] = (1.0, 5.0), seed: int = 42) -> DataFrame:
    """PPO clip; a seeded choice of unclipped valid tokens with covariance inside ``band`` is dropped."""
    r = _log_ratio(False)
    plain, held = -F.col("advantage") * F.exp(r), -F.col("advantage") * clamp(F.exp(r), 1 - low, 1 + high)
    rows = _covariance(tokens).withColumns({"_plain": plain, "_held": held})
    inside = rows.where((F.col("mask") > 0) & ~(F.col("_held") > F.col("_plain")) & (F.col("cov") > band[0]) & (F.col("cov") < band[1]))
    ranked = global_row_index(inside.select(key, seeded_key(seed, key).alias("_order")), ["_order", key])
    drop = ranked.where(F.col("row_idx") < _count(tokens, ratio)).select(key, F.lit(0.0).alias("_keep"))
    keep = F.coalesce("_keep", F.lit(1.0))
    return rows.join(drop, key, "left").withColumns({"loss": F.greatest("_plain", "_held") * keep, "clipped": 1 - keep, "clipped_low": F.lit(0.0), "kl": -r}).drop("_keep", "_plain", "_held", "cov")


def geo_mean(tokens: DataFrame, low: float = 0.4, high: float = 0.4) -> DataFrame:
    """One row (loss, clipped, clipped_low, kl): the geometric-mean objective of whole sequences, plain mean over them."""
    r, a, m = _log_ratio(False), F.col("advantage"), F.col("mask")
    held = clamp(r, -low, high)
    sign = F.signum(a)
    worst = sign * F.least(sign * r, sign * held)
    seqs = tokens.groupBy("traj_id").agg((F.sum(worst * m) / (F.sum(m) + F.lit(EPS))).alias("r"), (F.sum(a * m) / (F.sum(m) + F.lit(EPS))).alias("a"))
    out = (r != held).cast("double")
    flags = tokens.agg(
        masked_mean(out * (a > 0).cast("double"), m).alias("clipped"), masked_mean(out * (a < 0).cast("double"), m).alias("clipped_low"), masked_mean(-r, m).alias("kl")
    )
    return seqs.agg(F.avg(-F.col("a") * F.exp("r")).alias("loss")).crossJoin(F.broadcast(flags))  # one row each


def policy_metrics(scored: DataFrame, mode: str = "token-mean") -> DataFrame:
    """One row: the reduced loss and the masked means of whatever flags the loss left on its tokens."""
    names = [c for c in ("clipped", "clipped_low", "kl") if c in scored.columns]
    loss = loss_mean(scored, mode)
    if not names:
        return loss
    flags = scored.agg(*(masked_mean(F.col(c), F.col("mask")).alias(c) for c in names))
    return loss.crossJoin(F.broadcast(flags))  # one row each


def kl_estimate(kind: str, new: Column, ref: Column) -> Column:
    """k1 (or kl), abs, k2 (or mse), k3 (or low_var_kl) of log-probabilities; a '+' suffix changes gradients only."""
    diff = new - ref
    kind = kind.removesuffix("+")
    if kind in ("k1", "kl"):
        return diff
    if kind == "abs":
        return F.abs(diff)
    if kind in ("k2", "mse"):
        return 0.5 * diff * diff
    if kind in ("k3", "low_var_kl"):
        back = clamp(-diff, -20, 20)
        return clamp(F.exp(back) - back - 1, -10, 10)
    raise ValueError(f"unknown estimator {kind}")


def penalised_reward(tokens: DataFrame, beta: float, kind: str = "k1") -> DataFrame:
    """``reward`` less beta x KL of old to reference log-probabilities on valid tokens."""
    return tokens.withColumn("reward", F.col("reward") - beta * kl_estimate(kind, F.col("old_logp"), F.col("ref_logp")) * F.col("mask"))


def value_loss(tokens: DataFrame, clip: float = 0.5, mode: str = "token-mean") -> DataFrame:
    """One row (loss, clipped): half the worse squared error of the new value and of it held near the old one."""
    held = F.greatest(F.least(F.col("vpred"), F.col("value") + clip), F.col("value") - clip)
    free, tied = (F.col("vpred") - F.col("ret")) ** 2, (held - F.col("ret")) ** 2
    rows = tokens.withColumns({"loss": F.greatest(free, tied), "clipped": (tied > free).cast("double")})
    reduced = loss_mean(rows, mode).select((0.5 * F.col("loss")).alias("loss"))
    return reduced.crossJoin(F.broadcast(rows.agg(masked_mean(F.col("clipped"), F.col("mask")).alias("clipped"))))  # one row each


def entropy(logits: Column) -> Column:
    """Entropy of a softmax over an array of logits, inside the JVM."""
    top = F.array_max(logits)
    z = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.log(z) + top - F.aggregate(logits, F.lit(0.0), lambda s, x: s + x * F.exp(x - top)) / z


def log_prob_at(logits: Column, place: Column) -> Column:
    """Log-softmax of an array of logits at a 0-based place."""
    top = F.array_max(logits)
    return F.element_at(logits, place + 1) - top - F.log(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def sum_pi_squared(logits: Column) -> Column:
    """Sum of squared softmax probabilities."""
    top = F.array_max(logits)
    z = F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(2 * (x - top))) / (z * z)


def top_k_forward_kl(teacher: Column, student: Column) -> Column:
    """Sum of p (log p - log q) over aligned arrays of the teacher's top log-probabilities and the student's."""
    return F.aggregate(F.zip_with(teacher, student, lambda p, q: F.exp(p) * (p - q)), F.lit(0.0), lambda s, x: s + x)


def learning_rate(step: Column, kind: str, warmup: int, total: int, floor: float = 0.0, cycles: float = 0.5, stable: float = 0.9) -> Column:
    """Factor of the peak rate at a step: 'constant', 'cosine' or 'wsd' (warm-up, stable, decay)."""
    warm = step / F.lit(float(max(1, warmup)))
    if kind == "constant":
        return F.when(step < warmup, warm).otherwise(1.0)
    if kind == "cosine":
        done = (step - warmup) / F.lit(float(max(1, total - warmup)))
        wave = 0.5 * (1 + F.cos(F.lit(3.141592653589793) * cycles * 2 * done))
        return F.when(step < warmup, warm).otherwise(F.greatest(F.lit(floor), wave * (1 - floor) + floor))
    if kind == "wsd":
        hold = int((total - warmup) * stable)
        done = (step - warmup - hold) / F.lit(float(max(1, total - warmup - hold)))
        wave = 0.5 * (1 + F.cos(F.lit(3.141592653589793) * cycles * 2 * done))
        return F.when(step < warmup, warm).when(step < warmup + hold, 1.0).when(step < total, F.greatest(F.lit(floor), (1 - floor) * wave + floor)).otherwise(floor)
    raise ValueError(f"unknown schedule {kind}")


def adaptive_kl(steps: DataFrame, start: float, target: float, horizon: float, order: str = "step", group: str | None = None) -> DataFrame:
    """``coef`` after each step: start x product of 1 + clip(kl / target - 1, 0.2) n / horizon (a running sum of logs).

    A row is a training step (of a ``group``, if there are several runs), so the window is as long as a training.
    """
    w = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    factor = 1 + clamp(F.col("kl") / target - 1, -0.2, 0.2) * F.col("n") / horizon
    return steps.withColumn("coef", F.lit(start) * F.exp(F.sum(F.log(factor)).over(w)))
