"""Queries of objective and off-policy operators over the token table, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import aggregates, objective, offpolicy
from millrace.session import table

from .common import Book, rounded
from .rollout import TOKENS, tokens

BOOK = Book(TOKENS)


def _tok(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).withColumn("token_id", F.col("traj_id") * 1000 + F.col("pos"))


def _metrics(scored: DataFrame, mode: str = "token-mean") -> DataFrame:
    out = objective.policy_metrics(scored, mode)
    return rounded(out, *out.columns)


_MEAN = "coalesce(sum(CASE WHEN mask <> 0 THEN ({}) * mask END), 0) / (sum(mask) + 1e-8)"
_R = "least(greatest(logp - old_logp, -20), 20)"


def _clip(x: str, low: float, high: float) -> str:
    return f"greatest(least({x}, {1 + high}), {1 - low})"


def _loss_sql(loss: str, clipped: str | None = None, low: str | None = None, kl: str | None = None, source: str = "tok") -> str:
    flags = "".join(f", R({_MEAN.format(x)}) AS {n}" for n, x in (("clipped", clipped), ("clipped_low", low), ("kl", kl)) if x)
    return f"SELECT R(sum(CASE WHEN mask <> 0 THEN ({loss}) * mask END) / sum(mask)) AS loss{flags} FROM {source}"


_held = f"-advantage * {_clip(f'exp({_R})', 0.2, 0.2)}"
_plain = f"-advantage * exp({_R})"
BOOK.add(
    "l1_vanilla_ppo",
    lambda s, d: _metrics(objective.vanilla(tokens(s, d))),
    ", v AS (SELECT *, greatest({p}, {h}) AS w FROM tok) ".format(p=_plain, h=_held)
    + _loss_sql("CASE WHEN advantage < 0 THEN least(-advantage * 3.0, w) ELSE w END", f"({_held} > {_plain})::DOUBLE", "(w > -advantage * 3.0 AND advantage < 0)::DOUBLE", f"-{_R}", "v"),
)
_valid = "(CASE WHEN advantage > 0 THEN {up} ELSE {down} END)::INT"
for _name, _up, _down in (
    ("dppo_tv", "exp(logp) - exp(old_logp) <= 0.2", "exp(logp) - exp(old_logp) >= -0.2"),
    (
        "dppo_kl",
        "exp(old_logp) * (old_logp - logp) + (1 - exp(old_logp)) * ln((1 - exp(old_logp) + 1e-8) / (1 - exp(logp) + 1e-8)) <= 0.2 OR exp(logp) <= exp(old_logp)",
        "exp(old_logp) * (old_logp - logp) + (1 - exp(old_logp)) * ln((1 - exp(old_logp) + 1e-8) / (1 - exp(logp) + 1e-8)) <= 0.2 OR exp(logp) >= exp(old_logp)",
    ),
):
    _v = _valid.format(up=_up, down=_down)
    _run = objective.LOSSES[_name]
    BOOK.add(
        f"l{2 if _name == 'dppo_tv' else 3}_{_name}",
        # probabilities above 1 cannot happen with log-probabilities; the stand-in's are capped at -0.001
        lambda s, d, run=_run: _metrics(run(tokens(s, d).withColumn("logp", F.least("logp", F.lit(-0.001))).withColumn("old_logp", F.least("old_logp", F.lit(-0.001))))),
        ", c AS (SELECT * REPLACE (least(logp, -0.001) AS logp, least(old_logp, -0.001) AS old_logp) FROM tok) "
        + _loss_sql(f"-advantage * least(exp({_R}), 20.0) * logp * {_v}", f"1 - {_v}", f"(exp({_R}) > 20.0)::INT * {_v}", f"-{_R}", "c"),
    )
BOOK.add(
    "l4_gspo",
    lambda s, d: _metrics(objective.gspo(tokens(s, d)), "seq-mean-token-mean"),
    """, q AS (SELECT traj_id, exp(least(sum((logp - old_logp) * mask) / greatest(sum(mask), 1), 10)) AS s FROM tok GROUP BY traj_id
    ), v AS (SELECT tok.*, -advantage * s AS p, -advantage * greatest(least(s, 1.0004), 0.9997) AS h FROM tok JOIN q ON tok.traj_id = q.traj_id
    ), z AS (SELECT traj_id, sum(greatest(p, h) * mask) / (sum(mask) + 1e-8) AS l, sum(mask) AS m FROM v GROUP BY traj_id)
    SELECT R((SELECT sum(l) FILTER (m > 0) / count(*) FILTER (m > 0) FROM z)) AS loss, """
    + f"R({_MEAN.format('(h > p)::INT')}) AS clipped, R(0.0) AS clipped_low, R({_MEAN.format('old_logp - logp')}) AS kl FROM v",
)
_tau = "(CASE WHEN advantage > 0 THEN 1.0 ELSE 1.05 END)"
BOOK.add("l5_sapo", lambda s, d: _metrics(objective.sapo(tokens(s, d))), _loss_sql(f"-(4.0 / {_tau} / (1 + exp(-{_tau} * (exp({_R}) - 1)))) * advantage", "0.0", "0.0", f"-{_R}"))
BOOK.add("l6_gpg", lambda s, d: _metrics(objective.gpg(tokens(s, d))), _loss_sql("-logp * advantage"))
BOOK.add("l10_cispo", lambda s, d: _metrics(objective.cispo(tokens(s, d))), _loss_sql(f"-{_clip(f'exp({_R})', 0.2, 0.2)} * advantage * logp", f"(exp({_R}) <> {_clip(f'exp({_R})', 0.2, 0.2)})::INT", "0.0", f"-{_R}"))
_COV = """, c AS (SELECT *, traj_id * 1000 + pos AS token_id, (advantage - (SELECT sum(advantage * mask) / (sum(mask) + 1e-8) FROM tok)) * (logp - (SELECT sum(logp * mask) / (sum(mask) + 1e-8) FROM tok)) AS cov FROM tok
    ), k AS (SELECT greatest(1, floor({ratio} * sum(mask)))::BIGINT AS k FROM tok)"""
BOOK.add(
    "l8_kl_cov",
    lambda s, d: _metrics(objective.kl_cov(_tok(s, d), ratio=0.02)),
    _COV.format(ratio=0.02) + ", t AS (SELECT token_id FROM (SELECT token_id, row_number() OVER (ORDER BY cov DESC, token_id) AS n FROM c WHERE mask > 0), k WHERE n <= k) "
    + _loss_sql("-advantage * exp(logp - old_logp) + CASE WHEN token_id IN (SELECT token_id FROM t) THEN abs(logp - old_logp) ELSE 0 END", None, None, "abs(logp - old_logp)", "c"),
)
_h0, _p0 = "-advantage * greatest(least(exp(logp - old_logp), 1.2), 0.8)", "-advantage * exp(logp - old_logp)"
BOOK.add(
    "l7_clip_cov",
    lambda s, d: _metrics(objective.clip_cov(_tok(s, d), ratio=0.02, band=(0.01, 0.1))),
    _COV.format(ratio=0.02) + f""", t AS (SELECT token_id FROM (SELECT token_id, row_number() OVER (ORDER BY md5('42:' || token_id), token_id) AS n FROM c
      WHERE mask > 0 AND NOT ({_h0} > {_p0}) AND cov > 0.01 AND cov < 0.1), k WHERE n <= k), v AS (SELECT *, (token_id NOT IN (SELECT token_id FROM t))::INT AS keep FROM c) """
    + _loss_sql(f"greatest({_p0}, {_h0}) * keep", "1 - keep", "0.0", "old_logp - logp", "v"),
)
BOOK.add(
    "l9_geo_mean",
    lambda s, d: rounded(objective.geo_mean(tokens(s, d)), "loss", "clipped", "clipped_low", "kl"),
    """, v AS (SELECT *, logp - old_logp AS r, greatest(least(logp - old_logp, 0.4), -0.4) AS h, sign(advantage) AS g FROM tok
    ), q AS (SELECT traj_id, sum(g * least(g * r, g * h) * mask) / (sum(mask) + 1e-8) AS r, sum(advantage * mask) / (sum(mask) + 1e-8) AS a FROM v GROUP BY traj_id)
    SELECT R((SELECT avg(-a * exp(r)) FROM q)) AS loss, """
    + f"R({_MEAN.format('(r <> h AND advantage > 0)::INT')}) AS clipped, R({_MEAN.format('(r <> h AND advantage < 0)::INT')}) AS clipped_low, R({_MEAN.format('-r')}) AS kl FROM v",
)
BOOK.add(
    "l11_bypass_reinforce",
    lambda s, d: _metrics(objective.reinforce(offpolicy.importance_weights(tokens(s, d))).drop("is_raw")),
    f", v AS (SELECT *, least(exp(least(greatest(old_logp - rollout_logp, -20), 20)) * mask, 2.0) AS w FROM tok) {_loss_sql('-logp * advantage * w', None, None, 'old_logp - logp', 'v')}",
)
BOOK.add(
    "l12_value_loss",
    lambda s, d: rounded(objective.value_loss(tokens(s, d).withColumns({"vpred": F.col("value") * 30, "ret": F.col("reward") * 10})), "loss", "clipped"),
    """, v AS (SELECT mask, pow(value * 30 - reward * 10, 2) AS f, pow(greatest(least(value * 30, value + 0.5), value - 0.5) - reward * 10, 2) AS t FROM tok)
    SELECT R(0.5 * sum(greatest(f, t) * mask) / sum(mask)) AS loss, """
    + f"R({_MEAN.format('(t > f)::INT')}) AS clipped FROM v",
)
_SEQ = ", z AS (SELECT traj_id, sum(logp * advantage * mask) AS s, sum(mask) AS m, count(*) AS w FROM tok GROUP BY traj_id) SELECT "
BOOK.add(
    "a15_loss_modes",
    lambda s, d: rounded(
        (lambda t: aggregates.loss_mean(t, "token-mean").withColumnRenamed("loss", "token_mean")
         .crossJoin(aggregates.loss_mean(t, "seq-mean-token-sum").withColumnRenamed("loss", "seq_sum"))
         .crossJoin(aggregates.loss_mean(t, "seq-mean-token-sum-norm").withColumnRenamed("loss", "seq_norm"))
         .crossJoin(aggregates.loss_mean(t, "seq-mean-token-mean").withColumnRenamed("loss", "seq_mean")))(tokens(s, d).withColumn("loss", F.col("logp") * F.col("advantage"))),
        "token_mean", "seq_sum", "seq_norm", "seq_mean"),
    _SEQ + "R(sum(s) / sum(m)) AS token_mean, R(sum(s) FILTER (m > 0) / count(*) FILTER (m > 0)) AS seq_sum, R(sum(s) FILTER (m > 0) / count(*) FILTER (m > 0) / max(w)) AS seq_norm, R(sum(s / (m + 1e-8)) FILTER (m > 0) / count(*) FILTER (m > 0)) AS seq_mean FROM z",
)
_KL = {"k1": "logp - old_logp", "abs": "abs(logp - old_logp)", "k2": "0.5 * pow(logp - old_logp, 2)", "k3": "least(greatest(exp(least(greatest(old_logp - logp, -20), 20)) - least(greatest(old_logp - logp, -20), 20) - 1, -10), 10)"}
BOOK.add(
    "m1_kl_estimates",
    lambda s, d: rounded(tokens(s, d).select("traj_id", "pos", *(objective.kl_estimate(k, F.col("logp"), F.col("old_logp")).alias(k) for k in _KL)), *_KL),
    "SELECT traj_id, pos, " + ", ".join(f"R({x}) AS {k}" for k, x in _KL.items()) + " FROM tok",
)
BOOK.add(
    "m2_kl_penalised_reward",
    lambda s, d: rounded(objective.penalised_reward(tokens(s, d).withColumn("ref_logp", F.col("rollout_logp")), 0.1).select("traj_id", "pos", "reward"), "reward"),
    "SELECT traj_id, pos, R(reward - 0.1 * (old_logp - rollout_logp) * mask) AS reward FROM tok",
)
BOOK.add(
    "r3_rejection_mask",
    lambda s, d: offpolicy.rejection_mask(tokens(s, d), "token_k1,seq_mean_k3,seq_max_k2", "0.9_1.1,0.02,0.02").select("traj_id", "pos", F.col("keep").cast("int").alias("keep")),
    """, v AS (SELECT *, least(greatest(old_logp - rollout_logp, -20), 20) AS r FROM tok
    ), q AS (SELECT traj_id, coalesce(sum(CASE WHEN mask <> 0 THEN (exp(r) - 1 - r) * mask END), 0) / (sum(mask) + 1e-8) AS k3, coalesce(max(CASE WHEN mask <> 0 THEN 0.5 * r * r END), 0) AS k2 FROM v GROUP BY traj_id)
    SELECT v.traj_id, pos, (mask * (-r >= ln(0.9) AND -r <= ln(1.1) AND k3 <= 0.02 AND k2 <= 0.02)::INT)::INT AS keep FROM v JOIN q ON v.traj_id = q.traj_id""",
)
for _n, _t, _sql in (("token", 1.05, "least(exp(r) * mask, 1.05)"), ("icepop", "0.95_1.05", "CASE WHEN exp(r) * mask BETWEEN 0.95 AND 1.05 THEN exp(r) * mask ELSE 0 END")):
    BOOK.add(
        f"r4_weights_{_n}",
        lambda s, d, t=_t: rounded(offpolicy.importance_weights(tokens(s, d), "token", t).select("traj_id", "pos", "is_weight"), "is_weight"),
        f", v AS (SELECT *, least(greatest(old_logp - rollout_logp, -20), 20) AS r FROM tok) SELECT traj_id, pos, R({_sql}) AS is_weight FROM v",
    )
BOOK.add(
    "r4_weights_sequence_normalised",
    lambda s, d: rounded(offpolicy.importance_weights(tokens(s, d), "sequence", 2.0, True).select("traj_id", "pos", "is_weight"), "is_weight"),
    """, q AS (SELECT traj_id, exp(least(greatest(sum((old_logp - rollout_logp) * mask), -20), 20)) AS w, sum(mask) AS m FROM tok GROUP BY traj_id
    ), v AS (SELECT tok.traj_id, pos, mask, m, least(w * mask, 2.0) AS w FROM tok JOIN q ON tok.traj_id = q.traj_id
    ), s AS (SELECT traj_id, sum(w * mask) / (sum(mask) + 1e-8) AS w, any_value(m) AS m FROM v GROUP BY traj_id
    ), mean AS (SELECT sum(w) FILTER (m > 0) / count(*) FILTER (m > 0) AS mean FROM s)
    SELECT traj_id, pos, R(w / mean) AS is_weight FROM v, mean""",
)
_W = ["mean", "max", "min", "fraction_high", "fraction_low", "seq_mean", "seq_std", "seq_max", "seq_min", "seq_max_deviation", "seq_fraction_high", "seq_fraction_low", "std", "eff_sample_size"]
BOOK.add(
    "a38_weight_metrics",
    lambda s, d: rounded(offpolicy.weight_metrics(offpolicy.importance_weights(tokens(s, d), "token", 1.1), 1.1), *_W),
    f""", v AS (SELECT *, exp(least(greatest(old_logp - rollout_logp, -20), 20)) * mask AS raw, least(exp(least(greatest(old_logp - rollout_logp, -20), 20)) * mask, 1.1) AS w FROM tok
    ), q AS (SELECT traj_id, coalesce(sum(w * mask), 0) / (sum(mask) + 1e-8) AS s FROM v GROUP BY traj_id
    ), s AS (SELECT R(avg(s)) AS seq_mean, R(stddev_samp(s)) AS seq_std, R(max(s)) AS seq_max, R(min(s)) AS seq_min, R(max(abs(s - 1))) AS seq_max_deviation,
      R(avg((s > 1.1)::INT)) AS seq_fraction_high, R(avg((s < 1 / 1.1)::INT)) AS seq_fraction_low FROM q
    ), t AS (SELECT {_MEAN.format("w")} AS h, {_MEAN.format("w * w")} AS h2, R({_MEAN.format("w")}) AS mean, R(max(CASE WHEN mask <> 0 THEN w END)) AS max, R(min(CASE WHEN mask <> 0 THEN w END)) AS min,
      R({_MEAN.format("(raw > 1.1)::INT")}) AS fraction_high, R({_MEAN.format("(raw < 1 / 1.1)::INT")}) AS fraction_low FROM v)
    SELECT t.* EXCLUDE (h, h2), s.*, R(sqrt(greatest(h2 - h * h, 0))) AS std, R(pow(h + 1e-8, 2) / h2) AS eff_sample_size FROM t, s""",
)
_P = ["training_ppl", "training_log_ppl", "rollout_ppl", "rollout_log_ppl", "log_ppl_diff", "log_ppl_abs_diff", "log_ppl_diff_max", "log_ppl_diff_min", "ppl_ratio", "chi2_seq", "kl", "k3_kl", "chi2_token"]
BOOK.add(
    "a37_offpolicy_metrics",
    lambda s, d: rounded(offpolicy.offpolicy_metrics(tokens(s, d)), *_P),
    f""", q AS (SELECT traj_id, sum(old_logp * mask) / (sum(mask) + 1e-8) AS o, sum(rollout_logp * mask) / (sum(mask) + 1e-8) AS r, sum((old_logp - rollout_logp) * mask) AS s FROM tok GROUP BY traj_id
    ), a AS (SELECT R(avg(exp(-o))) AS training_ppl, R(avg(-o)) AS training_log_ppl, R(avg(exp(-r))) AS rollout_ppl, R(avg(-r)) AS rollout_log_ppl, R(avg(r - o)) AS log_ppl_diff, R(avg(abs(r - o))) AS log_ppl_abs_diff,
      R(max(r - o)) AS log_ppl_diff_max, R(min(r - o)) AS log_ppl_diff_min, R(avg(exp(r - o))) AS ppl_ratio, R(avg(exp(2 * least(greatest(s, -20), 20))) - 1) AS chi2_seq FROM q
    ), b AS (SELECT R({_MEAN.format("rollout_logp - old_logp")}) AS kl, R({_MEAN.format("exp(old_logp - rollout_logp) - (old_logp - rollout_logp) - 1")}) AS k3_kl,
      R({_MEAN.format("exp(2 * least(greatest(old_logp - rollout_logp, -20), 20))")} - 1) AS chi2_token FROM tok)
    SELECT a.*, b.* FROM a, b""",
)
BOOK.add(
    "a39_rejection_metrics",
    lambda s, d: rounded(offpolicy.rejection_metrics(tokens(s, d), "token_k1,token_k3", "0.9_1.1,0.01"), "mean", "max", "min", "rejected"),
    f""", v AS (SELECT mask, least(greatest(old_logp - rollout_logp, -20), 20) AS r FROM tok)
    SELECT 'token_k1' AS option, R({_MEAN.format("-r")}) AS mean, R(max(CASE WHEN mask <> 0 THEN -r END)) AS max, R(min(CASE WHEN mask <> 0 THEN -r END)) AS min, R({_MEAN.format("(NOT (-r >= ln(0.9) AND -r <= ln(1.1)))::INT")}) AS rejected FROM v
    UNION ALL SELECT 'token_k3', R({_MEAN.format("exp(r) - 1 - r")}), R(max(CASE WHEN mask <> 0 THEN exp(r) - 1 - r END)), R(min(CASE WHEN mask <> 0 THEN exp(r) - 1 - r END)), R({_MEAN.format("(NOT exp(r) - 1 - r <= 0.01)::INT")}) FROM v""",
)
def _logits(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))


QUERIES, SQL = BOOK.queries, BOOK.sql
PLAIN = Book()
PLAIN.add(
    "m7_softmax_stats",
    lambda s, d: rounded(
        _logits(s, d).select("vec_id", objective.entropy(F.col("x")).alias("entropy"), objective.log_prob_at(F.col("x"), F.lit(3)).alias("logp"), objective.sum_pi_squared(F.col("x")).alias("sum_pi_sq")), "entropy", "logp", "sum_pi_sq"
    ),
    """WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(64)) AS i FROM embeddings), z AS (SELECT vec_id, max(x) AS m FROM e GROUP BY vec_id
    ), p AS (SELECT e.vec_id, x, i, m, exp(x - m) AS p FROM e JOIN z ON e.vec_id = z.vec_id)
    SELECT vec_id, R(ln(sum(p)) + any_value(m) - sum(x * p) / sum(p)) AS entropy, R(max(x) FILTER (i = 3) - any_value(m) - ln(sum(p))) AS logp, R(sum(p * p) / pow(sum(p), 2)) AS sum_pi_sq FROM p GROUP BY vec_id""",
)
PLAIN.add(
    "m8_top_k_forward_kl",
    lambda s, d: rounded(
        _logits(s, d).select("vec_id", objective.top_k_forward_kl(F.slice("x", 1, 8), F.slice("x", 9, 8)).alias("kl"), F.size(F.array_intersect(F.slice("x", 1, 8), F.slice("x", 9, 8))).alias("shared")), "kl"
    ),
    "SELECT vec_id, R(list_sum([exp(embedding[i]::DOUBLE) * (embedding[i]::DOUBLE - embedding[i + 8]::DOUBLE) FOR i IN range(1, 9)])) AS kl, len(list_intersect(embedding[1:8], embedding[9:16]))::INT AS shared FROM embeddings",
)
PLAIN.add(
    "m9_learning_rates",
    lambda s, d: rounded(
        s.range(0, 200).select(F.col("id").alias("step"), *(objective.learning_rate(F.col("id"), k, 10, 150, 0.1).alias(k) for k in ("constant", "cosine", "wsd"))), "constant", "cosine", "wsd"
    ),
    """SELECT step, R(CASE WHEN step < 10 THEN step / 10.0 ELSE 1.0 END) AS constant,
    R(CASE WHEN step < 10 THEN step / 10.0 ELSE greatest(0.1, 0.5 * (1 + cos(pi() * (step - 10) / 140.0)) * 0.9 + 0.1) END) AS cosine,
    R(CASE WHEN step < 10 THEN step / 10.0 WHEN step < 136 THEN 1.0 WHEN step < 150 THEN greatest(0.1, 0.9 * 0.5 * (1 + cos(pi() * (step - 136) / 14.0)) + 0.1) ELSE 0.1 END) AS wsd FROM range(200) t(step)""",
)
PLAIN.add(
    "m3_adaptive_kl",
    lambda s, d: rounded(objective.adaptive_kl(table(s, d, "orders").select(F.col("o_orderkey").alias("step"), (F.col("o_custkey") % 50).alias("run"), (F.col("o_totalprice") / 1e6).alias("kl"), F.lit(32).alias("n")), 0.2, 0.1, 10000.0, "step", "run").select("run", "step", "coef"), "coef"),
    """SELECT o_custkey % 50 AS run, o_orderkey AS step, R(0.2 * exp(sum(ln(1 + greatest(least(o_totalprice / 1e6 / 0.1 - 1, 0.2), -0.2) * 32 / 10000.0)) OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING))) AS coef FROM orders""",
)
QUERIES |= PLAIN.queries
SQL |= PLAIN.sql
