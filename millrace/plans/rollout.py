"""Estimator queries over tokens made from lineitem, with SQL.

traj_id = l_orderkey, uid = l_orderkey mod 400, pos = rank in the order's full sort, reward = l_discount,
value = l_tax, old_logp = -l_quantity / 50, logp and rollout_logp near it, mask = l_returnflag is not 'R'.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators import estimators as est
from millrace.session import table

from .common import Book, rounded

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"]


def tokens(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ORDER))
    return rows.select(
        F.col("l_orderkey").alias("traj_id"), (F.col("l_orderkey") % 400).alias("uid"), place.cast("long").alias("pos"), F.col("l_discount").alias("reward"), F.col("l_tax").alias("value"),
        (F.col("l_returnflag") != "R").cast("int").alias("mask"), (-F.col("l_quantity") / 50).alias("old_logp"), (-F.col("l_quantity") / 50 + (F.col("l_tax") - 0.04) * 5).alias("logp"),
        (-F.col("l_quantity") / 50 + (F.col("l_discount") - 0.05) * 4).alias("rollout_logp"), (F.col("l_tax") + 0.2).alias("sum_pi_sq"), (F.col("l_discount") * 10 - 0.5).alias("advantage"),
    )


TOKENS = f"""tok AS (
  SELECT l_orderkey AS traj_id, l_orderkey % 400 AS uid, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS pos, l_discount AS reward, l_tax AS value,
    CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS mask, -l_quantity / 50 AS old_logp, -l_quantity / 50 + (l_tax - 0.04) * 5 AS logp,
    -l_quantity / 50 + (l_discount - 0.05) * 4 AS rollout_logp, l_tax + 0.2 AS sum_pi_sq, l_discount * 10 - 0.5 AS advantage FROM lineitem
), traj AS (SELECT traj_id, uid, sum(reward) AS score, sum(mask) AS length FROM tok GROUP BY ALL
), grp AS (SELECT uid, count(*) AS n, CASE WHEN count(*) = 1 THEN 0 ELSE avg(score) END AS mean, CASE WHEN count(*) = 1 THEN 1 ELSE stddev_samp(score) END AS std FROM traj GROUP BY uid
)"""
_WHITE = """, m AS (SELECT sum(v * mask) / (sum(mask) + 1e-8) AS mean, sum(mask) AS n FROM raw
), w AS (SELECT mean, sum((v - mean) * (v - mean) * mask) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM raw, m GROUP BY mean
)"""
BOOK = Book(TOKENS)
_add, _rounded = BOOK.add, rounded


def _outcome(name: str, run: Callable[[DataFrame], DataFrame], formula: str, extra: str = "") -> None:
    _add(
        name,
        lambda s, d: _rounded(run(tokens(s, d)).select("traj_id", "uid", "advantage"), "advantage"),
        f"{extra} SELECT traj_id, t.uid, R({formula}) AS advantage FROM traj t JOIN grp g ON t.uid = g.uid",
    )


_outcome("e2_grpo", est.grpo, "(score - mean) / (std + 1e-6)")
_outcome("e2_dr_grpo", lambda t: est.grpo(t, by_std=False), "score - mean")
_outcome("e7_rloo", est.rloo, "CASE WHEN n > 1 THEN (score * n - mean * n) / (n - 1) ELSE score END")
_outcome("e8_rloo_vectorized", est.rloo_vectorized, "CASE WHEN n > 1 THEN (score * n - mean * n) / (n - 1) ELSE 0 END")
_outcome("e12_gpg", est.gpg, "(SELECT count(*) / greatest(1, count(*) FILTER (score <> 0)) FROM traj) * (score - mean)")
_add(
    "e5_grpo_passk",
    lambda s, d: _rounded(est.grpo_passk(tokens(s, d)).select("traj_id", "uid", "advantage"), "advantage"),
    """, r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, traj_id) AS k, lead(score) OVER (PARTITION BY uid ORDER BY score DESC, traj_id) AS second FROM traj)
    SELECT traj_id, r.uid, R(CASE WHEN k = 1 THEN (score - second) / (std + 1e-6) ELSE 0 END) AS advantage FROM r JOIN grp g ON r.uid = g.uid""",
)
_add(
    "e9_opo",
    lambda s, d: _rounded(est.opo(tokens(s, d)), "advantage"),
    """, b AS (SELECT uid, count(*) AS n, sum(score * length) / nullif(sum(length), 0) AS base FROM traj GROUP BY uid)
    SELECT traj_id, t.uid, R(score - CASE WHEN n > 1 THEN base ELSE 0 END) AS advantage FROM traj t JOIN b ON t.uid = b.uid""",
)
_add(
    "e2_grpo_tokens",
    lambda s, d: _rounded(est.to_tokens(t := tokens(s, d), est.grpo(t)), "advantage"),
    "SELECT tok.traj_id, tok.uid, pos, R((score - mean) / (std + 1e-6) * mask) AS advantage FROM tok JOIN traj t ON tok.traj_id = t.traj_id JOIN grp g ON t.uid = g.uid",
)
_add(
    "e6_reinforce_pp_baseline",
    lambda s, d: _rounded(est.reinforce_pp_baseline(tokens(s, d)), "advantage"),
    f""", raw AS (SELECT tok.traj_id, tok.uid, pos, mask, score - mean AS v FROM tok JOIN traj t ON tok.traj_id = t.traj_id JOIN grp g ON t.uid = g.uid) {_WHITE}
    SELECT traj_id, uid, pos, R((v - mean) / sqrt(var + 1e-8) * mask) AS advantage FROM raw, w""",
)
_add(
    "e4_gdpo",
    lambda s, d: _rounded(est.gdpo(tokens(s, d)), "advantage"),
    f""", k AS (SELECT traj_id, uid, sum(reward) AS a, sum(value) AS b FROM tok GROUP BY ALL
    ), st AS (SELECT uid, count(*) AS n, avg(a) AS ma, avg(b) AS mb, stddev_samp(a) AS sa, stddev_samp(b) AS sb FROM k GROUP BY uid
    ), led AS (SELECT traj_id, CASE WHEN n = 1 THEN a / 1.000001 + b / 1.000001 ELSE (a - ma) / (sa + 1e-6) + (b - mb) / (sb + 1e-6) END AS v FROM k JOIN st ON k.uid = st.uid
    ), raw AS (SELECT tok.traj_id, uid, pos, mask, v FROM tok JOIN led ON tok.traj_id = led.traj_id) {_WHITE}
    SELECT traj_id, uid, pos, R((v - mean) / sqrt(var + 1e-8) * mask) AS advantage FROM raw, w""",
)
_add(
    "w1_return_to_go",
    lambda s, d: _rounded(tokens(s, d).select("traj_id", "pos", est.return_to_go().alias("ret")), "ret"),
    "SELECT traj_id, pos, R(sum(reward * mask) OVER (PARTITION BY traj_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING)) AS ret FROM tok",
)
_add(
    "w4_energy",
    lambda s, d: _rounded(tokens(s, d).select("traj_id", "pos", est.energy().alias("w")), "w"),
    "SELECT traj_id, pos, R(sum((1 - 2 * exp(old_logp) + sum_pi_sq) * mask) OVER (PARTITION BY traj_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS w FROM tok",
)
_add(
    "e11_remax",
    lambda s, d: _rounded(est.remax(t := tokens(s, d), t.groupBy("traj_id").agg(F.max("value").alias("baseline"))), "advantage"),
    """, b AS (SELECT traj_id, max(value) AS baseline FROM tok GROUP BY traj_id)
    SELECT tok.traj_id, uid, pos, R(sum(reward * mask) OVER (PARTITION BY tok.traj_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) - baseline * mask) AS advantage
    FROM tok JOIN b ON tok.traj_id = b.traj_id""",
)
_OTB = """, raw AS (SELECT *, sum(reward * mask) OVER (PARTITION BY traj_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS ret,
      sum((1 - 2 * exp(old_logp) + sum_pi_sq) * mask) OVER (PARTITION BY traj_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS w, {at} AS spot FROM tok
    ), base AS (SELECT uid, spot, sum(ret * w) / (sum(w) + 1e-8) AS base FROM raw WHERE mask <> 0 GROUP BY uid, spot
    ), len AS (SELECT uid, traj_id, sum(mask) AS len FROM tok GROUP BY uid, traj_id {having}
    ), top AS (SELECT uid, count(*) AS n, max(len) AS longest FROM len GROUP BY uid
    ), shape AS (SELECT l.traj_id, n, len = longest AND count(*) FILTER (len = longest) OVER (PARTITION BY l.uid) = 1 AS lone,
      max(CASE WHEN len < longest THEN len END) OVER (PARTITION BY l.uid) AS second FROM len l JOIN top ON l.uid = top.uid)
    SELECT raw.traj_id, raw.uid, pos, R((ret - CASE WHEN n > 1 AND NOT coalesce(lone AND raw.spot > second, false) THEN coalesce(base, 0) ELSE 0 END) * mask) AS advantage
    FROM raw LEFT JOIN base ON raw.uid = base.uid AND raw.spot = base.spot LEFT JOIN shape ON raw.traj_id = shape.traj_id"""
_add("e13_optimal_token_baseline", lambda s, d: _rounded(est.optimal_token_baseline(tokens(s, d)), "advantage"), _OTB.format(at="pos", having=""))
_add(
    "e14_tir_optimal_token_baseline",
    lambda s, d: _rounded(est.tir_optimal_token_baseline(tokens(s, d)), "advantage"),
    _OTB.format(at="sum(mask) OVER (PARTITION BY traj_id ORDER BY pos ROWS UNBOUNDED PRECEDING)", having="HAVING sum(mask) > 0"),
)
# the recurrences in SQL: a recursive walk from each trajectory's last token
_add(
    "e1_gae",
    lambda s, d: _rounded(est.gae(tokens(s, d)), "advantage", "ret"),
    f""", rev AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY pos DESC) AS k FROM tok
    ), fold AS (SELECT traj_id, uid, pos, mask, value, k, CASE WHEN mask <> 0 THEN reward - value ELSE 0 END AS adv, CASE WHEN mask <> 0 THEN value ELSE 0 END AS nxt FROM rev WHERE k = 1
      UNION ALL SELECT r.traj_id, r.uid, r.pos, r.mask, r.value, r.k, CASE WHEN r.mask <> 0 THEN r.reward + f.nxt - r.value + 0.95 * f.adv ELSE f.adv END, CASE WHEN r.mask <> 0 THEN r.value ELSE f.nxt END
      FROM fold f JOIN rev r ON r.traj_id = f.traj_id AND r.k = f.k + 1
    ), raw AS (SELECT *, adv AS v FROM fold) {_WHITE}
    SELECT traj_id, uid, pos, R((v - mean) / sqrt(var + 1e-8)) AS advantage, R(adv + value) AS ret FROM raw, w""",
    recursive=True,
)
_add(
    "e10_reinforce_pp",
    lambda s, d: _rounded(est.reinforce_pp(tokens(s, d)), "advantage", "ret"),
    f""", rev AS (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY pos DESC) AS k FROM tok
    ), fold AS (SELECT traj_id, uid, pos, mask, k, reward AS ret, reward * mask AS run FROM rev WHERE k = 1
      UNION ALL SELECT r.traj_id, r.uid, r.pos, r.mask, r.k, r.reward + 0.9 * f.run, (r.reward + 0.9 * f.run) * r.mask FROM fold f JOIN rev r ON r.traj_id = f.traj_id AND r.k = f.k + 1
    ), raw AS (SELECT *, ret AS v FROM fold) {_WHITE}
    SELECT traj_id, uid, pos, R((v - mean) / sqrt(var + 1e-8) * mask) AS advantage, R(ret) AS ret FROM raw, w""",
    recursive=True,
)

def _sessions(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select((F.col("o_orderkey") % 3000).alias("session"), (F.col("o_orderkey") % 300).alias("uid"), F.col("o_orderkey").alias("step"), F.col("o_totalprice").alias("score"))


_add(
    "e15_multi_trajectory",
    lambda s, d: _rounded(est.multi_trajectory(_sessions(s, d)).select("session", "uid", "step", "advantage"), "advantage"),
    """, o AS (SELECT o_orderkey % 3000 AS session, o_orderkey % 300 AS uid, o_orderkey AS step, o_totalprice AS score FROM orders
), fin AS (SELECT * FROM o QUALIFY row_number() OVER (PARTITION BY session ORDER BY step DESC) = 1
), g AS (SELECT uid, CASE WHEN count(*) = 1 THEN 0 ELSE avg(score) END AS mean, CASE WHEN count(*) = 1 THEN 1 ELSE stddev_samp(score) END AS std FROM fin GROUP BY uid)
SELECT o.session, o.uid, o.step, R((fin.score - mean) / (std + 1e-6)) AS advantage FROM o JOIN fin ON o.session = fin.session JOIN g ON fin.uid = g.uid""",
)
QUERIES, SQL = BOOK.queries, BOOK.sql
