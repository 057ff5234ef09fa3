"""Evaluation and record queries over samples, predictions, normalizations and stand-ins, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import records
from millrace.operators import aggregates, joins, metrics
from millrace.session import table

from .common import Book, rounded
from .rollout import TOKENS, tokens

BOOK = Book()
_ID = r"lower(regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"
_KEY = r"lower(regexp_replace(CAST({} AS VARCHAR), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"
_A = "CASE WHEN {k} IN (" + ", ".join(f"'{x}'" for x in records.POSITIVE) + ") THEN 'sarcastic' WHEN {k} IN (" + ", ".join(f"'{x}'" for x in records.NEGATIVE) + ") THEN 'non-sarcastic' END"
_B = "CASE WHEN {k} IN (" + ", ".join(f"'{x}'" for x in records.POSITIVE) + ") THEN 'sarcastic' WHEN {k} IN (" + ", ".join(f"'{x}'" for x in records.NEGATIVE_B) + ") THEN 'non-sarcastic' END"


def label_a(x: str) -> str:
    return _A.format(k=_KEY.format(x))


def label_b(x: str) -> str:
    return _B.format(k=f"replace({_KEY.format(x)}, '_', '-')")


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    """The latest prediction of each sample id, joined to its first sample row: dataset, language, gold, pred, valid."""
    p = table(spark, d, "predictions").withColumn("key", F.lower(records.strip("sample_id")))
    last = joins.latest_row(p, ["key"], ["prediction_no"], ["gold_label", "analysis", "json_valid"])
    s = table(spark, d, "samples").withColumn("key", F.lower(records.strip("sample_id")))
    first = joins.first_row(s, ["key"], ["line_no"], ["source", "language", "label"])
    pred = records.label_rule_a(F.col("analysis.label"))
    return first.join(last, "key").select(
        F.col("source").alias("dataset"), "language", F.coalesce(records.label_rule_a("gold_label"), records.label_rule_a("label")).alias("gold"), pred.alias("pred"),
        (F.coalesce("json_valid", F.lit(False)) & pred.isNotNull()).alias("valid"),
    )


EVALUATED = f"""ev AS (
  SELECT s.source AS dataset, s.language, coalesce({label_a("gold_label")}, {label_a("s.label")}) AS gold, {label_a("analysis.label")} AS pred,
    coalesce(json_valid, false) AND ({label_a("analysis.label")}) IS NOT NULL AS valid
  FROM (SELECT *, {_ID.format("sample_id")} AS key FROM samples QUALIFY row_number() OVER (PARTITION BY {_ID.format("sample_id")} ORDER BY line_no) = 1) s
  JOIN (SELECT *, {_ID.format("sample_id")} AS key FROM predictions QUALIFY row_number() OVER (PARTITION BY {_ID.format("sample_id")} ORDER BY prediction_no DESC) = 1) p ON s.key = p.key
)"""
_REPORT = ["accuracy", "valid_accuracy", "coverage", "precision", "recall", "f1", "specificity", "npv", "macro_precision", "macro_recall", "macro_f1", "weighted_f1", "balanced_accuracy", "mcc", "kappa"]


def a3_classification(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.classification_report(evaluated(spark, d))
    return rounded(out.select("level", "dataset", "language", *metrics.COUNTS, "support_pos", "support_neg", *_REPORT), *_REPORT)


def _div(a: str, b: str) -> str:
    return f"coalesce(({a}) / nullif(({b})::DOUBLE, 0), 0)"


REPORT = f"""{EVALUATED}, cnt AS (
  SELECT CASE WHEN grouping(dataset, language) = 0 THEN 'subgroup' WHEN grouping(dataset) = 0 THEN 'dataset' ELSE 'pooled' END AS level, dataset, language, count(*) AS samples,
    count(*) FILTER (valid) AS completed, count(*) FILTER (NOT valid) AS invalid, count(*) FILTER (valid AND gold = 'sarcastic' AND pred = 'sarcastic') AS tp,
    count(*) FILTER (valid AND gold = 'non-sarcastic' AND pred = 'non-sarcastic') AS tn, count(*) FILTER (valid AND gold = 'non-sarcastic' AND pred = 'sarcastic') AS fp,
    count(*) FILTER (valid AND gold = 'sarcastic' AND pred = 'non-sarcastic') AS fn_valid, count(*) FILTER (NOT valid AND gold = 'sarcastic') AS invalid_pos,
    count(*) FILTER (NOT valid AND gold = 'non-sarcastic') AS invalid_neg
  FROM (SELECT * REPLACE (coalesce(dataset, 'na') AS dataset, coalesce(language, 'na') AS language) FROM ev) GROUP BY GROUPING SETS ((dataset, language), (dataset), ())
), kept AS (SELECT * FROM cnt WHERE level <> 'subgroup' OR dataset IN (SELECT dataset FROM cnt WHERE level = 'subgroup' GROUP BY dataset HAVING count(*) > 1)
), r0 AS (SELECT *, tp + fn_valid + invalid_pos AS support_pos, tn + fp + invalid_neg AS support_neg, {_div("tp + tn", "completed + invalid")} AS accuracy, {_div("tp + tn", "completed")} AS valid_accuracy,
    {_div("completed", "samples")} AS coverage, {_div("tp", "tp + fp")} AS precision, {_div("tp", "tp + fn_valid + invalid_pos")} AS recall, {_div("tn", "tn + fn_valid")} AS npv,
    {_div("tn", "tn + fp + invalid_neg")} AS specificity FROM kept
), r1 AS (SELECT *, {_div("2 * precision * recall", "precision + recall")} AS f1, {_div("2 * npv * specificity", "npv + specificity")} AS f1n,
    {_div("(tp + fp) * (tp + fn_valid) + (tn + fn_valid) * (tn + fp)", "completed * completed")} AS pe, sqrt((tp + fp)::DOUBLE * (tp + fn_valid) * (tn + fp) * (tn + fn_valid)) AS root FROM r0
), report AS (SELECT level, dataset, language, samples, completed, invalid, tp, tn, fp, fn_valid, invalid_pos, invalid_neg, support_pos, support_neg, accuracy, valid_accuracy, coverage, precision, recall, f1,
    specificity, npv, (precision + npv) / 2 AS macro_precision, (recall + specificity) / 2 AS macro_recall, (f1 + f1n) / 2 AS macro_f1, {_div("f1 * support_pos + f1n * support_neg", "support_pos + support_neg")} AS weighted_f1,
    (recall + specificity) / 2 AS balanced_accuracy, CASE WHEN root = 0 THEN 0 ELSE (tp::DOUBLE * tn - fp::DOUBLE * fn_valid) / root END AS mcc, CASE WHEN pe = 1 THEN 0 ELSE (valid_accuracy - pe) / (1 - pe) END AS kappa FROM r1)"""
BOOK.add(
    "a3_classification_report",
    a3_classification,
    f"WITH {REPORT} SELECT level, dataset, language, samples, completed, invalid, tp, tn, fp, fn_valid, invalid_pos, invalid_neg, support_pos, support_neg, {', '.join(f'R({c}) AS {c}' for c in _REPORT)} FROM report",
)
BOOK.add(
    "a6_dataset_macro",
    lambda s, d: rounded(metrics.macro_row(metrics.classification_report(evaluated(s, d))), *_REPORT),
    f"WITH {REPORT} SELECT {', '.join(f'R(avg({c})) AS {c}' for c in _REPORT)} FROM report WHERE level = 'dataset' AND completed > 0",
)


def _delta(s: SparkSession, d: str) -> DataFrame:
    rows = evaluated(s, d)
    one = metrics.classification_report(rows).where("level = 'dataset'")
    two = metrics.classification_report(rows.withColumn("pred", F.lit("sarcastic"))).where("level = 'dataset'")
    return rounded(metrics.unpivot_delta(one, two, "dataset", ["accuracy", "f1", "mcc"]), "left", "right", "delta")


BOOK.add(
    "j12_role_comparison",
    _delta,
    f"""WITH {REPORT.replace("ev AS (", "ev0 AS (", 1)}""".replace("FROM ev)", "FROM ev0)")
    + f""", b AS (SELECT coalesce(dataset, 'na') AS dataset, count(*) FILTER (valid) AS completed, count(*) AS n, count(*) FILTER (valid AND gold = 'sarcastic') AS tp,
      count(*) FILTER (valid AND gold = 'non-sarcastic') AS fp, count(*) FILTER (NOT valid AND gold = 'sarcastic') AS ip FROM ev0 GROUP BY 1
    ), o AS (SELECT dataset, {_div("tp", "n")} AS accuracy, {_div("2 * " + _div("tp", "tp + fp") + " * " + _div("tp", "tp + ip"), _div("tp", "tp + fp") + " + " + _div("tp", "tp + ip"))} AS f1, 0.0 AS mcc FROM b
    ), l AS (SELECT dataset, unnest(['accuracy', 'f1', 'mcc']) AS metric, unnest([accuracy, f1, mcc]) AS v FROM report WHERE level = 'dataset'
    ), r AS (SELECT dataset, unnest(['accuracy', 'f1', 'mcc']) AS metric, unnest([accuracy, f1, mcc]) AS v FROM o)
    SELECT l.dataset, l.metric, R(l.v) AS "left", R(r.v) AS "right", R(l.v - r.v) AS delta FROM l JOIN r ON l.dataset = r.dataset AND l.metric = r.metric""",
)
BOOK.add(
    "a1_split_summary",
    lambda s, d: metrics.split_summary(table(s, d, "samples").withColumn("label", records.label_rule_a("label"))),
    f"""SELECT grp, label, count(*) AS n, grouping(grp, label)::INT AS level FROM (SELECT concat_ws(':', coalesce(source, 'na'), coalesce(language, 'na')) AS grp, coalesce({label_a("label")}, 'na') AS label FROM samples)
    GROUP BY GROUPING SETS ((grp, label), (grp), ())""",
)
BOOK.add(
    "a2_validation_counts",
    lambda s, d: table(s, d, "samples").agg(F.count(F.lit(1)).alias("samples"), F.count("reference_reasoning").alias("inline_references"), F.count_if(records.label_rule_a("label").isNull()).alias("unlabelled")),
    f"SELECT count(*) AS samples, count(reference_reasoning) AS inline_references, count(*) FILTER (({label_a('label')}) IS NULL) AS unlabelled FROM samples",
)
BOOK.add(
    "a7_status_rollup",
    lambda s, d: metrics.status_rollup(
        table(s, d, "predictions").select((F.col("prediction_no") % 50).alias("shard"), F.when(F.col("json_valid"), "complete").when(F.col("error") == "timeout while saving", "paused").otherwise("invalid").alias("status")), ["shard"]
    ),
    """SELECT prediction_no % 50 AS shard, CASE WHEN bool_and(coalesce(json_valid, false)) THEN 'complete' WHEN bool_or(NOT coalesce(json_valid, false) AND coalesce(error, '') = 'timeout while saving') THEN 'paused'
    ELSE 'invalid_outputs' END AS status FROM predictions GROUP BY 1""",
)
BOOK.add(
    "a8_extraction_summary",
    lambda s, d: table(s, d, "normalizations").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if("normalization.valid").alias("valid"), F.count_if(F.col("normalization.valid") & F.col("normalization.mechanism").isNull()).alias("no_mechanism"),
        F.count_if(F.col("attempts") > 1).alias("retried"), F.sum(F.col("attempts").cast("long")).alias("attempts"), F.count_distinct("sample_id").alias("candidates"),
    ),
    """SELECT count(*) AS rows, count(*) FILTER (normalization.valid) AS valid, count(*) FILTER (normalization.valid AND normalization.mechanism IS NULL) AS no_mechanism, count(*) FILTER (attempts > 1) AS retried,
    sum(attempts)::BIGINT AS attempts, count(DISTINCT sample_id) AS candidates FROM normalizations""",
)
BOOK.add(
    "a9_a13_masked_stats",
    lambda s, d: rounded(
        aggregates.masked_stats(t := tokens(s, d), "value", "mask").crossJoin(t.agg(aggregates.masked_sum(F.col("value"), F.col("mask")).alias("sum"))), "mean", "var", "sum"
    ),
    f"""WITH {TOKENS}, m AS (SELECT sum(value * mask) / (sum(mask) + 1e-8) AS mean, sum(mask) AS n FROM tok)
    SELECT R(mean) AS mean, R(sum(pow(value - mean, 2) * mask) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1)) AS var, R(sum(value * mask)) AS sum FROM tok, m GROUP BY mean""",
)
BOOK.add(
    "a12_whiten",
    lambda s, d: rounded(aggregates.whiten(tokens(s, d), "value", "mask", "white").select("traj_id", "pos", "white"), "white"),
    f"""WITH {TOKENS}, m AS (SELECT sum(value * mask) / (sum(mask) + 1e-8) AS mean, sum(mask) AS n FROM tok
    ), w AS (SELECT mean, sum(pow(value - mean, 2) * mask) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS var FROM tok, m GROUP BY mean)
    SELECT traj_id, pos, R((value - mean) / sqrt(var + 1e-8)) AS white FROM tok, w""",
)
BOOK.add(
    "a13_group_stats",
    lambda s, d: rounded(aggregates.group_stats(table(s, d, "orders"), "o_custkey", "o_totalprice"), "mean", "std"),
    "SELECT o_custkey, count(*) AS n, R(CASE WHEN count(*) = 1 THEN 0 ELSE avg(o_totalprice) END) AS mean, R(CASE WHEN count(*) = 1 THEN 1 ELSE stddev_samp(o_totalprice) END) AS std FROM orders GROUP BY 1",
)
BOOK.add(
    "a14_group_codes",
    lambda s, d: aggregates.group_codes(table(s, d, "samples").select("line_no", "source").where("source is not null"), "source").select("line_no", "source", F.col("code").cast("long").alias("code")),
    "SELECT line_no, source, dense_rank() OVER (ORDER BY source) - 1 AS code FROM samples WHERE source IS NOT NULL",
)
BOOK.add(
    "a16_reduce_metric",
    lambda s, d: rounded(metrics.reduce_metric(table(s, d, "events").select(F.concat(F.element_at(F.array(F.lit("max_"), F.lit("min_"), F.lit("")), (F.col("event_id") % 3 + 1).cast("int")), "event_type").alias("name"), "value")), "value"),
    """SELECT name, R(CASE WHEN contains(name, 'max') THEN max(value) WHEN contains(name, 'min') THEN min(value) ELSE avg(value) END) AS value
    FROM (SELECT ['max_', 'min_', ''][event_id % 3 + 1] || event_type AS name, value FROM events) GROUP BY name""",
)
BOOK.add(
    "a17_reduce_across_ranks",
    lambda s, d: rounded(
        metrics.reduce_across_ranks(table(s, d, "events").select(F.col("event_type").alias("name"), F.element_at(F.array(*map(F.lit, ("SUM", "MEAN", "MIN", "MAX"))), (F.length("event_type") % 4 + 1).cast("int")).alias("kind"), F.floor(F.col("event_id") / 100).alias("step"), (F.col("event_id") % 8).alias("rank"), "value")), "value"
    ),
    """WITH e AS (SELECT event_type AS name, ['SUM', 'MEAN', 'MIN', 'MAX'][length(event_type) % 4 + 1] AS kind, event_id // 100 AS step, value FROM events
    ), s AS (SELECT name, kind, step, avg(value) AS m, min(value) AS lo, max(value) AS hi FROM e GROUP BY ALL)
    SELECT name, kind, R(CASE kind WHEN 'SUM' THEN sum(m) WHEN 'MEAN' THEN avg(m) WHEN 'MIN' THEN min(lo) ELSE max(hi) END) AS value FROM s GROUP BY name, kind""",
)
BOOK.add(
    "a18_step_metrics",
    lambda s, d: rounded(
        metrics.step_metrics(table(s, d, "events").select(F.concat(F.element_at(F.array(*map(F.lit, ("global_step/", "avg_", "total_", "max_", "w_"))), (F.col("event_id") % 5 + 1).cast("int")), "event_type").alias("name"), F.col("event_id").alias("step"), "value", (F.col("user_id") % 7).alias("weight"))), "value"
    ),
    """SELECT name, R(CASE WHEN name LIKE 'global_step%' THEN arg_max(value, step) WHEN name LIKE '%avg%' OR name LIKE '%mean%' THEN avg(value) WHEN name LIKE '%total%' THEN sum(value) WHEN name LIKE '%max%' THEN max(value)
    ELSE sum(value * weight) / sum(weight) END) AS value FROM (SELECT ['global_step/', 'avg_', 'total_', 'max_', 'w_'][event_id % 5 + 1] || event_type AS name, event_id AS step, value, user_id % 7 AS weight FROM events) GROUP BY name""",
)
BOOK.add(
    "a19_batch_stats",
    lambda s, d: rounded(
        metrics.length_stats(tokens(s, d).groupBy("traj_id").agg(F.sum("reward").alias("score"), F.sum("mask").alias("length")), ["score", "length"], 6), "score_mean", "score_max", "score_min", "length_mean", "clip_ratio", "aborted_ratio"
    ),
    f"""WITH {TOKENS} SELECT R(avg(score)) AS score_mean, R(max(score)) AS score_max, R(min(score)) AS score_min, R(avg(length)) AS length_mean, max(length)::BIGINT AS length_max, min(length)::BIGINT AS length_min,
    R(avg((length >= 6)::INT)) AS clip_ratio, R(avg((length = 0)::INT)) AS aborted_ratio FROM traj""",
)
BOOK.add(
    "a20_explained_variance",
    lambda s, d: rounded(metrics.explained_variance(table(s, d, "lineitem"), "l_extendedprice", "l_quantity"), "explained_variance"),
    "SELECT R(1 - var_samp(l_extendedprice - l_quantity) / (var_samp(l_extendedprice) + 1e-5)) AS explained_variance FROM lineitem",
)
BOOK.add(
    "a22_throughput",
    lambda s, d: rounded(table(s, d, "events").groupBy("event_type").agg(metrics.throughput(F.sum("user_id"), F.sum("value"), 8).alias("rate")), "rate"),
    "SELECT event_type, R(sum(user_id) / (sum(value) * 8)) AS rate FROM events GROUP BY 1",
)
BOOK.add(
    "a23_variance_proxies",
    lambda s, d: rounded(metrics.variance_proxies(tokens(s, d), 0.5), "signal_strength", "total_power", "pure_noise", "expected_a_squared", "expected_w"),
    f"""WITH {TOKENS}, q AS (SELECT traj_id, sum(advantage * mask) / (sum(mask) + 1e-8) AS a, sum((1 - 2 * exp(old_logp) + sum_pi_sq) * mask) AS w FROM tok GROUP BY traj_id)
    SELECT R(0.25) AS signal_strength, R(avg(a * a * greatest(w, 0))) AS total_power, R(greatest((avg(a * a * greatest(w, 0)) - 0.25) / (count(*) - 1), 0)) AS pure_noise, R(avg(a * a)) AS expected_a_squared, R(avg(w)) AS expected_w FROM q""",
)


def _responses(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderpriority").alias("data_source"), F.col("o_custkey").alias("uid"), (F.col("o_totalprice") / 1000).alias("val"), F.col("o_orderstatus").alias("pred"), F.col("o_orderkey").alias("resp"))


_BEST = ["mean", "std", "best", "best_std", "worst", "worst_std"]
BOOK.add(
    "a26_best_worst_at_n",
    lambda s, d: rounded(metrics.best_worst_at(_responses(s, d), ["data_source", "uid"]).select("data_source", "uid", "responses", F.coalesce("n", F.lit(0)).cast("long").alias("n"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in _BEST)), *_BEST),
    """WITH o AS (SELECT o_orderpriority AS data_source, o_custkey AS uid, o_totalprice / 1000 AS v, row_number() OVER (PARTITION BY o_orderpriority, o_custkey ORDER BY o_totalprice) AS i, count(*) OVER (PARTITION BY o_orderpriority, o_custkey) AS k FROM orders
    ), n AS (SELECT DISTINCT k, unnest(CASE WHEN k <= 1 THEN [NULL]::BIGINT[] ELSE list_distinct(list_concat([pow(2, j)::BIGINT FOR j IN range(1, 40) IF pow(2, j) < k], [k])) END) AS n FROM (SELECT DISTINCT k FROM o))
    SELECT data_source, uid, o.k AS responses, R(avg(v)) AS mean, R(stddev_pop(v)) AS std, coalesce(n, 0) AS n, R(coalesce(sum(v * (pow(i / o.k, n) - pow((i - 1) / o.k, n))), 0)) AS best, R(coalesce(sum(v * (pow((o.k - i + 1) / o.k, n) - pow((o.k - i) / o.k, n))), 0)) AS worst,
      R(sqrt(greatest(sum(v * v * (pow(i / o.k, n) - pow((i - 1) / o.k, n))) - pow(sum(v * (pow(i / o.k, n) - pow((i - 1) / o.k, n))), 2), 0))) AS best_std,
      R(sqrt(greatest(sum(v * v * (pow((o.k - i + 1) / o.k, n) - pow((o.k - i) / o.k, n))) - pow(sum(v * (pow((o.k - i + 1) / o.k, n) - pow((o.k - i) / o.k, n))), 2), 0))) AS worst_std
    FROM o JOIN n ON o.k = n.k GROUP BY data_source, uid, o.k, n""",
)
BOOK.add(
    "a25_majority_value",
    lambda s, d: rounded(metrics.majority_value(_responses(s, d), ["data_source", "uid"], "pred", "val", "resp"), "val"),
    """WITH v AS (SELECT o_orderpriority AS data_source, o_custkey AS uid, o_orderstatus AS pred, count(*) AS c, min(o_orderkey) AS f, arg_min(o_totalprice / 1000, o_orderkey) AS val FROM orders GROUP BY ALL)
    SELECT data_source, uid, R(val) AS val FROM v QUALIFY row_number() OVER (PARTITION BY data_source, uid ORDER BY c DESC, f) = 1""",
)
BOOK.add("a24_bootstrap", lambda s, d: rounded(metrics.bootstrap(_responses(s, d), ["data_source", "uid"], "val", 2), "best_mean", "best_std", "worst_mean", "worst_std"))
BOOK.add(
    "a29_eval_by_source",
    lambda s, d: rounded(metrics.eval_by_source(table(s, d, "embeddings").select((F.col("label") % 5).cast("string").alias("data_source"), F.transform("embedding", lambda x: x.cast("double")).alias("x")), "x"), "score"),
    "SELECT (label % 5)::VARCHAR AS data_source, R(avg(list_sum([x::DOUBLE FOR x IN embedding]) / len(embedding))) AS score FROM embeddings GROUP BY 1",
)
BOOK.add(
    "a30_accept_ratios",
    lambda s, d: rounded(metrics.accept_ratios(table(s, d, "lineitem").withColumn("r", F.col("l_linenumber") % 3), "l_quantity", "l_extendedprice", "r"), "accept_rate", "accept_length"),
    "SELECT R(avg(coalesce(l_quantity / nullif(l_extendedprice, 0), 0))) AS accept_rate, R(avg(coalesce(l_quantity / nullif(l_linenumber % 3, 0), 0))) AS accept_length FROM lineitem",
)
BOOK.add(
    "a31_percentiles",
    lambda s, d: rounded(metrics.percentiles(table(s, d, "events"), ["event_type"], "value"), "avg", "max", "min", "p50", "p95", "p99"),
    "SELECT event_type, R(avg(value)) AS avg, R(max(value)) AS max, R(min(value)) AS min, R(quantile_cont(value, 0.5)) AS p50, R(quantile_cont(value, 0.95)) AS p95, R(quantile_cont(value, 0.99)) AS p99 FROM events GROUP BY 1",
)
BOOK.add(
    "a32_partial_rollouts",
    lambda s, d: rounded(metrics.partial_rollouts(table(s, d, "events").select(F.floor(F.col("event_id") / 100).alias("a"), F.floor((F.col("event_id") + F.col("user_id") % 60) / 100).alias("b")), "a", "b"), "ratio"),
    "WITH e AS (SELECT event_id // 100 AS a, (event_id + user_id % 60) // 100 AS b FROM events) SELECT count(*) FILTER (b > a) AS partial, R(avg((b > a)::INT)) AS ratio, max(b - a) AS max_span, count(DISTINCT b) AS versions FROM e",
)
BOOK.add(
    "a33_slowest",
    lambda s, d: rounded(metrics.slowest(table(s, d, "events"), ["event_type"], "value", "event_id"), "min", "max", "mean"),
    "SELECT event_type, R(min(value)) AS min, R(max(value)) AS max, R(avg(value)) AS mean, (list(event_id ORDER BY value DESC, event_id))[1] AS slowest FROM events GROUP BY 1",
)
BOOK.add(
    "a35_token_agreement",
    lambda s, d: rounded(metrics.token_agreement(tokens(s, d), "old_logp", "rollout_logp", "mask"), "pearson", "diff_mean", "diff_max", "diff_std"),
    f"WITH {TOKENS} SELECT R(corr(exp(old_logp), exp(rollout_logp))) AS pearson, R(avg(abs(exp(old_logp) - exp(rollout_logp)))) AS diff_mean, R(max(abs(exp(old_logp) - exp(rollout_logp)))) AS diff_max, R(stddev_samp(abs(exp(old_logp) - exp(rollout_logp)))) AS diff_std FROM tok WHERE mask <> 0",
)
BOOK.add(
    "f0_label_rules",
    lambda s, d: table(s, d, "samples").select("line_no", records.label_rule_a("label").alias("a"), records.label_rule_b("label").alias("b")),
    f"SELECT line_no, {label_a('label')} AS a, {label_b('label')} AS b FROM samples",
)
QUERIES, SQL = BOOK.queries, BOOK.sql
