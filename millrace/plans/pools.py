"""Pool, balancing, scoring and stream queries, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import parsing, scorers
from millrace.operators import balance, pool
from millrace.session import scratch, table
from millrace.streaming import queues

from .common import Book, rounded

BOOK = Book()
# --- pool: events as an action log; each pool starts with ADDs, later rows vote on one of the first ids ---------------


def actions(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    n, kind = F.floor(F.col("event_id") / 40), F.col("event_id") % 40
    action = F.when(kind < 8, "ADD").otherwise(F.element_at(F.array(*map(F.lit, ("UPVOTE", "MODIFY", "UPVOTE", "SKIP", "DOWNVOTE"))), (F.col("user_id") % 5 + 1).cast("int")))
    rows = e.select(F.concat(F.lit("pool-"), n).alias("pool"), F.col("event_id").alias("seq"), action.alias("action"), F.format_string("exp-%06d", (F.col("user_id") % 8 + 1).cast("int")).alias("t"))
    return rows.select(
        "pool", "seq", F.when(F.col("action").isin("ADD", "UPVOTE", "MODIFY"), "sarcastic").otherwise("non-sarcastic").alias("candidate_label"), "action",
        F.when(~F.col("action").isin("ADD", "SKIP"), F.col("t")).alias("target_id"), F.when(F.col("action") == "ADD", F.concat(F.lit("mechanism "), "seq")).alias("mechanism"),
        F.when(F.col("action").isin("ADD", "MODIFY"), F.concat(F.lit("boundary "), "seq")).alias("exclusion_boundary"), F.when(F.col("action") == "MODIFY", "BOUNDARY").alias("modification_scope"),
    )


_ACT = """act AS (SELECT 'pool-' || (event_id // 40) AS pool, event_id AS seq, CASE WHEN event_id % 40 < 8 THEN 'ADD' ELSE ['UPVOTE', 'MODIFY', 'UPVOTE', 'SKIP', 'DOWNVOTE'][user_id % 5 + 1] END AS action,
    printf('exp-%06d', user_id % 8 + 1) AS t FROM events)"""
BOOK.add(
    "k2_pool_counters",
    lambda s, d: pool.counters(actions(s, d)),
    f"""WITH {_ACT}, a AS (SELECT pool, printf('exp-%06d', row_number() OVER (PARTITION BY pool ORDER BY seq)) AS id FROM act WHERE action = 'ADD'
    ), v AS (SELECT pool, t AS id, count(*) FILTER (action = 'UPVOTE') AS u, count(*) FILTER (action = 'DOWNVOTE') AS w, count(*) FILTER (action = 'MODIFY') AS m FROM act WHERE action NOT IN ('ADD', 'SKIP') GROUP BY ALL)
    SELECT a.pool, a.id, 2 + coalesce(u, 0) + coalesce(m, 0) - coalesce(w, 0) AS importance, 1 + coalesce(m, 0) AS revision, coalesce(u, 0) AS upvotes, coalesce(w, 0) AS downvotes, coalesce(m, 0) AS modifies
    FROM a LEFT JOIN v ON a.pool = v.pool AND a.id = v.id""",
)
BOOK.add("k3_pool_fold", lambda s, d: pool.fold(actions(s, d), capacity=6, drop_inactive_targets=True))
BOOK.add("k7_pool_export", lambda s, d: pool.ranked(pool.fold(actions(s, d), capacity=6, drop_inactive_targets=True)).select("pool", "place", "id", "active", "importance"))
def _damaged(s: SparkSession, d: str) -> DataFrame:
    """The log with one row in seven made wrong: label, target, texts or action."""
    n = F.col("seq") % 7
    return actions(s, d).withColumns({
        "candidate_label": F.when((n == 0) & (F.col("seq") % 2 == 0), "ironic").when(n == 0, "non-sarcastic").otherwise(F.col("candidate_label")),
        "target_id": F.when(n == 1, F.lit(None).cast("string")).otherwise(F.col("target_id")),
        "mechanism": F.when(n == 2, F.lit(None).cast("string")).otherwise(F.col("mechanism")),
        "action": F.when((n == 3) & (F.col("seq") % 3 == 0), "VOTE").otherwise(F.col("action")),
        "modification_scope": F.when(n == 4, "FULL").otherwise(F.col("modification_scope")),
    })


BOOK.add(
    "k1_action_errors",
    lambda s, d: _damaged(s, d).withColumn("error", F.coalesce(pool.action_error(), F.lit("none"))).groupBy("action", "error").count(),
    f"""WITH {_ACT}, x AS (SELECT seq, CASE WHEN seq % 7 = 3 AND seq % 3 = 0 THEN 'VOTE' ELSE action END AS action,
      CASE WHEN seq % 7 = 0 AND seq % 2 = 0 THEN 'ironic' WHEN seq % 7 = 0 THEN 'non-sarcastic' WHEN action IN ('ADD', 'UPVOTE', 'MODIFY') THEN 'sarcastic' ELSE 'non-sarcastic' END AS label,
      seq % 7 <> 1 AND action NOT IN ('ADD', 'SKIP') AS has_target, seq % 7 <> 2 AND action = 'ADD' AS has_mechanism, action IN ('ADD', 'MODIFY') AS has_boundary,
      CASE WHEN seq % 7 = 4 THEN 'FULL' WHEN action = 'MODIFY' THEN 'BOUNDARY' END AS scope FROM act
    ), e AS (SELECT action, CASE WHEN label NOT IN ('sarcastic', 'non-sarcastic') THEN 'unknown label'
      WHEN label = 'sarcastic' AND action NOT IN ('ADD', 'MODIFY', 'UPVOTE', 'SKIP') THEN 'action is not legal for sarcastic' WHEN label = 'non-sarcastic' AND action NOT IN ('MODIFY', 'UPVOTE', 'DOWNVOTE', 'SKIP') THEN 'action is not legal for non-sarcastic'
      WHEN action IN ('MODIFY', 'UPVOTE', 'DOWNVOTE') AND NOT has_target THEN 'target is missing' WHEN action = 'ADD' AND NOT (has_mechanism AND has_boundary) THEN 'texts are missing'
      WHEN action = 'MODIFY' AND scope <> 'BOUNDARY' AND NOT has_mechanism THEN 'mechanism is missing' ELSE 'none' END AS error FROM x)
    SELECT action, error, count(*) AS count FROM e GROUP BY ALL""",
)
BOOK.add(
    "a41_action_counts",
    lambda s, d: pool.action_counts(actions(s, d)),
    f"""WITH {_ACT} SELECT pool, {", ".join(f"count(*) FILTER (action = '{a}') AS {chr(34)}{a}{chr(34)}" for a in ("ADD", "MODIFY", "UPVOTE", "DOWNVOTE", "SKIP"))} FROM act GROUP BY pool""",
)
# --- balance ---------------------------------------------------------------------------------------------------------


def _lengths(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.floor(F.col("o_orderkey") / 64).alias("batch"), F.col("o_orderkey").alias("idx"), (F.col("o_custkey") % 900 + 10).alias("len"))


BOOK.add("b1_differencing", lambda s, d: balance.imbalance(balance.balanced(_lengths(s, d), "batch", "idx", "len", 8), "batch", "part", "len"))
BOOK.add(
    "b2_greedy",
    lambda s, d: balance.imbalance(balance.balanced(_lengths(s, d), "batch", "idx", "len", 8, method="greedy"), "batch", "part", "len"),
    """WITH RECURSIVE l AS (SELECT o_orderkey // 64 AS batch, row_number() OVER (PARTITION BY o_orderkey // 64 ORDER BY o_orderkey) AS n, o_custkey % 900 + 10 AS len FROM orders
    ), f AS (SELECT DISTINCT batch, 0::BIGINT AS n, [0::BIGINT FOR x IN range(8)] AS s FROM l UNION ALL
      SELECT l.batch, l.n, [CASE WHEN x + 1 = list_position(f.s, list_min(f.s)) THEN f.s[x + 1] + l.len ELSE f.s[x + 1] END FOR x IN range(8)] FROM f JOIN l ON l.batch = f.batch AND l.n = f.n + 1
    ), e AS (SELECT batch, max(n) AS n FROM l GROUP BY 1)
    SELECT f.batch, list_min(s) AS min, list_max(s) AS max, list_max(s) - list_min(s) AS diff FROM f JOIN e ON e.batch = f.batch AND e.n = f.n""",
)
BOOK.add("b4_micro_batches", lambda s, d: balance.micro_batches(_lengths(s, d), "batch", "idx", "len", 4000))
BOOK.add(
    "a34_contiguous_imbalance",
    lambda s, d: balance.imbalance(_lengths(s, d).withColumn("part", F.floor((F.col("idx") % 64) / 8)), "batch", "part", "len"),
    "WITH p AS (SELECT o_orderkey // 64 AS batch, (o_orderkey % 64) // 8 AS part, sum(o_custkey % 900 + 10)::BIGINT AS s FROM orders GROUP BY ALL) SELECT batch, min(s) AS min, max(s) AS max, max(s) - min(s) AS diff FROM p GROUP BY batch",
)
BOOK.add("m4_workload", lambda s, d: _lengths(s, d).select("idx", balance.workload(F.col("len")).alias("cost")), "SELECT o_orderkey AS idx, 24576 * (o_custkey % 900 + 10) + pow(o_custkey % 900 + 10, 2)::BIGINT AS cost FROM orders")
# --- scorers ---------------------------------------------------------------------------------------------------------


def _responses(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders")
    n = (F.col("o_custkey") % 1000).cast("string")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("so we get "), n, F.lit(" #### "), n)).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("#### 1,"), n)).otherwise(F.concat(F.lit("about "), n))
    return o.select("o_orderkey", F.lit("gsm8k").alias("data_source"), text.alias("response"), n.alias("truth"))


BOOK.add(
    "c2_gsm8k",
    lambda s, d: scorers.score(_responses(s, d)).select("o_orderkey", "score"),
    """WITH r AS (SELECT o_orderkey, (o_custkey % 1000)::VARCHAR AS n FROM orders), t AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 'so we get ' || n || ' #### ' || n WHEN 1 THEN '#### 1,' || n ELSE 'about ' || n END AS x FROM r
    ), a AS (SELECT *, replace(regexp_extract(right(x, 300), '.*#### (-?[0-9.,]+)', 1), ',', '') AS a FROM t) SELECT o_orderkey, (CASE WHEN a = '' THEN 0.0 WHEN a = n THEN 1.0 ELSE 0.0 END)::DOUBLE AS score FROM a""",
)


def _answer() -> Column:
    return F.concat(F.when(F.col("p_partkey") % 5 == 0, F.lit("no tags ")).otherwise(F.concat(F.repeat(F.lit("<answer>x</answer>"), F.when(F.col("p_partkey") % 4 == 0, 11).otherwise(0)), F.lit("<answer> The "))), F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).otherwise(F.col("p_name")), F.lit("! </answer>"))


BOOK.add(
    "c3_qa_exact",
    lambda s, d: table(s, d, "part").select("p_partkey", scorers.qa_match(_answer(), F.array(F.lower("p_name"), F.col("p_brand"))).alias("exact"),
        scorers.qa_match(F.concat(F.lit("<answer>It is "), "p_name", F.lit(" now</answer>")), F.array(F.when(F.col("p_partkey") % 7 == 0, F.col("p_type")).otherwise(F.col("p_name"))), inside=True).alias("inside")),
    r"""WITH f AS (SELECT *, trim(regexp_replace(regexp_replace(regexp_replace(lower(CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_name END), '[[:punct:]]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS said,
      trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name), '[[:punct:]]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS name, trim(regexp_replace(lower(p_brand), '[[:punct:]]', '', 'g')) AS brand,
      trim(regexp_replace(regexp_replace(regexp_replace(lower(p_type), '[[:punct:]]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')) AS kind FROM part)
    SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 OR said NOT IN (name, brand) THEN 0.0 WHEN p_partkey % 4 = 0 THEN 0.25 ELSE 1.0 END::DOUBLE AS exact,
      contains('it is ' || name || ' now', CASE WHEN p_partkey % 7 = 0 THEN kind ELSE name END)::INT::DOUBLE AS inside FROM f""",
)
BOOK.add(
    "c5_medmcqa",
    lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", scorers.medmcqa(F.col("text"), F.lit("e")).alias("score")),
    "SELECT doc_id, contains(substr(text, 1, 16), 'e')::INT::DOUBLE AS score FROM documents WHERE text IS NOT NULL",
)
BOOK.add(
    "m6_overlong_penalty",
    lambda s, d: rounded(table(s, d, "documents").where("n_chars is not null").select("doc_id", scorers.overlong_penalty(F.col("n_chars"), 1000, 400).alias("penalty")), "penalty"),
    "SELECT doc_id, R(least(-(n_chars - 600) / 400.0, 0)) AS penalty FROM documents WHERE n_chars IS NOT NULL",
)
BOOK.add(
    "m10_multiset_match",
    lambda s, d: rounded(table(s, d, "part").select("p_partkey", scorers.multiset_match(F.split("p_name", " "), F.split("p_type", " ")).alias("score")), "score"),
    """WITH a AS (SELECT p_partkey, w, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY ALL), b AS (SELECT p_partkey, w, count(*) AS n FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY ALL
    ), s AS (SELECT a.p_partkey, sum(least(a.n, b.n)) AS s FROM a JOIN b ON a.p_partkey = b.p_partkey AND a.w = b.w GROUP BY 1)
    SELECT p.p_partkey, R(coalesce(s, 0) / (len(string_split(p_name, ' ')) + len(string_split(p_type, ' ')) - coalesce(s, 0))) AS score FROM part p LEFT JOIN s ON p.p_partkey = s.p_partkey""",
)


def _one() -> Column:
    return F.when(F.col("o_custkey") % 4 == 0, F.concat(F.lit(r"so \boxed{\frac1{"), (F.col("o_custkey") % 9 + 1).cast("string"), F.lit("}}"))).when(F.col("o_custkey") % 4 == 1, F.concat(F.lit(r"\boxed{x} thus \boxed{\dfrac{1}{"), (F.col("o_custkey") % 9 + 1).cast("string"), F.lit("}}"))).when(
    F.col("o_custkey") % 4 == 2, F.concat(F.lit(r"\boxed{1/"), (F.col("o_custkey") % 9 + 1).cast("string"), F.lit("}"))).otherwise(F.lit(r"\boxed{never closed"))


BOOK.add(
    "c7_math_boxed",
    lambda s, d: table(s, d, "orders").select("o_orderkey", scorers.math_boxed(_one(), F.concat(F.lit("1/"), (F.col("o_orderkey") % 9 + 1).cast("string"))).alias("score")),
    "SELECT o_orderkey, (o_custkey % 4 < 3 AND o_custkey % 9 = o_orderkey % 9)::INT::DOUBLE AS score FROM orders",
)


def _k() -> Column:
    return (F.col("o_orderkey") % 10).cast("string")


def _sum() -> Column:
    return F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("so \\boxed{"), _k(), F.lit(" + 3 * 4}"))).when(F.col("o_orderkey") % 4 == 1, F.concat(_k(), F.lit(" / 3 * 4 "))).when(F.col("o_orderkey") % 4 == 2, F.concat(F.lit("\\boxed{"), _k(), F.lit(" + 3}"))).otherwise(F.concat(F.lit("-"), _k(), F.lit(" + 3 * 4")))


BOOK.add(
    "c4_countdown",
    lambda s, d: table(s, d, "orders").select("o_orderkey", scorers.countdown(_sum(), F.array((F.col("o_orderkey") % 10).cast("long"), F.lit(3).cast("long"), F.lit(4).cast("long")), (F.col("o_custkey") % 30).cast("long")).alias("r")).select("o_orderkey", "r.score", "r.acc", "r.pred"),
    """WITH k AS (SELECT o_orderkey, o_orderkey % 10 AS k, o_orderkey % 4 AS w, o_custkey % 30 AS target FROM orders
    ), a AS (SELECT o_orderkey, CASE w WHEN 0 THEN k + 12 = target WHEN 1 THEN k % 3 = 0 AND k // 3 * 4 = target ELSE false END AS acc, CASE w WHEN 0 THEN k || ' + 3 * 4' WHEN 1 THEN k || ' / 3 * 4' WHEN 2 THEN k || ' + 3' ELSE '-' || k || ' + 3 * 4' END AS pred FROM k)
    SELECT o_orderkey, CASE WHEN acc THEN 1.0 ELSE -1.0 END::DOUBLE AS score, acc, pred FROM a""",
)


def _matches(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select("event_type", F.col("event_id").alias("seq"), (F.col("event_id") % 12).alias("a"), ((F.col("event_id") + 1 + F.col("user_id") % 10) % 12).alias("b"), (F.col("value") > 50).cast("double").alias("result"))


BOOK.add(
    "c13_elo",
    lambda s, d: rounded(scorers.elo(_matches(s, d), "event_type"), "elo", "reward"),
    """WITH RECURSIVE m AS (SELECT event_type, (event_id % 12)::INT AS a, ((event_id + 1 + user_id % 10) % 12)::INT AS b, (value > 50)::INT::DOUBLE AS r, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events
    ), f AS (SELECT event_type, 0::BIGINT AS n, [1000.0::DOUBLE FOR x IN range(12)] AS e UNION ALL
      SELECT m.event_type, m.n, [CASE WHEN x = m.a AND x = m.b THEN f.e[x + 1] - 32 * (m.r - 1 / (1 + pow(10, (f.e[m.b + 1] - f.e[m.a + 1]) / 400))) WHEN x = m.a THEN f.e[x + 1] + 32 * (m.r - 1 / (1 + pow(10, (f.e[m.b + 1] - f.e[m.a + 1]) / 400)))
        WHEN x = m.b THEN f.e[x + 1] - 32 * (m.r - 1 / (1 + pow(10, (f.e[m.b + 1] - f.e[m.a + 1]) / 400))) ELSE f.e[x + 1] END FOR x IN range(12)] FROM f JOIN m ON m.event_type = f.event_type AND m.n = f.n + 1
    ), l AS (SELECT event_type, max(n) AS n FROM m GROUP BY 1), p AS (SELECT DISTINCT event_type, unnest([a, b]) AS player FROM m)
    SELECT p.event_type, p.player::BIGINT AS player, R(e[p.player + 1]) AS elo, R((e[p.player + 1] - 1000) / 200 + 0.5) AS reward FROM l JOIN f ON f.event_type = l.event_type AND f.n = l.n JOIN p ON p.event_type = l.event_type""".replace(
        "SELECT event_type, 0::BIGINT AS n, [1000.0::DOUBLE FOR x IN range(12)] AS e UNION", "SELECT DISTINCT event_type, 0::BIGINT AS n, [1000.0::DOUBLE FOR x IN range(12)] AS e FROM events UNION"
    ),
)
BOOK.add(
    "c13_win_rates",
    lambda s, d: rounded(scorers.win_rates(_matches(s, d), "event_type"), "score"),
    """WITH m AS (SELECT event_type, event_id % 12 AS a, (event_id + 1 + user_id % 10) % 12 AS b, (value > 50)::INT AS r FROM events)
    SELECT event_type, player, count(*) AS games, R(avg(s)) AS score FROM (SELECT event_type, a AS player, r AS s FROM m UNION ALL SELECT event_type, b, 1 - r FROM m) GROUP BY ALL""",
)


def _call() -> Column:
    return F.when(F.col("event_id") % 5 == 0, "no call").when(F.col("event_id") % 5 == 1, F.concat(F.lit("<tool_call>not json</tool_call>"), F.lit('<tool_call>{"name": "'), "event_type", F.lit('", "arguments": '), "props", F.lit("}</tool_call>"))).when(
    F.col("event_id") % 5 == 2, F.concat(F.lit('<tool_call>{"name": "look"}</tool_call>'))).otherwise(F.concat(F.repeat(F.concat(F.lit('<tool_call>{"name": "look", "arguments": '), "props", F.lit("}</tool_call>")), (F.col("event_id") % 5 - 1).cast("int"))))


BOOK.add(
    "f24_tool_calls",
    lambda s, d: table(s, d, "events").select("event_id", parsing.tool_calls(_call()).alias("c")).select("event_id", F.size("c").alias("calls"), F.try_element_at("c", F.lit(1))["name"].alias("name")),
    "SELECT event_id, CASE event_id % 5 WHEN 1 THEN 1 WHEN 3 THEN 2 WHEN 4 THEN 3 ELSE 0 END AS calls, CASE event_id % 5 WHEN 1 THEN event_type WHEN 3 THEN 'look' WHEN 4 THEN 'look' END AS name FROM events",
)
# --- streams ---------------------------------------------------------------------------------------------------------


def _events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(F.concat(F.lit("q"), F.col("user_id") % 20).alias("queue"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "click", "get").otherwise("put").alias("op"))


BOOK.add(
    "t1_bounded_queue",
    lambda s, d: queues.bounded_queue(_events(s, d), "queue", "seq", 50),
    """WITH RECURSIVE e AS (SELECT 'q' || (user_id % 20) AS queue, event_type <> 'click' AS put, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS k FROM events
    ), f AS (SELECT queue, k, CASE WHEN put THEN 1 ELSE 0 END AS len, 0 AS got, 0 AS dropped FROM e WHERE k = 1 UNION ALL
      SELECT e.queue, e.k, CASE WHEN put THEN least(f.len + 1, 50) ELSE greatest(f.len - 1, 0) END, f.got + (NOT put AND f.len > 0)::INT, f.dropped + (put AND f.len = 50)::INT FROM f JOIN e ON e.queue = f.queue AND e.k = f.k + 1
    ), p AS (SELECT queue, count(*) FILTER (put) AS produced, max(k) AS k FROM e GROUP BY queue)
    SELECT p.queue, produced, got::BIGINT AS consumed, dropped::BIGINT AS dropped, len::BIGINT AS left FROM p JOIN f ON p.queue = f.queue AND p.k = f.k""".replace("AS left FROM", 'AS "left" FROM'),
)
BOOK.add(
    "t2_newest",
    lambda s, d: queues.newest(_events(s, d), "queue", "seq", 30).select("queue", "seq"),
    "SELECT 'q' || (user_id % 20) AS queue, event_id AS seq FROM events QUALIFY row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id DESC) <= 30",
)
BOOK.add(
    "t6_stale_counts",
    lambda s, d: queues.stale_counts(table(s, d, "events").select(F.floor(F.col("event_id") / 100).alias("version"), (F.col("user_id") % 3 == 0).cast("int").alias("a"), (F.col("user_id") % 3 == 1).cast("int").alias("q")), "version", "a", "q"),
    "SELECT event_id // 100 AS version, count(*) FILTER (user_id % 3 < 2) AS stale FROM events GROUP BY 1",
)
BOOK.add(
    "t8_replay_buffer",
    lambda s, d: queues.replay_buffer(table(s, d, "events").select((F.col("event_id") % 50).alias("partition"), F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.lit(1).cast("long").alias("global_steps"),
        F.when(F.col("event_id") % 211 == 0, "running").otherwise("success").alias("status")), 1).select("partition", "key"),
    """WITH l AS (SELECT event_id % 50 AS partition, user_id AS key, event_id % 211 = 0 AS running FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 50, user_id ORDER BY event_id DESC) = 1)
    SELECT partition, key FROM l WHERE partition NOT IN (SELECT partition FROM l WHERE running)""",
)
BOOK.add(
    "t11_token_bucket",
    lambda s, d: rounded(queues.token_bucket(table(s, d, "events").select("event_type", "event_id", (F.col("event_id") / 10).alias("at"), "value"), "event_type", "event_id", "at", "value", 40.0, 200.0), "wait"),
    """WITH RECURSIVE e AS (SELECT event_type, event_id, event_id / 10 AS moment, value::DOUBLE AS c, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events
    ), f AS (SELECT event_type, event_id, n, moment AS t, greatest(least(c, 200) - 200.0, 0.0) / 40 AS wait, 200.0 - c AS level FROM e WHERE n = 1 UNION ALL
      SELECT e.event_type, e.event_id, e.n, greatest(e.moment, f.t), greatest(least(e.c, 200) - least(200.0, f.level + greatest(e.moment - f.t, 0) * 40), 0.0) / 40, least(200.0, f.level + greatest(e.moment - f.t, 0) * 40) - e.c FROM f JOIN e ON e.event_type = f.event_type AND e.n = f.n + 1)
    SELECT event_type, event_id, R(wait) AS wait FROM f""",
)


def _as_stream(s: SparkSession, rows: DataFrame) -> tuple[DataFrame, str]:
    home = f"{scratch(s)}/stream-{uuid.uuid4().hex}"
    rows.write.parquet(f"{home}/in")
    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    return queues.stream_files(s, f"{home}/in", schema, 4), home


def t7_count_batches(s: SparkSession, d: str) -> DataFrame:
    """Count-triggered batches of each event type through Structured Streaming, state kept across triggers."""
    stream, home = _as_stream(s, table(s, d, "events").select("event_type", F.col("event_id").alias("seq")).repartitionByRange(4, "seq"))
    return queues.run_available(queues.count_batches_stream(stream, "event_type", 64), f"{home}/out", f"{home}/checkpoint")


BOOK.add(
    "t7_count_batches",
    t7_count_batches,
    """WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS k FROM events)
    SELECT event_type, k // 64 AS batch, count(*) AS rows, min(event_id) AS first_seq, max(event_id) AS last_seq FROM r GROUP BY event_type, k // 64 HAVING count(*) = 64""",
)


def event_time_windows(s: SparkSession, d: str) -> DataFrame:
    """Tumbling event-time windows with a watermark (an extension); complete output of one run over what is there."""
    stream, home = _as_stream(s, table(s, d, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value"))
    windows = queues.run_updates(queues.windowed_metrics(stream, "1 hour", "10 minutes"), f"{home}/out", f"{home}/checkpoint", ["start", "event_type"], "n")
    return windows.groupBy("event_type").agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("n"), F.round(F.sum("total"), 4).alias("total"))


BOOK.add(
    "x_event_time_windows",
    event_time_windows,
    "SELECT event_type, count(DISTINCT date_trunc('hour', ts)) AS windows, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1",
)
QUERIES, SQL = BOOK.queries, BOOK.sql
