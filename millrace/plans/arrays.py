"""Token-array queries over documents' characters, embeddings and orders, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import sequences as seq
from millrace.session import table

from .common import Book, rounded
from .rollout import TOKENS, tokens

BOOK = Book()


def _ids(s: SparkSession, d: str) -> DataFrame:
    """vec_id and 64 small ints of each embedding."""
    return table(s, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.floor(F.abs(x) * 10).cast("int")).alias("ids"))


_IDS = "v AS (SELECT vec_id, [floor(abs(x) * 10)::INT FOR x IN embedding] AS ids FROM embeddings)"
BOOK.add(
    "f21_eos_mask",
    lambda s, d: _ids(s, d).select("vec_id", F.aggregate(seq.eos_mask(F.col("ids"), 2, 3), F.lit(0), lambda a, x: a + x).alias("kept")),
    f"WITH {_IDS} SELECT vec_id, coalesce(nullif(least(coalesce(nullif(list_position(ids, 2), 0), 999), coalesce(nullif(list_position(ids, 3), 0), 999)), 999), 64)::INT AS kept FROM v",
)
BOOK.add(
    "f19_pad_or_cut",
    lambda s, d: _ids(s, d).select("vec_id", *(F.array_join(seq.pad_or_cut(F.slice("ids", 1, (F.col("vec_id") % 20).cast("int") + 1), 12, 0, side, cut), " ").alias(f"{side}_{cut}") for side, cut in (("left", "left"), ("right", "right"), ("right", "middle")))),
    f"""WITH {_IDS}, p AS (SELECT vec_id, ids[1:vec_id % 20 + 1] AS x, (vec_id % 20 + 1)::INT AS n FROM v)
    SELECT vec_id, array_to_string(CASE WHEN n > 12 THEN x[n - 11:n] ELSE list_concat(list_resize([]::INT[], 12 - n, 0), x) END, ' ') AS left_left, array_to_string(CASE WHEN n > 12 THEN x[1:12] ELSE list_resize(x, 12, 0) END, ' ') AS right_right,
      array_to_string(CASE WHEN n > 12 THEN list_concat(x[1:6], x[n - 5:n]) ELSE list_resize(x, 12, 0) END, ' ') AS right_middle FROM p""",
)
BOOK.add(
    "f18_sft_loss_mask",
    lambda s, d: table(s, d, "orders").select("o_orderkey", F.array_join(seq.sft_loss_mask((F.col("o_orderkey") % 5 + 1).cast("int"), (F.col("o_custkey") % 4 + 1).cast("int")), "").alias("mask")),
    "SELECT o_orderkey, repeat('0', (o_orderkey % 5)::INT) || repeat('1', (o_custkey % 4 + 1)::INT) || '0' AS mask FROM orders",
)
BOOK.add(
    "z3_unpadded",
    lambda s, d: _ids(s, d).select("vec_id", F.array_join(seq.unpadded(F.col("ids"), F.transform("ids", lambda x: (x > 1).cast("int"))), " ").alias("kept")),
    f"WITH {_IDS} SELECT vec_id, array_to_string([x FOR x IN ids IF x > 1], ' ') AS kept FROM v",
)
BOOK.add(
    "z2_position_ids",
    lambda s, d: _ids(s, d).select("vec_id", F.posexplode(seq.position_ids(F.transform(F.slice("ids", 1, 10), lambda x: (x > 1).cast("int")))).alias("i", "p")),
    f"WITH {_IDS}, m AS (SELECT vec_id, (i - 1)::INT AS i, (ids[i] > 1)::INT AS m FROM v, range(1, 11) t(i)) SELECT vec_id, i, greatest(sum(m) OVER (PARTITION BY vec_id ORDER BY i) - 1, 0)::INT AS p FROM m",
)
BOOK.add(
    "a36_token_differences",
    lambda s, d: seq.token_differences(_ids(s, d).withColumns({"b": F.reverse("ids"), "m": F.transform("ids", lambda x, i: (i % 2).cast("int"))}), "ids", "b", "m").select("vec_id", "diff"),
    f"WITH {_IDS} SELECT vec_id, list_sum([(ids[i] <> ids[65 - i] AND i % 2 = 0)::INT FOR i IN range(1, 65)])::INT AS diff FROM v",
)
BOOK.add(
    "z1_assembled_turns",
    lambda s, d: seq.assembled_turns(
        table(s, d, "events").select(F.floor(F.col("event_id") / 6).alias("conv_id"), F.col("event_id").alias("turn"), F.when(F.col("event_id") % 2 == 1, "assistant").otherwise("user").alias("role"),
            F.array((F.col("user_id") % 9).cast("int"), F.lit(7), F.lit(8)).alias("ids"), F.lit(1).alias("prompt_len"))).select("conv_id", F.array_join("ids", " ").alias("ids"), F.array_join("loss_mask", "").alias("mask")),
    """SELECT event_id // 6 AS conv_id, string_agg((user_id % 9) || ' 7 8', ' ' ORDER BY event_id) AS ids, string_agg(CASE WHEN event_id % 2 = 1 THEN '011' ELSE '000' END, '' ORDER BY event_id) AS mask FROM events GROUP BY 1""",
)
BOOK.add(
    "z10_samples_per_prompt",
    lambda s, d: seq.samples_per_prompt(table(s, d, "orders"), "o_custkey", "o_orderkey", "o_orderstatus").select("o_custkey", F.array_join("samples", "").alias("samples")),
    "SELECT o_custkey, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS samples FROM orders GROUP BY 1",
)
BOOK.add(
    "z16_equal_parts",
    lambda s, d: seq.equal_parts(o := table(s, d, "orders").select(F.col("o_orderkey").alias("row_idx")), 7, o.count()).groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("row_idx").alias("lo")),
    "WITH n AS (SELECT count(*) // 7 AS k FROM orders) SELECT (o_orderkey // k)::INT AS part, count(*) AS n, min(o_orderkey) AS lo FROM orders, n WHERE o_orderkey // k < 7 GROUP BY 1",
)
BOOK.add(
    "u6_repeat_each",
    lambda s, d: seq.repeat_each(table(s, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("n")), "n").select("o_orderkey", "copy"),
    "SELECT o_orderkey, unnest(range(o_custkey % 4))::INT AS copy FROM orders WHERE o_custkey % 4 > 0",
)
BOOK.add(
    "u12_padding_rows",
    lambda s, d: seq.with_padding_rows(table(s, d, "orders").select("o_orderkey"), 4096, {"o_orderkey": F.lit(-1).cast("long")}).groupBy("is_padding").count(),
    "SELECT false AS is_padding, count(*) AS count FROM orders UNION ALL SELECT true, (4096 - count(*) % 4096) % 4096 FROM orders",
)
BOOK.add(
    "w6_top_two",
    lambda s, d: seq.top_two(table(s, d, "orders"), "o_orderpriority", "o_totalprice"),
    'SELECT o_orderpriority, max(o_totalprice) AS "first", (list(o_totalprice ORDER BY o_totalprice DESC))[2] AS "second" FROM orders GROUP BY 1',
)
BOOK.add(
    "z17_prompt_groups",
    lambda s, d: seq.prompt_groups(table(s, d, "orders"), "o_custkey", "o_orderkey"),
    'SELECT o_custkey, count(*) AS size, min(o_orderkey) AS "first" FROM orders GROUP BY 1',
)
BOOK.add(
    "b8_dispatch",
    lambda s, d: seq.dispatched(table(s, d, "orders").select(F.col("o_orderkey").alias("row_idx")), "chunk", 5, total=table(s, d, "orders").count()).groupBy("rank").agg(F.min("row_idx").alias("lo"), F.max("row_idx").alias("hi")),
    "WITH n AS (SELECT count(*) // 5 AS k FROM orders) SELECT (o_orderkey // k)::INT AS rank, min(o_orderkey) AS lo, max(o_orderkey) AS hi FROM orders, n GROUP BY 1",
)
BOOK.add(
    "f24_swapped_preference",
    lambda s, d: seq.swapped_preference(table(s, d, "part").select("p_partkey", F.col("p_name").alias("response1"), F.col("p_type").alias("response2"), F.lit(1).alias("answer")), "p_partkey"),
    "SELECT p_partkey, CASE WHEN f THEN p_type ELSE p_name END AS response1, CASE WHEN f THEN p_name ELSE p_type END AS response2, CASE WHEN f THEN 2 ELSE 1 END AS answer FROM (SELECT *, substr(md5('42:' || p_partkey), 1, 1) >= '8' AS f FROM part)",
)
BOOK.add(
    "f16_expanded_content",
    lambda s, d: table(s, d, "part").select("p_partkey", F.explode(seq.expanded_content(F.concat(F.lit("see <image> and "), "p_name", F.lit(" <image>")), F.array("p_brand", "p_type"), F.array().cast("array<string>"))).alias("x")).select("p_partkey", "x.type", "x.value"),
    """SELECT p_partkey, unnest(['text', 'image', 'text', 'image']) AS type, unnest(['see ', p_brand, ' and ' || p_name || ' ', p_type]) AS value FROM part""",
)
BOOK.add(
    "a21_timing_per_token",
    lambda s, d: rounded(seq.timing_per_token(table(s, d, "events").groupBy(F.when(F.col("event_type") == "click", "gen").otherwise(F.col("event_type")).alias("name")).agg(F.sum("value").alias("seconds")), tokens(s, d).agg(F.sum("mask").alias("response"), F.count(F.lit(1)).alias("total"))), "ms_per_token"),
    f"""WITH {TOKENS}, n AS (SELECT sum(mask) AS response, count(*) AS total FROM tok)
    SELECT name, R(1000 * s / CASE WHEN name = 'gen' THEN response ELSE total END) AS ms_per_token FROM (SELECT CASE WHEN event_type = 'click' THEN 'gen' ELSE event_type END AS name, sum(value) AS s FROM events GROUP BY 1), n""",
)
BOOK.add(
    "a42_dense_flops",
    lambda s, d: rounded(table(s, d, "events").groupBy("event_type").agg(seq.dense_flops(F.sum("user_id"), F.sum(F.col("user_id") * F.col("user_id")), 7e9, 28, 3584, F.sum("value")).alias("tflops")), "tflops"),
    "SELECT event_type, R((6.0 * 7e9 * sum(user_id) + 12.0 * sum(user_id * user_id) * 28 * 3584) / sum(value) / 1e12) AS tflops FROM events GROUP BY 1",
)
BOOK.add("u14_table_equality", lambda s, d: seq.differs(table(s, d, "nation"), table(s, d, "nation").repartition(3)).groupBy().agg(F.count(F.lit(1)).alias("n")), "SELECT 0::BIGINT AS n")
QUERIES, SQL = BOOK.queries, BOOK.sql
