"""Goldens and edges of the core operators."""

import random

import hashlib
import json

import pytest
from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import functions as F

from millrace.functions import decisions, parsing, prompts, records, scorers
from millrace.operators import aggregates, balance, batches, components, estimators, joins, metrics, offpolicy, ordering, pairs, pool, sequences
from millrace.sources import artifacts, jsonl
from millrace.streaming import queues


def classified(spark, rows):
    df = spark.createDataFrame(rows, "gold string, pred string, valid boolean")
    return metrics.classification_rates(df.agg(*metrics.classification_counts())).first()


def test_metric_goldens(spark):
    s, n = "sarcastic", "non-sarcastic"
    r = classified(spark, [(s, s, True), (s, n, True), (n, n, True), (None, None, False)])
    assert (r.samples, r.accuracy, r.invalid) == (4, 0.5, 1)
    r = classified(spark, [(n, n, True), (s, None, False)])
    assert r.support_pos == 1 and r.recall == 0
    r = classified(spark, [(s, s, True), (n, s, True), (n, None, False)])
    assert (round(r.accuracy, 6), round(r.coverage, 6), r.tp, r.invalid_neg) == (0.333333, 0.666667, 1, 1)
    assert classified(spark, []).accuracy == 0


def test_masked_aggregates_ignore_nan_outside_the_mask(spark):
    df = spark.createDataFrame([(1.0, 1), (3.0, 1), (float("nan"), 0)], "v double, m int")
    r = aggregates.masked_stats(df, "v", "m").first()
    assert round(r["mean"], 6) == 2.0 and round(r["var"], 5) == 2.0
    with pytest.raises(PySparkException, match="mask"):
        aggregates.masked_stats(df.where("v = 1"), "v", "m").collect()


def tokens(spark, rows):
    return spark.createDataFrame([(t, u, p, float(r), m) for t, u, p, r, m in rows], "traj_id long, uid long, pos long, reward double, mask int")


def test_singleton_groups_of_each_estimator(spark):
    t = tokens(spark, [(1, 1, 1, 2, 1), (2, 2, 1, 1, 1), (3, 2, 1, 3, 1)])
    value = lambda df: {r.traj_id: round(r.advantage, 4) for r in df.collect()}
    assert value(estimators.rloo(t)) == {1: 2.0, 2: -2.0, 3: 2.0}
    assert value(estimators.rloo_vectorized(t))[1] == 0.0
    assert value(estimators.grpo(t))[1] == 2.0
    assert value(estimators.opo(t))[1] == 2.0
    with pytest.raises(PySparkException, match="two trajectories"):
        estimators.grpo_passk(t).collect()
    assert set(estimators.ESTIMATORS) >= {"gae", "grpo", "gdpo", "rloo", "opo", "remax", "gpg", "optimal_token_baseline", "tir_optimal_token_baseline"}


def test_thresholds():
    assert offpolicy.is_threshold("0.5_2") == (2.0, 0.5)
    assert offpolicy.rs_thresholds(["token_k1", "seq_sum_k2"], "2")["token_k1"] == (0.5, 2.0)
    for bad in (True, "0", "2_1", "1_2_3"):
        with pytest.raises(ValueError):
            offpolicy.is_threshold(bad)
    with pytest.raises(ValueError):
        offpolicy.rs_thresholds(["token_k2"], "0.5_2")


def test_pool_goldens():
    p = pool.replayed([("ADD", None, "m", "b", None), ("UPVOTE", "exp-000001", None, None, None), ("MODIFY", "exp-000001", None, "c", "BOUNDARY"), ("DOWNVOTE", "exp-000001", None, None, None)])
    item = p.items["exp-000001"]
    assert (item["importance"], item["revision"], item["upvotes"], item["modifies"], item["downvotes"]) == (3, 2, 1, 1, 1)
    for _ in range(3):
        p.apply("DOWNVOTE", "exp-000001", None, None, None)
    assert item["importance"] == 0 and not item["active"]
    p = pool.replayed([("ADD", None, f"m{i}", "b", None) for i in range(3)], capacity=2)
    assert [i for i, x in p.items.items() if x["active"]] == ["exp-000002", "exp-000003"]
    p.apply("DOWNVOTE", "exp-000003", None, None, None)
    assert p.items["exp-000001"]["active"] and not p.items["exp-000003"]["active"]
    with pytest.raises(ValueError):
        p.apply("MODIFY", "exp-000002", "other", None, "BOUNDARY")


def test_balance_against_brute_force():
    rng = random.Random(1)
    for _ in range(20):
        sizes = [rng.randint(1, 90) for _ in range(12)]
        for equal in (False, True):
            parts = balance.differencing(sizes, 3, equal)
            assert sorted(i for p in parts for i in p) == list(range(12))
            assert not equal or {len(p) for p in parts} == {4}
            sums = [sum(sizes[i] for i in p) for p in parts]
            assert max(sums) - min(sums) <= max(sizes)
    assert balance.greedy([3, 3, 2, 2, 2], 2) == [[0, 2, 4], [1, 3]]
    for bad in (([1], 2, False), ([1, 2, 3], 2, True)):
        with pytest.raises(ValueError):
            balance.differencing(*bad)


def test_components_on_random_graphs(spark):
    rng = random.Random(3)
    edges = [(f"n{rng.randint(0, 60):02d}", f"n{rng.randint(0, 60):02d}") for _ in range(45)] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(150)] + [("x", "x"), ("y", None)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "x string, y string")).collect()}
    parent = {}

    def find(v):
        while parent.setdefault(v, v) != v:
            v = parent[v]
        return v

    for a, b in edges:
        if a and b and a != b:
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    assert got == {v: find(v) for v in parent}
    assert components.components(spark.createDataFrame([], "x string, y string")).count() == 0


def test_salted_left_join(spark):
    rows = spark.createDataFrame([(n, "hot" if n < 50 else None if n < 60 else f"k{n}") for n in range(80)], "n int, k string")
    right = spark.createDataFrame([("hot", 1), ("k70", 2), ("other", 3)], "k string, v int")
    want = sorted((r.n, r.k or "", r.v or 0) for r in rows.join(right, "k", "left").collect())
    for most in (10, 1000):
        assert sorted((r.n, r.k or "", r.v or 0) for r in joins.salted_left_join(rows, right, "k", most).collect()) == want


def test_member_pairs_of_hot_classes(spark):
    left = spark.createDataFrame([("big", n) for n in range(40)] + [("x", 100), ("lone", 7)], "cls string, id int")
    right = spark.createDataFrame([("y", n) for n in range(30)] + [("big", 500)], "cls string, id int")
    links = spark.createDataFrame([("big", "y", 0.5), ("x", "y", 0.9), ("x", "big", 0.8), ("none", "y", 1.0)], "cls_a string, cls_b string, w double")
    want = sorted([(n, m, 0.5) for n in range(40) for m in range(30)] + [(100, m, 0.9) for m in range(30)] + [(100, 500, 0.8)])
    for block in (1000, 7):
        assert sorted((r.x, r.y, r.w) for r in pairs.member_pairs(links, left, right, block).collect()) == want


def test_pairs_of_hot_groups_in_blocks(spark):
    rows = spark.range(50).select(F.col("id"), F.when(F.col("id") < 30, "hot").when(F.col("id") < 32, "two").otherwise(F.col("id").cast("string")).alias("k"), (F.col("id") % 3 == 0).alias("f"))
    for block in (4, 100):
        got = {(r.a.id, r.b.id) for r in pairs.keyed_pairs(rows, ["k"], "id", ["id"], block).collect()}
        assert got == {(a, b) for a in range(30) for b in range(a + 1, 30)} | {(30, 31)}
        got = [(r.a.id, r.b.id) for r in pairs.two_sided_pairs(rows, ["k"], "id", "f", ["id"], block).collect()]
        assert sorted(got) == sorted([(a, b) for a in range(0, 30, 3) for b in range(30) if b % 3] + [(30, 31)])


def test_row_index_and_stratified_errors(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("id"))
    assert all(r.id == r.row_idx for r in ordering.global_row_index(df, ["id"]).collect())
    quotas = spark.createDataFrame([("a", 5)], "s string, quota int")
    with pytest.raises(PySparkException, match="too few"):
        ordering.stratified_sample(spark.createDataFrame([(1, "a")], "id long, s string"), "id", ["s"], quotas).collect()
    with pytest.raises(ValueError):
        ordering.chunk_of(F.lit(1), 10, 3)


def test_resampling_follows_the_weights(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 0.0), (4, None)], "id long, w double")
    counts = {r.id: r["count"] for r in ordering.resample(df, "id", F.col("w"), 4000).groupBy("id").count().collect()}
    assert sum(counts.values()) == 4000 and set(counts) == {1, 2} and abs(counts[2] - 3000) < 150


def test_labels_and_records(spark):
    df = spark.createDataFrame([("x", " SARCASTIC "), ("y", "not-sarcastic"), ("z", "not_sarcastic"), (None, "1"), (" ", None), ("v", "1.0"), ("w", "true")], "id string, gold_label string").withColumns({"post_text": F.lit("t"), "image": F.lit("i")})
    rows = records.normalised(df).collect()
    # strings are labels by their spelling alone; numbers and booleans by their value
    assert [r.label for r in rows] == ["sarcastic", None, "non-sarcastic", "sarcastic", None, None, None]
    record = {"gold_label": "1", "image": "i", "post_text": "t"}
    assert rows[3].sample_id == "generated:" + hashlib.sha256(json.dumps(record, sort_keys=True).encode()).hexdigest()[:24]
    assert rows[4].sample_id.startswith("generated:") and rows[4].sample_id != rows[3].sample_id and rows[4].error == "label is unknown"
    assert df.select(records.label_rule_b("gold_label").alias("b")).collect()[1].b == "non-sarcastic"
    typed = spark.createDataFrame([(True, 1.0), (False, 0.0), (None, 2.0)], "label boolean, gold_label double")
    assert [r.x for r in typed.select(records.label_rule_a(records.label_text(typed, "label")).alias("x")).collect()] == ["sarcastic", "non-sarcastic", None]
    assert [r.x for r in typed.select(records.label_rule_a(records.label_text(typed, "gold_label")).alias("x")).collect()] == ["sarcastic", "non-sarcastic", None]


def test_record_extras(spark):
    reasoning = "struct<visual_evidence:string,textual_evidence:string,explanation:string,label:string>"
    df = spark.createDataFrame([("a", "t", "1", "../b/./c.jpg", "s", "de", 1, ("v", "w", "e", "sarcastic"), True), ("b", "t", "0", "/x//y.jpg", None, None, None, ("v", "w", "e", "sarcastic"), False)],
        f"guid string, tweet string, class string, photo_path string, dataset string, lang string, text_label int, analysis {reasoning}, reference_valid boolean")
    a, b = records.normalised(df, "/data/in").collect()
    assert (a.sample_id, a.text, a.label, a.image_path, a.source, a.language, a.extraction_metadata, a.reference_reasoning.explanation, a.error) == ("a", "t", "sarcastic", "/data/b/c.jpg", "s", "de", {"text_label": "1"}, "e", None)
    assert (b.image_path, b.source, b.extraction_metadata, b.reference_reasoning) == ("/x/y.jpg", None, {}, None)


def test_sentence_goldens(spark):
    texts = ["Dr. Smith is fine. He left, e.g. yesterday!", "J. K. wrote it. It cost 3.5 dollars. Done.", 'He said "no." Then he left.', "One only.", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r.n for r in df.select(F.size(parsing.sentences(F.col("t"))).alias("n")).collect()][:4] == [2, 3, 2, 1]
    errors = [r.e for r in df.select(parsing.experience_error(F.col("t")).alias("e")).collect()]
    assert errors[0] is None and errors[3] == "content must have two or three sentences" and errors[5] == "content must be a non-empty English string"
    fixed = spark.createDataFrame([("Praise sounds warm, but the queue is long.",), ("A. B c d. E f. G h. I j.",)], "t string").select(parsing.repaired_sentences(F.col("t")).alias("t")).collect()
    assert fixed[0].t == "Praise sounds warm. The queue is long."


def test_outputs(spark):
    good = '{"visual_evidence": "a", "textual_evidence": "b", "explanation": "c", "label": "sarcastic"}'
    raws = [good, "<think>x</think>" + good, "<think>x", "```json\n" + good + "\n```", "[1]", "", None, good[:-1] + ', "more": 1}', '{"label": "sarcastic"}']
    errors = [r.e for r in spark.createDataFrame([(r,) for r in raws], "r string").select(parsing.reasoning_output_error("r").alias("e")).collect()]
    assert errors[:2] == [None, None] and errors[2] == "unterminated thinking block" and "fences" in errors[3] and "object" in errors[4]
    assert errors[5] == errors[6] == "model output is empty" and errors[7:] == ["unexpected field", "missing field"]


def test_scorers(spark):
    df = spark.createDataFrame([("gsm8k", "a #### 1,234", "1234"), ("gsm8k", "none", "1"), ("medmcqa", "The answer is B", "B"), ("math", r"so \boxed{\frac12}", "1/2")], "data_source string, response string, truth string")
    assert [r.score for r in scorers.score(df).collect()] == [1.0, 0.0, 1.0, 1.0]
    with pytest.raises(PySparkException, match="no scorer"):
        scorers.score(df.withColumn("data_source", F.lit("other"))).collect()
    value = lambda text, **k: scorers.arithmetic(text, **k)[0]
    assert value("2 + 3 * 4 // 6") == 4 and value("12 / 4") == 3 and value("7 / 2") is None and value("1 / 0") is None and value("__import__('os')") is None and value("-2") is None
    assert value("100 * 100", within=(0, 999)) is None and value("5 - 7", within=(0, 999)) is None and value("5 - 7") == -2
    assert scorers.last_boxed(r"\boxed{a{b}c} \boxed{open") is None and scorers.last_boxed(r"\boxed{a{b}c}") == "a{b}c" and scorers.last_boxed(r"$\boxed 7$ done") == "7"


def test_math_forms():
    same = [(r"\dfrac{1}{2}", "1/2"), ("0.5", r"\frac12"), (r"\frac1{72}", r"\frac{1}{72}"), ("x=5", "5"), (".5", "1/2"), (r"90^\circ", "90"), (r"5\text{ cm}", "5"), (r"\sqrt3", r"\sqrt{3}"), (r"\left(1, 2\right)", "(1,2)"), (r"10\%", "10"), (r"\frac{1}{2", r"\frac{1}{2")]
    assert all(scorers.math_equal(a, b) for a, b in same)
    assert not scorers.math_equal("1,000 dollars", "1000") and not scorers.math_equal("01/2", "1/2") and not scorers.math_equal(r"\sqrt", "x")
    assert scorers.dapo_form("so x = 1,000 dollars") == "1000" and scorers.dapo_form(r"the value is $\frac12$ units") == r"\frac{1}{2}" and scorers.dapo_form(r"\text{ways}12 degrees") == "12"
    assert scorers.numeric_equal("50%", "0.5") and scorers.numeric_equal("1,000", "1000.0") and not scorers.numeric_equal("1", "2") and not scorers.numeric_equal("pi", "3.14")


def test_scored_structs(spark):
    df = spark.createDataFrame([(r"\boxed{2 + 3}", [2, 3], 5), ("2 + 3 ", [2, 3], 5), (r"\boxed{5}", [2, 3], 5), (r"\boxed{3 / 2}", [2, 3], 1), (None, [2], 2)], "r string, n array<long>, t long")
    assert [tuple(x) for x in df.select(scorers.countdown("r", "n", "t").alias("s")).select("s.*").collect()] == [(1.0, True, "2 + 3"), (1.0, True, "2 + 3"), (-1.0, False, "5"), (-1.0, False, "3 / 2"), (-1.0, False, None)]
    df = spark.createDataFrame([("thus\nAnswer: 1,000 dollars", "1000"), ("no", "1"), (r"\boxed{7}", "7")], "r string, t string")
    assert [tuple(x) for x in df.select(scorers.math_dapo("r", "t").alias("s")).select("s.*").collect()] == [(1.0, True, "1000"), (-1.0, False, "[INVALID]"), (-1.0, False, "[INVALID]")]
    assert [tuple(x) for x in df.select(scorers.math_strict_box("r", "t").alias("s")).select("s.*").collect()] == [(-1.0, False, None), (-1.0, False, None), (1.0, True, "7")]
    think, call = "<think>x</think>\n", '<tool_call>\n{"name": "look", "parameters": {"q": 1, "r": 2}}\n</tool_call>'
    wanted = think + call
    said = ["<|im_start|>assistant" + wanted + "<|im_end|>", think + call.replace('"r": 2', '"r": 3'), think + call.replace("look", "find"), "nothing", think + "<tool_call>\nnot json\n</tool_call>"]
    df = spark.createDataFrame([(r, wanted) for r in said], "r string, t string")
    got = [tuple(x) for x in df.select(scorers.tool_call_score(F.col("r"), F.col("t")).alias("s")).select("s.*").collect()]
    # names 1, parameter names 1, one of two values: 3 of 4 points
    assert got == [(4.0, 1.0, 3.0), (1.0 + 1.5, 1.0, 1.5), (-2.0, 1.0, -3.0), (-3.0, 0.0, -3.0), (-2.0, 1.0, -3.0)]


def test_upsert_keeps_places(spark):
    base = spark.createDataFrame([("a", 0, "old"), ("b", 1, "old"), ("a", 2, "old2")], "k string, p long, v string")
    new = spark.createDataFrame([("b", 0, "x"), ("b", 1, "y"), ("c", 2, "z")], "k string, at long, v string")
    assert {(r.k, r.p, r.v) for r in artifacts.upsert(base, new, "k", "p", "at").collect()} == {("a", 0, "old"), ("b", 1, "y"), ("c", 5, "z")}


def test_journal_tail(spark):
    lines = spark.createDataFrame([("f", 1, True), ("f", 2, False)], "file string, line_no long, ok boolean")
    assert artifacts.repaired_journal(lines, F.col("ok")).count() == 1
    with pytest.raises(PySparkException, match="corrupt"):
        artifacts.repaired_journal(lines, F.col("ok"), repair_tail=False).collect()
    with pytest.raises(PySparkException, match="corrupt"):
        artifacts.repaired_journal(lines.withColumn("ok", ~F.col("ok")), F.col("ok")).collect()


def test_strict_lines(spark):
    lines = spark.createDataFrame([(1, '{"a": 1}'), (2, " "), (3, "[1]"), (4, None)], "line_no long, raw string")
    from pyspark.sql.types import LongType, StructType

    schema = StructType().add("a", LongType())
    assert [(r.line_no, r.a, r.error is None) for r in jsonl.parse_lines(lines, schema).orderBy("line_no").collect()] == [(1, 1, True), (3, None, False)]
    with pytest.raises(PySparkException, match="line 3"):
        jsonl.parse_lines(lines, schema, strict=True).collect()
    with pytest.raises(ValueError):
        jsonl.keyed(spark.createDataFrame([("a",), ("a",)], "k string"), "k")


def test_review_states(spark):
    c = spark.createDataFrame([(i, "f", "c") for i in range(4)], "id long, fingerprint string, reasoning string")
    r = spark.createDataFrame([(1, "g", "ACCEPT", None), (2, "f", "ACCEPT", None), (3, "f", "REVISE", "new")], "id long, correction_fingerprint string, decision string, revised_reasoning string")
    got = {x.id: (x.state, x.reasoning) for x in joins.review_state(c, r, "id").collect()}
    assert got == {0: ("PENDING", "c"), 1: ("STALE", "c"), 2: ("ACCEPT", "c"), 3: ("REVISE", "new")}
    with pytest.raises(PySparkException, match="revises"):
        joins.review_state(c, r.withColumn("revised_reasoning", F.lit("x")), "id").collect()


def test_lookup_and_zip_raise(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "x")], "k long, v string")
    with pytest.raises(PySparkException, match="missing row"):
        joins.lookup(a, b, "k").collect()
    left = spark.createDataFrame([(0, float("nan"))], "row_idx long, v double")
    assert joins.zip_columns(left, left.withColumn("w", F.lit(1))).count() == 1
    with pytest.raises(PySparkException, match="differ"):
        joins.zip_columns(left, left.withColumn("v", F.lit(2.0))).collect()


def test_majority_and_best_of_n(spark):
    df = spark.createDataFrame([(1, "A", 0.9, 0), (1, "B", 0.8, 1), (1, "A", 0.7, 2)], "uid long, pred string, val double, i long")
    assert metrics.majority_value(df, ["uid"], "pred", "val", "i").first().val == 0.9
    tie = df.where("i < 2")
    assert metrics.majority_value(tie, ["uid"], "pred", "val", "i").first().val == 0.9
    rows = {r.n: r for r in metrics.best_worst_at(df, ["uid"]).collect()}
    assert set(rows) == {2, 3}
    values = [0.9, 0.8, 0.7]
    assert round(rows[2].best, 9) == round(sum(max(a, b) for a in values for b in values) / 9, 9)
    assert metrics.best_worst_at(df.limit(1), ["uid"]).first().n is None


def test_queues(spark):
    events = spark.createDataFrame([("q", i, "put") for i in range(5)] + [("q", 5, "get")], "queue string, seq long, op string")
    r = queues.bounded_queue(events, "queue", "seq", 3).first()
    assert (r.produced, r.consumed, r.dropped, r.left) == (5, 1, 2, 2)
    assert queues.staleness_budget(10, 0.5, 4) == 60
    rows = queues.token_bucket(spark.createDataFrame([("k", 1, 0.0, 8.0), ("k", 2, 0.0, 4.0), ("k", 3, 10.0, 1.0)], "k string, o long, t double, c double"), "k", "o", "t", "c", 1.0, 10.0)
    assert {x.o: x.wait for x in rows.collect()} == {1: 0.0, 2: 2.0, 3: 0.0}


def test_sequences(spark):
    df = spark.createDataFrame([([5, 2, 7, 2],), ([5, 5],), ([],)], "ids array<int>")
    assert [r.m for r in df.select(sequences.eos_mask(F.col("ids"), 2).alias("m")).collect()] == [[1, 1, 0, 0], [1, 1], []]
    assert [r.p for r in df.select(sequences.pad_or_cut(F.col("ids"), 3, 0, "left", "left").alias("p")).collect()] == [[2, 7, 2], [0, 5, 5], [0, 0, 0]]
    with pytest.raises(PySparkException, match="longer"):
        df.select(sequences.pad_or_cut(F.col("ids"), 3)).collect()
    with pytest.raises(PySparkException, match="media"):
        spark.range(1).select(sequences.expanded_content(F.lit("a <image>"), F.array().cast("array<string>"), F.array().cast("array<string>"))).collect()
    assert sequences.required_multiple(4, 6) == 12


def test_review_of_loaders(spark):
    raw = spark.createDataFrame([("1", "en", "t", "i", '{"label": 1, "multi_label": 0}'), ("2", "en", "t", "i", '{"label": 1}')], "id string, lang string, text string, image string, record string")
    assert [r.label for r in artifacts.load_sarcnet(raw).collect()] == ["0", "1"]
    with pytest.raises(PySparkException, match="usable label"):
        artifacts.load_sarcnet(raw.withColumn("record", F.lit('{"multi_label": 1}'))).collect()
    one = spark.createDataFrame([("7", "t", "1")], "image_id string, text string, label string")
    assert artifacts.load_all({"mmsd2": one}).first().sample_id == "mmsd2:na:7"
    with pytest.raises(PySparkException, match="duplicate"):
        artifacts.load_all({"mmsd2": one.union(one)}).collect()


def test_repaired_sentences_are_whole(spark):
    many, long = " ".join(["One is so."] * 1100), "The praise sounds warm, but " + "the queue is long " * 6000 + "now."
    fixed = [r.t for r in spark.createDataFrame([(many,), (long,)], "t string").select(parsing.repaired_sentences(F.col("t")).alias("t")).collect()]
    assert fixed[0] == "One is so. One is so. " + "; ".join(["One is so"] * 1098) + "."
    assert fixed[1] == "The praise sounds warm. The queue is long " + "the queue is long " * 5999 + "now."


# decisions, prompts, batches
def test_decisions(spark):
    good = {"mechanism": "Use A when x.", "exclusion_boundary": " Not when y. "}
    raws = [json.dumps(x) for x in (good, good | {"more": 1}, {"mechanism": "a"}, good | {"mechanism": " "}, good | {"mechanism": "word " * 80}, good | {"mechanism": "no end"})] + ["<think>x</think>" + json.dumps(good), "no json"]
    df = spark.createDataFrame([(n, r) for n, r in enumerate(raws)], "n int, raw string")
    plain, compressed = decisions.merge_error("raw"), decisions.merge_error("raw", accepted=7)
    rows = df.select(plain.alias("e"), compressed.alias("c"), decisions.merged("raw", plain).alias("m")).orderBy("n").collect()
    assert [r.e for r in rows] == [None, "fields are not exactly those expected", "fields are not exactly those expected", "mechanism: text is empty", "mechanism: too many words", None, None, "model output is not a single JSON object"]
    assert rows[0].m.experience == "Use A when x. Not when y." and rows[6].m == rows[0].m and rows[5].c == "mechanism is no complete sentence" and rows[0].c is None and rows[4].c == "mechanism is no complete sentence"
    assert df.select(decisions.merge_error("raw", accepted=6).alias("c")).collect()[0].c == "too many words together"
    one = lambda text, e: spark.createDataFrame([(text,)], "raw string").select(e.alias("e")).collect()[0].e
    boundary = json.dumps({"revised_exclusion_boundary": "Not when y."})
    fixed = F.lit("Use A when x.")
    assert one(boundary, decisions.boundary_merge_error("raw", fixed)) is None and one(boundary, decisions.boundary_merge_error("raw", fixed, most_words=6)) == "too many words together"
    assert one(boundary, decisions.boundary_merged("raw", fixed, decisions.boundary_merge_error("raw", fixed))).experience == "Use A when x. Not when y."
    cats = lambda *c: json.dumps({"causal_categories": list(c)})
    error = decisions.abstraction_error("raw", 2, 3)
    assert [one(c, error) for c in (cats("a  b.", "c"), cats("A.", "a!"), cats(), cats("a", "b", "c"), cats("a b c d"), cats(" "))] == [None, "categories repeat", "not one to so many categories", "not one to so many categories", "a category is too long", "a category is blank"]
    assert one(cats("a  b.", "c"), decisions.abstraction("raw", error)) == ["a b", "c"]
    rel = lambda a, t, r="why": json.dumps({"action": a, "target_id": t, "rationale": r})
    error = decisions.relation_error("raw", F.lit("sarcastic"), F.array(F.lit("exp-1")))
    assert [one(x, error) for x in (rel("ADD", None), rel("UPVOTE", "exp-1"), rel("UPVOTE", "exp-2"), rel("ADD", "exp-1"), rel("SKIP", None), rel("ADD", None, " "))] == [None, None, "target is not active", "target must be null", "action is not one of the label's", "rationale is empty"]
    assert one(rel("SKIP", None), decisions.relation_error("raw", F.lit("non-sarcastic"), F.array(F.lit("exp-1")))) is None
    assert one(rel("UPVOTE", "exp-1", " so "), decisions.relation("raw", error)).rationale == "so"


def test_prompts(spark):
    df = spark.createDataFrame([("hello", "Learn this. ", "sarcnet", {"text_label": "1", "image_label": "0"}, ["T\nbody\nmore", "only"])], "text string, exp string, source string, meta map<string,string>, docs array<string>")
    blind = prompts.blind_messages(F.col("text"), "SYS")
    got = df.select(blind.alias("m"), prompts.with_experience(blind, F.col("exp"), "G").alias("w"), prompts.with_experience(blind, F.lit(" "), "G").alias("u"), prompts.with_experience(F.slice(blind, 2, 1), F.col("exp"), "G").alias("n"),
        prompts.supervision_block(F.col("source"), F.col("meta")).alias("s"), prompts.supervision_block(F.lit("mmsd2"), F.col("meta")).alias("none"), prompts.passages(F.col("docs")).alias("p"),
        prompts.comparative_prompt({"text": F.col("text"), "teacher": F.lit(None).cast("string"), "gold_label": F.lit("x")}).alias("c")).collect()[0]
    assert got.m[1].content.startswith("<image>\nTreat") and "<post_text>\nhello\n</post_text>" in got.m[1].content and got.u == got.m
    assert got.w[0].content == "SYS\n\nG\n\nLearn this." and got.w[1] == got.m[1] and got.n[0].role == "system" and got.n[0].content == "G\n\nLearn this."
    assert got.s == '<sarcnet_supervision>\n{"image_label": "0", "text_label": "1"}\n</sarcnet_supervision>' and got.none == ""
    assert got.p == "Doc 1 (Title: T)\nbody\nmore\n\nDoc 2 (Title: only)" and got.c == "POST TEXT\nhello\n\nGOLD LABEL\nx"
    with pytest.raises(PySparkException, match="incomplete"):
        df.select(prompts.supervision_block(F.lit("docmsu"), F.col("meta"))).collect()
    obj = spark.createDataFrame([(("b\"q", None),)], "v struct<b:string,a:string>").select(prompts.sorted_object(F.col("v"), ("b", "a")).alias("j")).collect()[0].j
    assert json.loads(obj) == {"a": None, "b": 'b"q'} and list(json.loads(obj)) == ["a", "b"]
    context = spark.createDataFrame([(("g", "s", True, None, ""),), (("g", "s", True, "sarcastic", ""),), (("g", "s", False, "no", ""),), (("h", "s", True, None, ""),), (("g", "s", False, "sarcastic", None),)], "c struct<teacher_group:string,sample_id:string,blind_verified:boolean,gold_label:string,experience_text:string>")
    assert [r.e for r in context.select(prompts.selected_context_error("c", F.lit("g")).alias("e")).collect()] == [None, "a verified context carries gold", "a failed context has no gold label", "another teacher group", "experience_text is missing"]
    rows = spark.createDataFrame([("p", (5,), "img", 3), ("q", None, "img", None)], "prompt string, extra_info struct<index:int>, images string, n int")
    made = prompts.decorated(rows)
    assert "images" not in made.columns and [(r.raw_prompt, r["index"], r.tools_kwargs) for r in made.collect()] == [("p", 5, {}), ("q", 0, {})]
    assert [r.prompt for r in prompts.without_long_prompts(rows, F.col("n"), 3).collect()] == ["p"]


def test_batch_shapes(spark):
    df = spark.createDataFrame([(n, [n] * (n % 3), "m") for n in range(6)], "i int, x array<bigint>, meta string")
    assert batches.select_columns(df, ["i"], ["x", "none"]).columns == ["i", "x"] and [f.columns for f in batches.pop_columns(df, ["x"])] == [["x"], ["i", "meta"]]
    with pytest.raises(KeyError):
        batches.pop_columns(df, ["none"])
    with pytest.raises(ValueError):
        batches.rename_columns(df, ["i"], ["a", "b"])
    assert batches.rename_columns(df, ["i"], ["k"]).columns[0] == "k" and batches.prefixed(df, "v/", ("i",)).columns == ["i", "v/x", "v/meta"]
    assert batches.concat_batches([df, df], ["meta"]).count() == 12
    with pytest.raises(PySparkException, match="disagree"):
        batches.concat_batches([df, df.withColumn("meta", F.lit("other"))], ["meta"]).count()
    with pytest.raises(ValueError):
        batches.concat_batches([df, df.drop("x")])
    assert batches.merged_columns(df, df.select("i", "meta", F.lit(1).alias("y")), "i").columns == ["i", "x", "meta", "y"]
    with pytest.raises(PySparkException, match="conflicting"):
        batches.merged_columns(df, df.select("i", F.lit("z").alias("meta")), "i").collect()
    for candidate, edge in (("first", []), ("last", [5, 5])):
        padded = batches.pad_rows(df, "i", 2, candidate).orderBy("i").collect()
        assert [r.i for r in padded] == list(range(8)) and [r.is_pad for r in padded] == [False] * 6 + [True] * 2 and padded[7].x == edge
    folded = batches.fold(df, "i", 2, 3)
    assert {r.group: [x.i for x in r["items"]] for r in folded.collect()} == {0: [0, 1, 2], 1: [3, 4, 5]} and batches.unfold(folded).count() == 6
    with pytest.raises(PySparkException, match="do not fill"):
        batches.fold(df, "i", 1, 4).collect()
    got = {r.b: r for r in batches.collate(df.withColumn("b", F.floor(F.col("i") / 3)), "b", "i", ["x"], 0).collect()}
    assert got[1].offsets == [0, 0, 1, 3] and got[1].x == [4, 5, 5] and got[1].x_padded == [[0, 0], [4, 0], [5, 5]]
    assert batches.as_lists(df, ["meta"], "i", ["i", "x"]).collect()[0].i == list(range(6))
    assert batches.sampler(df, "i", 4).count() == 4 and batches.sampler(df, "i", 4, drop_last=False).count() == 6 and batches.first_rows(df, "i", 2).count() == 2
    assert [(r.epoch, r.global_step) for r in batches.epochs(df, "i", 2).where("i = 5").orderBy("epoch").collect()] == [(0, 5), (1, 11)]
    versions = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (1, 3)], "v int, c int")
    assert [tuple(r) for r in batches.version_metrics(versions, "v", "c").orderBy("c").collect()] == [(1, 1, 0, 0), (2, 2, 1, 1), (3, 1, 1, 2)]
    pilot = spark.createDataFrame([(True, 0.5, 1.0), (False, None, float("nan"))], "ok boolean, loss double, s double")
    r = batches.pilot_summary(pilot, F.col("ok"), F.col("loss"), F.col("s")).collect()[0]
    assert (r.rollout_samples, r.rollout_json_valid, r.rollout_valid, r.distillation_loss, r.scores_finite, r.kl_finite) == (2, 1, False, 0.5, False, False)


def test_tool_call_forms(spark):
    call = lambda text, form, **k: [(c.name, json.loads(c.arguments)) for c in spark.createDataFrame([(text,)], "t string").select(parsing.tool_calls(F.col("t"), form, **k).alias("c")).collect()[0].c]
    assert call('<tool_call>\n{"name": "f", "arguments": {"a": {"b": [1]}}}\n</tool_call> x <tool_call>bad</tool_call><tool_call>{"name": "g"}</tool_call>', "hermes") == [("f", {"a": {"b": [1]}})]
    hidden = '<|channel|>analysis<|message|>think<|start|>assistant<|channel|>commentary to=functions.no <|constrain|>json<|message|>{}<|call|><|end|>'
    assert call(hidden + '<|start|>assistant<|channel|>commentary to=functions.find <|constrain|>json<|message|>{"q": 1}<|call|>', "gpt-oss") == [("find", {"q": 1})]
    xml = "<tool_call>\n<function=f>\n<parameter=n>\n5\n</parameter>\n<parameter=s>\nnull\n</parameter>\n<parameter=o>{\"k\": 1}"
    assert call(xml, "qwen3_coder") == [("f", {"n": "5", "s": None, "o": '{"k": 1}'})] and call(xml, "qwen3_coder", types={"f": {"n": "integer", "o": "object"}}) == [("f", {"n": 5, "s": None, "o": {"k": 1}})]
    assert call('<|tool_call>call:f{a:<|"|>x, y<|"|>,b:2.5,c:true,d:null,e:word}<tool_call|>', "gemma4") == [("f", {"a": "x, y", "b": 2.5, "c": True, "d": None, "e": "word"})]


def test_group_balance_and_pairs_of_corpora(spark):
    rows = spark.createDataFrame([(0, n, 10 * (n // 2) + 1, f"u{n // 2}") for n in range(16)], "b int, i int, n int, u string")
    got = balance.balanced_batch(rows, "b", "i", "n", 4, "group", "u").collect()
    parts = {}
    for r in got:
        parts.setdefault(r.part, set()).add(r.i // 2)
    assert len(got) == 16 and all(len(us) == 2 for us in parts.values()) and len(set().union(*parts.values())) == 8
    assert {(r.part, r.place) for r in got} == {(p, k) for p in range(4) for k in range(4)}
    for mode in ("sequence", "minibatch"):
        out = balance.balanced_batch(rows, "b", "i", "n", 4, mode, mini=8).collect()
        assert len(out) == 16 and (mode == "sequence" or all({r.i // 8 for r in out if r.part == p} == {0, 1} for p in range(4)))
    assert spark.range(1).select(balance.ceil_div(F.lit(7), 2).alias("a"), balance.round_up(F.lit(7), 4).alias("b")).collect()[0] == (4, 8)
    corpora = spark.createDataFrame([(f"d{n}", "docmsu") for n in range(5)] + [(f"m{n}", "mmsd2") for n in range(8)] + [("s0", "sarcnet"), ("s1", "sarcnet")], "id string, source string")
    groups = ordering.pairwise_groups(corpora, "id", "source").collect()
    sizes = {g: len({r.id for r in groups if r.group == g}) for g in ordering.PAIRS}
    assert sizes == {"mmsd2_docmsu": 13, "mmsd2_sarcnet": 10, "docmsu_sarcnet": 7} and len({r.place for r in groups}) == 15


def test_pool_and_cache_loads(spark, tmp_path):
    pool_of = lambda *items: spark.createDataFrame([(json.dumps({"experiences": list(items)}),)], "value string")
    item = {"id": "exp-1", "text": " t ", "active": True}
    assert [tuple(r) for r in artifacts.load_pool(pool_of(item, item | {"id": "exp-2", "active": False})).collect()] == [("exp-1", "t", True), ("exp-2", "t", False)]
    for bad in ((item, item), (item | {"more": 1},), (item | {"text": " "},), (item | {"active": "yes"},), ({"id": "a", "text": "b"},)):
        with pytest.raises(PySparkException, match="pool"):
            artifacts.load_pool(pool_of(*bad)).collect()
    with pytest.raises(PySparkException, match="list of experiences"):
        artifacts.load_pool(spark.createDataFrame([('{"a": 1}',)], "value string")).collect()
    wanted = spark.createDataFrame([(0, "a", "x"), (1, "b", "y"), (2, "c", "x")], "place int, sample_id string, gold_label string")
    cache = lambda *rows: spark.createDataFrame(list(rows), "place int, sample_id string, method string, gold_label string, normalization string, attempts int")
    load = lambda *rows: [r.sample_id for r in artifacts.load_normalizations(cache(*rows), wanted, "m").collect()]
    assert load((0, "a", "m", "x", "n", 1), (1, "b", "m", "y", "n", 2)) == ["a", "b"]
    for rows, match in (([(0, "b", "m", "y", "n", 1)], "order"), ([(0, "a", "k", "x", "n", 1)], "method"), ([(0, "a", "m", "y", "n", 1)], "label"), ([(0, "a", "m", "x", "n", 0)], "call")):
        with pytest.raises(PySparkException, match=match):
            load(*rows)
    raw = spark.createDataFrame([(1, "t", 1), (2, "u", 0)], "image_id int, text string, label int")
    assert [r.sample_id for r in artifacts.load_benchmark({"MMSD2.0": raw, "RedEval": raw}, "image_id", 1).orderBy("sample_id").collect()] == ["mmsd2:1", "redeval:1"]
    with pytest.raises(ValueError, match="unsupported"):
        artifacts.load_benchmark({"other": raw})
    made = []
    make = lambda: made.append(1) or raw
    for _ in range(2):
        assert jsonl.reuse_or_dump(spark, f"{tmp_path}/dump", 3, make).count() == 2
    assert made == [1]
    for step in (1, 2):
        jsonl.log_metrics(spark.createDataFrame([(step, 0.5, None)], "step int, loss double, other string"), f"{tmp_path}/log")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/log").collect()) == ['{"data":{"loss":0.5},"step":1}', '{"data":{"loss":0.5},"step":2}']
