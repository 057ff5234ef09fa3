"""Functions that no query runs: scans, stores, scorers, masks, joins and stream rules on small tables with known results."""

import json

import pytest
from pyspark.errors.exceptions.base import PySparkException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace import session
from millrace.functions import parsing, scorers
from millrace.operators import balance, joins, metrics, offpolicy, ordering, pool, sequences
from millrace.sources import artifacts, jsonl
from millrace.streaming import queues


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_scans_of_arrays_maps_and_files(spark, tmp_path):
    schema = StructType([StructField("a", LongType()), StructField("b", StringType())])
    (tmp_path / "x.json").write_text('[{"a": 1, "b": "u"},\n {"a": 2}]')
    assert sorted(rows(jsonl.scan_array(spark, str(tmp_path / "x.json"), schema))) == [(1, "u"), (2, None)]
    (tmp_path / "bad.json").write_text('[{"a": 1')
    with pytest.raises(Exception, match="FAILED_READ_FILE"):
        jsonl.scan_array(spark, str(tmp_path / "bad.json"), schema).collect()
    (tmp_path / "m.json").write_text('{"k": {"a": 5},\n "l": {"a": 6}}')
    assert sorted((r.key, r.value.a) for r in jsonl.scan_map(spark, str(tmp_path / "m.json"), schema).collect()) == [("k", 5), ("l", 6)]
    (tmp_path / "y.jsonl").write_text('{"a": 3, "c": true}\n')
    spark.createDataFrame([(4, "p")], "a long, b string").write.parquet(str(tmp_path / "z.parquet"))
    union = jsonl.scan_files(spark, [str(tmp_path / n) for n in ("x.json", "y.jsonl", "z.parquet")])
    assert sorted(r.a for r in union.collect()) == [1, 2, 3, 4] and set(union.columns) == {"a", "b", "c"}
    with pytest.raises(ValueError, match="unknown file kind"):
        jsonl.scan_files(spark, ["x.txt"])


def test_keyed_and_nested(spark):
    good = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    assert jsonl.keyed(good, "k").count() == 2
    for bad in ([("a", 1), ("a", 2)], [(None, 1)]):
        with pytest.raises(ValueError, match="present and unique"):
            jsonl.keyed(spark.createDataFrame(bad, "k string, v int"), "k")
    nested = spark.createDataFrame([((("x",),),)], "o struct<p:struct<q:string>>")
    assert rows(nested.select(jsonl.nested_value("o", ["p", "q"]))) == [("x",)] and jsonl.flatten_params(nested.schema) == [("o/p/q", "o.p.q")]
    lists = spark.createDataFrame([([1],), ([1, 2],)], "l array<int>")
    assert rows(lists.select(jsonl.unwrap(F.col("l"), lists.schema["l"].dataType))) == [(1,), (None,)]


def test_dumps_and_reports(spark, tmp_path):
    out = spark.createDataFrame([(1, "q", "a", 0.5), (2, "r", "b", 1.0)], "step int, input string, output string, score double")
    jsonl.dump_generations(out, str(tmp_path / "gen"))
    assert sorted(p.name for p in (tmp_path / "gen").iterdir() if p.is_dir()) == ["step=1", "step=2"] and spark.read.json(str(tmp_path / "gen")).count() == 2
    jsonl.write_report(out, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).columns == out.columns


def test_stores(spark):
    store = spark.createDataFrame([("b", "f1", True), ("x", "f2", False), ("a", "f1", None)], "k string, fingerprint string, json_valid boolean")
    wanted = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "k string, at int")
    placed = artifacts.compact(store, wanted, "k", "at").orderBy("place")
    assert [r.k for r in placed.collect()] == ["a", "b", "x"]
    done = lambda retry: [r.k for r in store.where(artifacts.completed(store, F.lit("f1"), retry)).orderBy("k").collect()]
    assert done(True) == ["b"] and done(False) == ["b"]
    moved = artifacts.migrate(store, spark.createDataFrame([("f1", "f9")], "old string, new string"))
    assert {r.k: r.fingerprint for r in moved.collect()} == {"a": "f9", "b": "f9", "x": "f2"}
    shards = spark.createDataFrame([("b", 1), ("a", 0), ("z", 1)], "k string, shard int")
    assert [r.k for r in artifacts.merge_shards(shards, wanted, "k", "at").orderBy("at").collect()] == ["a", "b"]
    with pytest.raises(PySparkException, match="two shards"):
        artifacts.merge_shards(shards.union(spark.createDataFrame([("b", 0)], "k string, shard int")), wanted, "k", "at").collect()
    active = spark.createDataFrame([("p", 2, "two", True), ("p", 1, "one", True), ("p", 3, "no", False)], "pool string, n int, text string, active boolean")
    assert rows(artifacts.render_pool(active, ["pool"], "n")) == [("p", "- one\n- two")]


def test_reflection_and_composition(spark):
    item = {"target_models": ["m1"], "content": "Treat praise with care. Check the picture first."}
    reflect = lambda *items: json.dumps({"experiences": list(items)})
    raws = [reflect(item), reflect(), reflect(item, item), reflect(item | {"target_models": ["m9"]}), reflect(item | {"target_models": ["m1", "m1"]}), reflect(item | {"content": "One only."}), "x"]
    df = spark.createDataFrame([(n, r) for n, r in enumerate(raws)], "n int, raw string").orderBy("n")
    assert [e for (e,) in rows(df.select(parsing.reflection_error("raw", ("m1", "m2"))))] == [None, "one to three experiences", "experiences repeat", "bad target models", "bad target models", "bad experience content", "model output is not a single JSON object"]
    two = spark.createDataFrame([(" a b ", "c"), ("a " * 80, "c"), (" ", "")], "m string, b string")
    assert rows(two.select(parsing.composed(F.col("m"), F.col("b")))) == [("a b c",), (None,), (None,)]


def test_other_scorers(spark):
    df = spark.createDataFrame([("<think>x</think> so \\boxed{7}", "7"), ("\\boxed{7}", "7"), ("<think>x</think> \\boxed{8}", "7")], "r string, t string")
    assert [round(s, 6) for (s,) in rows(df.select(scorers.geo3k(F.col("r"), F.col("t"))))] == [1.0, 0.9, 0.1]
    scored = spark.createDataFrame([("searchR1_nq", "<answer>The Cat!</answer>", "cat"), ("constant", "x", "y")], "data_source string, response string, truth string")
    assert [r.score for r in scorers.score(scored).collect()] == [1.0, 0.0]
    tokens = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (1, 2, 0), (2, 0, 0)], "traj_id int, pos int, mask int")
    got = scorers.at_last_token(tokens, spark.createDataFrame([(1, 0.5), (2, 0.9)], "traj_id int, score double"))
    assert {(r.traj_id, r.pos): r.reward for r in got.collect()} == {(1, 0): 0.0, (1, 1): 0.5, (1, 2): 0.0, (2, 0): 0.0}


def test_artifact_join_and_disjointness(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "k string")
    made, spare = spark.createDataFrame([("a", 1), ("x", 9)], "k string, v int"), spark.createDataFrame([("a", 7), ("b", 2)], "k string, v int")
    assert sorted(rows(joins.materialise(wanted, made, spare, "k", "v"))) == [("a", 1, True), ("b", 2, True), ("x", 9, False)]
    with pytest.raises(PySparkException, match="no v"):
        joins.materialise(wanted, made, spare.where("k = 'a'"), "k", "v").collect()
    assert rows(joins.duplicates(made.union(made), "k").orderBy("k")) == [("a", 2), ("x", 2)] and joins.overlap(made, spare, "k").count() == 1


def test_teacher_tokens_line_up(spark):
    teacher = spark.createDataFrame([("a", 0, 7, -0.5), ("a", 1, 8, -0.1)], "k string, pos int, token int, logp double")
    student = spark.createDataFrame([("a", 2, 7, 2), ("a", 3, 8, 2), ("a", 4, 9, 2)], "k string, pos int, token int, shift int")
    assert sorted((r.pos, r.token, r.logp or 0.0) for r in joins.align_tokens(teacher, student, "k").collect()) == [(2, 7, -0.5), (3, 8, -0.1), (4, 9, 0.0)]
    with pytest.raises(PySparkException, match="line up"):
        joins.align_tokens(teacher, student.withColumn("token", F.lit(1)), "k").collect()


def test_sections_of_validation(spark):
    m = spark.createDataFrame([("d", "acc", "mean@4", 4, 4), ("d", "acc", "mean@2", 2, 4), ("d", "reward", "mean@4", 4, 4), ("e", "reward", "best@4/mean", 4, 4), ("e", "reward", "worst@4/mean", 4, 4)], "data_source string, var string, name string, n int, top_n int")
    assert [r.section for r in metrics.validation_core(m).orderBy("data_source", "var", F.desc("n"), "name").collect()] == ["val-core", "val-aux", "val-aux", "val-core", "val-aux"]


def test_corrections(spark):
    tokens = spark.createDataFrame([(1, 0, 1, -1.0, -1.0), (1, 1, 1, -1.0, -4.0), (2, 0, 1, -2.0, -2.0)], "traj_id int, pos int, mask int, old_logp double, rollout_logp double")
    plain = offpolicy.corrected(tokens, threshold=2.0)
    assert [round(r.is_weight, 6) for r in plain.orderBy("traj_id", "pos").collect()] == [1.0, 2.0, 1.0]
    masked = offpolicy.corrected(tokens, threshold=2.0, options="token_k1", limits="0.5_2.0")
    assert {(r.traj_id, r.pos): int(r["mask"]) for r in masked.collect()} == {(1, 0): 1, (1, 1): 0, (2, 0): 1}
    assert [r.old_logp for r in offpolicy.bypass(tokens).orderBy("traj_id", "pos").collect()] == [-1.0, -4.0, -2.0]


def test_positions_and_prefixes(spark):
    indexed = spark.createDataFrame([(n, f"v{n}") for n in range(5)], "row_idx int, v string")
    at = spark.createDataFrame([(0, 3), (1, 3), (2, 0)], "pos int, row_idx int")
    assert [r.v for r in ordering.take_at(indexed, at).orderBy("pos").collect()] == ["v3", "v3", "v0"]
    log = spark.createDataFrame([("p", 0, "a"), ("p", 1, "c")], "pool string, seq int, candidate_id string")
    wanted = spark.createDataFrame([("p", 0, "a"), ("p", 1, "b"), ("p", 2, "c")], "pool string, seq int, candidate_id string")
    assert rows(pool.prefix_mismatch(log, wanted).select("seq", "candidate_id")) == [(1, "c")] and pool.prefix_mismatch(log.limit(1), wanted).count() == 0
    shuffled = spark.createDataFrame([("b", 9), ("a", 8)], "k string, v int")
    assert [r.k for r in balance.restore_order(shuffled, spark.createDataFrame([("a", 0), ("b", 1)], "k string, at int"), "k", "at").orderBy("at").collect()] == ["a", "b"]


def test_masks_and_pairs(spark):
    df = spark.createDataFrame([([1, 2, 3, 4], [0, 1, 1, 0], 2, 2)], "ids array<int>, m array<int>, p int, r int")
    got = df.select(sequences.unpadded(F.col("ids"), F.col("m")).alias("u"), sequences.response_part(F.col("m"), 3).alias("t"), sequences.sft_loss_mask(F.col("p"), F.col("r")).alias("s"), sequences.position_ids(F.col("m")).alias("i")).collect()[0]
    assert got.u == [2, 3] and got.t == [1, 1, 0] and got.s == [0, 1, 1, 0] and got.i == [0, 0, 1, 1]
    pairs = spark.createDataFrame([([1], [2, 3], [4])], "prompt array<int>, chosen array<int>, rejected array<int>")
    assert rows(sequences.preference_pairs(pairs, 4, 9).select("chosen_ids", "rejected_ids")) == [([1, 2, 3, 9], [1, 4, 9, 0])]
    sides = spark.createDataFrame([(n, "x", "y", 1) for n in range(40)], "k int, response1 string, response2 string, answer int")
    swapped = sequences.swapped_preference(sides, "k").collect()
    assert {(r.response1, r.answer) for r in swapped} == {("x", 1), ("y", 2)} and all((r.response1 == "x") == (r.answer == 1) for r in swapped)
    stepped = sequences.step_batches(spark.createDataFrame([("g", n) for n in range(5)], "g string, n int"), "g", "n", 2)
    assert [r.mini for r in stepped.orderBy("n").collect()] == [0, 0, 1, 1, 2] and sequences.required_multiple(4, 6) == 12


def test_stream_rules(spark):
    idx = spark.range(10).withColumnRenamed("id", "row_idx")
    assert queues.count_batches(idx, 4, total=10).count() == 8 and queues.count_batches(idx, 4).agg(F.max("batch")).collect()[0][0] == 2
    df = spark.createDataFrame([(5, 0), (1, 9), (1, 0)], "q int, s int")
    assert [p for (p,) in rows(df.select(queues.must_pause(F.col("q"), 5, F.col("s"), 9)))] == [True, True, False] and queues.staleness_budget(10, 0.5, 2) == 30


def test_broadcast_only_when_small(spark):
    plan = lambda most: spark.range(50).join(session.small_side(spark.range(20).hint("merge"), most), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(20) and "broadcast" not in plan(19)


def test_scratch_is_cleared(spark):
    path = f"{session.scratch(spark)}/probe"
    spark.range(3).write.parquet(path)
    assert spark.read.parquet(path).count() == 3
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    session.clear_scratch(spark)
    assert not fs.exists(hadoop)


def test_reward_managers(spark, tmp_path):
    from millrace.functions import rewards

    (tmp_path / "own.py").write_text("def own(source, response, truth, extra):\n    return {'score': float(response == truth), 'style': 0.5, 'tag': extra}\n\ndef many(sources, responses, truths, extras):\n    return [len(r or '') for r in responses]\n")
    responses = spark.createDataFrame([(1, "gsm8k", "#### 4", "4", "e"), (2, "gsm8k", "none", "none", None)], "traj_id int, data_source string, response string, truth string, extra string")
    tokens = spark.createDataFrame([(1, 0, 1), (1, 1, 1), (1, 2, 0), (2, 0, 1)], "traj_id int, pos int, mask int")
    by = lambda df: {(r.traj_id, r.pos): r.reward for r in df.collect()}
    assert by(rewards.rewards("naive", responses, tokens)[0]) == {(1, 0): 0.0, (1, 1): 1.0, (1, 2): 0.0, (2, 0): 0.0}
    own = rewards.custom(rewards.load_function(str(tmp_path / "own.py"), "own"))
    rewarded, scored = rewards.rewards("gdpo", responses, tokens, scorer=own, keys=("style",))
    assert by(rewarded)[(2, 0)] == 1.0 and {r.traj_id: (r.score, r.style, r.extras["tag"]) for r in scored.collect()} == {1: (0.0, 0.5, "e"), 2: (1.0, 0.5, "None")}
    many = rewards.custom(rewards.load_function(str(tmp_path / "own.py"), "many"), batch=True)
    assert by(rewards.rewards("batch", responses, tokens, scorer=many)[0])[(1, 1)] == 6.0
    rewarded, scored = rewards.rewards("dapo", responses, tokens, most=3, buffer=2)
    assert {r.traj_id: (r.acc, r.overlong_reward, r.score) for r in scored.collect()} == {1: (1.0, -0.5, 0.5), 2: (0.0, 0.0, 0.0)}
    assert [f.columns for f in rewards.extracted(rewarded, scored, ["acc", "none"])] == [["traj_id", "pos", "reward"], ["traj_id", "acc"]]
    with pytest.raises(ValueError, match="unknown reward manager"):
        rewards.rewards("other", responses, tokens)
    with pytest.raises(AttributeError, match="no function"):
        rewards.load_function(str(tmp_path / "own.py"), "missing")


def test_isolation_and_retries(spark):
    from millrace.operators import control

    def halve(pdf):
        if (pdf["v"] % 5 == 0).any():
            raise ValueError("bad five")
        return pdf.assign(half=pdf["v"] / 2)

    df = spark.createDataFrame([(f"k{v}", v) for v in range(1, 21)], "k string, v int")
    got = {r.k: (r.half, r.error) for r in control.isolated(df, halve, "k string, half double", "k", attempts=2).collect()}
    assert len(got) == 20 and got["k4"] == (2.0, None) and got["k10"] == (None, "ValueError: bad five") and sum(e is not None for _, e in got.values()) == 4
    assert control.isolated(df.limit(0), halve, "k string, half double", "k").count() == 0

    def run(rows, attempt):
        seen.append(rows.count())
        return rows.select("k", F.lit(attempt).alias("n"), (F.col("v") % 4 < attempt).alias("json_valid"))

    seen = []
    done = control.retried(df, "k", run, F.col("json_valid"), 3).collect()
    assert seen == [20, 15, 10] and len(done) == 20 and {(r.attempts, r.json_valid) for r in done} == {(1, True), (2, True), (3, True), (3, False)}
    seen = []
    assert control.retried(df.where("v = 4"), "k", run, F.col("json_valid"), 3).count() == 1 and seen == [1]


def test_recovery_pauses_and_ablations(spark):
    from millrace.operators import control

    whole = json.dumps({"visual_evidence": "a", "textual_evidence": "b", "explanation": "c", "label": "sarcastic"})
    kind = "struct<visual_evidence:string,textual_evidence:string,explanation:string,label:string>"
    df = spark.createDataFrame([(1, "<think>x</think>" + whole, None, "old error"), (2, "junk", None, "old error"), (3, "junk", ("p", "q", "r", "s"), None)], f"n int, raw_output string, analysis {kind}, error string")
    got = {r.n: (r.analysis and r.analysis.explanation, r.error) for r in control.recovered(df).collect()}
    assert got == {1: ("c", None), 2: (None, "old error"), 3: ("r", None)}
    marks = control.Pauses(spark, None, "pauses")
    assert not marks.paused
    for _ in range(2):
        marks.pause()
        marks.pause()
        assert control.Pauses(spark, marks.home).paused
        marks.resume()
        assert not control.Pauses(spark, marks.home).paused
    columns = {"text": F.lit("t"), "teacher": F.lit("a"), "student": F.lit("b")}
    assert [sorted(control.ablated(columns, m)) for m in ("none", "teacher_only", "comparative")] == [["text"], ["teacher", "text"], ["student", "teacher", "text"]]
    with pytest.raises(ValueError, match="unknown mode"):
        control.ablated(columns, "both")
