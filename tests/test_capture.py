"""Change capture: exactly-once batches, replay after failure, and the defined results of odd rows."""

from datetime import datetime

import pytest

from millrace.operators.capture import ChangeCapture, changes_to_process, committed_content, current_content, journal_log

JOURNAL = "seq long, sample_id string, fingerprint string, updated_at timestamp_ntz, arrived_at timestamp_ntz, part string, best string"
PROCESSED = "run_id int, sample_id string, fingerprint string, processed_at timestamp_ntz"
RUNS = "run_id int, started_at timestamp_ntz, finished_at timestamp_ntz, status string"
T = [datetime(2025, 1, d) for d in range(1, 10)]


def journal(spark, rows):
    return spark.createDataFrame([(n, i, f, t, t, "x", "y") for n, i, f, t in rows], JOURNAL)


def test_latest_by_time_then_seq_and_odd_rows(spark):
    rows = [(1, " a ", "AA", T[1]), (2, "a", "bb", T[0]), (3, "b", "cc", T[1]), (4, "b", "dd", T[1]), (5, None, "ee", T[1]), (6, " ", "ff", T[1]), (7, "c", None, T[1]), (8, "d", "gg", None), (8, "d", "gg", None)]
    got = {(r.sample_id, r.fingerprint) for r in current_content(journal_log(journal(spark, rows))).collect()}
    assert got == {("a", "aa"), ("b", "dd"), ("d", "gg")}


def test_failed_runs_do_not_count(spark):
    done = spark.createDataFrame([(1, "a", "x", T[0]), (2, "a", "y", T[1]), (1, "b", "x", T[0]), (1, "b", "x", T[0])], PROCESSED)
    runs = spark.createDataFrame([(1, T[0], T[0], "succeeded"), (2, T[1], None, "failed")], RUNS)
    log = journal(spark, [(1, "a", "x", T[0]), (2, "b", "z", T[1]), (3, "c", "q", T[1])])
    got = {tuple(r) for r in changes_to_process(spark, log, done, runs).collect()}
    assert got == {("b", "z"), ("c", "q")}


def test_empty_tables(spark):
    none = changes_to_process(spark, journal(spark, []), spark.createDataFrame([], PROCESSED), spark.createDataFrame([], RUNS))
    assert none.columns == ["sample_id", "fingerprint"] and none.count() == 0


def test_replay_after_failure_neither_skips_nor_repeats(spark):
    nothing = committed_content(spark.createDataFrame([], PROCESSED), spark.createDataFrame([], RUNS))
    capture = ChangeCapture(spark)
    first = journal_log(journal(spark, [(1, "a", "x", T[0]), (2, "b", "x", T[0])]), 4)
    plan = capture.plan(first)  # planned, then the run dies before it publishes
    grown = journal_log(journal(spark, [(1, "a", "x", T[0]), (2, "b", "x", T[0]), (3, "c", "x", T[1])]), 4)
    assert ChangeCapture(spark, capture.home).plan(grown) == plan
    replayed = ChangeCapture(spark, capture.home).run(grown, nothing)
    assert {r.sample_id for r in replayed.collect()} == {"a", "b"}
    later = ChangeCapture(spark, capture.home).run(grown, nothing)
    assert {r.sample_id for r in later.collect()} == {"c"}
    assert ChangeCapture(spark, capture.home).run(grown, nothing).count() == 0
    assert {r.sample_id for r in capture.published().collect()} == {"a", "b", "c"}


def test_late_rows_in_a_second_batch_change_nothing(spark):
    known = committed_content(spark.createDataFrame([(1, "b", "new", T[0])], PROCESSED), spark.createDataFrame([(1, T[0], T[0], "succeeded")], RUNS))
    capture = ChangeCapture(spark)
    rows = [(1, "a", "new", T[2]), (2, "b", "new", T[2]), (3, "c", "old", T[0])]
    assert {r.sample_id for r in capture.run(journal_log(journal(spark, rows), 4), known).collect()} == {"a", "c"}
    rows += [(4, "a", "late", T[1]), (5, "b", "late", T[1]), (6, "c", "new", T[1]), (7, "c", "late", T[0]), (8, "d", "first", None)]
    assert {tuple(r) for r in capture.run(journal_log(journal(spark, rows), 4), known).select("sample_id", "fingerprint").collect()} == {("c", "new"), ("d", "first")}
    assert {(r.sample_id, r.fingerprint) for r in capture.published().collect()} == {("a", "new"), ("c", "new"), ("d", "first")}


def test_publishing_twice_changes_nothing(spark):
    capture = ChangeCapture(spark)
    plan = {"batch": 0, "begin": {}, "end": {}}
    rows = spark.createDataFrame([("a", "x", 1), ("a", "x", 1)], "sample_id string, fingerprint string, seq long")
    assert capture.publish(rows, plan).count() == 1
    assert capture.publish(rows.limit(0), plan).count() == 1
    with pytest.raises(Exception, match="another run"):
        capture.write("published/0.json", {})


def test_only_new_offsets_are_read_and_state_is_kept_by_folder(spark, tmp_path):
    done, runs = spark.createDataFrame([], PROCESSED), spark.createDataFrame([], RUNS)
    folder, plans = f"{tmp_path}/journal.parquet", []
    journal(spark, [(n, f"k{n}", "old", T[0]) for n in range(300)]).write.parquet(folder)
    for rows in ([], [(300, "k1", "new", T[1]), (301, "k2", "late", None)], [(302, "k300", "first", T[0])]):
        if rows:
            journal(spark, rows).write.mode("append").parquet(folder)
        found = changes_to_process(spark, spark.read.parquet(folder), done, runs)
        plans.append(sorted(tuple(r) for r in found.collect()))
    assert len(plans[0]) == 300 and ("k1", "old") in plans[0]
    assert len(plans[1]) == 300 and ("k1", "new") in plans[1] and ("k2", "old") in plans[1]
    assert len(plans[2]) == 301
    assert plans[2] == sorted(tuple(r) for r in changes_to_process(spark, spark.read.parquet(folder), done, runs).collect())
    log = journal_log(spark.read.parquet(folder))
    begin = {str(p): 299 for p in range(64)}
    plan = ChangeCapture(spark).slice(log, {"begin": begin, "end": {str(p): 302 for p in range(64)}})
    assert "GreaterThan(seq,299)" in plan._jdf.queryExecution().toString() and plan.count() == 3
    journal(spark, [(1, "z", "other", T[0])]).write.mode("overwrite").parquet(folder)
    assert [tuple(r) for r in changes_to_process(spark, spark.read.parquet(folder), done, runs).collect()] == [("z", "other")]


def test_content_is_compacted_and_a_crash_before_the_marker_is_replayed(spark, monkeypatch):
    from millrace.operators import capture as module

    monkeypatch.setattr(module, "COMPACT", 2)
    nothing = committed_content(spark.createDataFrame([], PROCESSED), spark.createDataFrame([], RUNS))
    capture, rows, seen = ChangeCapture(spark), [], {}
    for n in range(5):
        rows += [(10 * n + 1, "a", f"a{n}", T[n]), (10 * n + 2, f"k{n}", "x", T[n]), (10 * n + 3, "a", "late", T[0])]
        log = journal_log(journal(spark, rows), 4)
        capture.absorb(log)  # the run dies after the content was written
        capture = ChangeCapture(spark, capture.home)
        got = [(r.sample_id, r.fingerprint) for r in capture.run(log, nothing).collect()]
        assert len(got) == len(set(got)) and not set(got) & seen.keys()
        seen |= dict.fromkeys(got)
    assert {k for k, _ in seen} == {"a", *(f"k{n}" for n in range(5))} and ("a", "a4") in seen
    assert {(r.sample_id, r.fingerprint) for r in capture.published().collect()} >= {("a", "a4"), ("k0", "x")}
    assert capture.content().count() == 6
