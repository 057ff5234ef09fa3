"""Keyed joins with the reference relation's checks: missing rows, duplicates, stale fingerprints, review states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut, small_side


def _must(value: Column, bad: Column, message: str) -> Column:
    return F.when(bad, F.raise_error(F.lit(message)).cast("string")).otherwise(value)


def latest_row(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """The row of largest ``order`` per key: one aggregate, so a hot key is reduced before the shuffle. Null keys drop out."""
    known = rows.where(" and ".join(f"{k} is not null" for k in keys))
    return known.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*order)).alias("x")).select(*keys, *(F.col(f"x.{c}").alias(c) for c in keep))


def first_row(rows: DataFrame, keys: list[str], order: list[str], keep: list[str]) -> DataFrame:
    """As :func:`latest_row` for the smallest ``order``."""
    known = rows.where(" and ".join(f"{k} is not null" for k in keys))
    return known.groupBy(*keys).agg(F.min_by(F.struct(*keep), F.struct(*order)).alias("x")).select(*keys, *(F.col(f"x.{c}").alias(c) for c in keep))


def lookup(rows: DataFrame, right: DataFrame, key: str, message: str = "missing row") -> DataFrame:
    """Left join in which a key without a right row raises. Keys of ``right`` must be unique."""
    marked = rows.join(right.withColumn("_found", F.lit(True)), key, "left")
    return marked.withColumn(key, _must(F.col(key).cast("string"), F.col("_found").isNull(), message).cast(rows.schema[key].dataType)).drop("_found")


def salted_left_join(rows: DataFrame, right: DataFrame, key: str, most: int = 100_000) -> DataFrame:
    """Left join with ``right`` (unique by key), whose hot and null keys never meet in one task.

    Rows with a null key are not shuffled. Keys with more than ``most`` rows are found by a count and looked up in a
    broadcast of just their rows of ``right`` (fewer than rows / most; a shuffle join if even they are too many). ``rows``
    is read more than once.
    """
    others = [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right.columns if c != key]
    none = rows.where(F.col(key).isNull()).select("*", *others)
    known = rows.where(F.col(key).isNotNull())
    hot = cut(known.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(key))
    if hot.isEmpty():
        return known.join(right, key, "left").unionByName(none)
    keys = small_side(hot, 100_000)
    looked_up = known.join(keys, key, "left_semi").join(small_side(cut(right.join(keys, key, "left_semi")), 100_000), key, "left")
    return known.join(keys, key, "left_anti").join(right, key, "left").unionByName(looked_up).unionByName(none)


def exclude(rows: DataFrame, *others: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in none of ``others``."""
    for other in others:
        rows = rows.join(other.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    return rows


def restrict(rows: DataFrame, group: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in ``group`` (a semi join)."""
    return rows.join(group.select(key).distinct(), key, "left_semi")


def overlap(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys on both sides; empty when the split is clean."""
    return left.select(key).where(F.col(key).isNotNull()).intersect(right.select(key))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """(key, n) of keys with several rows."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def completion(samples: DataFrame, predictions: DataFrame, key: str, retry_invalid: bool = True) -> DataFrame:
    """samples with ``status``: absent, stale (fingerprint differs), invalid or completed.

    Both sides carry ``fingerprint``; predictions also ``json_valid``. Without ``retry_invalid`` an invalid prediction of
    the right fingerprint counts as completed.
    """
    right = predictions.select(key, F.col("fingerprint").alias("_fp"), F.coalesce("json_valid", F.lit(False)).alias("_ok"), F.lit(True).alias("_there"))
    joined = samples.join(right, key, "left")
    done = F.col("_ok") | F.lit(not retry_invalid)
    status = F.when(F.col("_there").isNull(), "absent").when(~F.col("fingerprint").eqNullSafe(F.col("_fp")), "stale").when(done, "completed").otherwise("invalid")
    return joined.withColumn("status", status).drop("_fp", "_ok", "_there")


def triplets(teacher: DataFrame, student: DataFrame, verified: DataFrame, key: str) -> DataFrame:
    """Three-way join by key: each side's ``valid`` as teacher_valid, student_valid, verified_valid, and ``usable``."""
    out = teacher.select(key, F.col("valid").alias("teacher_valid"))
    for side, name in ((student, "student_valid"), (verified, "verified_valid")):
        out = out.join(side.select(key, F.col("valid").alias(name)), key, "left")
    all_good = F.lit(True)
    for name in ("teacher_valid", "student_valid", "verified_valid"):
        all_good = all_good & F.coalesce(F.col(name), F.lit(False))
    return out.withColumn("usable", all_good)


def review_state(corrections: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """corrections with ``state`` and the reasoning in force: PENDING without a review, STALE if the review was of another
    correction, else ACCEPT (the correction) or REVISE (the review's). ACCEPT with a revision, and REVISE without, raise."""
    r = reviews.select(key, F.col("correction_fingerprint").alias("_fp"), F.col("decision").alias("_d"), F.col("revised_reasoning").alias("_rev"))
    joined = corrections.join(r, key, "left")
    state = F.when(F.col("_d").isNull(), "PENDING").when(~F.col("fingerprint").eqNullSafe(F.col("_fp")), "STALE").otherwise(F.col("_d"))
    wrong = ((F.col("_d") == "ACCEPT") & F.col("_rev").isNotNull()) | ((F.col("_d") == "REVISE") & F.col("_rev").isNull())
    joined = joined.withColumn("state", _must(state, F.coalesce(wrong, F.lit(False)), "a review revises exactly when it says REVISE"))
    return joined.withColumn("reasoning", F.when(F.col("state") == "REVISE", F.col("_rev")).otherwise(F.col("reasoning"))).drop("_fp", "_d", "_rev")


def materialise(requested: DataFrame, artifact: DataFrame, fallback: DataFrame, key: str, value: str) -> DataFrame:
    """``value`` of each requested key from the artifact, else the fallback (else it raises), then the artifact's other
    rows; ``requested`` says which is which."""
    a, f = artifact.select(key, F.col(value).alias("_a")), fallback.select(key, F.col(value).alias("_f"))
    got = requested.select(key).join(a, key, "left").join(f, key, "left")
    got = got.withColumn(value, F.coalesce("_a", "_f"))
    got = got.withColumn(value, F.when(F.col(value).isNull(), F.raise_error(F.lit(f"no {value}")).cast(got.schema[value].dataType)).otherwise(F.col(value)))
    rest = artifact.join(requested.select(key), key, "left_anti").select(key, value, F.lit(False).alias("requested"))
    return got.select(key, value, F.lit(True).alias("requested")).unionByName(rest)


def zip_columns(left: DataFrame, right: DataFrame, row_idx: str = "row_idx") -> DataFrame:
    """Columns of both by position; sizes must match and shared columns must be equal (NaN and null equal themselves)."""
    shared = [c for c in right.columns if c in left.columns and c != row_idx]
    renamed = right.withColumnsRenamed({c: f"_r_{c}" for c in shared}).withColumn("_right", F.lit(True))
    joined = left.withColumn("_left", F.lit(True)).join(renamed, row_idx, "full")
    bad = F.col("_left").isNull() | F.col("_right").isNull()
    for c in shared:
        bad = bad | ~F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    checked = joined.withColumn(row_idx, F.when(bad, F.raise_error(F.lit("sides differ")).cast(left.schema[row_idx].dataType)).otherwise(F.col(row_idx)))
    return checked.drop("_left", "_right", *(f"_r_{c}" for c in shared))


def final_to_session(rows: DataFrame, session: str, order: str, value: str, out: str) -> DataFrame:
    """The value of each session's last row, given to all its rows."""
    last = rows.groupBy(session).agg(F.max_by(value, order).alias(out))
    return rows.join(last, session)


def align_tokens(teacher: DataFrame, student: DataFrame, key: str) -> DataFrame:
    """Teacher tokens (key, pos, token, logp) at the student's offsets (key, pos, token, shift): positions move by the
    student's prompt length less one; a token that differs raises."""
    t = teacher.select(key, F.col("pos").alias("_pos"), F.col("token").alias("_token"), "logp")
    joined = student.withColumn("_pos", F.col("pos") - F.col("shift")).join(t, [key, "_pos"], "left")
    differs = F.col("_token").isNotNull() & (F.col("_token") != F.col("token"))
    return joined.withColumn("token", F.when(differs, F.raise_error(F.lit("tokens do not line up")).cast("int")).otherwise(F.col("token"))).drop("_pos", "_token")
