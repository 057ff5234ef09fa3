"""Column and row shapes of batches: selecting, renaming, concatenating, padding, folding, collating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def select_columns(rows: DataFrame, must: list[str], may: list[str] | None = None) -> DataFrame:
    """The columns ``must``, of which a missing one is an error, and those of ``may`` there are; all others without ``may``
    None."""
    missing = [c for c in must if c not in rows.columns]
    if missing:
        raise KeyError(f"no columns {missing}")
    return rows.select(*must, *(c for c in rows.columns if c not in must and (may is None or c in may)))


def pop_columns(rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the columns, the rest); a missing column is an error."""
    return select_columns(rows, columns, []), rows.drop(*columns)


def rename_columns(rows: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    """Parallel lists of names; both must be as long and ``old`` must exist."""
    if len(old) != len(new) or any(c not in rows.columns for c in old):
        raise ValueError("names to rename and new names do not match")
    return rows.withColumnsRenamed(dict(zip(old, new, strict=True)))


def concat_batches(parts: list[DataFrame], meta: list[str] | None = None) -> DataFrame:
    """UNION ALL of batches with the same columns; ``meta`` columns must have one value over all of them (checked where
    the result is used)."""
    if any(set(p.columns) != set(parts[0].columns) for p in parts):
        raise ValueError("batches have different columns")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    for name in meta or ():
        seen = out.agg(F.min(F.struct(F.col(name).isNull(), name)).alias("lo"), F.max(F.struct(F.col(name).isNull(), name)).alias("hi"))
        checked = seen.select(F.when(F.col("lo") == F.col("hi"), True).otherwise(F.raise_error(F.lit(f"batches disagree on {name}")).cast("boolean")).alias("_same"))
        out = out.crossJoin(F.broadcast(checked)).where("_same").drop("_same")  # one row
    return out


def merged_columns(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Both sides' columns by key; a column of both must agree row by row, or it is an error where the result is used."""
    both = [c for c in right.columns if c in left.columns and c != key]
    joined = left.join(right.withColumnsRenamed({c: f"_r_{c}" for c in both}), key)
    for c in both:
        bad = ~F.col(c).eqNullSafe(F.col(f"_r_{c}"))
        joined = joined.withColumn(c, F.when(bad, F.raise_error(F.lit(f"conflicting values of {c}")).cast(left.schema[c].dataType)).otherwise(F.col(c)))
    return joined.drop(*(f"_r_{c}" for c in both))


def prefixed(rows: DataFrame, prefix: str, but: tuple[str, ...] = ()) -> DataFrame:
    return rows.withColumnsRenamed({c: f"{prefix}{c}" for c in rows.columns if c not in but})


def pad_rows(rows: DataFrame, position: str, size: int, candidate: str = "first") -> DataFrame:
    """rows and ``size`` more copies of the first or last one at the end; ``is_pad`` marks them. Empty rows stay empty."""
    edge = rows.agg((F.min_by if candidate == "first" else F.max_by)(F.struct(*rows.columns), position).alias("row"), F.max(position).alias("end")).where("end is not null")
    more = edge.select("row", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("n"), "end") if size else edge.limit(0).select("row", F.lit(0).alias("n"), "end")
    pads = more.select(*((F.col("end") + F.col("n")).cast(rows.schema[c].dataType).alias(c) if c == position else F.col(f"row.{c}").alias(c) for c in rows.columns))
    return rows.withColumn("is_pad", F.lit(False)).unionByName(pads.withColumn("is_pad", F.lit(True)))


def fold(rows: DataFrame, position: str, groups: int, per_group: int) -> DataFrame:
    """(group, items): runs of ``per_group`` rows by position as arrays of structs; there must be groups x per_group rows."""
    group = F.floor(F.col(position) / per_group)
    packed = rows.groupBy(group.alias("group")).agg(F.sort_array(F.collect_list(F.struct(position, *(c for c in rows.columns if c != position)))).alias("items"))
    bad = (F.size("items") != per_group) | (F.col("group") >= groups)
    return packed.withColumn("group", F.when(bad, F.raise_error(F.lit("rows do not fill the groups")).cast("long")).otherwise(F.col("group")))


def unfold(folded: DataFrame) -> DataFrame:
    return folded.select(F.explode("items").alias("x")).select("x.*")


def collate(rows: DataFrame, batch: str, order: str, jagged: list[str], pad: int | None = None) -> DataFrame:
    """(batch, offsets, columns): a batch's arrays one after the other with the offsets where each begins and, with
    ``pad``, also side by side at the batch's longest length. A batch is as large as the sampler makes it."""
    packed = rows.groupBy(batch).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), *jagged))).alias("_x")).select(batch, *(F.col(f"_x.{c}").alias(c) for c in jagged))
    packed = packed.withColumn("_sizes", F.transform(jagged[0], lambda v: F.size(v))).withColumn("_longest", F.array_max("_sizes"))
    offsets = F.expr("transform(sequence(0, size(_sizes)), k -> aggregate(slice(_sizes, 1, k), 0, (a, n) -> a + n))")
    columns = [F.flatten(c).alias(c) for c in jagged]
    if pad is not None:
        columns += [F.expr(f"transform({c}, v -> concat(v, array_repeat(cast({pad} as bigint), _longest - size(v))))").alias(f"{c}_padded") for c in jagged]
    return packed.select(batch, offsets.alias("offsets"), *columns)


def as_lists(rows: DataFrame, group: list[str], order: str, columns: list[str]) -> DataFrame:
    """A list a column and group, in order: rows of dicts become a dict of lists. Groups are bounded by their maker."""
    packed = rows.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), *columns))).alias("x"))
    return packed.select(*group, *(F.col(f"x.{c}").alias(c) for c in columns))


def first_rows(rows: DataFrame, row_idx: str, n: int) -> DataFrame:
    """The rows at positions below ``n``: a limit by position, not by what comes first."""
    return rows.where(F.col(row_idx) < n)


def sampler(rows: DataFrame, row_idx: str, batch_size: int, drop_last: bool = True) -> DataFrame:
    """rows with ``batch``; the last batch, if not full, is dropped or kept. ``row_idx`` is the order of a sequential
    sampler or of a seeded shuffle (``ordering.hash_position``)."""
    out = rows.withColumn("batch", F.floor(F.col(row_idx) / batch_size))
    if not drop_last:
        return out
    n = rows.agg(F.count(F.lit(1)).alias("_rows"))
    return out.crossJoin(F.broadcast(n)).where(F.col(row_idx) < F.col("_rows") - F.col("_rows") % batch_size).drop("_rows")  # one row


def generation_sample(rows: DataFrame, text: str, n: int, seed: int = 42) -> DataFrame:
    """The ``n`` rows of least seeded hash of their input: what is shown of validation generations."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(text))), text).limit(n)


def epochs(rows: DataFrame, row_idx: str, count: int) -> DataFrame:
    """(epoch, row_idx, global_step, ...): the rows over again, as a continuous iterator gives them."""
    n = rows.agg(F.count(F.lit(1)).alias("_rows"))
    return (
        rows.crossJoin(F.broadcast(n)).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))  # one row
        .withColumn("global_step", F.col("epoch") * F.col("_rows") + F.col(row_idx)).drop("_rows")
    )


def version_metrics(rows: DataFrame, version: str, current: str) -> DataFrame:
    """Per current version (in order): trajectories, those made by an older one, and the running count of these: what is
    flushed between two synchronisations. Versions are few; the window runs over a row a version."""
    per = rows.groupBy(current).agg(F.count(F.lit(1)).alias("trajectories"), F.count_if(F.col(current) - F.col(version) >= 1).alias("stale"))
    return per.withColumn("stale_so_far", F.sum("stale").over(Window.orderBy(current)))


def pilot_summary(rows: DataFrame, valid: Column, loss: Column, scores: Column) -> DataFrame:
    """One row: samples, valid outputs, whether all are, the loss if finite, whether all scores and the loss are finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    agg = rows.agg(
        F.count(F.lit(1)).alias("rollout_samples"), F.count_if(valid).alias("rollout_json_valid"), F.max(F.when(finite(loss), loss)).alias("distillation_loss"),
        (F.coalesce(F.bool_and(finite(scores)), F.lit(False))).alias("scores_finite"),
    )
    return agg.select("rollout_samples", "rollout_json_valid", ((F.col("rollout_samples") > 0) & (F.col("rollout_json_valid") == F.col("rollout_samples"))).alias("rollout_valid"), "distillation_loss", "scores_finite", (F.col("distillation_loss").isNotNull() & F.col("scores_finite")).alias("kl_finite"))
