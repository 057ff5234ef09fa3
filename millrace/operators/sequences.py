"""Token-array operators: masks, padding, ragged forms, message expansion, conversation assembly, batch equality."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def eos_mask(ids: Column, *eos: int) -> Column:
    """1 up to and including the first end token (any of ``eos``), 0 after; all 1 without one."""
    at = F.array_min(F.filter(F.array(*(F.array_position(ids, F.lit(e)) for e in eos)), lambda p: p > 0))
    return F.transform(ids, lambda x, i: (at.isNull() | (i < at)).cast("int"))


def pad_or_cut(ids: Column, length: int, pad: int = 0, side: str = "right", truncation: str = "error") -> Column:
    """Exactly ``length`` tokens: padded on a side; longer ones cut at 'left', 'right' or 'middle', or an error."""
    n = F.size(ids)
    half = length // 2
    cut = {
        "left": F.slice(ids, F.greatest(n - length + 1, F.lit(1)), F.lit(length)), "right": F.slice(ids, 1, length),
        "middle": F.concat(F.slice(ids, 1, half), F.slice(ids, F.greatest(n - (length - half) + 1, F.lit(1)), F.lit(length - half))),
        "error": F.when(n > length, F.raise_error(F.lit(f"longer than {length} tokens")).cast("array<int>")).otherwise(ids),
    }[truncation]
    fill = F.array_repeat(F.lit(pad), F.greatest(F.lit(length) - n, F.lit(0)))
    out = F.when(n > length, cut).otherwise(ids)
    return F.concat(fill, out) if side == "left" else F.concat(out, fill)


def position_ids(mask: Column) -> Column:
    """Running count of valid tokens less one, at least 0, along an array mask."""
    return F.transform(mask, lambda _, i: F.greatest(F.aggregate(F.slice(mask, 1, i + 1), F.lit(0), lambda s, x: s + x.cast("int")) - 1, F.lit(0)))


def unpadded(ids: Column, mask: Column) -> Column:
    """The tokens under a mask of 1: padded to ragged."""
    return F.transform(F.filter(F.zip_with(ids, mask, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["b"] != 0), lambda x: x["a"])


def response_part(array: Column, length: int) -> Column:
    """The last ``length`` entries (a response's slice of an attention mask)."""
    return F.slice(array, F.greatest(F.size(array) - length + 1, F.lit(1)), F.lit(length))


def sft_loss_mask(prompt_length: Column, response_length: Column) -> Column:
    """Per token of prompt and response: 1 where the next token is trained on, so the prompt but its last token and the
    response's last token are 0."""
    total = prompt_length + response_length
    return F.transform(F.sequence(F.lit(0), total - 1), lambda i: ((i >= prompt_length - 1) & (i < total - 1)).cast("int"))


def clipped(value: Column, low: Column | float, high: Column | float) -> Column:
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.greatest(F.least(value, as_col(high)), as_col(low))


def preference_pairs(rows: DataFrame, length: int, eos: int, pad: int = 0) -> DataFrame:
    """``chosen_ids`` and ``rejected_ids``: prompt, response and end token, cut or padded on the right."""
    both = {f"{n}_ids": pad_or_cut(F.concat("prompt", n, F.array(F.lit(eos))), length, pad, truncation="right") for n in ("chosen", "rejected")}
    return rows.withColumns(both)


def swapped_preference(rows: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """response1, response2 and answer with the two sides swapped by a seeded bit of the key's hash."""
    flip = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 1), 16, 10).cast("int") >= 8
    return rows.withColumns(
        {"response1": F.when(flip, F.col("response2")).otherwise(F.col("response1")), "response2": F.when(flip, F.col("response1")).otherwise(F.col("response2")), "answer": F.when(flip, 3 - F.col("answer")).otherwise(F.col("answer"))}
    )


def expanded_content(text: Column, images: Column, videos: Column) -> Column:
    """A message's text as (type, value) parts: text between media tags, and each tag bound to the next of its media.

    Media that no tag uses, or tags without media, raise.
    """
    cut = F.filter(F.split(F.regexp_replace(text, r"(<image>|<video>)", "\u0001$1\u0001"), "\u0001"), lambda p: p != "")
    nth = lambda i, tag: F.size(F.filter(F.slice(cut, 1, i + 1), lambda p: p == tag))
    media = lambda name, arr, i, tag: F.struct(F.lit(name).alias("type"), F.try_element_at(arr, nth(i, tag)).alias("value"))
    parts = F.transform(
        cut, lambda p, i: F.when(p == "<image>", media("image", images, i, "<image>")).when(p == "<video>", media("video", videos, i, "<video>")).otherwise(F.struct(F.lit("text").alias("type"), p.alias("value")))
    )
    count = lambda tag: F.size(F.filter(cut, lambda p: p == tag))
    wrong = (count("<image>") != F.coalesce(F.size(images), F.lit(0))) | (count("<video>") != F.coalesce(F.size(videos), F.lit(0)))
    return F.when(wrong, F.raise_error(F.lit("media and tags do not match")).cast("array<struct<type:string,value:string>>")).otherwise(parts)


def assembled_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """(conv, ids, loss_mask) of conversations of (role, ids, prompt_len): tokens in turn order; only assistant tokens after
    their generation prompt are trained on. A conversation's turns bound its row."""
    mask = F.transform("ids", lambda _, i: ((F.col("role") == "assistant") & (i >= F.col("prompt_len"))).cast("int"))
    packed = turns.groupBy(conv).agg(F.array_sort(F.collect_list(F.struct(turn, "ids", mask.alias("m")))).alias("t"))
    return packed.select(conv, F.flatten(F.transform("t", lambda x: x["ids"])).alias("ids"), F.flatten(F.transform("t", lambda x: x["m"])).alias("loss_mask"))


def samples_per_prompt(rows: DataFrame, key: str, number: str, value: str) -> DataFrame:
    """n rows a prompt to one row with an array in order of the sample number."""
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(number, value))).alias("x"))
    return packed.select(key, F.transform("x", lambda v: v[value]).alias("samples"))


def equal_parts(indexed: DataFrame, n: int, total: int, row_idx: str = "row_idx") -> DataFrame:
    """``part`` of n equal parts by position; the remainder is dropped."""
    size = total // n
    return indexed.withColumn("part", F.floor(F.col(row_idx) / size).cast("int")).where(F.col("part") < n)


def repeat_each(rows: DataFrame, times: str) -> DataFrame:
    """Each row as often as its own count says (0: never), with ``copy`` from 0."""
    return rows.where(F.col(times) > 0).withColumn("copy", F.explode(F.expr(f"sequence(0, cast({times} as int) - 1)")))


def with_padding_rows(rows: DataFrame, multiple: int, columns: dict[str, Column]) -> DataFrame:
    """rows and as many literal no-op rows as the next multiple needs, flagged ``is_padding``; other columns are null."""
    total = rows.count()
    extra = rows.sparkSession.range(-total % multiple).select(*(c.alias(n) for n, c in columns.items()))
    return rows.withColumn("is_padding", F.lit(False)).unionByName(extra.withColumn("is_padding", F.lit(True)), allowMissingColumns=True)


def differs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either side that the other lacks, with multiplicity (null and NaN equal themselves): empty when equal."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def top_two(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, first, second) of each group's values, by an aggregate that keeps two."""
    best = rows.groupBy(group).agg(F.max(value).alias("first"))
    tied = rows.join(best, group).groupBy(group, "first").agg(F.count_if(F.col(value) == F.col("first")).alias("_t"), F.max(F.when(F.col(value) < F.col("first"), F.col(value))).alias("_s"))
    return tied.select(group, "first", F.when(F.col("_t") > 1, F.col("first")).otherwise(F.col("_s")).alias("second"))


def prompt_groups(rows: DataFrame, uid: str, key: str) -> DataFrame:
    """(uid, size, first key): rows that share a prompt."""
    return rows.groupBy(uid).agg(F.count(F.lit(1)).alias("size"), F.min(key).alias("first"))


def token_differences(rows: DataFrame, a: str, b: str, mask: str) -> DataFrame:
    """``diff``: places where two arrays differ under a mask, per row."""
    return rows.withColumn("diff", F.aggregate(F.zip_with(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), mask, lambda d, m: (d & (m != 0)).cast("int")), F.lit(0), lambda s, x: s + x))


def timing_per_token(timings: DataFrame, tokens: DataFrame) -> DataFrame:
    """Milliseconds a token: 'gen' over response tokens, other stages over all. ``tokens`` is one row (response, total)."""
    base = F.when(F.col("name") == "gen", F.col("response")).otherwise(F.col("total"))
    return timings.crossJoin(F.broadcast(tokens)).select("name", (1000 * F.col("seconds") / base).alias("ms_per_token"))  # one row


def step_batches(rows: DataFrame, group: str, order: str, size: int) -> DataFrame:
    """``mini`` batch within a group, by rank in order."""
    return rows.withColumn("mini", F.floor((F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1) / size).cast("int"))


def required_multiple(*sizes: int) -> int:
    """Least common multiple of what must divide a batch."""
    return math.lcm(*sizes)


def dense_flops(tokens: Column, seq_sq: Column, params: float, layers: int, hidden: int, seconds: Column) -> Column:
    """Achieved TFLOPS of a dense decoder: 6 x parameters x tokens for the weights, 12 x sum of squared lengths x layers x hidden for attention."""
    return (6.0 * F.lit(params) * tokens + 12.0 * seq_sq * layers * hidden) / seconds / 1e12


def dispatched(rows: DataFrame, mode: str, ranks: int, row_idx: str = "row_idx", total: int | None = None) -> DataFrame:
    """``rank`` of each row: 'all' copies to every rank, 'chunk' in equal stretches (must divide), 'stride' round robin."""
    if mode == "all":
        return rows.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))
    if mode == "stride":
        return rows.withColumn("rank", (F.col(row_idx) % ranks).cast("int"))
    if mode == "chunk":
        if total is None or total % ranks:
            raise ValueError(f"{total} rows do not divide over {ranks} ranks")
        return rows.withColumn("rank", F.floor(F.col(row_idx) / (total // ranks)).cast("int"))
    raise ValueError(f"unknown mode {mode}")
