"""Keyed artifact stores: upsert, journal replay, compaction, shard merge, cache predicates, corpus loaders."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.joins import duplicates
from millrace.operators.ordering import first_rows_by
from millrace.session import small_side


def upsert(base: DataFrame, incoming: DataFrame, key: str, position: str, arrival: str) -> DataFrame:
    """The latest incoming row per key in the place of the base's first match; later base copies are dropped, new keys
    come after the base in order of arrival.

    ``base`` has ``position``, ``incoming`` has ``arrival``; the result has ``position`` (base positions kept, new ones
    after the last). Aggregates by key only, so a hot key costs one row.
    """
    cols = [c for c in base.columns if c not in (key, position)]
    first = base.groupBy(key).agg(F.min_by(F.struct(position, *cols), position).alias("b"))
    last = incoming.groupBy(key).agg(F.max_by(F.struct(*cols), arrival).alias("i"), F.min(arrival).alias("at"))
    end = base.agg(F.coalesce(F.max(position), F.lit(-1)).alias("end"))
    both = first.join(last, key, "full").crossJoin(F.broadcast(end))  # one row
    place = F.coalesce(F.col(f"b.{position}"), F.col("end") + 1 + F.col("at"))
    return both.select(key, place.alias(position), *(F.when(F.col("i").isNotNull(), F.col(f"i.{c}")).otherwise(F.col(f"b.{c}")).alias(c) for c in cols))


def replay(base: DataFrame, journal: DataFrame, key: str, order: str) -> DataFrame:
    """base overridden by the journal's last row per key (journal rows have ``order``; base rows do not)."""
    last = journal.groupBy(key).agg(F.max_by(F.struct(*(c for c in base.columns if c != key)), order).alias("x"))
    fresh = last.select(key, *(F.col(f"x.{c}").alias(c) for c in base.columns if c != key))
    return base.join(fresh.select(key), key, "left_anti").unionByName(fresh.select(*base.columns))


def repaired_journal(lines: DataFrame, parsed_ok: Column, repair_tail: bool = True) -> DataFrame:
    """Journal lines (file, line_no, ...) without a truncated last line; an earlier bad line raises.

    Without ``repair_tail`` a bad last line raises too: of the two journals in use one repairs it and one does not.
    """
    ends = lines.groupBy("file").agg(F.max("line_no").alias("_end"))
    marked = lines.withColumn("_ok", F.coalesce(parsed_ok, F.lit(False))).join(small_side(ends, 1_000_000), "file")
    tail = (F.col("line_no") == F.col("_end")) & F.lit(repair_tail)
    # the check is in the filter itself, so no optimisation can drop bad lines before it
    bad = F.raise_error(F.concat(F.lit("corrupt journal line "), F.col("line_no"))).cast("boolean")
    return marked.where(F.when(~F.col("_ok") & ~tail, bad).otherwise(F.col("_ok"))).drop("_ok", "_end")


def compact(rows: DataFrame, requested: DataFrame, key: str, position: str) -> DataFrame:
    """rows in requested order (``position`` of the request), then the extras by key; ``place`` sorts them."""
    joined = rows.join(requested.select(key, F.col(position).alias("_at")), key, "left")
    return joined.withColumn("place", F.struct(F.col("_at").isNull().alias("extra"), F.coalesce("_at", F.lit(0)).alias("at"), F.col(key).alias("key"))).drop("_at")


def completed(rows: DataFrame, wanted: Column, retry_invalid: bool) -> Column:
    """Cached rows that need no new run: same fingerprint and valid, or invalid if those are not retried."""
    same = F.col("fingerprint").eqNullSafe(wanted)
    return same & (F.coalesce("json_valid", F.lit(False)) | (F.lit(not retry_invalid) & ~F.coalesce("json_valid", F.lit(True))))


def migrate(rows: DataFrame, compatible: DataFrame) -> DataFrame:
    """Rows with an old fingerprint get the new one where (old, new) says they are compatible."""
    joined = rows.join(compatible.select(F.col("old").alias("fingerprint"), "new"), "fingerprint", "left")
    return joined.withColumn("fingerprint", F.coalesce("new", "fingerprint")).drop("new")


def merge_shards(shards: DataFrame, requested: DataFrame, key: str, position: str) -> DataFrame:
    """Rows of all shards (``shard``, key, ...) in requested order; unknown keys are ignored, a key in two shards raises."""
    counts = shards.groupBy(key).agg(F.count_distinct("shard").alias("_n"))
    joined = shards.join(requested.select(key, position), key).join(counts, key)
    return joined.withColumn(key, F.when(F.col("_n") > 1, F.raise_error(F.lit("key in two shards")).cast(shards.schema[key].dataType)).otherwise(F.col(key))).drop("_n")


def first_valid_attempt(attempts: DataFrame, key: str, attempt: str, valid: str) -> DataFrame:
    """One row a key: its first valid attempt, else its last one (retries as a table of attempts)."""
    ok = F.coalesce(F.col(valid), F.lit(False))
    rank = F.struct(ok.alias("ok"), F.when(ok, -F.col(attempt)).otherwise(F.col(attempt)).alias("n"))
    best = attempts.groupBy(key).agg(F.max_by(F.struct(*(c for c in attempts.columns if c != key)), rank).alias("x"))
    return best.select(key, "x.*")


def exploded_experiences(records: DataFrame) -> DataFrame:
    """Candidates of records (sample_id, gold_label, experiences, error): rows with an error are skipped, ids are
    '<sample>::item-NN'."""
    rows = records.where("error is null").select("sample_id", "gold_label", F.posexplode("experiences").alias("item", "e"))
    return rows.select(F.format_string("%s::item-%02d", "sample_id", "item").alias("candidate_id"), "sample_id", "item", F.col("e.content").alias("content"), F.col("e.target_models").alias("target_models"), "gold_label")


def render_pool(pool: DataFrame, group: list[str], order: str, text: str = "text") -> DataFrame:
    """The active items of each pool as '- text' lines in order; pools are capped in size by construction."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: F.concat(F.lit("- "), x[text]))
    return pool.where("active").groupBy(*group).agg(F.concat_ws("\n", lines).alias("pool_text"))


LOADERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def loader(name: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable[[DataFrame], DataFrame]]:
    """Register a corpus loader: raw rows -> (sample_id, image_path, text, label, source, language)."""

    def add(function: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
        LOADERS[name] = function
        return function

    return add


@loader("mmsd2")
def load_mmsd2(raw: DataFrame) -> DataFrame:
    """image_id, text, label -> id 'mmsd2:na:<image_id>'."""
    return raw.select(F.concat(F.lit("mmsd2:na:"), F.col("image_id")).alias("sample_id"), F.concat("image_id", F.lit(".jpg")).alias("image_path"), "text", F.col("label").cast("string").alias("label"), F.lit("mmsd2").alias("source"), F.lit(None).cast("string").alias("language"))


@loader("sarcnet")
def load_sarcnet(raw: DataFrame) -> DataFrame:
    """id, lang, text, image and a JSON ``record``: multi_label overrides label where the key exists, and a null there, or
    a missing label key, raises."""
    keys = F.json_object_keys("record")
    multi, label = F.get_json_object("record", "$.multi_label"), F.get_json_object("record", "$.label")
    chosen = F.when(F.array_contains(keys, "multi_label"), multi).otherwise(label)
    bad = ~F.array_contains(keys, "label") | chosen.isNull()
    checked = F.when(bad, F.raise_error(F.lit("record has no usable label")).cast("string")).otherwise(chosen)
    return raw.select(F.format_string("sarcnet:%s:%s", "lang", "id").alias("sample_id"), F.col("image").alias("image_path"), "text", checked.alias("label"), F.lit("sarcnet").alias("source"), F.col("lang").alias("language"))


@loader("docmsu")
def load_docmsu(raw: DataFrame) -> DataFrame:
    """id, text, image and annotation (already joined by id); a missing annotation raises."""
    label = F.when(F.col("annotation").isNull(), F.raise_error(F.lit("no annotation")).cast("string")).otherwise(F.col("annotation"))
    return raw.select(F.concat(F.lit("docmsu:"), F.col("id")).alias("sample_id"), F.col("image").alias("image_path"), "text", label.alias("label"), F.lit("docmsu").alias("source"), F.lit("en").alias("language"))


# Names of the benchmark corpora, letter case aside.
DATASET_ALIASES = {"mmsd2": "mmsd2", "mmsd2.0": "mmsd2", "mmsd-v2": "mmsd2", "sarcnet": "sarcnet", "docmsu": "docmsu", "redeval": "redeval"}


def benchmark_rows(name: str, raw: DataFrame) -> DataFrame:
    """(sample_id, image_path, text, label, source, language) of a test corpus: image_id, text, label (mmsd2, redeval),
    sample_id, image_path, text, label (docmsu) or also ``language`` (sarcnet)."""
    key, language = ("sample_id", F.lit("en")) if name == "docmsu" else ("sample_id", F.col("language")) if name == "sarcnet" else ("image_id", F.lit("en"))
    image = F.col("image_path") if key == "sample_id" else F.concat(F.col(key).cast("string"), F.lit(".jpg"))
    parts = [F.lit(name), *([language] if name == "sarcnet" else []), F.col(key).cast("string")]
    return raw.select(F.concat_ws(":", *parts).alias("sample_id"), image.alias("image_path"), "text", F.col("label").cast("string").alias("label"), F.lit(name).alias("source"), language.alias("language"))


def load_benchmark(raw: dict[str, DataFrame], order: str | None = None, limit: int | None = None) -> DataFrame:
    """The test corpora under their names or aliases, one named twice counts once; with ``limit`` (1 or more) the first rows
    of each by its column ``order``. An unknown name is an error at once, a repeated id where the result is used."""
    if limit is not None and limit < 1:
        raise ValueError("a benchmark limit must be positive")
    out: dict[str, DataFrame] = {}
    for name, rows in raw.items():
        known = DATASET_ALIASES.get(name.casefold())
        if known is None:
            raise ValueError(f"unsupported benchmark dataset {name}")
        out.setdefault(known, benchmark_rows(known, rows if limit is None else first_rows_by(rows, order, limit)))
    return _unique(list(out.values()), "sample_id")


def load_pool(lines: DataFrame, value: str = "value") -> DataFrame:
    """(id, text, active) of pool files, one JSON object {"experiences": [{"id", "text", "active"}]} a row of ``value``.

    Other or missing keys, blank ids or texts, an ``active`` that is no boolean and repeated ids raise where the result
    is used.
    """
    items = F.from_json(F.get_json_object(value, "$.experiences"), "array<string>")
    bad_file = F.raise_error(F.lit("a pool needs a list of experiences")).cast("array<string>")
    rows = lines.select(F.explode(F.when(items.isNull(), bad_file).otherwise(items)).alias("item"))
    exact = F.array_sort(F.json_object_keys("item")) == F.array(*map(F.lit, ("active", "id", "text")))
    parsed = rows.select("item", exact.alias("exact"), F.from_json("item", "id string, text string, active boolean").alias("x"), F.get_json_object("item", "$.active").alias("flag"))
    text = F.trim(F.col("x.text"))
    bad = ~F.coalesce(F.col("exact"), F.lit(False)) | (F.coalesce("x.id", F.lit("")) == "") | (F.coalesce(text, F.lit("")) == "") | ~F.coalesce(F.col("flag").isin("true", "false"), F.lit(False))
    entries = parsed.select(F.when(bad, F.raise_error(F.lit("invalid pool entry")).cast("string")).otherwise(F.col("x.id")).alias("id"), text.alias("text"), F.col("x.active").alias("active"))
    repeated = duplicates(entries, "id").select(F.col("id").alias("_id"))
    checked = entries.join(repeated, F.col("id") == F.col("_id"), "left")
    return checked.select(F.when(F.col("_id").isNotNull(), F.raise_error(F.lit("duplicate pool id")).cast("string")).otherwise(F.col("id")).alias("id"), "text", "active")


def load_normalizations(cache: DataFrame, candidates: DataFrame, method: str) -> DataFrame:
    """The cached normalisations (place, sample_id, method, gold_label, normalization, attempts) of the candidates (place,
    sample_id, gold_label).

    The two orders must agree as far as both go; method and label must match and attempts be positive, or it is an error
    where the result is used. Cached rows of other candidates are left out.
    """
    own = candidates.select("sample_id", F.col("place").alias("_at"), F.col("gold_label").alias("_gold"))
    by_place = candidates.select("place", F.col("sample_id").alias("_there"))
    joined = cache.join(own, "sample_id", "left").join(by_place, "place", "left")
    bad = (
        F.when(F.col("_there").isNotNull() & (F.col("_there") != F.col("sample_id")), "cache and candidates are in another order")
        .when(F.col("_at").isNotNull() & ~F.col("method").eqNullSafe(F.lit(method)), "cache of another method")
        .when(F.col("_at").isNotNull() & ~F.col("gold_label").eqNullSafe(F.col("_gold")), "cached label differs")
        .when(F.col("_at").isNotNull() & ~F.coalesce(F.col("attempts") > 0, F.lit(False)), "invalid call record")
    )
    # the check is in the filter itself, so no optimisation can drop bad rows before it
    kept = joined.where(F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(F.col("_at").isNotNull()))
    return kept.select(*cache.columns)


def load_all(raw: dict[str, DataFrame], key: str = "sample_id") -> DataFrame:
    """Union of registered corpora; an id in two of them raises when the result is used."""
    return _unique([LOADERS[name](rows) for name, rows in raw.items()], key)


def _unique(parts: list[DataFrame], key: str) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    counts = out.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return out.join(counts, key).withColumn(key, F.when(F.col("_n") > 1, F.raise_error(F.lit("duplicate sample_id")).cast("string")).otherwise(F.col(key))).drop("_n")
