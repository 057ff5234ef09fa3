"""Record normalisation and validation of labelled samples and model analyses, as column expressions."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Label spellings of the two rules, after trimming and lower case (rule B reads underscores as hyphens).
POSITIVE = ("sarcastic", "sarcasm", "ironic", "1")
NEGATIVE = ("non-sarcastic", "non_sarcastic", "nonsarcastic", "not_sarcastic", "0")
NEGATIVE_B = ("non-sarcastic", "nonsarcastic", "not-sarcastic", "0")
LABELS = ("sarcastic", "non-sarcastic")
# Aliases of a sample's fields, in order of preference.
ALIASES = {
    "sample_id": ("sample_id", "id", "guid", "uid"),
    "image_path": ("image_path", "image", "img_path", "photo_path"),
    "text": ("text", "post_text", "caption", "tweet", "sentence"),
    "label": ("label", "gold_label", "target", "class"),
}
METADATA = ("text_label", "image_label", "img_label")
FIELDS = ("visual_evidence", "textual_evidence", "explanation", "label")
_BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(value: str | Column) -> Column:
    """Without surrounding Unicode blanks (Spark's trim strips U+0020 only)."""
    return F.regexp_replace(value, _BLANKS, "")


def or_null(value: str | Column) -> Column:
    """Stripped, null when blank."""
    text = strip(value)
    return F.when(text != "", text)


def label_text(rows: DataFrame, column: str) -> Column:
    """A label column as text for the rules: of booleans and numbers only 1 (true) and 0 (false) are labels."""
    kind, value = rows.schema[column].dataType, F.col(column)
    if isinstance(kind, StringType):
        return value
    number = value.cast("double")
    return F.when(number == 1, "1").when(number == 0, "0")


def label_rule_a(value: str | Column) -> Column:
    """Exact spellings after trim and lower case; 'not-sarcastic' is none of them. Unknown and null: null.

    The value is text; see :func:`label_text` for columns of other types.
    """
    key = F.lower(strip(value))
    return F.when(key.isin(*POSITIVE), LABELS[0]).when(key.isin(*NEGATIVE), LABELS[1])


def label_rule_b(value: str | Column) -> Column:
    """As rule A with underscores read as hyphens, so 'not_sarcastic' and 'not-sarcastic' both count."""
    key = F.replace(F.lower(strip(value)), F.lit("_"), F.lit("-"))
    return F.when(key.isin(*POSITIVE), LABELS[0]).when(key.isin(*NEGATIVE_B), LABELS[1])


def first_alias(rows: DataFrame, field: str) -> Column:
    """First non-null of the field's alias columns there are, as text; null if there is none."""
    there = [label_text(rows, a) if field == "label" else F.col(a).cast("string") for a in ALIASES[field] if a in rows.columns]
    return F.coalesce(*there) if there else F.lit(None).cast("string")


@F.pandas_udf(StringType())
def generated_id(records: pd.DataFrame) -> pd.Series:
    """'generated:' and 24 digits of the sha256 of a record as ASCII JSON with sorted keys; null for a null record.

    A null field counts as absent, as in a JSON line without that key.
    """

    def made(record: dict | None) -> str | None:
        there = {k: v for k, v in (record or {}).items() if v is not None}
        if not there:
            return None
        return "generated:" + hashlib.sha256(json.dumps(there, sort_keys=True, default=str).encode()).hexdigest()[:24]

    return pd.Series([made(r) for r in pa.Table.from_pandas(records, preserve_index=False).to_pylist()] if len(records) else [], dtype=object)


def resolved_path(path: Column, base_dir: str | None) -> Column:
    """``path`` under ``base_dir`` unless it is absolute, without '.', '..' and doubled slashes."""
    if base_dir is None:
        return path
    whole = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base_dir.rstrip("/") + "/"), path))
    parts = F.filter(F.split(whole, "/+"), lambda p: ~p.isin("", "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda done, p: F.when(p == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, p)))
    return F.when(path.isNotNull(), F.concat(F.lit("/"), F.array_join(kept, "/")))


def normalised(samples: DataFrame, base_dir: str | None = None) -> DataFrame:
    """sample_id, image_path, text, label, source, language, extraction_metadata, reference_reasoning and error of raw
    samples under any alias.

    A missing id is generated from the whole record; ``source`` and ``language`` may be called ``dataset`` and ``lang``;
    optional blanks become null; of the metadata only the label columns there are. A reference is the record's own or,
    without one, its ``analysis`` where ``reference_valid`` is true. ``error`` is the first failure.
    """
    has = samples.columns
    pick = {name: first_alias(samples, name) for name in ALIASES}
    whole = F.struct(*(F.col(f"`{c}`") for c in has))
    given = or_null(pick["sample_id"])
    made = generated_id(F.when(given.isNull(), whole))
    optional = []
    for name, other in (("source", "dataset"), ("language", "lang")):
        there = [or_null(F.col(c).cast("string")) for c in (name, other) if c in has]
        optional.append((F.coalesce(*there) if there else F.lit(None).cast("string")).alias(name))
    labels = [x for c in METADATA if c in has for x in (F.lit(c), F.col(c).cast("string"))]
    metadata = F.map_filter(F.create_map(*labels), lambda k, v: v.isNotNull()) if labels else F.create_map().cast("map<string,string>")
    reference = [F.col("reference_reasoning")] if "reference_reasoning" in has else []
    if {"analysis", "reference_valid"} <= set(has):
        reference.append(F.when(F.col("reference_valid") == F.lit(True), F.col("analysis")))
    rows = samples.select(
        F.coalesce(given, made).alias("sample_id"), resolved_path(or_null(pick["image_path"]), base_dir).alias("image_path"), pick["text"].alias("text"), label_rule_a(pick["label"]).alias("label"),
        *optional, metadata.alias("extraction_metadata"), (F.coalesce(*reference) if reference else F.lit(None).cast("string")).alias("reference_reasoning"),
    )
    error = F.when(or_null(F.col("text")).isNull(), "text is empty").when(F.col("label").isNull(), "label is unknown").when(F.col("image_path").isNull(), "image path is empty")
    return rows.withColumn("error", error)


def letters(value: Column) -> Column:
    return F.coalesce(F.regexp_count(value, F.lit("[A-Za-z]")), F.lit(0))


def foreign_letters(value: Column) -> Column:
    return F.coalesce(F.regexp_count(value, F.lit(r"[\p{L}&&[^\x00-\x7F]]")), F.lit(0))


def english_enough(value: Column) -> Column:
    """At least one ASCII letter and no fewer of them than other letters."""
    return (letters(value) > 0) & (letters(value) >= foreign_letters(value))


def reasoning_error(reasoning: str, gold: Column | None = None) -> Column:
    """First failure of a reasoning struct: missing field, blank field, unknown label, not English, label against gold."""
    out = F.lit(None).cast("string")
    value = {f: F.col(f"{reasoning}.{f}") for f in FIELDS}
    checks = [(value[f].isNull() | (strip(value[f]) == ""), f"{f} must be a non-empty string") for f in FIELDS]
    checks.append((~F.coalesce(value["label"].isin(*LABELS), F.lit(False)), "label must be sarcastic or non-sarcastic"))
    checks += [(~english_enough(value[f]), f"{f} must be in English") for f in FIELDS[:3]]
    if gold is not None:
        checks.append((value["label"] != gold, "label differs from the sample's"))
    for bad, message in reversed(checks):
        out = F.when(bad, message).otherwise(out)
    return F.when(F.col(reasoning).isNull(), "no reasoning").otherwise(out)


def source_key(value: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(strip(value)), r"[\s\-]+", "_"), r"_+", "_")


def fingerprint(*values: Column) -> Column:
    """sha256 of the fields joined by a unit separator; null and empty differ."""
    return F.sha2(F.concat_ws("\u001f", *(F.coalesce(v.cast("string"), F.lit("\u0000")) for v in values)), 256)


def trainer_record(samples: DataFrame, system: str, ability: str = "sarcasm") -> DataFrame:
    """Nested trainer rows: data_source, prompt (messages), ability, reward_model and extra_info; the gold label stays
    out of the prompt."""
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    prompt = F.array(message("system", F.lit(system)), message("user", F.concat(F.lit("<image>"), F.col("text"))))
    return samples.select(
        F.coalesce("source", F.lit("unknown")).alias("data_source"), prompt.alias("prompt"), F.lit(ability).alias("ability"),
        F.struct(F.lit("rule").alias("style"), F.col("label").alias("ground_truth")).alias("reward_model"), F.struct("sample_id", "language").alias("extra_info"),
    )
