"""Decisions a model returns about the rule pool: merges, boundary merges, abstractions and relations, as expressions.

Each kind has an error expression (the first failure, null for none) and a value expression (null where there is an error).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .parsing import after_think, output_error, rule_error
from .records import strip

# The actions a model may choose for a candidate of each label; a relation names a target or none.
RELATIONS = {"sarcastic": ("ADD", "MODIFY", "UPVOTE"), "non-sarcastic": ("DOWNVOTE", "MODIFY", "SKIP", "UPVOTE")}
TARGETED, UNTARGETED = ("MODIFY", "UPVOTE", "DOWNVOTE"), ("ADD", "SKIP")


def _object(raw: str | Column, *fields: str | StructField) -> tuple[Column, Column]:
    """(first failure as an object with exactly these fields, the object)."""
    shape = [f if isinstance(f, StructField) else StructField(f, StringType()) for f in fields]
    body = after_think(raw)
    exact = F.array_sort(F.json_object_keys(body)) == F.array(*map(F.lit, sorted(f.name for f in shape)))
    return F.coalesce(output_error(raw), F.when(~F.coalesce(exact, F.lit(False)), "fields are not exactly those expected")), F.from_json(body, StructType(shape))


def _words(text: Column) -> Column:
    body = strip(text)
    return F.when(body == "", 0).otherwise(F.size(F.split(body, r"\s+")))


def _both(mechanism: Column, boundary: Column) -> Column:
    return F.concat_ws(" ", strip(mechanism), strip(boundary))


def _complete(text: Column) -> Column:
    return strip(text).rlike(r"[.!?]$")


def merge_error(raw: str | Column, most_words: int = 70, most_mechanism: int | None = None, most_boundary: int | None = None, accepted: int | None = None) -> Column:
    """First failure of {"mechanism", "exclusion_boundary"}: fields, each text, the words of both together.

    With ``accepted`` it is a compressed merge: both texts must be complete sentences and together have at most so many words.
    """
    most_words = most_words if accepted is None else 1000
    bad, value = _object(raw, "mechanism", "exclusion_boundary")
    for name, most in (("mechanism", most_mechanism), ("exclusion_boundary", most_boundary)):
        error = rule_error(value[name], most or most_words)
        bad = F.coalesce(bad, F.when(error.isNotNull(), F.concat(F.lit(f"{name}: "), error)))
    total = _words(value["mechanism"]) + _words(value["exclusion_boundary"])
    bad = F.coalesce(bad, F.when(total > most_words, "too many words together"))
    if accepted is not None:
        bad = F.coalesce(bad, F.when(~_complete(value["mechanism"]), "mechanism is no complete sentence").when(~_complete(value["exclusion_boundary"]), "exclusion_boundary is no complete sentence").when(total > accepted, "too many words together"))
    return bad


def merged(raw: str | Column, error: Column) -> Column:
    """(mechanism, exclusion_boundary, experience) of a merge without ``error``."""
    _, value = _object(raw, "mechanism", "exclusion_boundary")
    mechanism, boundary = value["mechanism"], value["exclusion_boundary"]
    return F.when(error.isNull(), F.struct(strip(mechanism).alias("mechanism"), strip(boundary).alias("exclusion_boundary"), _both(mechanism, boundary).alias("experience")))


def boundary_merge_error(raw: str | Column, mechanism: Column, most_words: int = 70, accepted: int | None = None) -> Column:
    """First failure of {"revised_exclusion_boundary"}: it may have the words that the fixed ``mechanism`` leaves."""
    bad, value = _object(raw, "revised_exclusion_boundary")
    boundary, limit = value["revised_exclusion_boundary"], most_words if accepted is None else 1000
    bad = F.coalesce(bad, rule_error(boundary, limit), F.when(_words(boundary) + _words(mechanism) > limit, "too many words together"))
    if accepted is not None:
        bad = F.coalesce(bad, F.when(~_complete(boundary), "exclusion_boundary is no complete sentence").when(_words(boundary) + _words(mechanism) > accepted, "too many words together"))
    return bad


def boundary_merged(raw: str | Column, mechanism: Column, error: Column) -> Column:
    _, value = _object(raw, "revised_exclusion_boundary")
    boundary = value["revised_exclusion_boundary"]
    return F.when(error.isNull(), F.struct(strip(mechanism).alias("mechanism"), strip(boundary).alias("exclusion_boundary"), _both(mechanism, boundary).alias("experience")))


def _categories(raw: str | Column) -> tuple[Column, Column]:
    bad, value = _object(raw, StructField("causal_categories", ArrayType(StringType())))
    return bad, F.transform(value["causal_categories"], lambda c: F.regexp_replace(strip(c), r"\s+", " "))


def abstraction_error(raw: str | Column, most: int, most_words: int = 18) -> Column:
    """First failure of {"causal_categories": [...]}: 1 to ``most`` of them, none blank, long or repeated."""
    bad, items = _categories(raw)
    keys = F.transform(items, lambda c: F.regexp_replace(F.lower(c), r"[.!?]+$", ""))
    return F.coalesce(
        bad,
        F.when(items.isNull() | ~F.size(items).between(1, most), "not one to so many categories")
        .when(F.exists(items, lambda c: F.coalesce(c, F.lit("")) == ""), "a category is blank")
        .when(F.exists(items, lambda c: F.size(F.split(c, " ")) > most_words), "a category is too long")
        .when(F.size(F.array_distinct(keys)) < F.size(keys), "categories repeat"),
    )


def abstraction(raw: str | Column, error: Column) -> Column:
    """Categories with single blanks and no mark at the end."""
    _, items = _categories(raw)
    return F.when(error.isNull(), F.transform(items, lambda c: F.regexp_replace(c, r"[.!?]+$", "")))


def relation_error(raw: str | Column, gold: Column, active: Column) -> Column:
    """First failure of {"action", "target_id", "rationale"}: the action must be one of the label's, its target one of the
    ``active`` ids or, for ADD and SKIP, null."""
    bad, value = _object(raw, "action", "target_id", "rationale")
    action, target = value["action"], value["target_id"]
    legal = F.lit(False)
    for label, actions in RELATIONS.items():
        legal = F.when(gold == label, F.coalesce(action.isin(*actions), F.lit(False))).otherwise(legal)
    return F.coalesce(
        bad,
        F.when(~legal, "action is not one of the label's")
        .when(action.isin(*TARGETED) & ~F.coalesce(F.array_contains(active, target), F.lit(False)), "target is not active")
        .when(action.isin(*UNTARGETED) & target.isNotNull(), "target must be null")
        .when(F.coalesce(strip(value["rationale"]), F.lit("")) == "", "rationale is empty"),
    )


def relation(raw: str | Column, error: Column) -> Column:
    _, value = _object(raw, "action", "target_id", "rationale")
    return F.when(error.isNull(), F.struct(value["action"].alias("action"), value["target_id"].alias("target_id"), strip(value["rationale"]).alias("rationale")))
