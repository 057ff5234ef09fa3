"""Model-output parsing: think blocks, strict JSON, sentences, experience rules, word budgets."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .records import FIELDS, LABELS, strip

REASONING = StructType([StructField(f, StringType()) for f in FIELDS])
# Abbreviations whose full stop ends no sentence.
PROTECTED = ("Mr.", "Mrs.", "Ms.", "Dr.", "Prof.", "St.", "Jr.", "Sr.", "vs.", "etc.", "e.g.", "i.e.")
# Identifiers that must not be in an experience.
FORBIDDEN = r"(?i)\b(sample_id|image_path|gold label|ground truth|reference reasoning|supervision)\b"
DOT = "\ue000"


def after_think(raw: str | Column) -> Column:
    """Text after the last closing think tag; null for a block that never ends; stripped."""
    value = F.col(raw) if isinstance(raw, str) else raw
    open_ended = value.contains("<think>") & ~value.contains("</think>")
    return F.when(~open_ended, strip(F.substring_index(value, "</think>", -1)))


def output_error(raw: str | Column) -> Column:
    """First failure of a raw output as one strict JSON object: empty, unterminated thinking, fences, not an object."""
    value = F.col(raw) if isinstance(raw, str) else raw
    body = after_think(value)
    return (
        F.when(value.isNull() | (strip(value) == ""), "model output is empty").when(body.isNull(), "unterminated thinking block").when(body == "", "model output is empty")
        .when(body.contains("```"), "model output must not contain Markdown fences")
        .when(~(body.startswith("{") & body.endswith("}")) | F.try_parse_json(body).isNull(), "model output is not a single JSON object")
    )


def parsed_reasoning(raw: str | Column) -> Column:
    """The reasoning struct of an output without error, else null."""
    return F.when(output_error(raw).isNull(), F.from_json(after_think(raw), REASONING))


def reasoning_output_error(raw: str | Column) -> Column:
    """output_error, then missing or extra keys, blank fields and an unknown label."""
    body = after_think(raw)
    keys = F.json_object_keys(body)
    value = F.from_json(body, REASONING)
    out = F.when(F.size(F.array_except(keys, F.array(*map(F.lit, FIELDS)))) > 0, "unexpected field").when(F.size(F.array_intersect(keys, F.array(*map(F.lit, FIELDS)))) < len(FIELDS), "missing field")
    for f in FIELDS:
        out = out.when(F.coalesce(strip(value[f]), F.lit("")) == "", f"{f} must be a non-empty string")
    out = out.when(~value["label"].isin(*LABELS), "label must be sarcastic or non-sarcastic")
    return F.coalesce(output_error(raw), out)


EXPERIENCES = ArrayType(StructType([StructField("target_models", ArrayType(StringType())), StructField("content", StringType())]))


def reflection_error(raw: str | Column, models: tuple[str, ...]) -> Column:
    """First failure of {"experiences": [...]}: 1 to 3 items, known and unique targets, distinct contents, sentence rules."""
    items = F.from_json(F.get_json_object(after_think(raw), "$.experiences"), EXPERIENCES)
    targets = F.forall(items, lambda x: (F.size(x["target_models"]) > 0) & (F.size(F.array_distinct(x["target_models"])) == F.size(x["target_models"])) & F.forall(x["target_models"], lambda m: m.isin(*models)))
    distinct = F.size(F.array_distinct(F.transform(items, lambda x: F.lower(strip(x["content"]))))) == F.size(items)
    content = F.forall(items, lambda x: experience_error(x["content"]).isNull())
    own = (
        F.when(items.isNull(), "no experiences").when(~F.size(items).between(1, 3), "one to three experiences").when(~F.coalesce(targets, F.lit(False)), "bad target models")
        .when(~distinct, "experiences repeat").when(~F.coalesce(content, F.lit(False)), "bad experience content")
    )
    return F.coalesce(output_error(raw), own)


def sentences(text: Column) -> Column:
    """Sentences of a text; titles, e.g., i.e., initials and decimals end none."""
    held = text
    for word in PROTECTED:
        held = F.regexp_replace(held, r"\b" + word.replace(".", r"\."), word.replace(".", DOT))
    held = F.regexp_replace(F.regexp_replace(held, r"\b([A-Z])\.(?=\s)", f"$1{DOT}"), r"(\d)\.(\d)", f"$1{DOT}$2")
    parts = F.split(F.regexp_replace(held, r"([.!?][\"'’”]?)\s+", "$1\ue001"), "\ue001")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(strip(s), DOT, ".")), lambda s: s != "")


def experience_error(text: Column) -> Column:
    """First failure of an experience: empty, not English, forbidden identifiers, no end mark, not two or three sentences."""
    body = strip(text)
    n = F.size(sentences(body))
    return (
        F.when(text.isNull() | (body == ""), "content must be a non-empty English string").when(body.rlike(r"[㐀-鿿]"), "content must be in English").when(body.rlike(FORBIDDEN), "content contains forbidden identifiers")
        .when(~body.rlike("[A-Za-z]"), "content must contain English text").when(~body.rlike(r"[.!?][\"'’”]?$"), "content must end with sentence punctuation")
        .when(~n.isin(2, 3), "content must have two or three sentences")
    )


def repaired_sentences(text: Column) -> Column:
    """One sentence is split at its first '; ' or ', ' clause; more than three are merged from the third on with ';'."""
    body = strip(text)
    parts = sentences(body)
    cut = F.regexp_replace(body, r"^(.{10,}?)[;,]\s+(?:and |but |so )?([a-z])(.*)$", "$1. \ue002$2$3")
    rest = F.substring_index(cut, "\ue002", -1)
    split_up = F.concat(F.substring_index(cut, "\ue002", 1), F.upper(F.substring(rest, 1, 1)), F.substr(rest, F.lit(2)))
    tail = F.array_join(F.transform(F.slice(parts, F.lit(3), F.size(parts)), lambda s: F.regexp_replace(s, r"[.!?]+$", "")), "; ")
    merged = F.concat_ws(" ", parts[0], parts[1], F.concat(tail, F.lit(".")))
    return F.when((F.size(parts) == 1) & cut.contains("\ue002"), split_up).when(F.size(parts) > 3, merged).otherwise(body)


def rule_error(text: Column, max_words: int, prefix: str | None = None) -> Column:
    """First failure of a rule: blank, prefix missing, over the word cap, a token of 31 letters or more."""
    body = strip(text)
    out = F.when(text.isNull() | (body == ""), "text is empty")
    if prefix:
        out = out.when(~body.startswith(prefix), "required prefix is missing")
    return out.when(F.size(F.split(body, r"\s+")) > max_words, "too many words").when(body.rlike("[A-Za-z]{31,}"), "a token is too long")


def composed(mechanism: Column, boundary: Column, max_words: int = 80) -> Column:
    """Mechanism and boundary as one rule; null when both together pass the cap."""
    text = strip(F.concat_ws(" ", strip(mechanism), strip(boundary)))
    return F.when((text != "") & (F.size(F.split(text, r"\s+")) <= max_words), text)


def normalization_error(valid: Column, label: Column, mechanism: Column, boundary: Column) -> Column:
    """Label-conditioned check: invalid ones carry no text, sarcastic ones need both, others the boundary only."""
    m, b = mechanism.isNotNull(), boundary.isNotNull()
    return (
        F.when(valid.isNull(), "valid is missing").when(~valid & (m | b), "an invalid normalization carries text").when(valid & (label == "sarcastic") & ~m, "mechanism is missing")
        .when(valid & (label == "non-sarcastic") & m, "mechanism is not expected").when(valid & ~b, "boundary is missing")
    )


def word_budget(total: Column, first: Column, second: Column, least: int = 5) -> Column:
    """Words for the first of two fields out of ``total``, in proportion, rounded half to even, at least ``least`` each."""
    share = F.bround(F.try_divide(total * first, first + second), 0).cast("int")
    return F.greatest(F.lit(least), F.least(F.coalesce(share, F.lit(least)), total - least))


@F.pandas_udf(StringType())
def folded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """NFKC, casefold and single blanks; ASCII texts skip the first."""
    for batch in texts:
        yield batch.map(lambda t: None if not isinstance(t, str) else " ".join((t if t.isascii() else unicodedata.normalize("NFKC", t)).casefold().split()))


def last_number(text: Column, strict: bool = True) -> Column:
    """The answer in the last 300 characters: after the last '####', or the last number; thousands marks removed."""
    tail = F.right(text, F.lit(300))
    if strict:
        found = F.regexp_extract_all(tail, F.lit(r"#### (-?[0-9.,]+)"), F.lit(1))
        return F.regexp_replace(F.try_element_at(found, F.lit(-1)), r"[,$]", "")
    numbers = F.filter(F.regexp_extract_all(tail, F.lit(r"(-?[0-9.,]+)"), F.lit(1)), lambda x: ~x.isin("", "."))
    return F.try_element_at(numbers, F.lit(-1))


def qa_form(text: Column) -> Column:
    """Lower case, punctuation and articles removed, single blanks."""
    bare = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"\b(a|an|the)\b", " "), r"\s+", " "))


def tagged_answer(text: Column, tag: str = "answer") -> Column:
    """The content of the last <tag> block, stripped; null without one."""
    return strip(F.try_element_at(F.regexp_extract_all(text, F.lit(f"(?s)<{tag}>(.*?)</{tag}>"), F.lit(1)), F.lit(-1)))


CALLS = ArrayType(StructType([StructField("name", StringType()), StructField("arguments", StringType())]))


def tool_calls(text: Column, form: str = "hermes", types: dict[str, dict[str, str]] | None = None) -> Column:
    """(name, arguments as JSON) of the tool calls in a response, in one of :data:`TOOL_FORMS`.

    ``types`` (function -> parameter -> type) is for XML, whose values are text without it.
    """
    return _xml_calls(types)(text) if form == "qwen3_coder" else TOOL_FORMS[form](text)


def _json_calls(text: Column) -> Column:
    """<tool_call> blocks that hold a JSON object with a name and arguments; others are left out."""
    blocks = F.regexp_extract_all(text, F.lit(r"(?s)<tool_call>(.*?)</tool_call>"), F.lit(1))
    calls = F.transform(blocks, lambda b: F.struct(F.get_json_object(b, "$.name").alias("name"), F.get_json_object(b, "$.arguments").alias("arguments")))
    return F.filter(calls, lambda c: c["name"].isNotNull() & c["arguments"].isNotNull())


def _channel_calls(text: Column) -> Column:
    """Commentary messages to functions; what stands in the analysis channel is no call. Arguments are taken as they are."""
    shown = F.regexp_replace(text, r"(?s)(?:<\|start\|>assistant)?<\|channel\|>analysis<\|message\|>.*?<\|end\|>", "")
    pattern = r"(?s)<\|start\|>assistant<\|channel\|>[^<]* to=functions\.([^<]+) <\|constrain\|>json<\|message\|>(.*?)<\|call\|>"
    names, arguments = (F.regexp_extract_all(shown, F.lit(pattern), F.lit(k)) for k in (1, 2))
    return F.zip_with(names, arguments, lambda n, a: F.struct(n.alias("name"), a.alias("arguments")))


def _typed(value: str, kind: str | None = None) -> object:
    """A value written as text, by its declared type; 'null' is null whatever the type, and what cannot be read is text."""
    if value.lower() == "null":
        return None
    kind = (kind or "string").strip().lower()
    try:
        if kind.startswith(("int", "uint", "long", "short", "unsigned")):
            return int(value)
        if kind.startswith(("num", "float")):
            number = float(value)
            return number if number % 1 else int(number)
        if kind in ("object", "array", "list") or kind.startswith("dict"):
            return json.loads(value)
    except ValueError:
        return value
    return value.lower() == "true" if kind in ("boolean", "bool", "binary") else value


def _guessed(value: str) -> object:
    """true, false, null and numbers as what they are, anything else as text."""
    plain = value.strip()
    if plain.lower() in ("true", "false", "null"):
        return {"true": True, "false": False, "null": None}[plain.lower()]
    for kind in (int, float):
        try:
            return kind(plain)
        except ValueError:
            pass
    return plain


def xml_calls(text: str, types: dict[str, dict[str, str]]) -> list[dict]:
    """<function=name> with <parameter=key>value</parameter> inside <tool_call>; the last end tags may be missing."""
    if "<tool_call>" not in text:
        return []
    out = []
    for block in re.findall(r"(?s)<tool_call>(.*?)(?:</tool_call>|$)", text):
        for name, inside in re.findall(r"(?s)<function=([^>]+)>(.*?)(?:</function>|$)", block):
            values = {}
            for key, value in re.findall(r"(?s)<parameter=([^>]+)>(.*?)(?:</parameter>|$)", inside):
                values[key] = _typed(value.removeprefix("\n").removesuffix("\n"), types.get(name, {}).get(key))
            out.append({"name": name, "arguments": json.dumps(values, ensure_ascii=False)})
    return out


def _xml_calls(types: dict[str, dict[str, str]] | None = None):  # noqa: ANN202
    @F.pandas_udf(CALLS)
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda t: xml_calls(t, types or {}) if isinstance(t, str) else None)

    return run


@F.pandas_udf(CALLS)
def _marked_calls(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """call:name{key:value,...} between marks; text values stand between quote marks."""
    call, argument = re.compile(r'(?s)<\|tool_call>call:(\w+)\{(.*?)\}<tool_call\|>'), re.compile(r'(?s)(\w+):(?:<\|"\|>(.*?)<\|"\|>|([^,}]*))')

    def read(text: str | None) -> list[dict] | None:
        if not isinstance(text, str):
            return None
        out = []
        for name, inside in call.findall(text):
            values = {m[1]: m[2] if m[2] is not None else _guessed(m[3]) for m in argument.finditer(inside)}
            out.append({"name": name, "arguments": json.dumps(values, ensure_ascii=False)})
        return out

    for batch in texts:
        yield batch.map(read)


#: Ways in which models write tool calls: JSON in tags, channel messages, XML in tags, marked calls.
TOOL_FORMS = {"hermes": _json_calls, "gpt-oss": _channel_calls, "qwen3_coder": lambda text: _xml_calls()(text), "gemma4": lambda text: _marked_calls(text)}
