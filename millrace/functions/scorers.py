"""Rule-based scorers of responses, by data source: native expressions where they can be, pandas UDFs where not."""

from __future__ import annotations

import ast
import json
import operator
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from millrace.operators.grouped import streamed_rows

from .parsing import last_number, qa_form, tagged_answer

SCORERS: dict[str, Callable[[Column, Column], Column]] = {}


def scorer(*sources: str) -> Callable[[Callable[[Column, Column], Column]], Callable[[Column, Column], Column]]:
    """Register (response, truth) -> score for data sources."""

    def add(function: Callable[[Column, Column], Column]) -> Callable[[Column, Column], Column]:
        for source in sources:
            SCORERS[source] = function
        return function

    return add


def score(rows: DataFrame, source: str = "data_source", response: str = "response", truth: str = "truth") -> DataFrame:
    """rows with ``score`` by their source's scorer; a source without one raises."""
    out = F.raise_error(F.concat(F.lit("no scorer for "), F.coalesce(F.col(source), F.lit("null")))).cast("double")
    for name, function in SCORERS.items():
        out = F.when(F.col(source) == name, function(F.col(response), F.col(truth))).otherwise(out)
    return rows.withColumn("score", out)


@scorer("gsm8k")
def gsm8k(response: Column, truth: Column, strict: bool = True, format_score: float = 0.0) -> Column:
    """1 for the right number, ``format_score`` for another one, 0 for none."""
    answer = last_number(response, strict)
    return F.when(answer.isNull(), 0.0).when(answer == truth, 1.0).otherwise(format_score)


def qa_match(response: Column, answers: Column, inside: bool = False) -> Column:
    """1 if the tagged answer equals (or, ``inside``, contains) any golden answer in normal form; an exact match with more
    than ten tags is worth a quarter."""
    answer = qa_form(tagged_answer(response))
    hit = F.exists(answers, lambda a: answer.contains(qa_form(a)) if inside else answer == qa_form(a))
    many = (F.regexp_count(response, F.lit("<answer>")) > 10) | (F.regexp_count(response, F.lit("</answer>")) > 10)
    value = F.lit(1.0) if inside else F.when(many, 0.25).otherwise(1.0)
    return F.when(answer.isNotNull() & hit, value).otherwise(0.0)


@scorer("searchR1_nq", "searchR1_triviaqa", "searchR1_hotpotqa")
def qa_exact(response: Column, truth: Column) -> Column:
    return qa_match(response, F.array(truth))


@scorer("medmcqa")
def medmcqa(response: Column, truth: Column) -> Column:
    """Whether the first 16 characters hold the golden letter."""
    return F.substring(response, 1, 16).contains(truth).cast("double")


@scorer("constant")
def constant(response: Column, truth: Column) -> Column:
    return F.lit(0.0)


def braced(text: str, at: int) -> str | None:
    """``text`` from ``at`` to the brace that closes the first one opened after it; null when it never closes."""
    depth = 0
    for i in range(at, len(text)):
        depth += {"{": 1, "}": -1}.get(text[i], 0)
        if not depth and text[i] == "}":
            return text[at : i + 1]
    return None


def last_boxed(text: str) -> str | None:
    """The content of the last boxed expression, braces matched; null when it never closes. After '\\boxed ' with a blank
    the content goes up to a dollar sign or the end."""
    if "\\boxed " in text:
        return text.rsplit("\\boxed ", 1)[1].split("$", 1)[0]
    at = text.rfind("\\boxed{")
    whole = braced(text, at) if at >= 0 else None
    return whole[len("\\boxed{") : -1] if whole else None


# What is replaced, and then what is removed, in a final answer of the dapo rule.
DAPO_REPLACED = (("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"), (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"))
DAPO_REMOVED = (
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points", "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges",
    "students", "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3", "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", '"', "\\dots",
)
# Patterns of the dapo rule: what stands between dollar signs, wrappers taken off, shorthand fractions and roots.
DAPO_PATTERNS = (
    (r".*?\$(.*?)\$.*", r"$\1$"), (r"\\text\{(.*?)\}", r"\1"), (r"\\textbf\{(.*?)\}", r"\1"), (r"\\overline\{(.*?)\}", r"\1"), (r"\\boxed\{(.*)\}", r"\1"),
    (r"frac([^{])(.)", r"frac{\1}{\2}"), (r"sqrt([^{])", r"sqrt{\1}"), (r"\$", ""),
)
# What is replaced in an answer of the boxed rule.
BOXED_REPLACED = (("\n", ""), ("\\!", ""), ("\\\\", "\\"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\left", ""), ("\\right", ""), ("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""))


def dapo_form(answer: str) -> str:
    """A final answer by the dapo rule: what follows the last '=', without fixed words and wrappers."""
    out = answer.rsplit("=", 1)[-1]
    for old, new in DAPO_REPLACED + tuple((x, "") for x in DAPO_REMOVED):
        out = out.replace(old, new)
    for pattern, new in DAPO_PATTERNS:
        out = re.sub(pattern, new, out)
    plain = out.replace(",", "")
    return (plain if plain.isdigit() else out).strip()


def _fractions(text: str) -> str:
    """\\frac12 and \\frac1{2} with braces around single characters; left alone if one has no two arguments."""
    head, *rest = text.split("\\frac")
    out = [head]
    for part in rest:
        if not part:
            raise ValueError("a fraction without arguments")
        if part[0] != "{":
            if len(part) < 2:
                return text
            part = f"{{{part[0]}}}{part[1:]}" if part[1] == "{" else f"{{{part[0]}}}{{{part[1]}}}{part[2:]}"
        out.append(part)
    return "\\frac".join(out)


def math_form(answer: str) -> str:
    """An answer by the boxed rule: without decoration and units, one form of decimals, fractions and roots.

    Raises ValueError for what the rule has no form for (two units, a root or fraction without arguments).
    """
    out = answer
    for old, new in BOXED_REPLACED:
        out = out.replace(old, new)
    out, *units = out.split("\\text{ ")
    if len(units) > 1:
        raise ValueError("several units")
    out = out.replace("\\%", "").replace(" .", " 0.").replace("{.", "{0.")
    if not out:
        return out
    out = "0" + out if out[0] == "." else out
    left, *right = out.split("=")
    if len(right) == 1 and len(left) <= 2:
        out = right[0]
    if out.endswith("\\sqrt"):
        raise ValueError("a root without an argument")
    out = _fractions(re.sub(r"\\sqrt([^{])", r"\\sqrt{\1}", out).replace(" ", ""))
    if out == "0.5":
        return "\\frac{1}{2}"
    ratio = re.fullmatch(r"(0|-?[1-9][0-9]*)/(0|-?[1-9][0-9]*)", out)
    return f"\\frac{{{ratio[1]}}}{{{ratio[2]}}}" if ratio else out


def math_equal(a: str, b: str) -> bool:
    """Whether two answers have one form; as they stand where one has none."""
    try:
        return math_form(a) == math_form(b)
    except ValueError:
        return a == b


def _number(text: str) -> float | None:
    text = text.replace(",", "")
    try:
        return float(text) if not text.endswith("%") else float(text.rstrip("\\%")) / 100
    except ValueError:
        return None


def numeric_equal(a: str, b: str, tolerance: float = 1e-4) -> bool:
    """Equal as text or as numbers within a relative ``tolerance``; a percentage also equals its number. Nothing symbolic."""
    if a.strip().lower() == b.strip().lower():
        return True
    x, y = _number(a.strip()), _number(b.strip())
    return x is not None and y is not None and any(abs(x - z) <= tolerance * max(abs(x), abs(z)) for z in (y / 100, y, y * 100))


@F.pandas_udf(DoubleType())
def math_boxed(responses: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """1 if the last boxed answer equals the truth in normal form."""
    for response, truth in responses:
        yield pd.Series([float(bool(isinstance(r, str) and (b := last_boxed(r)) is not None and isinstance(t, str) and math_equal(b, t))) for r, t in zip(response, truth, strict=True)])


SCORERS["math"] = SCORERS["lighteval/MATH"] = lambda response, truth: math_boxed(response, truth)
RESULT = StructType([StructField("score", DoubleType()), StructField("acc", BooleanType()), StructField("pred", StringType())])


@F.pandas_udf(RESULT)
def math_dapo(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """(score +-1, acc, pred) of the last 'Answer:' line in the last 300 characters; without one it is '[INVALID]'."""
    for response, truth in batches:
        rows = []
        for r, t in zip(response, truth, strict=True):
            found = re.findall(r"(?i)Answer\s*:\s*([^\n]+)", (r or "")[-300:])
            pred = dapo_form(found[-1] if found else "[INVALID]")
            ok = isinstance(t, str) and pred == dapo_form(t)
            rows.append((1.0 if ok else -1.0, ok, pred))
        yield pd.DataFrame(rows, columns=["score", "acc", "pred"])


@F.pandas_udf(RESULT)
def math_strict_box(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """(score +-1, acc, pred): the last boxed answer in the last 100 characters equals the truth as it stands."""
    for response, truth in batches:
        rows = []
        for r, t in zip(response, truth, strict=True):
            tail = (r or "")[-100:]
            at = tail.rfind("\\boxed{")
            whole = braced(tail, at) if at >= 0 else None
            pred = whole[len("\\boxed{") : -1] if whole else None
            rows.append((1.0 if pred is not None and pred == t else -1.0, pred is not None and pred == t, pred))
        yield pd.DataFrame(rows, columns=["score", "acc", "pred"])


_OPERATORS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.FloorDiv: operator.floordiv, ast.Div: operator.floordiv}


def arithmetic(text: str, within: tuple[int, int] | None = None) -> tuple[int | None, Counter]:
    """(value, numbers used) of an expression of whole numbers and + - * / //; both divisions must come out even.

    The value is null for anything else (signs, other nodes, a division by zero or with a remainder, and, with
    ``within``, an intermediate result out of bounds).
    """
    used: Counter = Counter()

    def value(node: ast.AST) -> int:
        if isinstance(node, ast.Constant) and isinstance(node.value, int):
            used[node.value] += 1
            return node.value
        if not isinstance(node, ast.BinOp) or type(node.op) not in _OPERATORS:
            raise ValueError
        a, b = value(node.left), value(node.right)
        if isinstance(node.op, ast.Div | ast.FloorDiv) and (b == 0 or a % b):
            raise ValueError
        out = _OPERATORS[type(node.op)](a, b)
        if within and not within[0] <= out <= within[1]:
            raise ValueError
        return out

    try:
        return value(ast.parse(text.strip(), mode="eval").body), used
    except (ValueError, SyntaxError, RecursionError, MemoryError):
        return None, used


@F.pandas_udf(RESULT)
def countdown(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    """(response, numbers, target) -> (score +-1, acc, pred): the last boxed expression, or else the whole response, uses
    each number exactly once and hits."""
    for response, numbers, target in batches:
        rows = []
        for r, n, t in zip(response, numbers, target, strict=True):
            found = re.findall(r"\\boxed\{((?:[^{}]|\{[^{}]*\})*)\}", r or "")
            pred = None if r is None else (found[-1] if found else r).strip()
            value, used = arithmetic(pred) if pred else (None, Counter())
            ok = value is not None and n is not None and value == t and used == Counter(int(x) for x in n)
            rows.append((1.0 if ok else -1.0, ok, pred))
        yield pd.DataFrame(rows, columns=["score", "acc", "pred"])


def geo3k(response: Column, truth: Column) -> Column:
    """0.9 for the boxed answer and 0.1 for the think-then-box layout."""
    return 0.9 * math_boxed(response, truth) + 0.1 * response.rlike(r"(?s)^\s*<think>.*</think>.*\\boxed\{.*\}.*$").cast("double")


def multiset_match(a: Column, b: Column) -> Column:
    """Multiset Jaccard of two string arrays, inside the JVM; 1 for two empty ones."""
    both = F.array_distinct(F.concat(a, b))
    times = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    shared = F.aggregate(F.transform(both, lambda x: F.least(times(a, x), times(b, x))), F.lit(0), lambda s, x: s + x)
    return F.when(F.size(both) == 0, 1.0).otherwise(shared / (F.size(a) + F.size(b) - shared))


def _alike(a: list, b: list) -> float:
    """Multiset Jaccard; 1 for two equal lists, 0 if one is empty."""
    if a == b:
        return 1.0
    both = (Counter(a) & Counter(b)).total()
    return both / (len(a) + len(b) - both) if a and b else 0.0


def call_agreement(wanted: list[dict], called: list[dict]) -> float:
    """Share of the points that wanted tool calls (name, parameters) can earn: names as multisets, then for each wanted
    call, in order, the best unused call of its name by parameter names and equal values."""
    if wanted == called:
        return 1.0
    points, most, free = _alike([w["name"] for w in wanted], [c["name"] for c in called]), 1.0, list(called)
    for want in wanted:
        asked = want["parameters"]
        most += 1.0 + len(asked)
        worth = [_alike(list(asked), list(c["parameters"])) + sum(k in c["parameters"] and c["parameters"][k] == v for k, v in asked.items()) if c["name"] == want["name"] else 0.0 for c in free]
        if worth and max(worth) > 0:
            points += max(worth)
            free.pop(worth.index(max(worth)))
    return points / most


def _calls(text: str) -> list[dict]:
    """The JSON lines of the first tool_call block."""
    return [json.loads(line) for line in text.split("<tool_call>")[1].split("</tool_call>")[0].strip().split("\n")]


# The layout of a response by whether the truth has tool calls and a response, and what must be there once.
_LAYOUT = {
    (False, True): (r"^<think>.*?</think>\n<response>.*?</response>$", ("<response>",)),
    (True, False): (r"^<think>.*?</think>\n<tool_call>\n.*?\n</tool_call>$", ("<tool_call>",)),
    (True, True): (r"^<think>.*?</think>\n<tool_call>\n.*?\n</tool_call>\n<response>.*?</response>$", ("<tool_call>", "<response>")),
    (False, False): (r"^<think>.*?</think>$", ()),
}
# What stands around the assistant's turn, by model family.
TURNS = {"llama": ("<|start_header_id|>assistant<|end_header_id|>", "<|eot_id|>"), "qwen": ("<|im_start|>assistant", "<|im_end|>")}


def layout_ok(response: str, truth: str) -> bool:
    """Whether a response has the layout of the truth: think, then tool calls and/or a response, each once."""
    pattern, once = _LAYOUT["<tool_call>" in truth, "<response>" in truth]
    return bool(re.search(pattern, response, re.S)) and all(response.count(tag) == 1 == response.count(tag.replace("<", "</")) for tag in once)


def tool_call_score(response: Column, truth: Column, family: str = "qwen") -> Column:
    """(score, format_reward 0..1, accuracy_reward -3..3) of a response against a truth with tool calls and/or a response.

    ``family`` names the chat format around the assistant's turn. A truth without tool calls earns accuracy 0; calls that
    cannot be read earn -3.
    """
    before, after = TURNS[family]

    @F.pandas_udf("score double, format_reward double, accuracy_reward double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for responses, truths in batches:
            rows = []
            for r, t in zip(responses, truths, strict=True):
                said, t = (r or "").split(before)[-1].split(after)[0].strip(), t or ""
                accuracy = 0.0
                if "<tool_call>" in t:
                    wanted = _calls(t)
                    try:
                        accuracy = 6.0 * call_agreement(wanted, _calls(said)) - 3.0 if "</tool_call>" in said else -3.0
                    except (ValueError, KeyError, IndexError, TypeError, AttributeError):
                        accuracy = -3.0
                form = float(layout_ok(said, t))
                rows.append((form + accuracy, form, accuracy))
            yield pd.DataFrame(rows, columns=["score", "format_reward", "accuracy_reward"])

    return run(response, truth)


def overlong_penalty(length: Column, most: int, buffer: int, factor: float = 1.0) -> Column:
    """min(-(length - (most - buffer)) / buffer x factor, 0)."""
    return F.least(-(length - F.lit(most - buffer)) / F.lit(float(buffer)) * factor, F.lit(0.0))


def elo(matches: DataFrame, group: str, k: float = 32.0, start: float = 1000.0) -> DataFrame:
    """(group, player, elo, reward) after each group's matches (a, b, result of a: 1, 0.5, 0) in order of ``seq``; reward
    is (elo - 1000) / 200 + 0.5. Ratings depend on order, so a group's matches stream past one by one; its players'
    ratings are all that is remembered."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        rating: dict = {}
        for name, _, a, b, result in rows:
            ra, rb = rating.get(a, start), rating.get(b, start)
            expected = 1 / (1 + 10 ** ((rb - ra) / 400))
            rating[a] = ra + k * (result - expected)
            rating[b] = rb - k * (result - expected)
        for player, elo_ in sorted(rating.items()):
            yield name, player, elo_, (elo_ - 1000) / 200 + 0.5

    kind = dict(matches.dtypes)
    plain = matches.select(group, "seq", "a", "b", F.col("result").cast("double").alias("result"))
    return streamed_rows(plain, group, "seq", run, f"{group} {kind[group]}, player {kind['a']}, elo double, reward double")


def win_rates(matches: DataFrame, group: str) -> DataFrame:
    """(group, player, games, score): mean result of each player over its matches; order does not matter here."""
    sides = matches.select(group, F.col("a").alias("player"), "result").unionByName(matches.select(group, F.col("b").alias("player"), (1 - F.col("result")).alias("result")))
    return sides.groupBy(group, "player").agg(F.count(F.lit(1)).alias("games"), F.avg("result").alias("score"))


def at_last_token(tokens: DataFrame, scores: DataFrame) -> DataFrame:
    """Token rewards: each trajectory's score on its last valid token, 0 elsewhere."""
    last = tokens.where("mask <> 0").groupBy("traj_id").agg(F.max("pos").alias("_last"))
    joined = tokens.join(last, "traj_id", "left").join(scores.select("traj_id", "score"), "traj_id", "left")
    return joined.withColumn("reward", F.when(F.col("pos") == F.col("_last"), F.coalesce("score", F.lit(0.0))).otherwise(0.0)).drop("_last", "score")
