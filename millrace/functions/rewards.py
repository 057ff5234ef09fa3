"""Reward managers: how scores of responses become token rewards, with what extras. Managers and functions by name.

A manager gets responses (traj_id, data_source, response, truth, extra, ...) and tokens (traj_id, pos, mask) and returns the
tokens with ``reward``, the score on a trajectory's last valid token, and the scored responses with their extras.
"""

from __future__ import annotations

import importlib.util
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scorers import at_last_token, overlong_penalty, score

Manager = Callable[..., tuple[DataFrame, DataFrame]]
MANAGERS: dict[str, Manager] = {}


def manager(name: str) -> Callable[[Manager], Manager]:
    """Register a reward manager under a name; a name can be taken once."""

    def add(function: Manager) -> Manager:
        if name in MANAGERS:
            raise ValueError(f"reward manager {name} exists")
        MANAGERS[name] = function
        return function

    return add


def load_function(path: str, name: str) -> Callable:
    """A scoring function of one's own from a Python file: (data_source, response, truth, extra) -> number or dict."""
    spec = importlib.util.spec_from_file_location("custom_reward", path)
    if spec is None or spec.loader is None:
        raise FileNotFoundError(path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    if not hasattr(module, name):
        raise AttributeError(f"{path} has no function {name}")
    return getattr(module, name)


def custom(function: Callable, batch: bool = False) -> Callable[[DataFrame], DataFrame]:
    """A scorer of rows by a function of one's own: called a row, or with ``batch`` with four lists of an Arrow batch.

    A number is the score; of a dict 'score' is, and the rest become ``extras`` (text by name). A null response is passed
    on as it is; what the function raises fails the job.
    """

    def read(made: object) -> tuple[float, dict[str, str]]:
        if isinstance(made, dict):
            return float(made["score"]), {k: str(v) for k, v in made.items() if k != "score"}
        return float(made), {}

    @F.pandas_udf("score double, extras map<string,string>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            values = [[v if not isinstance(v, float) or v == v else None for v in c.tolist()] for c in columns]
            made = function(*values) if batch else [function(*row) for row in zip(*values, strict=True)]
            yield pd.DataFrame(list(map(read, made)), columns=["score", "extras"])

    def scored(rows: DataFrame) -> DataFrame:
        extra = F.col("extra") if "extra" in rows.columns else F.lit(None).cast("string")
        return rows.withColumn("_s", run("data_source", "response", "truth", extra)).withColumns({"score": F.col("_s.score"), "extras": F.col("_s.extras")}).drop("_s")

    return scored


def _scored(responses: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None) -> DataFrame:
    return scorer(responses) if scorer else score(responses)


@manager("naive")
def naive(responses: DataFrame, tokens: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Each response's score on its last valid token; by the registered scorer of its source if no other is given."""
    scored = _scored(responses, scorer)
    return at_last_token(tokens, scored), scored


MANAGERS["batch"] = MANAGERS["prime"] = naive  # they differ in how they call the scorer, which is Spark's business here


@manager("dapo")
def dapo(responses: DataFrame, tokens: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None, most: int | None = None, buffer: int = 0, factor: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """As naive, with ``acc`` (the score before) and, with ``most``, the penalty for responses in the overlong buffer added."""
    scored = _scored(responses, scorer).withColumn("acc", F.col("score"))
    if most is not None:
        lengths = tokens.where("mask <> 0").groupBy("traj_id").agg(F.count(F.lit(1)).alias("_n"))
        penalty = overlong_penalty(F.coalesce("_n", F.lit(0)), most, buffer, factor)
        scored = scored.join(lengths, "traj_id", "left").withColumns({"overlong_reward": penalty, "overlong": penalty < 0}).drop("_n").withColumn("score", F.col("score") + F.col("overlong_reward"))
    return at_last_token(tokens, scored), scored


@manager("gdpo")
def gdpo(responses: DataFrame, tokens: DataFrame, scorer: Callable[[DataFrame], DataFrame] | None = None, keys: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """As naive, with the named extras as reward columns of their own (null where a response has none)."""
    scored = _scored(responses, scorer)
    scored = scored.withColumns({k: F.col("extras")[k].cast("double") for k in keys}) if keys else scored
    return at_last_token(tokens, scored), scored


def rewards(name: str, responses: DataFrame, tokens: DataFrame, **options: object) -> tuple[DataFrame, DataFrame]:
    """By a manager's name."""
    if name not in MANAGERS:
        raise ValueError(f"unknown reward manager {name}; there are {sorted(MANAGERS)}")
    return MANAGERS[name](responses, tokens, **options)


def extracted(rewarded: DataFrame, scored: DataFrame, extras: list[str]) -> tuple[DataFrame, DataFrame]:
    """(token rewards, extras by trajectory): what goes on to the estimators."""
    return rewarded.select("traj_id", "pos", "reward"), scored.select("traj_id", *(c for c in extras if c in scored.columns))
