"""Running functions over tables that may fail: bisecting isolation, retries of invalid rows, recovery, pauses, ablations."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.parsing import parsed_reasoning
from millrace.session import cut

from .ledger import Ledger

#: Which blind reasonings a comparative prompt shows, by ablation mode.
ABLATIONS = {"none": (), "teacher_only": ("teacher",), "student_only": ("student",), "comparative": ("teacher", "student")}


def isolated(rows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str, attempts: int = 1, fatal: tuple[type[BaseException], ...] = (MemoryError,)) -> DataFrame:
    """``function`` on batches of rows; a batch that fails ``attempts`` times is halved until single rows fail alone.

    ``schema`` names the function's result, ``key`` included; rows that fail come out with their key, nulls and ``error``.
    Errors in ``fatal`` are raised at once. Empty input gives no rows.
    """
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def halves(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        said = None
        for _ in range(attempts):
            try:
                yield function(pdf)[names].assign(error=None)
                return
            except fatal:
                raise
            except Exception as failure:  # noqa: BLE001 - whatever a row makes the function raise is that row's error
                said = f"{type(failure).__name__}: {failure}"
        if len(pdf) == 1:
            yield pd.DataFrame({n: [pdf[key].iloc[0] if n == key else None] for n in names} | {"error": [said]})
        else:
            for part in (pdf.iloc[: len(pdf) // 2], pdf.iloc[len(pdf) // 2 :]):
                yield from halves(part)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield from halves(pdf)

    return rows.mapInPandas(work, f"{schema}, error string")


def retried(rows: DataFrame, key: str, run: Callable[[DataFrame, int], DataFrame], valid: Column, attempts: int = 3) -> DataFrame:
    """Each key's first valid result of ``run`` (rows, attempt), else its last one, with ``attempts``.

    Each further attempt runs on what has no valid result yet, and only if there is any; results are written once each.
    """
    left, done = rows, None
    for attempt in range(1, attempts + 1):
        made = cut(run(left, attempt).withColumn("attempts", F.lit(attempt)).withColumn("_ok", F.coalesce(valid, F.lit(False))))
        good = made if attempt == attempts else made.where("_ok")
        done = good if done is None else done.unionByName(good)
        left = left.join(made.where("_ok").select(key), key, "left_anti")
        if attempt < attempts and left.isEmpty():
            break
    return done.drop("_ok")


def recovered(rows: DataFrame, raw: str = "raw_output", parsed: str = "analysis", error: str = "error") -> DataFrame:
    """Rows whose cached result has an error, or none at all, read again from their raw output; a good one clears the error."""
    again = parsed_reasoning(raw)
    wants = F.col(error).isNotNull() | F.col(parsed).isNull()
    good = wants & again.isNotNull()
    return rows.withColumns({parsed: F.when(good, again.cast(rows.schema[parsed].dataType)).otherwise(F.col(parsed)), error: F.when(good, F.lit(None).cast("string")).otherwise(F.col(error))})


def ablated(columns: dict[str, Column], mode: str) -> dict[str, Column]:
    """The sections of a comparative prompt without the blind reasonings that a mode leaves out."""
    if mode not in ABLATIONS:
        raise ValueError(f"unknown mode {mode}; there are {sorted(ABLATIONS)}")
    return {name: c for name, c in columns.items() if name not in ("teacher", "student") or name in ABLATIONS[mode]}


class Pauses(Ledger):
    """Pause and resume marks in the shared folder, numbered in turn: a run looks at :attr:`paused` between batches."""

    def pause(self) -> None:
        if not self.paused:
            self.write(f"pauses/{self.last('pauses') + 1}.json", {})

    def resume(self) -> None:
        if self.paused:
            self.write(f"resumes/{self.last('pauses')}.json", {})

    @property
    def paused(self) -> bool:
        return self.last("pauses") > self.last("resumes")
