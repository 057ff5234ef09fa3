"""What the query modules share: registering a query with its SQL, and comparable rounding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
#: Added before rounding on both engines: keeps exact decimals off rounding edges, where float noise would decide.
NUDGE = 1.7e-9


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Columns rounded to 6 places the way :func:`sql` writes R(expression); -0 becomes 0."""
    return df.withColumns({c: F.round(F.col(c) + F.lit(NUDGE), 6) + F.lit(0.0) for c in columns})


def sql(text: str) -> str:
    """SQL with every R(expression) spelled out as the rounding above."""
    out, at = [], 0
    while (start := text.find("R(", at)) >= 0:
        if start and (text[start - 1].isalnum() or text[start - 1] == "_"):
            out.append(text[at : start + 2])
            at = start + 2
            continue
        depth, end = 1, start + 2
        while depth:
            depth += {"(": 1, ")": -1}.get(text[end], 0)
            end += 1
        out.append(f"{text[at:start]}(round(({sql(text[start + 2 : end - 1])}) + {NUDGE}, 6) + 0.0)")
        at = end
    return "".join(out) + text[at:]


class Book:
    """Queries and their SQL."""

    def __init__(self, prefix: str = "") -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}
        self.prefix = prefix

    def add(self, name: str, query: Query, text: str | None = None, recursive: bool = False) -> None:
        if name in self.queries:
            raise ValueError(f"query {name} exists")
        self.queries[name] = query
        if text:
            head = "WITH RECURSIVE" if recursive else "WITH"
            self.sql[name] = sql(f"{head} {self.prefix} {text}" if self.prefix else text)
