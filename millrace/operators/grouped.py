"""Many small ordered groups through Python without a pandas frame for each."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streamed_groups(rows: DataFrame, key: str, order: str, run: Callable[[list[tuple]], Iterable[tuple]], schema: str, flush: int = 20_000) -> DataFrame:
    """``run`` on the row tuples of each group, in order; its tuples make the result.

    Rows are partitioned by the key and sorted inside their partition, so groups stream past: a task holds one group
    and a buffer of results at a time. For groups whose size a parameter bounds; see :func:`streamed_rows` for others.
    """
    at, names = rows.columns.index(key), [c.strip().split(" ")[0] for c in schema.split(",")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tuples = (row for pdf in batches for row in pdf.itertuples(index=False, name=None))
        out: list[tuple] = []
        for _, group in groupby(tuples, key=lambda row: row[at]):
            out.extend(run(list(group)))
            if len(out) >= flush:
                yield pd.DataFrame(out, columns=names)
                out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, order).mapInPandas(work, schema)


def streamed_rows(rows: DataFrame, key: str, order: str, run: Callable[[Iterator[tuple]], Iterable[tuple]], schema: str, descending: bool = False, flush: int = 20_000) -> DataFrame:
    """As :func:`streamed_groups`, but ``run`` gets a group's row tuples as an iterator and its tuples are passed on as they
    come: a task holds a row, what ``run`` remembers and a buffer, however long the group is."""
    at, names = rows.columns.index(key), [c.strip().split(" ")[0] for c in schema.split(",")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tuples = (row for pdf in batches for row in pdf.itertuples(index=False, name=None))
        out: list[tuple] = []
        for _, group in groupby(tuples, key=lambda row: row[at]):
            for made in run(group):
                out.append(made)
                if len(out) >= flush:
                    yield pd.DataFrame(out, columns=names)
                    out = []
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.repartition(key).sortWithinPartitions(key, F.desc(order) if descending else order).mapInPandas(work, schema)


def streamed_scan(rows: DataFrame, key: str, order: str, inputs: list[str], start: tuple, step: Callable[..., tuple], out: str, descending: bool = False) -> DataFrame:
    """rows with ``out``, the first part of a state (double) that ``step`` (state, *inputs) carries from row to row of a group.

    Groups stream past in order like in :func:`streamed_rows`; columns stay arrays.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state, begun = None, start, False
        for pdf in batches:
            made = []
            for name, *values in zip(pdf[key].tolist(), *(pdf[c].tolist() for c in inputs), strict=True):
                if name != last or not begun:
                    last, state, begun = name, start, True
                state = step(state, *values)
                made.append(state[0])
            yield pdf.assign(**{out: made})

    schema = ", ".join(f"{c} {t}" for c, t in rows.dtypes) + f", {out} double"
    return rows.repartition(key).sortWithinPartitions(key, F.desc(order) if descending else order).mapInPandas(work, schema)
