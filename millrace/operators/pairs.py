"""Pair generation inside equal-key groups without unbounded tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut, small_side

BLOCK = 2048
#: Hot groups have more than BLOCK rows each; up to so many are broadcast, beyond that they are joined by a shuffle.
BROADCAST_GROUPS = 100_000


def _hot(rows: DataFrame, keys: list[str], block: int, flag: Column | None = None) -> DataFrame | None:
    """(keys, _n, _m) of the groups of more than ``block`` rows, ``_m`` of them with ``flag``; None if there are none."""
    counted = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.lit(True) if flag is None else flag).alias("_m"))
    hot = cut(counted.where(F.col("_n") > block))
    return None if hot.isEmpty() else small_side(hot, BROADCAST_GROUPS)


def _cells(rows: DataFrame, keys: list[str], own: Column, other: Column, id_col: str, payload: list[str], side: str) -> DataFrame:
    """``rows`` of hot groups, each in its own block and once for every block of the other side."""
    mine, theirs = ("_i", "_j") if side == "a" else ("_j", "_i")
    placed = rows.withColumn(mine, F.pmod(F.xxhash64(id_col), own)).withColumn(theirs, F.explode(F.sequence(F.lit(0).cast("long"), other - 1)))
    return placed.select(*keys, "_i", "_j", F.struct(*payload).alias(side))


def _blocks(size: str | Column, block: int) -> Column:
    return F.ceil((F.col(size) if isinstance(size, str) else size) / block).cast("long")


def keyed_pairs(rows: DataFrame, keys: list[str], id_col: str, payload: list[str], block: int = BLOCK) -> DataFrame:
    """All unordered pairs of rows with equal ``keys`` as structs ``a`` and ``b`` with ``a.id < b.id``.

    Groups of up to ``block`` rows are joined with themselves. A larger group of n rows is cut into ceil(n / block) blocks
    on the map side, before any of its rows is shuffled, and each pair of blocks is a cell of its own, so a task never
    sees more than about ``block`` rows a side of one group however hot its key is, and no pair is lost. Null keys form no
    group. Empty input gives no pairs. ``rows`` is read more than once: pass something cheap to recompute or already written.
    """
    hot = _hot(rows, keys, block)
    cold = rows if hot is None else rows.join(hot, keys, "left_anti")
    pairs = cold.select(*keys, F.struct(*payload).alias("a")).join(cold.select(*keys, F.struct(*payload).alias("b")), keys)
    if hot is not None:
        sized, n = rows.join(hot, keys), _blocks("_n", block)
        pairs = pairs.unionByName(
            _cells(sized, keys, n, n, id_col, payload, "a").join(_cells(sized, keys, n, n, id_col, payload, "b"), [*keys, "_i", "_j"]).drop("_i", "_j")
        )
    return pairs.where(F.col(f"a.{id_col}") < F.col(f"b.{id_col}"))


def two_sided_pairs(rows: DataFrame, keys: list[str], id_col: str, flag: str, payload: list[str], block: int = BLOCK) -> DataFrame:
    """All pairs of a row with ``flag`` true (``a``) and one with ``flag`` false (``b``) and equal ``keys``.

    Blocks both sides of hot groups like :func:`keyed_pairs`.
    """
    on = F.col(flag)
    hot = _hot(rows, keys, block, on)
    cold = rows if hot is None else rows.join(hot, keys, "left_anti")
    pairs = cold.where(on).select(*keys, F.struct(*payload).alias("a")).join(cold.where(~on).select(*keys, F.struct(*payload).alias("b")), keys)
    if hot is not None:
        sized = rows.join(hot.where("_m > 0 and _m < _n"), keys)
        a, z = _blocks("_m", block), _blocks(F.col("_n") - F.col("_m"), block)
        pairs = pairs.unionByName(
            _cells(sized.where(on), keys, a, z, id_col, payload, "a").join(_cells(sized.where(~on), keys, z, a, id_col, payload, "b"), [*keys, "_i", "_j"]).drop("_i", "_j")
        )
    return pairs


def member_pairs(links: DataFrame, left: DataFrame, right: DataFrame, block: int = BLOCK) -> DataFrame:
    """(x, y, ...): for each link (cls_a, cls_b, ...) all pairs of a member of cls_a in ``left`` and one of cls_b in ``right``.

    Both are (cls, id). A class of more than ``block`` members is cut into blocks and the links are multiplied by blocks, so
    that no task holds a whole class, however large.
    """
    out = links
    for side, members, name in (("cls_a", left, "x"), ("cls_b", right, "y")):
        placed = members.select(F.col("cls").alias(side), F.col("id").alias(name))
        hot = _hot(members, ["cls"], block)
        if hot is None:
            out = out.join(placed, side)
            continue
        # many blocks: as many as the class needs; links to small classes have the one block 0
        sized = hot.select(F.col("cls").alias(side), _blocks("_n", block).alias("_nb"))
        placed = placed.join(sized, side, "left").withColumn("_blk", F.coalesce(F.pmod(F.xxhash64(name), F.col("_nb")), F.lit(0).cast("long"))).drop("_nb")
        spread_out = out.join(sized, side, "left").withColumn("_blk", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_nb") - 1, F.lit(0).cast("long"))))).drop("_nb")
        out = spread_out.join(placed, [side, "_blk"]).drop("_blk")
    return out
