"""The rule pool: an ordered action log folded into a weighted set of at most ``capacity`` active references.

Where nothing is evicted and no importance falls to 0 the final counters are a plain aggregate (:func:`counters`). The
general fold needs the order: pools stream past in order, side by side over the partitions (a pool's state is bounded
by the references ever added).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .grouped import streamed_groups

CAPACITY = 100
# The legal actions of each candidate label; SKIP is always legal in a log.
LEGAL = {"sarcastic": ("ADD", "MODIFY", "UPVOTE", "SKIP"), "non-sarcastic": ("MODIFY", "UPVOTE", "DOWNVOTE", "SKIP")}
STATE = "pool string, id string, mechanism string, exclusion_boundary string, active boolean, importance long, revision long, created_order long, upvotes long, downvotes long, modifies long"


def reference_id(order: Column) -> Column:
    """'exp-' and six digits."""
    return F.format_string("exp-%06d", order)


def with_assigned_ids(actions: DataFrame) -> DataFrame:
    """``assigned_id`` of ADD rows: their rank among the pool's ADDs in order."""
    w = Window.partitionBy("pool").orderBy("seq")
    return actions.withColumn("assigned_id", F.when(F.col("action") == "ADD", reference_id(F.sum((F.col("action") == "ADD").cast("int")).over(w))))


def action_error() -> Column:
    """First failure of a log row by itself: unknown label or action, action not legal, target or texts missing."""
    label, action = F.col("candidate_label"), F.col("action")
    out = F.when(~F.coalesce(label.isin(*LEGAL), F.lit(False)), "unknown label")
    for name, legal in LEGAL.items():
        out = out.when((label == name) & ~F.coalesce(action.isin(*legal), F.lit(False)), f"action is not legal for {name}")
    out = out.when(action.isin("MODIFY", "UPVOTE", "DOWNVOTE") & F.col("target_id").isNull(), "target is missing")
    out = out.when((action == "ADD") & (F.col("mechanism").isNull() | F.col("exclusion_boundary").isNull()), "texts are missing")
    return out.when((action == "MODIFY") & (F.col("modification_scope") != "BOUNDARY") & F.col("mechanism").isNull(), "mechanism is missing")


def counters(actions: DataFrame) -> DataFrame:
    """(pool, id, importance, revision, upvotes, downvotes, modifies) as if nothing were ever evicted or at 0."""
    votes = actions.where("target_id is not null").groupBy("pool", F.col("target_id").alias("id")).agg(
        *(F.count_if(F.col("action") == a).alias(n) for a, n in (("UPVOTE", "upvotes"), ("DOWNVOTE", "downvotes"), ("MODIFY", "modifies")))
    )
    added = with_assigned_ids(actions).where("assigned_id is not null").select("pool", F.col("assigned_id").alias("id"))
    joined = added.join(votes, ["pool", "id"], "left").na.fill(0)
    return joined.select("pool", "id", (2 + F.col("upvotes") + F.col("modifies") - F.col("downvotes")).alias("importance"), (1 + F.col("modifies")).alias("revision"), "upvotes", "downvotes", "modifies")


def _key(mechanism: str | None, boundary: str | None) -> str:
    return " ".join(f"{mechanism} {boundary}".casefold().split())


class Pool:
    """One pool's state; :meth:`apply` takes log rows in order."""

    def __init__(self, capacity: int = CAPACITY) -> None:
        self.capacity = capacity
        self.items: dict[str, dict] = {}

    def _limit(self) -> None:
        """After every action the best ``capacity`` items with importance are the active ones, newer first among equals;
        an inactive item that ranks in comes back."""
        ranked = sorted((i for i in self.items.values() if i["importance"] > 0), key=lambda i: (-i["importance"], -i["created_order"]))
        for item in self.items.values():
            item["active"] = False
        for item in ranked[: self.capacity]:
            item["active"] = True

    def apply(self, action: str, target: str | None, mechanism: str | None, boundary: str | None, scope: str | None) -> None:
        if action == "ADD":
            same = next((i for i in self.items.values() if i["active"] and _key(i["mechanism"], i["exclusion_boundary"]) == _key(mechanism, boundary)), None)
            if same is not None:
                same["importance"] += 1
                same["upvotes"] += 1
            else:
                order = 1 + max((i["created_order"] for i in self.items.values()), default=0)
                self.items[f"exp-{order:06d}"] = dict(
                    id=f"exp-{order:06d}", mechanism=mechanism, exclusion_boundary=boundary, active=True, importance=2, revision=1, created_order=order, upvotes=0, downvotes=0, modifies=0
                )
        elif action != "SKIP":
            item = self.items.get(target or "")
            if item is None or not item["active"]:
                raise ValueError(f"{action} of {target}, which is not active")
            if action == "UPVOTE":
                item["importance"] += 1
                item["upvotes"] += 1
            elif action == "DOWNVOTE":
                item["importance"] -= 1
                item["downvotes"] += 1
            elif action == "MODIFY":
                if scope == "BOUNDARY" and mechanism is not None and mechanism != item["mechanism"]:
                    raise ValueError("a BOUNDARY change may not touch the mechanism")
                item["importance"] += 1
                item["revision"] += 1
                item["modifies"] += 1
                item["mechanism"] = item["mechanism"] if scope == "BOUNDARY" or mechanism is None else mechanism
                item["exclusion_boundary"] = item["exclusion_boundary"] if boundary is None else boundary
            else:
                raise ValueError(f"unknown action {action}")
        self._limit()

    def rows(self) -> list[dict]:
        return list(self.items.values())


def fold(actions: DataFrame, capacity: int = CAPACITY, drop_inactive_targets: bool = False) -> DataFrame:
    """The state of each pool after its log (pool, seq, action, target_id, mechanism, exclusion_boundary,
    modification_scope). An action on an inactive or unknown target raises, or is skipped with
    ``drop_inactive_targets``. An ADD equal to an active item counts as an UPVOTE of it."""

    names = [c.split()[0] for c in STATE.split(", ")[1:]]

    def run(group: list[tuple]) -> list[tuple]:
        state = Pool(capacity)
        for _, _, *row in group:
            try:
                state.apply(*row)
            except ValueError:
                if not drop_inactive_targets:
                    raise
        return [(group[0][0], *(item[n] for n in names)) for item in state.rows()]

    plain = actions.select("pool", "seq", "action", "target_id", "mechanism", "exclusion_boundary", "modification_scope")
    return streamed_groups(plain, "pool", "seq", run, STATE)


def ranked(state: DataFrame) -> DataFrame:
    """``place`` in an export: active items by importance, newer first, then inactive ones by age."""
    w = Window.partitionBy("pool").orderBy(F.desc("active"), F.when(F.col("active"), -F.col("importance")), F.when(F.col("active"), -F.col("created_order")), "created_order")
    return state.withColumn("place", F.row_number().over(w))


def prefix_mismatch(log: DataFrame, candidates: DataFrame) -> DataFrame:
    """Log rows (pool, seq, candidate_id) that are not the candidates' order (pool, seq, candidate_id): empty for a log
    that can be resumed."""
    return log.join(candidates.select("pool", "seq", F.col("candidate_id").alias("_want")), ["pool", "seq"], "left").where(~F.col("candidate_id").eqNullSafe(F.col("_want"))).drop("_want")


def action_counts(actions: DataFrame) -> DataFrame:
    return actions.groupBy("pool").pivot("action", ["ADD", "MODIFY", "UPVOTE", "DOWNVOTE", "SKIP"]).count().na.fill(0)


def replayed(rows: Iterator[tuple], capacity: int = CAPACITY) -> Pool:
    """A pool from (action, target, mechanism, boundary, scope) rows, for tests and small logs on the driver."""
    pool = Pool(capacity)
    for row in rows:
        pool.apply(*row)
    return pool
