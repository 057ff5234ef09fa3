"""Problem 3: splits that keep related records together.

Sample names are the nodes; a candidate with two different names is an edge. What is persisted after each run: the names
it saw first with their component, the ids it saw first, and the component table (component, root, split, ids). A run looks
up the names it meets, merges their roots by pointer jumping and rewrites the component table; names and ids of earlier runs
are never rewritten. Merged components keep the split they had, new ones fill what is missing to the target shares, and a
component that was merged from components of different splits is quarantined: it has no split until :meth:`SplitTable.resolve`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.operators.components import components
from millrace.operators.ledger import Ledger
from millrace.session import cut

ITEM_MARK = "::item-"
_BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"
#: Components above this share of all ids are placed one by one; there are fewer than 1 / BIG of them.
BIG = 0.005


def sample_name(col: Column) -> Column:
    """A sample's name, blanks around and letter case aside; null when blank."""
    name = F.lower(F.regexp_replace(col, _BLANKS, ""))
    return F.when(name != "", name)


def candidate_names(candidates: DataFrame) -> DataFrame:
    """(sample_id, own, given): the names a candidate id has by itself and by source_sample_id.

    The part before the first '::item-' counts; an id without that mark is its own name. Null ids drop out, repeated rows
    collapse, extra columns are ignored.
    """
    rows = candidates.where("sample_id is not null").select(
        "sample_id", sample_name(F.substring_index("sample_id", ITEM_MARK, 1)).alias("own"), sample_name(F.col("source_sample_id")).alias("given")
    )
    return rows.distinct()


def family_rows(candidates: DataFrame) -> DataFrame:
    """p3_found: (lead_id, sample_id) of each family of two or more ids, its least id in byte order leading."""
    table = SplitTable(candidates.sparkSession)
    table.absorb(candidates)
    rows = cut(table.items().distinct())
    leads = rows.groupBy("component").agg(F.min("sample_id").alias("lead_id"), F.max("sample_id").alias("last")).where("lead_id <> last")
    return rows.join(leads, "component").where("sample_id <> lead_id").select("lead_id", "sample_id")


def _fill(new: DataFrame, held: dict[str, int], targets: dict[str, float]) -> DataFrame:
    """(component, split) of new components (component, ids) such that all splits come close to their targets."""
    total = new.agg(F.sum("ids").alias("n")).first()["n"] or 0
    if not total:
        return new.select("component", F.lit(None).cast("string").alias("split"))
    whole = total + sum(held.values())
    scale = sum(targets.values())
    need = {s: max(0.0, share / scale * whole - held.get(s, 0)) for s, share in sorted(targets.items())}
    big = new.where(F.col("ids") > BIG * total).orderBy(F.desc("ids"), "component").collect()  # fewer than 1 / BIG rows
    placed = []
    for row in big:
        split = max(need, key=lambda s: need[s])
        need[split] -= row["ids"]
        placed.append((row["component"], split))
    # the rest in hash order: a component goes where the middle of its stretch of ids falls
    left = {s: max(0.0, n) for s, n in need.items()}
    room = sum(left.values()) or 1.0
    small = new.where(F.col("ids") <= BIG * total).withColumn("slot", F.expr("pmod(xxhash64(component), 1024)"))
    slots = small.groupBy("slot").agg(F.sum("ids").alias("slot_ids"))
    begun = slots.select("slot", (F.sum("slot_ids").over(Window.orderBy("slot")) - F.col("slot_ids")).alias("before"), F.sum("slot_ids").over(Window.partitionBy(F.lit(0))).alias("all"))
    inside = Window.partitionBy("slot").orderBy("component")
    at = small.join(F.broadcast(begun), "slot").withColumn("at", (F.col("before") + F.sum("ids").over(inside) - F.col("ids") / 2) / F.col("all"))
    choice, edge = F.lit(max(left, key=lambda s: left[s])), 0.0
    bounds = []
    for split, n in left.items():
        edge += n / room
        bounds.append((split, edge))
    for split, upto in reversed(bounds):
        choice = F.when(F.col("at") <= upto, F.lit(split)).otherwise(choice)
    rest = at.select("component", choice.alias("split"))
    if not placed:
        return rest
    return rest.unionByName(new.sparkSession.createDataFrame(placed, "component string, split string"))


class SplitTable(Ledger):
    """The persisted tables under ``home`` in the shared folder; opened anew, the newest published version counts.

    ``names/v`` (node, component) and ``ids/v`` (sample_id, node) hold what version v saw first, ``roots/v`` (component,
    root, split, ids) all components: ``ids`` counts what was added to the component itself, ``split`` is what it was
    given when it was a root. A version counts once its marker is written; what a run that died has left is overwritten.
    """

    def __init__(self, spark: SparkSession, home: str | None = None) -> None:
        super().__init__(spark, home, "splits")
        self.version = self.last("published") + 1

    def _stored(self, kind: str) -> DataFrame:
        versions = [self.version] if kind == "roots" else range(1, self.version + 1)
        return self.spark.read.parquet(*(f"{self.home}/{kind}/{v}" for v in versions))

    def items(self) -> DataFrame:
        """(sample_id, component) of every id seen, by the root its component has now; no rows before the first run."""
        if not self.version:
            return self.spark.createDataFrame([], "sample_id string, component string")
        return self._rooted(self._stored("ids")).select("sample_id", "component")

    def _rooted(self, rows: DataFrame) -> DataFrame:
        """``rows`` (node, ...) with the present root of each known node as ``component``."""
        roots = self._stored("roots")
        found = rows.join(self._stored("names"), "node")
        return found if self.version == 1 else found.join(roots.select("component", "root"), "component").drop("component").withColumnRenamed("root", "component")

    def states(self) -> DataFrame:
        """(component, split, splits, ids, quarantined) of each root."""
        merged = self._stored("roots").groupBy(F.col("root").alias("component")).agg(F.collect_set("split").alias("splits"), F.sum("ids").alias("ids"))
        return merged.select("component", F.when(F.size("splits") == 1, F.col("splits")[0]).alias("split"), "splits", "ids", (F.size("splits") > 1).alias("quarantined"))

    def _publish(self, roots: DataFrame) -> None:
        roots.write.mode("overwrite").parquet(f"{self.home}/roots/{self.version + 1}")
        self.write(f"published/{self.version}.json", {"version": self.version + 1})
        self.version += 1

    def absorb(self, candidates: DataFrame, targets: DataFrame | None = None) -> DataFrame:
        """Merge the candidates' names into the components and, with ``targets``, give splits to components that have
        none; returns the distinct ids (sample_id, node) met. Null ids and ids without a name drop out."""
        shares = {r["split"]: float(r["share"]) for r in targets.where("split is not null and share > 0").collect()} if targets is not None else {}  # a row a split
        if targets is not None and not shares:
            raise ValueError("split_targets names no split with a positive share")
        pairs = cut(candidate_names(candidates))
        met = pairs.select("sample_id", F.coalesce("own", "given").alias("node")).where("node is not null").distinct()
        nodes = pairs.select(F.explode(F.array("own", "given")).alias("node")).where("node is not null").distinct()
        edges = pairs.where("own <> given").select(F.col("own").alias("x"), F.col("given").alias("y"))
        if self.version:
            known = cut(self._rooted(nodes))
            edges = edges.unionByName(known.where("node <> component").select(F.col("node").alias("x"), F.col("component").alias("y")))
            nodes = nodes.join(known, "node", "left_anti")
            fresh = met.join(self._stored("ids"), ["sample_id", "node"], "left_anti")
        else:
            fresh = met
        found = components(edges)
        label = F.coalesce("component", "node").alias("component")
        named = nodes.join(found, "node", "left").select("node", label)
        named.write.mode("overwrite").parquet(f"{self.home}/names/{self.version + 1}")
        fresh.write.mode("overwrite").parquet(f"{self.home}/ids/{self.version + 1}")
        named, fresh = (self.spark.read.parquet(f"{self.home}/{kind}/{self.version + 1}") for kind in ("names", "ids"))
        # a new id's node may be an old name, whose root may just have been merged
        homes = named if not self.version else named.unionByName(known.select(F.col("component").alias("root"), "node").join(found.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("component", "root").alias("component")))
        added = fresh.join(homes, "node").groupBy("component").agg(F.count(F.lit(1)).alias("more"))
        labels = named.select("component").distinct()
        if self.version:
            old = self._stored("roots").join(found.select(F.col("node").alias("root"), F.col("component").alias("to")), "root", "left").select("component", F.coalesce("to", "root").alias("root"), "split", "ids")
            labels = labels.unionByName(old.select(F.col("root").alias("component"))).distinct().join(old.select("component"), "component", "left_anti")
        first = labels.select("component", F.col("component").alias("root"), F.lit(None).cast("string").alias("split"), F.lit(0).cast("long").alias("ids"))
        roots = old.unionByName(first) if self.version else first
        self._publish(roots.join(added, "component", "left").select("component", "root", "split", (F.col("ids") + F.coalesce("more", F.lit(0))).alias("ids")))
        if targets is not None:
            state = cut(self.states())
            held = {r["split"]: r["n"] for r in state.where("split is not null").groupBy("split").agg(F.sum("ids").alias("n")).collect()}  # a row a split
            new = _fill(state.where("size(splits) = 0").select("component", "ids"), held, shares).withColumnRenamed("split", "given")
            self._publish(self._stored_roots_with(new))
        return met

    def _stored_roots_with(self, given: DataFrame) -> DataFrame:
        """The component table with the splits of ``given`` (component, given); names and ids of this version are empty."""
        for kind in ("names", "ids"):
            self._stored(kind).limit(0).write.mode("overwrite").parquet(f"{self.home}/{kind}/{self.version + 1}")
        return self._stored("roots").join(given, "component", "left").select("component", "root", F.coalesce("given", "split").alias("split"), "ids")

    def resolve(self, decisions: DataFrame) -> None:
        """End quarantines: each (component, split) sets the split of a root and of all that was merged into it."""
        chosen = decisions.where("split is not null").select(F.col("component").alias("root"), F.col("split").alias("given"))
        roots = self._stored("roots").join(chosen, "root", "left").select("component", "root", F.coalesce("given", "split").alias("split"), "ids")
        self._stored_roots_with(self.spark.createDataFrame([], "component string, given string"))
        self._publish(roots)

    def update(self, candidates: DataFrame, targets: DataFrame) -> DataFrame:
        """Take in candidates and return (sample_id, component, split, quarantined) of them."""
        met = self.absorb(candidates, targets)
        return self._rooted(met).join(self.states(), "component").select("sample_id", "component", "split", "quarantined")


def split_candidates(spark: SparkSession, candidates: DataFrame, targets: DataFrame) -> DataFrame:
    """(sample_id, component, split, quarantined) of a first run over all candidates."""
    return SplitTable(spark).update(candidates, targets)
