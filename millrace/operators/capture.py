"""Problem 6: change capture from an append-only journal.

The journal is read as a log of hash partitions with an offset (``seq``) each. Every batch is planned first: its offset
range per partition and its number are written to the shared folder before any work, so a failed batch is replayed with
exactly the same range, and only that range is read. A batch merges the slice's newest content of each key into the
content kept from earlier batches, so a late row never replaces newer content. The sink writes each batch to a folder of
its own, deduplicated by key and offset, and publishes it with a marker file; a replay overwrites what a failed attempt
left and never adds to what was published.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import Ledger, file_stamps, home_of

#: Every so many batches the kept content is written whole, so that no run reads more than so many folders.
COMPACT = 16

#: Blanks that surround ids: every Unicode blank, not just U+0020.
_BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def clean_id(col: str) -> Column:
    """The id without surrounding blanks; null when nothing is left."""
    trimmed = F.regexp_replace(col, _BLANKS, "")
    return F.when(trimmed != "", trimmed)


def journal_log(journal: DataFrame, partitions: int = 64) -> DataFrame:
    """The journal as a log: clean sample_id, lower-case fingerprint, updated_at, seq and its log partition.

    Rows without id, fingerprint or seq are ignored. Extra columns are dropped.
    """
    rows = journal.select(clean_id("sample_id").alias("sample_id"), F.lower(clean_id("fingerprint")).alias("fingerprint"), "updated_at", "seq")
    rows = rows.where("sample_id is not null and fingerprint is not null and seq is not null")
    part = F.expr(f"cast(pmod(xxhash64(sample_id), {partitions}) as int)")
    return rows.withColumn("part", part.alias("part", metadata={"partitions": partitions}))


def current_content(log: DataFrame, *also: str) -> DataFrame:
    """One row a key: the content with the largest updated_at, then seq (a null updated_at is the smallest).

    A plain aggregate, so a key with a third of all rows is reduced before the shuffle. ``also`` names columns to keep
    that the key determines.
    """
    best = F.max(F.struct("updated_at", "seq", "fingerprint"))
    return log.groupBy("sample_id", *also).agg(best.alias("best")).select("sample_id", *also, "best.fingerprint", F.col("best.seq").alias("seq"))


def committed_content(processed_log: DataFrame, run_log: DataFrame) -> DataFrame:
    """(sample_id, fingerprints) written by the latest succeeded run of each key; failed runs count for nothing."""
    runs = F.broadcast(run_log.where("lower(trim(status)) = 'succeeded' and run_id is not null").select("run_id").distinct())
    rows = processed_log.join(runs, "run_id", "left_semi").select("run_id", clean_id("sample_id").alias("sample_id"), F.lower(clean_id("fingerprint")).alias("fingerprint"))
    rows = rows.where("sample_id is not null").groupBy("sample_id", "run_id").agg(F.collect_set("fingerprint").alias("fingerprints"))
    return rows.groupBy("sample_id").agg(F.max(F.struct("run_id", "fingerprints")).alias("last")).select("sample_id", "last.fingerprints")


class ChangeCapture(Ledger):
    """Exactly-once batches of changed records, with state under ``home`` in the shared folder."""

    def __init__(self, spark: SparkSession, home: str | None = None) -> None:
        super().__init__(spark, home, "capture")

    def plan(self, log: DataFrame, files: dict[str, str] | None = None) -> dict | None:
        """The batch to run: the one planned and not published, if any, else a new one up to the log's end now, or None if
        the log has nothing new. ``files`` are noted with the plan."""
        planned, published = self.last("plans"), self.last("published")
        if planned > published:
            return self.read(f"plans/{planned}.json")
        begin = self.read(f"plans/{published}.json")["end"] if published >= 0 else {}
        ends = self._after(log, begin).groupBy("part").agg(F.max("seq").alias("end")).collect()  # one row a log partition
        end = begin | {str(r["part"]): max(r["end"], begin.get(str(r["part"]), r["end"])) for r in ends}
        if end == begin and published >= 0:
            return None
        plan = {"batch": planned + 1, "begin": begin, "end": end, "files": files or {}}
        self.write(f"plans/{planned + 1}.json", plan)
        return plan

    @staticmethod
    def _after(log: DataFrame, begin: dict[str, int]) -> DataFrame:
        """Rows that can be new, by a bound that reaches the scan: the least offset read so far, if all partitions have one."""
        parts = log.schema["part"].metadata.get("partitions", 0)
        return log.where(F.col("seq") > min(begin.values())) if begin and len(begin) >= parts > 0 else log

    def slice(self, log: DataFrame, plan: dict) -> DataFrame:
        """The log rows of a planned range: offsets after ``begin`` up to ``end``, per partition."""
        if not plan["end"]:
            return log.where("false")
        edges = [(int(p), plan["begin"].get(p, -(2**63)), e) for p, e in plan["end"].items()]
        ranges = self.spark.createDataFrame(edges, "part int, lo long, hi long")
        able = self._after(log, plan["begin"]).where(F.col("seq") <= max(plan["end"].values()))
        return able.join(F.broadcast(ranges), "part").where("seq > lo and seq <= hi").drop("lo", "hi")

    def content(self) -> DataFrame | None:
        """(sample_id, updated_at, seq, fingerprint): what is known of each key up to the last published batch."""
        last = self.last("published")
        if last < 0:
            return None
        rows = self.spark.read.parquet(*(f"{self.home}/content/{b}" for b in range(last - last % COMPACT, last + 1)))
        if last % COMPACT == 0:
            return rows
        return rows.groupBy("sample_id").agg(F.max(F.struct("updated_at", "seq", "fingerprint")).alias("x")).select("sample_id", "x.*")

    def _newer(self, log: DataFrame, plan: dict) -> DataFrame:
        """The keys whose content the slice changes, with that content."""
        best = self.slice(log, plan).groupBy("sample_id").agg(F.max(F.struct("updated_at", "seq", "fingerprint")).alias("x"))
        kept = self.content()
        if kept is not None:
            before = kept.select("sample_id", F.struct("updated_at", "seq", "fingerprint").alias("old"))
            best = best.join(before, "sample_id", "left").where("old is null or x > old")
        return best.select("sample_id", "x.*")

    def absorb(self, log: DataFrame, files: dict[str, str] | None = None) -> dict | None:
        """Take the next range of the log into the kept content without publishing yet; returns its plan."""
        plan = self.plan(log, files)
        if plan is not None and self.last("published") < plan["batch"]:
            newer = self._newer(log, plan)
            newer.write.mode("overwrite").parquet(f"{self.home}/newer/{plan['batch']}")
            newer = self.spark.read.parquet(f"{self.home}/newer/{plan['batch']}")
            kept = self.content()
            if kept is not None and plan["batch"] % COMPACT == 0:
                newer = newer.unionByName(kept.join(newer.select("sample_id"), "sample_id", "left_anti"))
                newer.write.mode("overwrite").parquet(f"{self.home}/content/{plan['batch']}")
            else:
                fs, target = self._path(f"content/{plan['batch']}")
                fs.delete(target, True)
                fs.mkdirs(target.getParent())
                fs.rename(self._path(f"newer/{plan['batch']}")[1], target)
        return plan

    def run(self, log: DataFrame, committed: DataFrame) -> DataFrame:
        """Run one batch and return its published rows (sample_id, fingerprint, seq).

        A key's content is judged over the log up to the batch's end, and is of this batch if its offset is: a late row,
        older than what an earlier batch read, changes nothing.
        """
        plan = self.absorb(log)
        if plan is None:
            return self.spark.createDataFrame([], "sample_id string, fingerprint string, seq long")
        moved = self._path(f"newer/{plan['batch']}")
        newer = self.spark.read.parquet(f"{self.home}/{'newer' if moved[0].exists(moved[1]) else 'content'}/{plan['batch']}")
        return self.publish(pending(newer, committed).select("sample_id", "fingerprint", "seq"), plan)

    def publish(self, rows: DataFrame, plan: dict) -> DataFrame:
        """Write a batch once: rows deduplicated by key and offset, the folder replaced on replay, then the marker."""
        folder = f"{self.home}/batches/{plan['batch']}"
        if self.last("published") < plan["batch"]:
            rows.dropDuplicates(["sample_id", "seq"]).write.mode("overwrite").parquet(folder)
            self.write(f"published/{plan['batch']}.json", {"batch": plan["batch"]})
        return self.spark.read.parquet(folder)

    def published(self) -> DataFrame:
        """All published rows, the latest one of a key only: content is published in its order, so the last batch has it."""
        last = self.last("published")
        rows = [self.spark.read.parquet(f"{self.home}/batches/{b}").withColumn("batch", F.lit(b)) for b in range(last + 1)]
        whole = rows[0]
        for more in rows[1:]:
            whole = whole.unionByName(more)
        return whole.groupBy("sample_id").agg(F.max(F.struct("batch", "seq", "fingerprint")).alias("x")).select("sample_id", "x.fingerprint", "x.seq")


def pending(content: DataFrame, committed: DataFrame) -> DataFrame:
    """The rows of ``content`` that no succeeded run has written in this form."""
    known = content.join(committed, "sample_id", "left").where("fingerprints is null or not array_contains(fingerprints, fingerprint)")
    return known.drop("fingerprints")


def changes_to_process(spark: SparkSession, journal: DataFrame, processed_log: DataFrame, run_log: DataFrame) -> DataFrame:
    """p6_found: (sample_id, fingerprint) of the records the next run has to process.

    The content of the journal is kept in the shared folder by the journal's folder, and a later call takes in only what
    the journal has gained. If a file that was read is gone or was changed, the journal is read anew.
    """
    files, home = file_stamps(journal), home_of(journal, "capture")
    capture = ChangeCapture(spark, home)
    if home:
        while (last := capture.last("plans")) >= 0 and not capture.read(f"plans/{last}.json")["files"].items() <= files.items():
            capture = ChangeCapture(spark, f"{capture.home}-again")
    log, committed = journal_log(journal), committed_content(processed_log, run_log)
    plan = capture.absorb(log, files)
    if plan is not None:
        capture.write(f"published/{plan['batch']}.json", {"batch": plan["batch"]})
    return pending(capture.content(), committed).select("sample_id", "fingerprint")
