"""Session helpers shared by every operator: tables, lineage cuts, spreading and size-checked broadcasts."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir`` (a file or a directory of part files)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as ``spark.checkpoint.dir`` names it.

    Only where that is unset (tests, local mode) is a folder of our own made.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + os.path.join(tempfile.gettempdir(), f"millrace-{uuid.uuid4().hex}")
    spark.sparkContext.setCheckpointDir(own)
    return own


def scratch(spark: SparkSession, shared: bool = False) -> str:
    """A folder in the shared folder for what operators write: this application's own, or one that outlives it."""
    return f"{shared_dir(spark)}/millrace{'' if shared else '-' + spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove this application's own folder and the state kept about files; no frame that reads from it may be used
    afterwards."""
    for folder in (scratch(spark), scratch(spark, shared=True)):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder and cut its lineage; survives lost executors."""
    spark = df.sparkSession
    context = spark.sparkContext._jsc.sc()
    if not context.getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """Give a small input as many partitions as there are cores before CPU-heavy Python work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def small_side(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else unchanged (a shuffle join then)."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once a context, so Python workers find it wherever they run."""
    context = spark.sparkContext
    if not getattr(context, "_millrace_shipped", False):
        package = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
            for folder, _, names in os.walk(package):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.join("millrace", os.path.relpath(full, package)))
        context.addPyFile(path)
        context._millrace_shipped = True
    return spark
