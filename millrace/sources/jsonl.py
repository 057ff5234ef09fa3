"""JSON Lines, JSON arrays and maps in; sorted-key JSON Lines, partitioned dumps and CSV reports out."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from millrace.operators.joins import duplicates


def scan_lines(spark: SparkSession, path: str, schema: StructType, strict: bool = True) -> DataFrame:
    """line_no, raw, the schema's columns and ``error`` of each non-blank line of JSON objects.

    A line that is not one JSON object has an error, or raises with ``strict`` once it is used. Line numbers count blank
    lines and are exact for a single file (one split); over several files they order rows within each file.
    """
    lines = spark.read.text(path).withColumn("line_no", F.monotonically_increasing_id() + 1)
    return parse_lines(lines.select("line_no", F.col("value").alias("raw")), schema, strict)


def parse_lines(lines: DataFrame, schema: StructType, strict: bool = False) -> DataFrame:
    """As :func:`scan_lines` for (line_no, raw) that is already a table."""
    body = F.trim("raw")
    kept = lines.where(F.coalesce(F.regexp_replace("raw", r"[\s\p{Z}]+", "") != "", F.lit(False)))
    parsed = F.from_json(body, schema, {"mode": "PERMISSIVE"})
    is_object = F.coalesce(body.startswith("{") & body.endswith("}") & F.expr("try_parse_json(raw) is not null"), F.lit(False))
    error = F.when(~is_object, "line is not a JSON object")
    out = kept.withColumn("_p", parsed).withColumn("error", error)
    if strict:
        out = out.withColumn("_p", F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("line "), F.col("line_no"), F.lit(": "), F.col("error"))).cast(schema)).otherwise(F.col("_p")))
    return out.select("line_no", "raw", "_p.*", "error")


def scan_array(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of files that hold one JSON array of objects each."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def scan_map(spark: SparkSession, path: str, value: DataType) -> DataFrame:
    """(key, value) of files that hold one JSON object used as a map."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", MapType(StringType(), value))).alias("key", "value"))


def scan_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Union by name of parquet, json and jsonl files or folders, told apart by extension."""
    parts = []
    for path in paths:
        kind = path.rsplit(".", 1)[-1].lower()
        if kind == "parquet":
            parts.append(spark.read.parquet(path))
        elif kind in ("jsonl", "ndjson"):
            parts.append(spark.read.json(path))
        elif kind == "json":
            parts.append(spark.read.option("multiLine", True).json(path))
        else:
            raise ValueError(f"unknown file kind {path}")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def keyed(rows: DataFrame, key: str) -> DataFrame:
    """rows, after a check (one small job) that no key is null and none has two rows."""
    bad = duplicates(rows, key).limit(1).collect()
    if bad or not rows.where(F.col(key).isNull()).limit(1).isEmpty():
        raise ValueError(f"{key} must be present and unique")
    return rows


def nested_value(column: str, keys: list[str]) -> Column:
    """Index a nested column by a list of keys; arrays of one element are unwrapped on the way."""
    out = F.col(column)
    for key in keys:
        out = out.getField(key)
    return out


def unwrap(column: Column, kind: DataType) -> Column:
    """The element of an array of one, and anything else as it is."""
    return F.when(F.size(column) == 1, column[0]) if isinstance(kind, ArrayType) else column


def sorted_json(rows: DataFrame, columns: list[str] | None = None) -> Column:
    """One JSON object a row with its keys in order; nulls are kept."""
    names = sorted(columns or rows.columns)
    return F.to_json(F.struct(*names), {"ignoreNullFields": "false"})


def write_lines(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    rows.select(sorted_json(rows).alias("value")).write.mode(mode).text(path)


def overwrite_whole(rows: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Replace a folder so that readers see the old or the new one: written beside it first, then renamed."""
    spark = rows.sparkSession
    staged = f"{path}.{uuid.uuid4().hex}"
    rows.write.format(fmt).save(staged)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    target = hadoop(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    old = hadoop(f"{path}.{uuid.uuid4().hex}.old")
    had = fs.exists(target)
    if had:
        fs.rename(target, old)
    if not fs.rename(hadoop(staged), target):
        if had:
            fs.rename(old, target)
        raise RuntimeError(f"cannot replace {path}")
    if had:
        fs.delete(old, True)


def dump_generations(rows: DataFrame, path: str) -> None:
    """input, output, gts, score and extras as JSON Lines, a folder a step."""
    rows.write.mode("append").partitionBy("step").json(path)


def log_metrics(rows: DataFrame, path: str, step: str = "step") -> None:
    """Append {"data": {...}, "step": n} a row: all other columns are the data, nulls left out."""
    data = F.struct(*(c for c in rows.columns if c != step))
    rows.select(F.to_json(F.struct(data.alias("data"), F.col(step).alias("step"))).alias("value")).write.mode("append").text(path)


def reuse_or_dump(spark: SparkSession, path: str, step: int, make: Callable[[], DataFrame]) -> DataFrame:
    """The rows of a step: those dumped before, if they are complete, else ``make()``, dumped whole or not at all."""
    folder = f"{path}/step={step}"
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        make().write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def write_report(rows: DataFrame, path: str) -> None:
    """A CSV report with a header; reports are a row a dataset and small, so they are one file."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def flatten_params(schema: StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(name with '/', column path) of every leaf of a nested schema; array elements are left whole."""
    out = []
    for field in schema.fields:
        name, path = f"{prefix}{field.name}", f"{prefix.replace('/', '.')}{field.name}"
        out += flatten_params(field.dataType, f"{name}/") if isinstance(field.dataType, StructType) else [(name, path)]
    return out
