"""Every dealt query on tables that are empty, full of nulls, repeated, tied, long, or that carry extra columns."""

import pytest
from pyspark.sql import functions as F

from millrace.llm.queries import QUERIES
from millrace.session import table

DIR = "/root/testdata/sf0.001"
TABLES = ("samples", "candidates", "normalizations", "predictions", "documents", "labels", "split_targets", "mix_targets")
#: Names the operators use inside.
CLASHING = ("key", "cls", "form", "words", "n", "a", "b", "train", "id", "x", "y", "node", "component", "post", "tags", "ids", "at", "copies", "score", "_n", "_i", "_blk", "variant", "band", "field")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("edges")
    for name in TABLES:
        rows = table(spark, DIR, name)
        rows.limit(0).write.parquet(f"{home}/empty/{name}.parquet")
        few = rows.limit(60)
        nulls = spark.createDataFrame([tuple([None] * len(rows.columns))] * 3, rows.schema) if name not in ("split_targets", "mix_targets") else few.limit(0)
        odd = few.unionByName(few.limit(10)).unionByName(nulls)
        if "text" in rows.columns:
            key = "line_no" if name == "samples" else "doc_id"
            odd = odd.unionByName(few.limit(4).withColumn(key, F.col(key) + 900_000).withColumn("text", F.when(F.col(key) % 2 == 0, "").otherwise(F.repeat(F.lit("long text, "), 20_000))))
        odd = odd.withColumns({c: F.lit("clash") for c in CLASHING if c not in rows.columns})
        odd.write.parquet(f"{home}/odd/{name}.parquet")
        if name in ("split_targets", "mix_targets"):
            rows.write.parquet(f"{home}/nulls/{name}.parquet")
        else:
            nulls.write.parquet(f"{home}/nulls/{name}.parquet")
    return str(home)


@pytest.mark.parametrize("kind", ["empty", "nulls", "odd"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_defined_result(spark, folders, name, kind):
    if kind == "empty" and name == "p3_splits":
        with pytest.raises(ValueError, match="split_targets"):
            QUERIES[name](spark, f"{folders}/{kind}")
        return
    rows = QUERIES[name](spark, f"{folders}/{kind}").collect()
    if kind != "odd" and name.endswith("_found") and name != "p7_found":
        assert not rows
    if kind == "nulls" and name == "p7_found":
        assert {r.defect for r in rows} == {"empty"}
    if name == "p8_ids":
        assert all(r.ids is not None for r in rows) and len(rows) == table(spark, f"{folders}/{kind}", "documents").count()
