"""Change-capture queries over sample_journal, processed_log and run_log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.capture import changes_to_process
from millrace.session import table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return changes_to_process(spark, table(spark, d, "sample_journal"), table(spark, d, "processed_log"), table(spark, d, "run_log"))


_CLEAN = r"nullif(regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), '')"
QUERIES = {"p6_found": p6_found}
SQL = {
    "p6_found": f"""
WITH log AS (
  SELECT {_CLEAN.format("sample_id")} AS sample_id, lower({_CLEAN.format("fingerprint")}) AS fingerprint, updated_at, seq FROM sample_journal
), current AS (
  SELECT sample_id, fingerprint FROM log WHERE sample_id IS NOT NULL AND fingerprint IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY updated_at DESC NULLS LAST, seq DESC) = 1
), done AS (
  SELECT {_CLEAN.format("p.sample_id")} AS sample_id, lower({_CLEAN.format("p.fingerprint")}) AS fingerprint, p.run_id
  FROM processed_log p JOIN run_log r ON p.run_id = r.run_id WHERE lower(trim(r.status)) = 'succeeded'
), latest AS (
  SELECT sample_id, fingerprint FROM done WHERE sample_id IS NOT NULL
  QUALIFY rank() OVER (PARTITION BY sample_id ORDER BY run_id DESC) = 1
)
SELECT c.sample_id, c.fingerprint FROM current c
WHERE NOT EXISTS (SELECT 1 FROM latest l WHERE l.sample_id = c.sample_id AND l.fingerprint = c.fingerprint)
""",
}
