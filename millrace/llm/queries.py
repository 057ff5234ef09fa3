"""Queries over the corpus tables, and their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.session import table

from . import abuse, canon, language, mixing, neardup, overlap, pairdefects, splits, tokenise


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return canon.look_alike_pairs(table(spark, d, "samples"))


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    return canon.canonical_report(table(spark, d, "samples"))


def _pool_texts(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pool_texts(table(spark, d, "candidates"), table(spark, d, "normalizations"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(_pool_texts(spark, d))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_groups(_pool_texts(spark, d))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.family_rows(table(spark, d, "candidates"))


def p3_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.split_candidates(spark, table(spark, d, "candidates"), table(spark, d, "split_targets"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlaps(table(spark, d, "samples"))


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "samples"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_or_mixed(table(spark, d, "samples"))


def p5_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.language_report(table(spark, d, "samples"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return pairdefects.defective(table(spark, d, "predictions"), table(spark, d, "samples"))


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return pairdefects.defect_report(table(spark, d, "predictions"), table(spark, d, "samples"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenise.encode_documents(table(spark, d, "documents"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.mix(mixing.sized_documents(table(spark, d, "documents"), targets), targets)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.mix_shares(mixing.sized_documents(table(spark, d, "documents"), targets), targets)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abusive(table(spark, d, "documents"), table(spark, d, "labels"))


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return abuse.scored(table(spark, d, "documents"), table(spark, d, "labels"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abuse_rates(table(spark, d, "documents"), table(spark, d, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_canonical": p1_canonical,
    "p2_found": p2_found,
    "p2_groups": p2_groups,
    "p3_found": p3_found,
    "p3_splits": p3_splits,
    "p4_found": p4_found,
    "p4_report": p4_report,
    "p5_found": p5_found,
    "p5_segments": p5_segments,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p8_ids": p8_ids,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_scores": p10_scores,
    "p10_rates": p10_rates,
}

# The pairwise definitions as they stand: quadratic, for the small tables the SQL check runs on.
_WORDS = r"list_sort(list_distinct(regexp_extract_all(regexp_replace(lower({}), '(\p{{Han}})', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')))"
_BLANKS = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
_FAMILIES = f"""n AS (SELECT DISTINCT sample_id, nullif(lower({_BLANKS.format("split_part(sample_id, '::item-', 1)")}), '') AS own, nullif(lower({_BLANKS.format("source_sample_id")}), '') AS given FROM candidates WHERE sample_id IS NOT NULL
), e AS (SELECT own AS x, given AS y FROM n WHERE own <> given UNION SELECT given, own FROM n WHERE own <> given), v AS (SELECT own AS x FROM n WHERE own IS NOT NULL UNION SELECT given FROM n WHERE given IS NOT NULL
), r AS (SELECT x, x AS c FROM v UNION SELECT e.y, r.c FROM r JOIN e ON e.x = r.x), f AS (SELECT x, min(c) AS c FROM r GROUP BY x
), m AS (SELECT DISTINCT sample_id, c FROM n JOIN f ON f.x = coalesce(own, given))"""
SQL: dict[str, str] = {
    "p2_found": f"""WITH t AS (SELECT 'experience' AS field, sample_id AS id, experience AS text FROM candidates UNION SELECT 'mechanism', sample_id, normalization.mechanism FROM normalizations UNION SELECT 'exclusion_boundary', sample_id, normalization.exclusion_boundary FROM normalizations
    ), w AS (SELECT DISTINCT field, id, {_WORDS.format("text")} AS w FROM t WHERE id IS NOT NULL AND text IS NOT NULL), u AS (SELECT * FROM w WHERE len(w) > 0
    ), k AS (SELECT DISTINCT field, w, len(w) AS n FROM u), p AS (SELECT a.field, a.w AS x, b.w AS y, len(list_intersect(a.w, b.w)) AS shared, a.n + b.n AS total FROM k a JOIN k b ON a.field = b.field AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
    ), near AS (SELECT field, x, y FROM p WHERE shared > 0 AND 5 * shared >= 4 * (total - shared))
    SELECT DISTINCT a.field, a.id AS id_a, b.id AS id_b FROM near JOIN u a ON a.field = near.field AND a.w = x JOIN u b ON b.field = near.field AND b.w = y WHERE a.id < b.id""",
    "p3_found": f"""WITH RECURSIVE {_FAMILIES}, l AS (SELECT c, min(sample_id) AS lead_id FROM m GROUP BY c)
    SELECT DISTINCT lead_id, sample_id FROM m JOIN l ON l.c = m.c WHERE sample_id <> lead_id""",
}
