"""Corpus, batch, sampling, artifact and parsing queries over the domain tables, with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import parsing, records
from millrace.operators import batches, joins, ordering
from millrace.session import scratch, table
from millrace.sources import artifacts, jsonl

from .common import Book, rounded
from .evaluation import label_a

BOOK = Book()
_STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def strip_sql(x: str) -> str:
    return _STRIP.format(x)


def or_null_sql(x: str) -> str:
    return f"nullif({strip_sql(x)}, '')"


def _samples(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "samples")


# --- records -------------------------------------------------------------------------------------------------------
BOOK.add(
    "row9_normalised_records",
    lambda s, d: records.normalised(_samples(s, d)).select("sample_id", "image_path", "text", "label", "source", "language", F.col("reference_reasoning.explanation").alias("explanation"), "error"),
    f"""WITH n AS (SELECT {or_null_sql("sample_id")} AS sample_id, {or_null_sql("image_path")} AS image_path, text, {label_a("label")} AS label,
      {or_null_sql("source")} AS source, {or_null_sql("language")} AS language, reference_reasoning.explanation AS explanation FROM samples)
    SELECT *, CASE WHEN {or_null_sql("text")} IS NULL THEN 'text is empty' WHEN label IS NULL THEN 'label is unknown' WHEN image_path IS NULL THEN 'image path is empty' END AS error FROM n""",
)
BOOK.add(
    "row13_reasoning_errors",
    lambda s, d: table(s, d, "predictions").select("prediction_no", F.coalesce(records.reasoning_error("analysis", records.label_rule_a("gold_label")), F.lit("none")).alias("error")),
    "SELECT prediction_no, CASE WHEN analysis IS NULL THEN 'no reasoning' "
    + "".join(f"WHEN analysis.{f} IS NULL OR {strip_sql(f'analysis.{f}')} = '' THEN '{f} must be a non-empty string' " for f in records.FIELDS)
    + "WHEN NOT coalesce(analysis.label IN ('sarcastic', 'non-sarcastic'), false) THEN 'label must be sarcastic or non-sarcastic' "
    + "".join(
        f"WHEN NOT (length(regexp_replace(analysis.{f}, '[^A-Za-z]', '', 'g')) > 0 AND length(regexp_replace(analysis.{f}, '[^A-Za-z]', '', 'g')) >= length(regexp_replace(analysis.{f}, '[\\x00-\\x7F]|[^\\p{{L}}]', '', 'g'))) THEN '{f} must be in English' "
        for f in records.FIELDS[:3]
    )
    + f"WHEN analysis.label <> {label_a('gold_label')} THEN 'label differs from the sample''s' ELSE 'none' END AS error FROM predictions",
)
BOOK.add(
    "f18_fingerprints",
    lambda s, d: _samples(s, d).select("line_no", records.fingerprint(F.col("sample_id"), F.col("text"), F.col("label")).alias("fp")),
    "SELECT line_no, sha256(concat_ws(chr(31), coalesce(sample_id, chr(0)), coalesce(text, chr(0)), coalesce(label, chr(0)))) AS fp FROM samples",
)
BOOK.add(
    "f10_trainer_records",
    lambda s, d: records.trainer_record(_samples(s, d), "Decide whether the post is sarcastic.").select("data_source", F.col("prompt")[1]["content"].alias("content"), "ability", F.col("reward_model.ground_truth").alias("truth"), F.col("extra_info.sample_id").alias("sample_id")),
    "SELECT coalesce(source, 'unknown') AS data_source, '<image>' || text AS content, 'sarcasm' AS ability, label AS truth, sample_id FROM samples",
)
BOOK.add(
    "f8_source_keys",
    lambda s, d: table(s, d, "documents").select("doc_id", records.source_key("source").alias("key")),
    f"SELECT doc_id, regexp_replace(regexp_replace(lower({strip_sql('source')}), '[\\s\\-]+', '_', 'g'), '_+', '_', 'g') AS key FROM documents",
)
# --- parsing -------------------------------------------------------------------------------------------------------
BOOK.add(
    "f1_after_think",
    lambda s, d: table(s, d, "predictions").select("prediction_no", parsing.after_think("raw_output").alias("body")),
    f"SELECT prediction_no, CASE WHEN NOT (contains(raw_output, '<think>') AND NOT contains(raw_output, '</think>')) THEN {strip_sql('list_last(string_split(raw_output, ' + chr(39) + '</think>' + chr(39) + '))')} END AS body FROM predictions",
)
BOOK.add(
    "f2_output_errors",
    lambda s, d: table(s, d, "predictions").select("prediction_no", F.coalesce(parsing.output_error("raw_output"), F.lit("none")).alias("error")),
    f"""WITH b AS (SELECT prediction_no, raw_output, CASE WHEN NOT (contains(raw_output, '<think>') AND NOT contains(raw_output, '</think>')) THEN {strip_sql("list_last(string_split(raw_output, '</think>'))")} END AS body FROM predictions)
    SELECT prediction_no, CASE WHEN raw_output IS NULL OR {strip_sql("raw_output")} = '' THEN 'model output is empty' WHEN body IS NULL THEN 'unterminated thinking block' WHEN body = '' THEN 'model output is empty'
      WHEN contains(body, '```') THEN 'model output must not contain Markdown fences' WHEN NOT (starts_with(body, '{{') AND ends_with(body, '}}')) OR NOT json_valid(body) THEN 'model output is not a single JSON object' ELSE 'none' END AS error FROM b""",
)
BOOK.add(
    "f3_parsed_reasoning",
    lambda s, d: table(s, d, "predictions").select("prediction_no", parsing.parsed_reasoning("raw_output").alias("r")).select("prediction_no", F.col("r.label").alias("label"), F.col("r.explanation").alias("explanation")),
    f"""WITH b AS (SELECT prediction_no, raw_output, CASE WHEN NOT (contains(raw_output, '<think>') AND NOT contains(raw_output, '</think>')) THEN {strip_sql("list_last(string_split(raw_output, '</think>'))")} END AS body FROM predictions
    ), ok AS (SELECT prediction_no, CASE WHEN starts_with(body, '{{') AND ends_with(body, '}}') AND NOT contains(body, '```') AND json_valid(body) THEN body END AS body FROM b)
    SELECT prediction_no, json_extract_string(body, '$.label') AS label, json_extract_string(body, '$.explanation') AS explanation FROM ok""",
)
BOOK.add("f6_sentences", lambda s, d: table(s, d, "candidates").select("sample_id", "written_at", F.posexplode(parsing.sentences(F.col("experience"))).alias("n", "sentence")))
BOOK.add("f5_experience_errors", lambda s, d: table(s, d, "candidates").groupBy(F.coalesce(parsing.experience_error(F.col("experience")), F.lit("none")).alias("error")).agg(F.count(F.lit(1)).alias("n")))
BOOK.add("f7_repaired_sentences", lambda s, d: table(s, d, "candidates").select("sample_id", "written_at", parsing.repaired_sentences(F.col("experience")).alias("experience")))
BOOK.add(
    "f10_rule_errors",
    lambda s, d: table(s, d, "normalizations").select("sample_id", "saved_at", F.coalesce(parsing.rule_error(F.col("normalization.mechanism"), 30, "Classify as sarcastic when"), F.lit("none")).alias("error")),
    f"""WITH n AS (SELECT sample_id, saved_at, normalization.mechanism AS t, {strip_sql("normalization.mechanism")} AS b FROM normalizations)
    SELECT sample_id, saved_at, CASE WHEN t IS NULL OR b = '' THEN 'text is empty' WHEN NOT starts_with(b, 'Classify as sarcastic when') THEN 'required prefix is missing' WHEN len(regexp_split_to_array(b, '\\s+')) > 30 THEN 'too many words'
      WHEN regexp_matches(b, '[A-Za-z]{{31,}}') THEN 'a token is too long' ELSE 'none' END AS error FROM n""".replace("{{31,}}", "{31,}"),
)
BOOK.add(
    "f12_normalization_errors",
    lambda s, d: table(s, d, "normalizations").select("sample_id", "saved_at", "normalization").join(joins.first_row(table(s, d, "candidates"), ["sample_id"], ["written_at", "source_item_index"], ["gold_label"]), "sample_id").select(
        "sample_id", "saved_at", F.coalesce(parsing.normalization_error(F.col("normalization.valid"), F.col("gold_label"), F.col("normalization.mechanism"), F.col("normalization.exclusion_boundary")), F.lit("none")).alias("error")),
    """WITH c AS (SELECT sample_id, gold_label FROM candidates QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY written_at, source_item_index) = 1)
    SELECT n.sample_id, saved_at, CASE WHEN normalization.valid IS NULL THEN 'valid is missing' WHEN NOT normalization.valid AND (normalization.mechanism IS NOT NULL OR normalization.exclusion_boundary IS NOT NULL) THEN 'an invalid normalization carries text'
      WHEN normalization.valid AND gold_label = 'sarcastic' AND normalization.mechanism IS NULL THEN 'mechanism is missing' WHEN normalization.valid AND gold_label = 'non-sarcastic' AND normalization.mechanism IS NOT NULL THEN 'mechanism is not expected'
      WHEN normalization.valid AND normalization.exclusion_boundary IS NULL THEN 'boundary is missing' ELSE 'none' END AS error FROM normalizations n JOIN c ON n.sample_id = c.sample_id""",
)
BOOK.add("f14_folded", lambda s, d: table(s, d, "documents").select("doc_id", parsing.folded("text").alias("text")))
BOOK.add(
    "f16_word_budgets",
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", parsing.word_budget(F.lit(40), F.col("l_quantity"), F.col("l_linenumber").cast("double")).alias("words")),
    "SELECT l_orderkey, l_linenumber, l_partkey, greatest(5, least(round_even(40 * l_quantity / (l_quantity + l_linenumber), 0)::INT, 35)) AS words FROM lineitem",
)
# --- sources and artifacts -----------------------------------------------------------------------------------------


def _journal(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(s, d, "sample_journal").where("sample_id is not null").select("sample_id", "seq", "fingerprint")
    half = rows.agg((F.max("seq") / 2).cast("long").alias("h")).first()["h"]
    return rows.where(F.col("seq") <= half), rows.where(F.col("seq") > half)


def s19_upsert(s: SparkSession, d: str) -> DataFrame:
    base, new = _journal(s, d)
    out = artifacts.upsert(base.select("sample_id", F.col("seq").alias("place"), "fingerprint"), new.select("sample_id", F.col("seq").alias("at"), "fingerprint"), "sample_id", "place", "at")
    return out.select("sample_id", "place", "fingerprint")


_HALF = "h AS (SELECT floor(max(seq) / 2)::BIGINT AS h FROM sample_journal WHERE sample_id IS NOT NULL)"
BOOK.add(
    "s19_upsert",
    s19_upsert,
    f"""WITH {_HALF}, b AS (SELECT sample_id, min(seq) AS place, arg_min(struct_pack(f := fingerprint), seq).f AS fp FROM sample_journal, h WHERE sample_id IS NOT NULL AND seq <= h GROUP BY 1
    ), i AS (SELECT sample_id, min(seq) AS at0, arg_max(struct_pack(f := fingerprint), seq).f AS fp FROM sample_journal, h WHERE sample_id IS NOT NULL AND seq > h GROUP BY 1)
    SELECT coalesce(b.sample_id, i.sample_id) AS sample_id, coalesce(place, (SELECT max(seq) FROM sample_journal, h WHERE sample_id IS NOT NULL AND seq <= h) + 1 + at0) AS place, CASE WHEN i.sample_id IS NOT NULL THEN i.fp ELSE b.fp END AS fingerprint
    FROM b FULL JOIN i ON b.sample_id = i.sample_id""",
)


def s20_replay(s: SparkSession, d: str) -> DataFrame:
    base, new = _journal(s, d)
    first = joins.first_row(base, ["sample_id"], ["seq"], ["fingerprint"])
    return artifacts.replay(first, new, "sample_id", "seq")


BOOK.add(
    "s20_journal_replay",
    s20_replay,
    f"""WITH {_HALF}, b AS (SELECT sample_id, arg_min(struct_pack(f := fingerprint), seq).f AS fingerprint FROM sample_journal, h WHERE sample_id IS NOT NULL AND seq <= h GROUP BY 1
    ), i AS (SELECT sample_id, arg_max(struct_pack(f := fingerprint), seq).f AS fingerprint FROM sample_journal, h WHERE sample_id IS NOT NULL AND seq > h GROUP BY 1)
    SELECT * FROM b WHERE sample_id NOT IN (SELECT sample_id FROM i) UNION ALL SELECT * FROM i""",
)


def s1_jsonl_round_trip(s: SparkSession, d: str) -> DataFrame:
    """events.props written as JSON Lines with sorted keys and scanned back strictly."""
    home = f"{scratch(s)}/lines-{uuid.uuid4().hex}"
    rows = table(s, d, "events").select("event_id", "user_id", "event_type", "props")
    jsonl.write_lines(rows, home, "overwrite")
    schema = rows.schema
    return jsonl.scan_lines(s, home, schema).select("event_id", "user_id", "event_type", "props")


BOOK.add("s1_jsonl_round_trip", s1_jsonl_round_trip, "SELECT event_id, user_id, event_type, props FROM events")
BOOK.add(
    "s17_sorted_json",
    lambda s, d: table(s, d, "region").select("r_regionkey", jsonl.sorted_json(table(s, d, "region")).alias("line")),
    """SELECT r_regionkey, '{"r_name":' || to_json(r_name)::VARCHAR || ',"r_regionkey":' || r_regionkey || '}' AS line FROM region""",
)
BOOK.add(
    "s14_exploded_experiences",
    lambda s, d: artifacts.exploded_experiences(
        table(s, d, "candidates").where("source_sample_id is not null").groupBy(F.col("source_sample_id").alias("sample_id")).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("written_at", "experience"))), lambda x: F.struct(F.array(F.lit("m")).alias("target_models"), x["experience"].alias("content"))).alias("experiences"))
        .withColumns({"gold_label": F.lit("x"), "error": F.lit(None).cast("string")})).select("candidate_id", "sample_id", "content"),
    """SELECT printf('%s::item-%02d', source_sample_id, row_number() OVER (PARTITION BY source_sample_id ORDER BY written_at, experience) - 1) AS candidate_id, source_sample_id AS sample_id, experience AS content
    FROM candidates WHERE source_sample_id IS NOT NULL""",
)
BOOK.add(
    "cp1_first_valid_attempt",
    lambda s, d: artifacts.first_valid_attempt(table(s, d, "predictions").select("sample_id", "prediction_no", F.coalesce("json_valid", F.lit(False)).alias("valid")).where("sample_id is not null"), "sample_id", "prediction_no", "valid"),
    """SELECT sample_id, prediction_no, coalesce(json_valid, false) AS valid FROM predictions WHERE sample_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sample_id
    ORDER BY coalesce(json_valid, false) DESC, CASE WHEN coalesce(json_valid, false) THEN prediction_no ELSE -prediction_no END) = 1""",
)
BOOK.add(
    "s18_overwrite_whole",
    lambda s, d: _overwritten(s, table(s, d, "supplier")),
    "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier",
)


def _overwritten(s: SparkSession, rows: DataFrame) -> DataFrame:
    home = f"{scratch(s)}/whole-{uuid.uuid4().hex}"
    jsonl.overwrite_whole(rows.limit(0), home)
    jsonl.overwrite_whole(rows, home)
    return s.read.parquet(home)


# --- joins ---------------------------------------------------------------------------------------------------------
BOOK.add(
    "j2_split_exclusion",
    lambda s, d: joins.exclude(_samples(s, d).where("split = 'train'").select("line_no", "sample_id"), _samples(s, d).where("split = 'test'"), _samples(s, d).where("split = 'validation'"), key="sample_id").select("line_no", "sample_id"),
    "SELECT line_no, sample_id FROM samples a WHERE split = 'train' AND NOT EXISTS (SELECT 1 FROM samples b WHERE b.split <> 'train' AND b.sample_id = a.sample_id)",
)
BOOK.add(
    "j3_group_restriction",
    lambda s, d: joins.restrict(table(s, d, "candidates").select(F.col("source_sample_id").alias("sample_id"), "experience"), _samples(s, d).where("split = 'validation'"), "sample_id"),
    "SELECT source_sample_id AS sample_id, experience FROM candidates WHERE source_sample_id IN (SELECT sample_id FROM samples WHERE split = 'validation')",
)
BOOK.add(
    "j4_split_overlap",
    lambda s, d: joins.overlap(_samples(s, d).where("split = 'train'"), _samples(s, d).where("split = 'test'"), "sample_id"),
    "SELECT sample_id FROM samples WHERE split = 'train' INTERSECT SELECT sample_id FROM samples WHERE split = 'test'",
)
BOOK.add(
    "j1_lookup",
    lambda s, d: joins.lookup(table(s, d, "nation"), table(s, d, "region").withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select("n_nationkey", "n_name", "r_name"),
    "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey",
)
_LAST = ["fingerprint", "json_valid"]
BOOK.add(
    "j5_completion",
    lambda s, d: joins.completion(
        joins.first_row(_samples(s, d), ["sample_id"], ["line_no"], ["text"]).join(joins.first_row(table(s, d, "predictions"), ["sample_id"], ["prediction_no"], ["fingerprint"]), "sample_id", "left"),
        joins.latest_row(table(s, d, "predictions"), ["sample_id"], ["prediction_no"], _LAST), "sample_id").select("sample_id", "status"),
    """WITH s AS (SELECT DISTINCT sample_id FROM samples WHERE sample_id IS NOT NULL
    ), f AS (SELECT sample_id, fingerprint FROM predictions QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY prediction_no) = 1
    ), l AS (SELECT sample_id, fingerprint, coalesce(json_valid, false) AS ok FROM predictions QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY prediction_no DESC) = 1)
    SELECT s.sample_id, CASE WHEN l.sample_id IS NULL THEN 'absent' WHEN f.fingerprint IS DISTINCT FROM l.fingerprint THEN 'stale' WHEN ok THEN 'completed' ELSE 'invalid' END AS status
    FROM s LEFT JOIN f ON s.sample_id = f.sample_id LEFT JOIN l ON s.sample_id = l.sample_id""",
)
BOOK.add(
    "j6_triplets",
    lambda s, d: joins.triplets(*(table(s, d, "orders").where(F.col("o_orderkey") % m != 0).select("o_orderkey", (F.col("o_orderkey") % (m + 4) != 1).alias("valid")) for m in (97, 7, 5)), "o_orderkey").select("o_orderkey", "teacher_valid", "usable"),
    """WITH t AS (SELECT o_orderkey, o_orderkey % 101 <> 1 AS v FROM orders WHERE o_orderkey % 97 <> 0), s AS (SELECT o_orderkey, o_orderkey % 11 <> 1 AS v FROM orders WHERE o_orderkey % 7 <> 0), w AS (SELECT o_orderkey, o_orderkey % 9 <> 1 AS v FROM orders WHERE o_orderkey % 5 <> 0)
    SELECT t.o_orderkey, t.v AS teacher_valid, coalesce(t.v, false) AND coalesce(s.v, false) AND coalesce(w.v, false) AS usable
    FROM t LEFT JOIN s ON t.o_orderkey = s.o_orderkey LEFT JOIN w ON t.o_orderkey = w.o_orderkey""",
)
BOOK.add(
    "j10_final_to_session",
    lambda s, d: rounded(joins.final_to_session(table(s, d, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value", "final").select("user_id", "event_id", "final"), "final"),
    "SELECT user_id, event_id, R(first_value(value) OVER (PARTITION BY user_id ORDER BY event_id DESC)) AS final FROM events",
)


def _indexed(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").alias("row_idx"), "o_orderkey", "o_custkey")


_ORD = "o AS (SELECT o_orderkey AS row_idx, o_orderkey, o_custkey FROM orders)"
# --- order, sampling, batches --------------------------------------------------------------------------------------
BOOK.add(
    "o_row_index",
    lambda s, d: ordering.global_row_index(_samples(s, d).select("line_no", "collected_at"), ["collected_at", "line_no"]).select("line_no", F.col("row_idx").cast("long").alias("row_idx")),
    "SELECT line_no, row_number() OVER (ORDER BY collected_at, line_no) - 1 AS row_idx FROM samples",
)
BOOK.add("o5_seeded_sample", lambda s, d: ordering.seeded_sample(_samples(s, d).select("line_no", "source"), "line_no", 200), "SELECT line_no, source FROM samples ORDER BY md5('42:' || line_no), line_no LIMIT 200")
BOOK.add(
    "o4_stratified_sample",
    lambda s, d: ordering.stratified_sample(_samples(s, d).where("source is not null").select("line_no", "source", "split"), "line_no", ["source", "split"],
        _samples(s, d).where("source is not null").groupBy("source", "split").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / 4)).cast("int").alias("quota"))).select("line_no", "source", "split", "selection_index"),
    """WITH q AS (SELECT source, split, greatest(1, count(*) // 4) AS quota FROM samples WHERE source IS NOT NULL GROUP BY ALL), r AS (SELECT line_no, source, split, row_number() OVER (PARTITION BY source, split ORDER BY md5('42:' || line_no), line_no) AS selection_index
    FROM samples WHERE source IS NOT NULL) SELECT r.line_no, r.source, r.split, selection_index FROM r JOIN q ON r.source = q.source AND r.split = q.split WHERE selection_index <= quota""",
)
BOOK.add("o7_resample", lambda s, d: ordering.resample(table(s, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", F.col("o_totalprice") ** 2, 1000).select("draw", "o_orderkey"))
BOOK.add(
    "o6_pairwise_groups",
    lambda s, d: ordering.pairwise_groups(_samples(s, d).select("line_no", F.lower(records.strip("source")).alias("source")), "line_no", "source").select("group", "line_no", F.col("place").cast("long").alias("place")),
    f"""WITH r AS (SELECT line_no, lower({strip_sql("source")}) AS source, row_number() OVER (ORDER BY md5('42:' || line_no), line_no) - 1 AS place FROM samples
    ), g AS (SELECT * FROM (VALUES ('mmsd2_docmsu', 'mmsd2'), ('mmsd2_docmsu', 'docmsu'), ('mmsd2_sarcnet', 'mmsd2'), ('mmsd2_sarcnet', 'sarcnet'), ('docmsu_sarcnet', 'docmsu'), ('docmsu_sarcnet', 'sarcnet')) t("group", source))
    SELECT "group", line_no, place FROM r JOIN g ON r.source = g.source""",
)
BOOK.add(
    "o8_sampler_batches",
    lambda s, d: batches.sampler(_indexed(s, d), "row_idx", 256).groupBy("batch").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_orderkey").alias("total")),
    f"WITH {_ORD}, n AS (SELECT count(*) AS n FROM o) SELECT row_idx // 256 AS batch, count(*) AS rows, sum(o_orderkey)::BIGINT AS total FROM o, n WHERE row_idx < n - n % 256 GROUP BY 1",
)
BOOK.add(
    "o12_generation_sample",
    lambda s, d: batches.generation_sample(table(s, d, "predictions").where("raw_output is not null").select("prediction_no", F.concat("prediction_no", F.lit(":"), "raw_output").alias("input")), "input", 50).select("prediction_no"),
    "SELECT prediction_no FROM predictions WHERE raw_output IS NOT NULL ORDER BY md5('42:' || prediction_no || ':' || raw_output), prediction_no || ':' || raw_output LIMIT 50",
)
BOOK.add(
    "u8_fold_unfold",
    lambda s, d: batches.unfold(batches.fold(table(s, d, "lineitem").select(F.col("l_orderkey"), "l_linenumber", "l_partkey", "l_quantity").groupBy("l_partkey").agg(F.sum("l_quantity").alias("q")).select((F.col("l_partkey") - 1).alias("at"), "q").where("at < 160"), "at", 10, 16)).select("at", F.round("q", 4).alias("q")),
    "SELECT l_partkey - 1 AS at, round(sum(l_quantity), 4) AS q FROM lineitem WHERE l_partkey <= 160 GROUP BY 1",
)
BOOK.add(
    "u11_pad_by_edge",
    lambda s, d: batches.pad_rows(table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("at"), "n_name"), "at", 7, "last"),
    "SELECT n_nationkey::BIGINT AS at, n_name, false AS is_pad FROM nation UNION ALL SELECT n_nationkey + i, n_name, true FROM nation, range(1, 8) t(i) WHERE n_nationkey = (SELECT max(n_nationkey) FROM nation)",
)
BOOK.add(
    "a40_rows_to_lists",
    lambda s, d: batches.as_lists(table(s, d, "nation"), ["n_regionkey"], "n_nationkey", ["n_nationkey", "n_name"]),
    "SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS n_nationkey, list(n_name ORDER BY n_nationkey) AS n_name FROM nation GROUP BY 1",
)
BOOK.add(
    "t3_epochs",
    lambda s, d: batches.epochs(table(s, d, "supplier").select((F.col("s_suppkey") - 1).alias("row_idx")), "row_idx", 3).select("row_idx", "epoch", F.col("global_step").cast("long").alias("global_step")),
    "SELECT s_suppkey - 1 AS row_idx, e::INT AS epoch, e * (SELECT count(*) FROM supplier) + s_suppkey - 1 AS global_step FROM supplier, range(3) t(e)",
)
BOOK.add(
    "t10_version_metrics",
    lambda s, d: batches.version_metrics(table(s, d, "events").select(F.floor(F.col("event_id") / 500).alias("current"), (F.floor(F.col("event_id") / 500) - F.col("user_id") % 3).alias("made")), "made", "current"),
    """WITH p AS (SELECT event_id // 500 AS current, count(*) AS trajectories, count(*) FILTER (user_id % 3 >= 1) AS stale FROM events GROUP BY 1)
    SELECT current, trajectories, stale, sum(stale) OVER (ORDER BY current)::BIGINT AS stale_so_far FROM p""",
)
BOOK.add(
    "a43_pilot_summary",
    lambda s, d: batches.pilot_summary(table(s, d, "predictions").select("raw_output", "attempts"), F.coalesce(parsing.output_error("raw_output").isNull(), F.lit(False)), F.lit(0.25), F.col("attempts").cast("double")).select("rollout_samples", "rollout_json_valid", "rollout_valid", "distillation_loss", "scores_finite", "kl_finite"),
    f"""WITH b AS (SELECT raw_output, attempts, CASE WHEN NOT (contains(raw_output, '<think>') AND NOT contains(raw_output, '</think>')) THEN {strip_sql("list_last(string_split(raw_output, '</think>'))")} END AS body FROM predictions
    ), v AS (SELECT attempts, coalesce(body <> '' AND NOT contains(body, '```') AND starts_with(body, '{{') AND ends_with(body, '}}') AND json_valid(body), false) AS ok FROM b)
    SELECT count(*) AS rollout_samples, count(*) FILTER (ok) AS rollout_json_valid, bool_and(ok) AS rollout_valid, 0.25::DOUBLE AS distillation_loss, bool_and(attempts IS NOT NULL) AS scores_finite, bool_and(attempts IS NOT NULL) AS kl_finite FROM v""",
)

BOOK.add("row5_slice", lambda s, d: ordering.slice_rows(_indexed(s, d), 10, 9000, 7), f"WITH {_ORD} SELECT * FROM o WHERE row_idx >= 10 AND (row_idx - 10) % 7 = 0 AND row_idx < 9000")
BOOK.add(
    "u5_repeat_interleave",
    lambda s, d: ordering.repeat_rows(_indexed(s, d), 3).select("o_orderkey", "copy", F.col("out_idx").cast("long").alias("out_idx")),
    f"WITH {_ORD} SELECT o_orderkey, c::INT AS copy, row_idx * 3 + c AS out_idx FROM o, range(3) t(c)",
)
BOOK.add(
    "u10_pad_to_multiple",
    lambda s, d: ordering.pad_to_multiple(_indexed(s, d), 4096).select("row_idx", "o_orderkey", "is_pad"),
    f"""WITH {_ORD}, n AS (SELECT count(*) AS n, (4096 - count(*) % 4096) % 4096 AS pad FROM o)
    SELECT row_idx, o_orderkey, false AS is_pad FROM o UNION ALL SELECT n + i, o_orderkey, true FROM n, range(4096) t(i), o WHERE i < pad AND row_idx = i % n""",
)
BOOK.add(
    "w9_consecutive_runs",
    lambda s, d: ordering.runs(table(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], ["event_id"], "event_type").select("user_id", "event_id", F.col("run_no").cast("long").alias("run_no"), F.col("in_run").cast("long").alias("in_run")),
    """WITH a AS (SELECT user_id, event_id, event_type, CASE WHEN lag(event_type) OVER w IS DISTINCT FROM event_type OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
    ), b AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS run_no FROM a)
    SELECT user_id, event_id, run_no, row_number() OVER (PARTITION BY user_id, run_no ORDER BY event_id) - 1 AS in_run FROM b""",
)
BOOK.add(
    "w13_strided_shards",
    lambda s, d: _indexed(s, d).select("o_orderkey", (F.col("row_idx") % 8).alias("shard"), F.floor(F.col("row_idx") / 64).alias("mini_batch")),
    f"WITH {_ORD} SELECT o_orderkey, row_idx % 8 AS shard, row_idx // 64 AS mini_batch FROM o",
)
BOOK.add(
    "w14_zigzag",
    lambda s, d: table(s, d, "orders").select("o_orderkey", ordering.micro_batch_rank(F.col("o_orderkey") % 16, F.lit(16)).cast("long").alias("place")),
    "SELECT o_orderkey, CASE WHEN (o_orderkey % 16) % 2 = 0 THEN 8 - 1 - (o_orderkey % 16) // 2 ELSE 8 + (o_orderkey % 16) // 2 END AS place FROM orders",
)
BOOK.add(
    "u7_unfold_chunks",
    lambda s, d: table(s, d, "embeddings").select("vec_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, 16))).alias("n", "x")).select("vec_id", "n", F.size("x").alias("width"), F.round(F.aggregate("x", F.lit(0.0), lambda a, b: a + b.cast("double")) + F.lit(1.7e-9), 6).alias("total")),
    "SELECT vec_id, n::INT AS n, 16 AS width, round(list_sum([v::DOUBLE FOR v IN embedding[n * 16 + 1 : n * 16 + 16]]) + 1.7e-9, 6) AS total FROM embeddings, range(4) t(n)",
)
BOOK.add(
    "u3_id_sets",
    lambda s, d: _samples(s, d).where("split = 'train'").select("sample_id").union(_samples(s, d).where("split = 'test'").select("sample_id")).distinct().subtract(_samples(s, d).where("split = 'validation'").select("sample_id")),
    "SELECT DISTINCT sample_id FROM samples WHERE split IN ('train', 'test') EXCEPT SELECT sample_id FROM samples WHERE split = 'validation'",
)
QUERIES, SQL = BOOK.queries, BOOK.sql
