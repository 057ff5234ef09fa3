"""Problem 9: mixing sources to target weights by systematic sampling.

The mix is as large as it can be with every source at its target share and no document used more than ``max_repeats``
times. Within a source each document's expected copies are prefix-summed in order of size, one random offset is added,
and a document is emitted once per integer boundary its stretch crosses. Sizes are tokens of a public tokenizer.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.session import cut

from .tokenise import TOKENIZER, token_counts

_BLANKS = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def clean_source(source: str | Column) -> Column:
    """Clean spelling: no blanks around, lower case; null when blank."""
    name = F.lower(F.regexp_replace(source, _BLANKS, ""))
    return F.when(name != "", name)


def _offset(seed: int, source: str) -> float:
    return int.from_bytes(hashlib.sha256(f"{seed}:{source}".encode()).digest()[:6], "big") / 2**48


def _rates(sized: DataFrame, targets: DataFrame) -> list[dict]:
    """Expected copies a document of each target source; one row a source on the driver."""
    totals = {r["source"]: r["tokens"] for r in sized.groupBy("source").agg(F.sum("n_tokens").alias("tokens")).collect()}
    wanted = [(r["source"], float(r["target_share"]), int(r["max_repeats"])) for r in targets.collect()]
    scale = sum(share for _, share, _ in wanted) or 1.0
    wanted = [(s, share / scale, most) for s, share, most in wanted if share > 0]
    caps = [totals[s] * most / share for s, share, most in wanted if totals.get(s)]
    size = min(caps) if len(caps) == len(wanted) and caps else 0.0  # a source without tokens leaves no mix at its shares
    return [{"source": s, "target_share": share, "max_repeats": most, "rate": min(float(most), share * size / totals[s]) if totals.get(s) else 0.0} for s, share, most in wanted]


def sized_documents(documents: DataFrame, targets: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents of target sources that have tokens, written once."""
    names = F.broadcast(targets.select(clean_source("source").alias("source")).where("source is not null").distinct())
    rows = documents.select("doc_id", clean_source("source").alias("source"), "text").join(names, "source", "left_semi")
    return cut(token_counts(rows, path).where("n_tokens > 0"))


def mix(sized: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, source, n_tokens, copy_no) of every copy in the mix, copies numbered from 1.

    ``targets`` may spell sources in any case. Documents without tokens and of other sources are never used. The prefix
    sums run over slots (size class and hash of the id) of which there are a bounded number a source, then inside a slot.
    """
    spark = sized.sparkSession
    targets = targets.select(clean_source("source").alias("source"), "target_share", "max_repeats").where("source is not null")
    rates = [(r["source"], r["rate"], _offset(seed, r["source"])) for r in _rates(sized, targets)]
    rated = spark.createDataFrame(rates, "source string, rate double, offset double")
    rows = sized.withColumn("grade", F.expr("cast(floor(16 * log2(n_tokens)) as int)")).withColumn("slot", F.expr("cast(pmod(xxhash64(doc_id), 64) as int)"))
    slots = rows.groupBy("source", "grade", "slot").agg(F.count(F.lit(1)).alias("n"))
    before = slots.select("source", "grade", "slot", (F.sum("n").over(Window.partitionBy("source").orderBy("grade", "slot")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("source", "grade", "slot").orderBy("n_tokens", "doc_id"))
    ranked = rows.withColumn("place", place).join(before, ["source", "grade", "slot"]).join(F.broadcast(rated), "source")
    upto = (F.col("before") + F.col("place")) * F.col("rate") + F.col("offset")
    copies = (F.floor(upto + 1e-9) - F.floor(upto - F.col("rate") + 1e-9)).cast("int")
    return ranked.withColumn("copies", copies).where("copies > 0").select("doc_id", "source", "n_tokens", F.explode(F.expr("sequence(1, copies)")).alias("copy_no"))


def mix_shares(sized: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """Per target source: target share, documents and copies used, tokens, the share reached and the most repeats."""
    used = mix(sized, targets, seed).groupBy("source").agg(
        F.count_if(F.col("copy_no") == 1).alias("docs"), F.count(F.lit(1)).alias("copies"), F.sum("n_tokens").alias("tokens"), F.max("copy_no").alias("most_repeats")
    )
    wanted = targets.select(clean_source("source").alias("source"), "target_share", "max_repeats").where("source is not null")
    joined = wanted.join(F.broadcast(used), "source", "left").na.fill(0)
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    return joined.select("source", "target_share", "max_repeats", "docs", "copies", "tokens", "most_repeats", F.when(whole > 0, F.col("tokens") / whole).otherwise(0.0).alias("share"))
