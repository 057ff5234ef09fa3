"""Problem 4: same or near-same records across splits.

Texts are compared in the form of problem 1, records of equal word sets are one class. As words may be reordered, a class
is fingerprinted in canonical order: its words from the rarest to the commonest, ties by hash. In this order the word sets
of two records are aligned when their common words are, so seeds are collinear however the texts were shuffled.

Fingerprints are winnowed: a rolling hash over every ``K`` neighbouring words, of which the minima, those made of the
``K * (d + 1)`` least words, are selected, each with its position. ``d`` is the number of words that may differ at a
similarity of 0.8 (a quarter of the words). The bound loses nothing: among the ``K * (d + 1)`` least words of both records
together at most d differ and cut the others into at most d + 1 runs, so one run has ``K`` words and both select it.

Fingerprints are joined across splits; seeds of a pair are chained by position, the chain bounds the words that can be
aligned (lossless, with word bitmaps), and pairs that pass are extended to the full alignment of both records, which
decides. The report chains and aligns the texts as written and gives the share of an evaluation record that is covered.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.pairs import member_pairs, two_sided_pairs
from millrace.session import cut, spread

from .canon import canonical_form
from .mixing import clean_source
from .splits import sample_name
from .words import may_be_near, near_same, set_key, word_list

#: Counts of words are kept by hash bucket: a bounded table whatever the vocabulary. Any common order is sound.
COUNT_BUCKETS = 1 << 18
#: Words in a rolling hash of the fingerprints, and of the report's seeds.
K, SEED_WORDS = 2, 3


def file_name(path: str) -> Column:
    """The file a path names: query and folders off, escapes resolved, lower case; null for null and blank paths."""
    plain = F.regexp_replace(F.regexp_replace(path, r"[?#].*$", ""), r"\+", "%2B")
    decoded = F.coalesce(F.try_url_decode(plain), plain)
    name = F.substring_index(F.regexp_replace(F.regexp_replace(decoded, r"\\", "/"), r"[\s\p{Z}\p{Cf}]+|/+$", ""), "/", -1)
    return F.when(name != "", F.lower(name))


def records(samples: DataFrame) -> DataFrame:
    """line_no, train, split, source, id_key, file_key, words (in order) and cls of each sample in a known split."""
    split = F.lower(F.trim("split"))
    rows = samples.select("line_no", split.alias("split"), "source", "sample_id", "image_path", "text").where("line_no is not null and split in ('train', 'validation', 'test')")
    rows = spread(rows).withColumn("form", canonical_form(F.col("text"))).withColumn("words", word_list(F.col("form")))
    sets = F.sort_array(F.array_distinct("words"))
    return rows.select(
        "line_no", (F.col("split") == "train").alias("train"), "split", clean_source("source").alias("source"),
        sample_name(F.col("sample_id")).alias("id_key"), file_name("image_path").alias("file_key"), "words",
        F.when(F.size("words") > 0, set_key(sets)).alias("cls"),
    )


def _fingerprints(batches: Iterator[pd.DataFrame], counts: np.ndarray) -> Iterator[pd.DataFrame]:
    """(cls, hashes) -> (cls, n, bitmaps, prints): the selected rolling hashes of the canonical order, by position."""
    one, base = np.uint64(1), np.uint64(0x9E3779B97F4A7C15)
    for pdf in batches:
        if not len(pdf):
            continue
        sizes = pdf["hashes"].map(len).to_numpy()
        flat = np.concatenate(pdf["hashes"].to_list()).astype(np.int64)
        bits = flat.view(np.uint64)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        record = np.repeat(np.arange(len(pdf)), sizes)
        ranked = bits[np.lexsort((flat, counts[(bits & np.uint64(COUNT_BUCKETS - 1)).astype(np.int64)], record))]
        # hash of words i .. i + K - 1, rolled over the whole batch; those that run over a record's end are never selected
        rolled = ranked.copy()
        for step in range(1, K):
            rolled[: len(ranked) - step] = rolled[: len(ranked) - step] * base + ranked[step:]
        rolled ^= rolled >> np.uint64(29)
        differ = sizes // 4
        chosen = np.where(differ > 0, np.minimum(K * (differ + 1), sizes) - K + 1, 0)  # equal sets are one class already
        out = pdf[["cls", "in_train", "all_train"]].copy()
        out["n"] = sizes
        for name, shift in (("m0", 20), ("m1", 28), ("m2", 36)):
            out[name] = np.bitwise_xor.reduceat(one << ((bits >> np.uint64(shift)) & np.uint64(63)), starts).view(np.int64)
        signed = rolled.view(np.int64)
        out["prints"] = [signed[s : s + k] for s, k in zip(starts, chosen, strict=True)]
        yield out


def chain(a: list[str], b: list[str], k: int = SEED_WORDS) -> list[tuple[int, int, int]]:
    """Collinear blocks (begin in a, begin in b, length) of common words: seeds of k words by rolling hash, the longest
    chain rising in both, each seed extended to both sides as far as words agree."""
    k = max(1, min(k, len(a), len(b)))

    def rolled(words: list[str]) -> list[int]:
        mask, base = (1 << 61) - 1, 1_000_003
        top, value, out = pow(base, k, mask), 0, []
        for i, word in enumerate(words):
            value = (value * base + hash(word)) % mask
            if i >= k:
                value = (value - top * hash(words[i - k])) % mask
            if i >= k - 1:
                out.append(value)
        return out

    where: dict[int, list[int]] = defaultdict(list)
    for j, value in enumerate(rolled(b)):
        where[value].append(j)
    tails: list[int] = []
    ends: list[tuple[int, int, int]] = []  # (i, j, previous)
    last: list[int] = []
    for i, value in enumerate(rolled(a)):
        for j in reversed(where.get(value, ())):
            if a[i : i + k] != b[j : j + k]:
                continue
            at = bisect_left(tails, j)
            ends.append((i, j, last[at - 1] if at else -1))
            if at == len(tails):
                tails.append(j)
                last.append(len(ends) - 1)
            else:
                tails[at], last[at] = j, len(ends) - 1
    seeds, at = [], last[-1] if last else -1
    while at >= 0:
        i, j, at = ends[at]
        seeds.append((i, j))
    blocks: list[tuple[int, int, int]] = []
    for i, j in reversed(seeds):
        pi, pj, n = blocks[-1] if blocks else (0, 0, 0)
        if blocks and i < pi + n and j < pj + n:
            continue
        lo_i, lo_j = pi + n, pj + n
        while i > lo_i and j > lo_j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        if i < lo_i or j < lo_j:
            skip = max(lo_i - i, lo_j - j)
            i, j = i + skip, j + skip
        length = 0
        while i + length < len(a) and j + length < len(b) and a[i + length] == b[j + length]:
            length += 1
        if length:
            blocks.append((i, j, length))
    return blocks


def aligned(a: list[str], b: list[str]) -> int:
    """Words of ``a`` aligned to ``b``: the chain's blocks, and in each gap between them the words both gaps have."""
    done, pi, pj = 0, 0, 0
    for i, j, n in [*chain(a, b), (len(a), len(b), 0)]:
        if pi < i and pj < j:
            done += (Counter(a[pi:i]) & Counter(b[pj:j])).total()
        done, pi, pj = done + n, i + n, j + n
    return done


def _covered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Alignment coverage of the evaluation side of near-same pairs."""
    for pdf in batches:
        cover = [aligned(list(b), list(a)) / len(b) for a, b in zip(pdf["words_a"], pdf["words_b"], strict=True)]
        yield pdf[["cls_a", "cls_b"]].assign(coverage=np.asarray(cover, float))


def near_class_pairs(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The classes (cls, words in text order, ...), and (cls_a of train, cls_b of evaluation) of near-same classes with
    different word sets, written once."""
    texts = rows.where("cls is not null")
    classes = cut(texts.groupBy("cls").agg(F.max_by("words", "line_no").alias("words"), F.max("train").alias("in_train"), F.min("train").alias("all_train")))
    hashed = classes.select("cls", F.expr("transform(array_distinct(words), w -> xxhash64(w))").alias("hashes"), "in_train", "all_train")
    counted = hashed.select(F.explode("hashes").alias("h")).groupBy(F.expr(f"cast(h & {COUNT_BUCKETS - 1} as int)").alias("bucket")).count().toPandas()  # bounded
    counts = np.zeros(COUNT_BUCKETS, np.int64)
    counts[counted["bucket"]] = counted["count"]
    shared = rows.sparkSession.sparkContext.broadcast(counts.astype(np.uint32))  # 1 MB at any size
    schema = "cls binary, in_train boolean, all_train boolean, n int, m0 long, m1 long, m2 long, prints array<long>"
    printed = cut(spread(hashed).mapInPandas(lambda batches: _fingerprints(batches, shared.value), schema))
    sides = F.expr("explode(filter(array(if(in_train, true, null), if(all_train, null, false)), s -> s is not null))")
    seeds = printed.select("cls", "n", "m0", "m1", "m2", sides.alias("train"), "prints").select("cls", "train", "n", "m0", "m1", "m2", F.posexplode("prints").alias("at", "print"))
    pairs = two_sided_pairs(seeds, ["print"], "cls", "train", ["cls", "n", "at", "m0", "m1", "m2"]).where("a.cls <> b.cls")
    # a seed: what lies before it in both records, itself, and what lies behind it in both
    pairs = pairs.where(f"9 * (least(a.at, b.at) + {K} + least(a.n - a.at, b.n - b.at) - {K}) >= 4 * (a.n + b.n)")
    for bitmap in ("m0", "m1", "m2"):
        pairs = pairs.where(may_be_near("a.n", "b.n", (f"a.{bitmap}", f"b.{bitmap}")))
    chained = pairs.groupBy(F.col("a.cls").alias("cls_a"), F.col("b.cls").alias("cls_b"), F.col("a.n").alias("na"), F.col("b.n").alias("nb")).agg(
        F.min("a.at").alias("a0"), F.max("a.at").alias("a1"), F.min("b.at").alias("b0"), F.max("b.at").alias("b1")
    )
    chained = chained.where("9 * (least(a0, b0) + least(a1 - a0, b1 - b0) + least(na - a1, nb - b1)) >= 4 * (na + nb)")
    sets = classes.select("cls", F.array_distinct("words").alias("words"))
    both = chained.join(sets.withColumnsRenamed({"cls": "cls_a", "words": "words_a"}), "cls_a").join(sets.withColumnsRenamed({"cls": "cls_b", "words": "words_b"}), "cls_b")
    return classes, cut(both.where(near_same("words_a", "words_b")).select("cls_a", "cls_b"))


def overlaps(samples: DataFrame) -> DataFrame:
    """p4_found: (line_no_a, line_no_b), smaller first, of each train and evaluation record that overlap by id, image
    or text. Null and blank ids, paths and texts, and texts without words, link nothing; rows of other splits are no
    part of it."""
    rows = cut(records(samples))
    found = []
    for key in ("id_key", "file_key", "cls"):
        pairs = two_sided_pairs(rows.where(F.col(key).isNotNull()).select(key, "line_no", "train"), [key], "line_no", "train", ["line_no"])
        found.append(pairs.select(F.col("a.line_no").alias("x"), F.col("b.line_no").alias("y")))
    _, near = near_class_pairs(rows)
    members = rows.where("cls is not null").select("cls", F.col("line_no").alias("id"), "train")
    across = member_pairs(near, members.where("train").drop("train"), members.where("not train").drop("train")).select("x", "y")
    every = found[0].unionByName(found[1]).unionByName(found[2]).unionByName(across)
    return every.select(F.least("x", "y").alias("line_no_a"), F.greatest("x", "y").alias("line_no_b")).distinct()


def overlap_report(samples: DataFrame) -> DataFrame:
    """Per evaluation split and source: records, records with an overlap by each way and by any, mean text coverage.

    Records are looked up by key and by class; no pair of records is made.
    """
    rows = cut(records(samples))
    classes, near = near_class_pairs(rows)
    words = classes.select("cls", "words")
    both = near.join(words.withColumnsRenamed({"cls": "cls_a", "words": "words_a"}), "cls_a").join(words.withColumnsRenamed({"cls": "cls_b", "words": "words_b"}), "cls_b")
    covered = both.mapInPandas(_covered, "cls_a binary, cls_b binary, coverage double").groupBy(F.col("cls_b").alias("cls")).agg(F.max("coverage").alias("coverage"))
    # a class that train has too is covered whole
    covered = classes.select("cls", F.when(F.col("in_train"), 1.0).alias("whole")).join(covered, "cls", "left").select("cls", F.coalesce("whole", "coverage").alias("coverage"))
    evaluated = rows.where("not train").select("split", "source", "id_key", "file_key", "cls")
    for name, key in (("by_id", "id_key"), ("by_image", "file_key")):
        seen = rows.where(F.col("train") & F.col(key).isNotNull()).select(key).distinct().withColumn(name, F.lit(True))
        evaluated = evaluated.join(seen, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    evaluated = evaluated.join(covered, "cls", "left").withColumn("by_text", F.col("coverage").isNotNull())
    return evaluated.groupBy("split", "source").agg(
        F.count(F.lit(1)).alias("records"), *(F.count_if(k).alias(k) for k in ("by_id", "by_image", "by_text")),
        F.count_if(F.col("by_id") | F.col("by_image") | F.col("by_text")).alias("overlapping"), F.avg(F.coalesce("coverage", F.lit(0.0))).alias("mean_coverage"),
    )
