"""Problem 2: groups and pairs of near-same texts by MinHash banding.

Texts with equal word sets are collapsed to one class first, so a hot group of copies is one row from then on. Each
class gets a MinHash signature; bands of it are shuffled, classes that share a band are compared by set size and word
bitmaps inside the join (lossless), and what is left is verified exactly on the full word sets.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.components import components
from millrace.operators.pairs import keyed_pairs, member_pairs
from millrace.session import cut, spread

from .words import NEAR_SAME, may_be_near, near_same, set_key, word_set

ROWS_PER_BAND = 5
TARGET_RECALL = 0.9999
FIELDS = ("experience", "mechanism", "exclusion_boundary")


def bands_for(rows: int, recall: float, similarity: float = NEAR_SAME) -> int:
    """Bands of ``rows`` hashes needed to find a pair of exactly ``similarity`` with probability ``recall``."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))


def signatures(batches: Iterator[pd.DataFrame], rows: int, bands: int) -> Iterator[pd.DataFrame]:
    """Band hashes, set size and a 64-bit word bitmap of each (field, cid, hashes). A band's hash holds its number and field."""
    rng = np.random.default_rng(20250106)
    mult = rng.integers(1, 2**63, rows * bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    add = rng.integers(0, 2**63, rows * bands, dtype=np.uint64)
    mix = rng.integers(1, 2**63, rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    one = np.uint64(1)
    for pdf in batches:
        for begin in range(0, len(pdf), 1024):
            part = pdf.iloc[begin : begin + 1024]
            sizes = part["hashes"].map(len).to_numpy()
            flat = np.concatenate(part["hashes"].to_list()).astype(np.int64).view(np.uint64)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            bands_out = np.empty((len(part), bands), np.uint64)
            fields = part["field"].map(lambda f: zlib.crc32(f.encode()) << 8).to_numpy(np.uint64)
            for band in range(bands):
                acc = fields + np.uint64(band + 1)
                for row in range(rows):
                    k = band * rows + row
                    hashed = flat * mult[k] + add[k]
                    hashed ^= hashed >> np.uint64(32)
                    hashed *= mult[k - 1]
                    acc = (acc ^ np.minimum.reduceat(hashed, starts)) * mix[row]
                    acc ^= acc >> np.uint64(29)
                bands_out[:, band] = acc
            out = part[["cid"]].copy()
            out["n"] = sizes
            out["bitmap"] = np.bitwise_xor.reduceat(one << ((flat >> np.uint64(3)) & np.uint64(63)), starts).view(np.int64)
            out["bands"] = list(bands_out.view(np.int64))
            yield out


def class_members(texts: DataFrame) -> DataFrame:
    """(field, id, cls, words) of each distinct text with words; null ids, null texts and texts without words drop out."""
    words = texts.where("id is not null and text is not null").select("field", "id", word_set(F.col("text")).alias("words"))
    return words.where("size(words) > 0").withColumn("cls", set_key(F.concat(F.array(F.concat("field", F.lit("\u001f"))), F.col("words"))))


def near_classes(members: DataFrame, rows: int = ROWS_PER_BAND, recall: float = TARGET_RECALL) -> DataFrame:
    """(field, cls_a, cls_b) of near-same classes of different word sets, each pair once."""
    bands = bands_for(rows, recall)
    # classes are numbered when written, so what is shuffled with each band is short
    classes = cut(members.groupBy("field", "cls").agg(F.first("words").alias("words")).withColumn("cid", F.monotonically_increasing_id()))
    signed = spread(classes.select("field", "cid", F.expr("transform(words, w -> xxhash64(w))").alias("hashes"))).mapInPandas(
        lambda batches: signatures(batches, rows, bands), "cid long, n int, bitmap long, bands array<long>"
    )
    banded = cut(signed).select("cid", "n", "bitmap", F.explode("bands").alias("band"))
    pairs = keyed_pairs(banded, ["band"], "cid", ["cid", "n", "bitmap"]).where(may_be_near("a.n", "b.n", ("a.bitmap", "b.bitmap")))
    pairs = pairs.select(F.col("a.cid").alias("cid_a"), F.col("b.cid").alias("cid_b")).distinct()
    joined = pairs.join(classes.select(F.col("cid").alias("cid_a"), "field", F.col("cls").alias("cls_a"), F.col("words").alias("words_a")), "cid_a").join(
        classes.select(F.col("cid").alias("cid_b"), F.col("cls").alias("cls_b"), F.col("words").alias("words_b")), "cid_b"
    )
    return joined.where(near_same("words_a", "words_b")).select("field", "cls_a", "cls_b")


def near_pairs(texts: DataFrame) -> DataFrame:
    """(field, id_a, id_b), id_a < id_b in byte order, of all near-same texts (field, id, text); equal word sets count.

    An id with several texts in a field is in a pair if any of its texts is. An id is never paired with itself.
    """
    found = cut(class_members(texts).select("field", "id", "cls", "words"))
    near = cut(near_classes(found))
    members = cut(found.select("field", "id", "cls").distinct())
    within = keyed_pairs(members, ["field", "cls"], "id", ["id"]).select("field", F.col("a.id").alias("x"), F.col("b.id").alias("y"))
    plain = members.select("cls", "id")  # a class is of one field
    across = member_pairs(near, plain, plain).select("field", "x", "y").where("x <> y")
    both = within.unionByName(across)
    return both.select("field", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def near_groups(texts: DataFrame) -> DataFrame:
    """One row per (field, id): the id of its group of chained near-same texts (hex of the least class) and the number
    of distinct classes in it. Ids whose texts are in several groups appear once per group."""
    found = cut(class_members(texts))
    near = near_classes(found).select(F.concat_ws(":", "field", F.hex("cls_a")).alias("x"), F.concat_ws(":", "field", F.hex("cls_b")).alias("y"))
    groups = components(near)
    named = found.select("field", "id", F.concat_ws(":", "field", F.hex("cls")).alias("node")).distinct()
    sized = groups.groupBy("component").agg(F.count(F.lit(1)).alias("classes"))
    rooted = groups.join(sized, "component")
    return (
        named.join(rooted, "node", "left")
        .select("field", "id", F.coalesce("component", "node").alias("group_id"), F.coalesce("classes", F.lit(1)).alias("group_classes"))
        .distinct()
    )


def pool_texts(candidates: DataFrame, normalizations: DataFrame) -> DataFrame:
    """(field, id, text) of the three fields; nested fields are read by name, extra columns are ignored."""
    parts = [candidates.select(F.lit("experience").alias("field"), F.col("sample_id").alias("id"), F.col("experience").alias("text"))]
    for name in FIELDS[1:]:
        parts.append(normalizations.select(F.lit(name).alias("field"), F.col("sample_id").alias("id"), F.col(f"normalization.{name}").alias("text")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
