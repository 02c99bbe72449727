"""SimHash near-duplicates through covering locality-sensitive hashing."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .graph import components
from .shared import Scratch, table

BITS = 64


def fingerprint(text: str | None, width: int) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles; 0 for a text without words."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprint_column(text, width: int):
    """The fingerprint as a signed long column."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(x, width) for x in texts], dtype="int64")

    return of(text)


def covering_masks(radius: int, bits: int = BITS) -> list[int]:
    """2^(radius+1)-1 masks such that any bit positions, radius at most, are all outside one of them.

    Position i has a nonzero vector a(i) of radius+1 bits; the mask of a nonzero v keeps the positions with
    <a(i), v> odd. For radius positions some v is orthogonal to all their vectors: that mask keeps none of them.
    Vectors are dealt from the last one down, so that few positions still get those with a first component, and
    masks keep even shares of them: 32 or 64 of 64 positions for radius 6.
    """
    vectors = [v for v in product((0, 1), repeat=radius + 1) if any(v)]
    signed = lambda x: x - (1 << bits) if x >> (bits - 1) else x
    return [signed(sum(1 << i for i in range(bits) if sum(a * b for a, b in zip(vectors[-1 - i % len(vectors)], v)) % 2)) for v in vectors]


def links(prints: DataFrame, scratch: Scratch, radius: int = 2, bucket: int = 64) -> DataFrame:
    """Distinct fingerprints (column fp) to edges u, v whose components are those of all links within the radius.

    Each fingerprint goes into one table for each covering mask. In a table's bucket of up to `bucket`
    fingerprints all pairs are compared. Members of larger buckets are joined exactly without pairs: each posts
    all words within radius/2 flips of itself, so two that differ in up to 2*(radius//2) bits meet at a word; the
    members that meet at a word are then within the radius of each other, and become a star. That needs an even radius.
    """
    if radius % 2:
        raise ValueError("radius must be even")
    masks = covering_masks(radius)
    posted = prints.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("mask", "key"))
    sizes = posted.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1")
    sized = scratch.saved(posted.join(sizes, ["mask", "key"]), "buckets")
    pairs = (
        sized.where(F.col("n") <= bucket)
        .groupBy("mask", "key")
        .agg(F.array_sort(F.collect_list("fp")).alias("fps"))
        .select(F.explode("fps").alias("u"), "fps")
        .select("u", F.explode(F.filter("fps", lambda v: (v > F.col("u")) & (F.bit_count(F.col("u").bitwiseXOR(v)) <= radius))).alias("v"))
    )
    flips = [0]
    for _ in range(radius // 2):
        flips = sorted({x ^ (1 << i) for x in flips for i in range(BITS)} | set(flips))
    flips = [x - (1 << BITS) if x >> (BITS - 1) else x for x in flips]
    met = (
        sized.where(F.col("n") > bucket)
        .select("fp")
        .distinct()
        .select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(x)) for x in flips])).alias("word"))
    )
    stars = met.groupBy("word").agg(F.array_sort(F.collect_list("fp")).alias("fps")).where(F.size("fps") > 1)
    stars = stars.select(F.element_at("fps", 1).alias("u"), F.explode(F.slice("fps", 2, len(flips))).alias("v"))
    return pairs.union(stars).distinct()


def near_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, radius: int = 2) -> DataFrame:
    """Per row of docs: doc_id, fp (signed long), root (fp that stands for the component), component_id.

    Null and empty texts have fingerprint 0 and link like any other. A row with a null doc_id counts in the links but
    never names a component, unless all rows of it are null. Repeated rows stay. Other columns are not looked at.
    """
    with Scratch(docs.sparkSession) as scratch:
        rows = scratch.kept(docs.select(F.col(doc_id).alias("doc_id"), fingerprint_column(F.col(text), width).alias("fp")), "simhash")
        prints = scratch.saved(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "prints")
        roots = components(links(prints.select("fp"), scratch, radius), scratch)
        named = prints.join(roots, prints.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
        lows = named.groupBy("root").agg(F.min("low").alias("component_id"))
        named = scratch.kept(named.join(lows, "root").select("fp", "root", "component_id"), "classes")
    return rows.join(named, "fp").select("doc_id", "fp", "root", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of three-word shingles and the components of links of two bits. Null and empty texts have fingerprint zero and link like others; repeated rows stay; an empty table gives none."""
    found = near_classes(table(spark, sf_dir, "documents"), width=3, radius=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
