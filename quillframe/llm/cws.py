"""Document fingerprints by consistent weighted sampling, as DataFrame operations only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

#: Samples of a fingerprint, and bits kept of each.
SAMPLES, SAMPLE_BITS = 64, 16
#: A word's hash gives it one of BUCKETS draws of c and, by other bits, one of BUCKETS draws of r and beta, so BUCKETS^2 kinds of words.
#: What follows from r and beta is in a table for counts up to LEVELS, and worked out in place for greater ones. The tables have a
#: fixed size, 37 MB, whatever the input.
BUCKETS, LEVELS = 8192, 8
SPACES = "[\\x20\\x09-\\x0D]+"
#: Documents in a block of neighbours, and the most blocks.
BLOCK_ROWS, MAX_BLOCKS = 128, 65_536


def _uniform(key: str, k: Column, i: int) -> Column:
    return (F.shiftrightunsigned(F.xxhash64(key, k, F.lit(i)), 11) + 0.5) * 2.0**-53


def _gamma(key: str, k: Column, i: int) -> Column:
    return -F.log(_uniform(key, k, i) * _uniform(key, k, i + 1))


def _packed(value: Column, low: Column) -> Column:
    """Fixed point in the high bits, a hash in the low ones; sums of such numbers are of that kind."""
    return F.shiftleft(F.floor(value * 2.0**32).cast("long"), SAMPLE_BITS) + low.bitwiseAND(F.lit((1 << SAMPLE_BITS) - 1))


def first_parts(samples: int = SAMPLES) -> Column:
    """For each sample of column __c: ln c, with c ~ Gamma(2, 1)."""
    return F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda k: _packed(F.log(_gamma("__c", k, 0)), F.xxhash64("__c", F.lit(-1))))


def second_parts(samples: int = SAMPLES) -> Column:
    """For each sample of columns __r and __n: -(r (t - beta) + r), with r ~ Gamma(2, 1), beta ~ U(0, 1), t = floor(ln n / r + beta).

    With a first part it is ln a: a document's sample is the (word, t) of its least a, and two documents
    agree in a sample as often as the generalised Jaccard similarity of their word counts says.
    """
    drawn = F.transform(F.sequence(F.lit(1), F.lit(samples)), lambda k: F.struct(_gamma("__r", k, 2).alias("r"), _uniform("__r", k, 4).alias("beta")))
    drawn = F.transform(drawn, lambda x: F.struct(x["r"].alias("r"), x["beta"].alias("beta"), F.floor(F.log(F.col("__n").cast("double")) / x["r"] + x["beta"]).alias("t")))
    return F.transform(drawn, lambda x: _packed(128 - x["r"] * (x["t"] - x["beta"]) - x["r"], F.xxhash64("__r", x["t"])))


def signatures(rows: DataFrame, keys: list[str], text: str, samples: int = SAMPLES) -> DataFrame:
    """keys, signature (array of samples) of each text; the keys must tell rows apart.

    The weight of a word is how often it stands in the text. Texts without words (null ones too) have one word of their own.
    Where rows are already partitioned by some of the keys, nothing is shuffled; otherwise the counts are combined before that.
    """
    spark = rows.sparkSession
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), SPACES, -1), lambda w: w != "")
    words = F.when(F.size(words) > 0, words).otherwise(F.array(F.lit("")))
    terms = rows.select(*keys, F.explode(words).alias("__word")).select(*keys, F.xxhash64("__word").alias("__h"))
    counts = terms.groupBy(*keys, "__h").agg(F.count("*").alias("__n"))
    cells = counts.select(*keys, "__n", F.pmod("__h", F.lit(BUCKETS)).alias("__c"), F.pmod(F.shiftright("__h", 24), F.lit(BUCKETS)).alias("__r"))
    first = spark.range(BUCKETS).select(F.col("id").alias("__c"), first_parts(samples).alias("__first"))
    second = spark.range(BUCKETS * LEVELS).select(F.expr(f"id div {LEVELS}").alias("__r"), (F.col("id") % LEVELS + 1).alias("__n"))
    second = second.select("__r", "__n", second_parts(samples).alias("__known"))
    drawn = cells.join(F.broadcast(first), "__c").join(F.broadcast(second), ["__r", "__n"], "left")
    drawn = drawn.select(*keys, "__first", F.coalesce("__known", second_parts(samples)).alias("__second"))
    least = drawn.groupBy(*keys).agg(*[F.min(F.col("__first")[k] + F.col("__second")[k]).alias(f"__s{k}") for k in range(samples)])
    low = F.lit((1 << SAMPLE_BITS) - 1)
    return least.select(*keys, F.array(*[F.col(f"__s{k}").bitwiseAND(low).cast("int") for k in range(samples)]).alias("signature"))


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """Share of equal samples: an estimate of generalised Jaccard similarity, exactly 1 for equal signatures."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)) / F.lit(float(samples))


def as_text(signature: Column) -> Column:
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), SAMPLE_BITS // 4, "0")), ""))


def neighbours(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """block, place, real, doc_id, text, next (the following text by doc_id; after the last, the first).

    Rows are cut into blocks at approximate quantiles of doc_id, and the first rows of a block also stand, not real, at the end of
    the one before; so one shuffle, by block, brings neighbours together. Null texts are empty; null ids come
    first; rows with one id are in order of their texts' hashes.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ids = rows.where("doc_id is not null")
    n = ids.count()
    parts = max(1, min(MAX_BLOCKS, math.ceil(n / BLOCK_ROWS)))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(parts)], max(10_000, 10 * parts)).alias("cuts"), F.min("doc_id").alias("least")).first()
    cuts = sorted({cuts["least"], *cuts["cuts"]}) if n else []
    array = F.expr(f"array({', '.join(f'{x}L' for x in cuts)})") if cuts else F.expr("cast(array() as array<bigint>)")
    steps = F.array(*[F.lit(1 << i) for i in range(len(cuts).bit_length(), -1, -1)])
    at = F.aggregate(steps, F.lit(0), lambda pos, step: F.when(F.get(F.col("__cuts"), pos + step - 1) <= F.col("doc_id"), pos + step).otherwise(pos))
    rows = rows.withColumn("__cuts", array).withColumn("block", at)
    first = F.get(F.col("__cuts"), F.col("block") - 1) == F.col("doc_id")
    stand = F.when(F.coalesce(first, F.lit(False)), F.array(F.struct(F.col("block"), F.lit(True).alias("real")), F.struct((F.col("block") - 1).alias("block"), F.lit(False).alias("real")))).otherwise(F.array(F.struct(F.col("block"), F.lit(True).alias("real"))))
    placed = rows.select("doc_id", "text", F.xxhash64("text").alias("order"), F.explode(stand).alias("s")).select("s.block", "s.real", "doc_id", "text", "order", F.lit(0).alias("wrap"))
    head = rows.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).limit(1)
    head = head.select(F.lit(len(cuts)).alias("block"), F.lit(False).alias("real"), "doc_id", "text", F.lit(0).cast("long").alias("order"), F.lit(1).alias("wrap"))
    line = Window.partitionBy("block").orderBy("wrap", F.col("doc_id").asc_nulls_first(), "order", F.col("real").desc())
    return placed.unionByName(head).select("block", F.row_number().over(line).alias("place"), "real", "doc_id", "text", F.lead("text").over(line).alias("next"))


def edited_pairs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, signature, edited_signature, near_edited, near_next for each row of docs.

    The edited text has the last floor(n_chars / 4) code points replaced by as many first ones (or all) of the next
    document's. A null text is empty; a lone document is its own next one; repeated rows stay; an empty table gives none.
    Ids are whole numbers; a text that is none ends the job.
    """
    rows = neighbours(docs, doc_id, text)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.coalesce("next", F.lit("")), F.lit(1), quarter))
    rows = rows.select("block", "place", "real", "doc_id", n.cast("long").alias("n_chars"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), edited.alias("body")))).alias("b"))
    rows = rows.select("block", "place", "real", "doc_id", "n_chars", "b.kind", "b.body").where("real or kind = 0")
    rows = rows.withColumn("sha", F.when(F.col("kind") == 1, F.unhex(F.sha2("body", 256))))
    keys = ["block", "place", "kind", "real", "doc_id", "n_chars", "sha"]
    signed = signatures(rows, keys, "body", samples)
    line = Window.partitionBy("block").orderBy("place", "kind")
    ahead = lambda c, k: F.lead(c, k).over(line)
    both = signed.select("kind", "real", "doc_id", "n_chars", ahead("sha", 1).alias("sha"), "signature", ahead("signature", 1).alias("edited"), ahead("signature", 2).alias("following"))
    return both.where("real and kind = 0").select(
        "doc_id",
        "n_chars",
        F.lower(F.hex("sha")).alias("edited_sha256"),
        "signature",
        F.col("edited").alias("edited_signature"),
        likeness(F.col("signature"), F.col("edited"), samples).alias("near_edited"),
        likeness(F.col("signature"), F.col("following"), samples).alias("near_next"),
    )


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and its edited text, and their likenesses. Null texts are empty; repeated rows stay; an empty table gives none."""
    rows = edited_pairs(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", "edited_sha256", as_text(F.col("signature")).alias("fingerprint"), as_text(F.col("edited_signature")).alias("edited_fingerprint"), "near_edited", "near_next")
