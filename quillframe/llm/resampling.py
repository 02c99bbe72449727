"""Importance resampling towards a target: hashed runs of words, bucket gains, Gumbel draws without replacement."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, table

BUCKETS = 10_000
#: Words in the longest feature.
LONGEST = 3
#: Documents of fewer words are never drawn.
LEAST_WORDS = 20
#: Bytes of text that are worked on together; a longer text is a piece of its own.
PIECE = 2_000_000
#: Where no more words than this are still open, each is ended by itself.
FEW = 24

_byte = np.arange(256)
#: Bytes of words: 0-9, a-z, A-Z (which count as a-z) and all bytes of characters beyond ASCII.
_in_word = (_byte >= 0x80) | ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122)) | ((_byte >= 65) & (_byte <= 90))
_lower = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)


def _crc_table() -> np.ndarray:
    """The reflected CRC-32's step for each byte, from its polynomial."""
    steps = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        steps = np.where(steps & 1, np.uint32(0xEDB88320) ^ (steps >> np.uint32(1)), steps >> np.uint32(1))
    return steps


_steps = _crc_table()


def _advanced(states: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """CRC states after codes[start : start + size] of each, all starts a byte at a time; sizes must not grow along the arrays."""
    states, place, open_ = states.copy(), 0, len(sizes)
    while open_ > FEW:
        now = states[:open_]
        states[:open_] = _steps[(now ^ codes[starts[:open_] + place]) & np.uint32(0xFF)] ^ (now >> np.uint32(8))
        place += 1
        open_ = int(np.searchsorted(-sizes[:open_], -place, side="left"))
    for i in range(open_):
        rest = codes[starts[i] + place : starts[i] + sizes[i]].tobytes()
        states[i] = zlib.crc32(rest, int(states[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    return states


def _words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, size and text of each word in the bytes of several texts, which end at `ends`."""
    inside = np.zeros(len(data) + 1, np.int8)
    inside[:-1] = _in_word[data]
    edges = np.diff(inside, prepend=np.int8(0))
    cuts = ends[:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    cuts = cuts[(inside[cuts] == 1) & (inside[cuts - 1] == 1)]  # a word ends with its text, though the next text goes on
    starts = np.sort(np.concatenate([np.flatnonzero(edges == 1), np.unique(cuts)]))
    stops = np.sort(np.concatenate([np.flatnonzero(edges == -1), np.unique(cuts)]))
    return starts, stops - starts, np.searchsorted(ends, starts, side="right")


def features(data: np.ndarray, ends: np.ndarray, buckets: int = BUCKETS, longest: int = LONGEST) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Words of each text, and for each run length the text and the bucket of every run.

    A run's CRC goes on from that of the run a word shorter, so no run is ever put together.
    """
    starts, sizes, owner = _words(data, ends)
    n_words = np.bincount(owner, minlength=len(ends))
    codes = _lower[data]
    order = np.argsort(-sizes, kind="stable")
    states = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    found = []
    for k in range(longest):
        if k:
            whole = np.flatnonzero(owner[k:] == owner[:-k]) if len(owner) > k else np.zeros(0, np.int64)  # first words of runs that stay in one text
            before = states[whole]
            states = np.zeros(len(starts), np.uint32)
            states[whole + k] = _steps[(before ^ np.uint32(32)) & np.uint32(0xFF)] ^ (before >> np.uint32(8))
            last = np.zeros(len(starts), bool)
            last[whole + k] = True
            chosen = order[last[order]]
        else:
            whole, chosen = np.arange(len(starts)), order
        # here states stand at each run's last word; afterwards at its first
        after = _advanced(states[chosen], codes, starts[chosen], sizes[chosen])
        ended = np.zeros(len(starts), np.uint32)
        ended[chosen - k] = after
        states = ended
        found.append((owner[whole], ((states[whole] ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64)))
    return n_words, found


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes of several texts, and where each text ends in them; null texts are empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        until = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        until = min(until, len(texts))
        yield data[offsets[at] : offsets[until]], offsets[at + 1 : until + 1] - offsets[at]
        at = until


def bucket_counts(df: DataFrame, text: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: the features of all texts by bucket. Each task adds up its own rows, then the sums meet by bucket."""

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data, ends in _pieces(batch.column(0)):
                for _, found in features(data, ends, buckets)[1]:
                    total += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["bucket", "n"])

    return df.select(text).mapInArrow(counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """Of each bucket, thousandths of nats by which a feature speaks for the target, rounded down; counts are smoothed by one."""
    all_raw, all_target = sum(raw.values()) + buckets, sum(target.values()) + buckets
    return np.array([math.floor(1000 * math.log(float(target.get(b, 0) + 1) * all_raw / (float(raw.get(b, 0) + 1) * all_target))) for b in range(buckets)], np.int64)


def weights(text: Column, values: np.ndarray, spark: SparkSession) -> Column:
    """struct(n_words, n_features, weight) of each text: weight is the sum of its features' gains."""
    sent = spark.sparkContext.broadcast(values)  # as many numbers as there are buckets

    def weighed(texts: pa.Array) -> pa.Array:
        own, rows = sent.value, []
        for data, ends in _pieces(texts):
            n_words, found = features(data, ends, len(own))
            n, total = np.zeros(len(ends), np.int64), np.zeros(len(ends), np.int64)
            for owner, bucket in found:
                sums = np.concatenate([[0], np.cumsum(own[bucket])])
                of = np.searchsorted(owner, np.arange(len(ends) + 1))  # owners stand in order
                n += np.diff(of)
                total += sums[of[1:]] - sums[of[:-1]]
            rows.append((n_words, n, total))
        columns = [np.concatenate(c) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 3
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], ["n_words", "n_features", "weight"])

    return F.arrow_udf(weighed, "n_words long, n_features long, weight long")(text)


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a standard Gumbel draw, rounded down, fixed by seed and id (null: empty)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text", percent: int = 5, seed: int = 42, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (long), and the columns of `keep` in a struct `kept`, for each row of docs.

    rank counts the drawn documents from the highest score: so many hundredths of those of LEAST_WORDS words, drawn without
    replacement by weight (each score is a weight and a Gumbel draw); others have none. Ties go to the smaller id, null ids last.
    Null and empty texts have no features and weight 0. Repeated rows are documents of their own. An empty target makes all
    gains speak of the raw counts alone; empty docs give no rows. Columns that are not named do not matter.
    """
    spark = docs.sparkSession
    collected = lambda df, c: {r.bucket: r.n for r in bucket_counts(df, c).collect()}  # noqa: E731  a row a bucket
    values = gains(collected(docs, text), collected(target, target_text))
    kept = F.struct(*[F.col(c) for c in keep]) if keep else F.lit(None).cast("string")
    rows = docs.select(F.col(doc_id).alias("doc_id"), weights(F.col(text), values, spark).alias("own"), kept.alias("kept"))
    rows = rows.select("doc_id", "own.*", (F.col("own.weight") + noise(F.col("doc_id"), seed)).alias("score"), "kept")
    scratch = Scratch(spark)
    rows = scratch.kept(rows.withColumn("row", F.monotonically_increasing_id()), "weights")
    able = rows.where(F.col("n_words") >= LEAST_WORDS)
    drawn = percent * able.count() // 100
    # ranges of scores, each with its number in a written table, so that both readings agree
    place = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranged = scratch.kept(able.repartitionByRange(*place).withColumn("part", F.spark_partition_id()), "ranges")
    parts = ranged.groupBy("part").agg(F.max("score").alias("top"), F.min("score").alias("low"), F.count("*").alias("n")).collect()  # a row a partition
    starts, before = [], 0
    for p in sorted(parts, key=lambda p: (-p.top, -p.low, p.part)):
        starts += [(p.part, before)] * (before < drawn)
        before += p.n
    starts = F.broadcast(spark.createDataFrame(starts, "part int, before long"))
    number = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*place))
    top = ranged.join(starts, "part").withColumn("rank", number).withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    none = F.lit(None).cast("long").alias("rank")
    beyond = ranged.join(starts, "part", "left_anti").select("*", none)
    rest = rows.where(F.col("n_words") < LEAST_WORDS).select("*", none)
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank", *(["kept"] if keep else [])]
    return top.select(columns).unionByName(beyond.select(columns)).unionByName(rest.select(columns))


def resampled(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn rows of docs, all their columns, as ranked() draws them."""
    return ranked(docs, target, keep=tuple(docs.columns), **options).where("rank is not null").select("kept.*")


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of each document. Null texts have no features; null ids are drawn last among ties; repeated rows stay; an empty table gives none."""
    found = ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
