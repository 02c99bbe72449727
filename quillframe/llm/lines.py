"""Line dedup: exact classes by hash, near ones by a segment-partition edit join."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, StringType

from .shared import fresh, maybe_broadcast, Scratch, table

#: Lines that differ in up to EDITS code points are repeats. Lines of fewer than MIN_CHARS are at most exact repeats.
EDITS, MIN_CHARS = 2, 20
#: Lines of one key that are compared with so many others at a time; more are cut into chunks, chunk against chunk.
CHUNK = 256
#: Keys or lines that may be broadcast.
BROADCAST_ROWS = 500_000


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most `edits`: Hyyro's bit vectors over a diagonal band of 2 * edits + 1 cells."""
    if abs(len(a) - len(b)) > edits:
        return False
    low, high = 0, min(len(a), len(b))
    while low < high:  # common prefix
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[low:mid] == b[low:mid] else (low, mid - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:  # common suffix
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[len(a) - mid :] == b[len(b) - mid :] else (low, mid - 1)
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    # At column j, bit i of the band is row j - edits + i; plus and minus are the steps down from the row above.
    width = 2 * edits + 1
    full, plus, minus = (1 << width) - 1, ((1 << (edits + 1)) - 1) << edits, 0
    score = min(edits, len(a))
    for j, c in enumerate(b):
        first = j - edits
        seen = where.get(c, 0)
        match = (seen >> first if first >= 0 else seen << -first) & full
        zero = (((match & plus) + plus) ^ plus) | match | minus
        across_plus = (minus | ~(zero | plus)) & full
        across_minus = zero & plus
        shifted = zero >> 1
        plus = (across_minus | ~(shifted | across_plus)) & full
        minus = across_plus & shifted
        # down the band's lowest diagonal to the last row, then along it
        if j + edits < len(a):
            score += not zero >> (width - 1) & 1
        else:
            at = width - 2 - (j + edits - len(a))
            if at < 0:
                return False
            score += (across_plus >> at & 1) - (across_minus >> at & 1)
        if score > 2 * edits + len(b) - len(a):
            return False
    return score <= edits


_ODD = np.uint64(0x9E3779B97F4A7C15)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((int(_ODD), pow(int(_ODD), -1, 1 << 64))):
            steps = np.full(2 * n, base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def keys_of(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed (length, segment, substring); which line; 3 where the line is indexed under it, 2 where it only probes there.

    A line of n code points is cut into edits + 1 segments. It probes for lines of its length and up to `edits` less. Of lines within the distance, some
    segment of the shorter one is in the longer one at a start that the multi-match-aware bounds leave. Substrings are hashed from
    prefix sums of their polynomial, so that a batch takes a few array operations.
    """
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    power, inverse = _powers_to(len(codes) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed((codes + np.uint64(1)) * _ODD) * power[: len(codes)], dtype=np.uint64)])
    n = np.fromiter(map(len, lines), np.int64, len(lines))
    first = np.cumsum(n) - n
    which = np.arange(len(lines))
    keys, owners, roles = [], [], []
    for less in range(edits + 1):
        size_of = n - less
        for i in range(edits + 1):
            start, end = size_of * i // (edits + 1), size_of * (i + 1) // (edits + 1)
            size = end - start
            low = np.maximum(np.maximum(start - i, start + less - (edits - i)), 0)
            high = np.minimum(np.minimum(start + i, start + less + (edits - i)), n - size)
            for shift in range(-i, i + 1):
                at = start + shift
                ok = (size_of > edits) & (low <= at) & (at <= high)
                a, b = (first + at)[ok], (first + at + size)[ok]
                h = (sums[b] - sums[a]) * inverse[a]
                keys.append(_mixed(h + _mixed((size_of[ok] * 16 + i).astype(np.uint64) * _ODD)))
                owners.append(which[ok])
                roles.append(np.full(len(a), 3 if not less and not shift else 2, np.int32))
    return np.concatenate(keys).view(np.int64), np.concatenate(owners), np.concatenate(roles)


def _id(docs: DataFrame, doc_id: str) -> Column:
    """Ids as they are if they are whole numbers or texts, else as texts."""
    kind = docs.schema[doc_id].dataType
    return F.col(doc_id) if isinstance(kind, (IntegralType, StringType)) else F.col(doc_id).cast("string")


def lines_of(docs: DataFrame, doc_id: str, text: str, shortest: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_key (hash of the row's text), line_no (from 0), line of `shortest` code points and more; blank ones of fewer than MIN_CHARS are left out."""
    rows = docs.select(_id(docs, doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("line_no", "line"))
    return rows.where((F.length("line") >= MIN_CHARS) | (F.length("line") >= shortest) & F.col("line").rlike(r"\S"))


def line_hash(salt: int) -> Column:
    return F.xxhash64(F.lit(salt), F.col("line"))


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key", "line_no")


def near_lines(lines: DataFrame, scratch: Scratch, edits: int = EDITS) -> DataFrame:
    """h1, h2 (hashes of a line), earliest (order): for each line that has another one within `edits` edits, the first such occurrence.

    Only ids of lines are shuffled, until keys are known under which different lines meet; then the texts of those alone. However
    many lines meet under a key, each task compares a chunk of them with a chunk, and keeps the first for each line: no pairs.
    """

    ids_of = lines.select(line_hash(1).alias("id"), "line")

    def post(wanted=None):
        """The posting function; only the wanted keys (a broadcast sorted array), if there are any."""

        def of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for at in range(0, len(pdf), 2000):
                    some = dict(zip(pdf["id"].iloc[at : at + 2000], pdf["line"].iloc[at : at + 2000]))
                    keys, which, roles = keys_of(list(some.values()), edits)
                    rows = pd.DataFrame({"key": keys, "id": np.fromiter(some, np.int64, len(some))[which], "role": roles})
                    if wanted is not None:
                        place = np.minimum(np.searchsorted(wanted.value, keys), max(len(wanted.value) - 1, 0))
                        rows = rows[wanted.value[place] == keys] if len(wanted.value) else rows[:0]
                    yield rows

        return of

    posting = "key long, id long, role int"
    posted = ids_of.mapInPandas(post(), posting)
    met = posted.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.bit_or("role").alias("role"))
    met = scratch.saved(met.where("a != b and role = 3").select("key"), "keys")
    if met.count() <= BROADCAST_ROWS:
        keys = np.sort(met.toPandas()["key"].to_numpy(np.int64))
        posted = ids_of.mapInPandas(post(lines.sparkSession.sparkContext.broadcast(keys)), posting)
    else:
        posted = posted.join(met, "key", "left_semi")
    found = scratch.saved(posted.groupBy("key", "id").agg(F.bit_or("role").alias("role")), "posted")
    ids = found.select("id").distinct()
    texts = lines.withColumns({"id": line_hash(1), "h2": line_hash(2)})
    texts = texts.join(maybe_broadcast(ids, ids.count(), BROADCAST_ROWS), "id", "left_semi").groupBy("id", "h2", "line").agg(F.min(_order()).alias("first"))
    texts = scratch.saved(texts, "texts")
    sizes = found.groupBy("key").agg(F.count("*").alias("n")).select("key", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"))
    rows = found.join(sizes, "key").join(texts, "id")
    mine = F.pmod(F.xxhash64("id", "key"), F.col("chunks")).cast("int")
    every = F.sequence(F.lit(0), F.col("chunks") - 1)
    kind = lines.schema["doc_id"].dataType
    named = F.coalesce(F.col("first.doc_id"), F.lit(0 if isinstance(kind, IntegralType) else "").cast(kind)).alias("doc_id")
    both = lambda bit, a, b: rows.where(F.col("role").bitwiseAND(F.lit(bit)) != 0).select("key", a.alias("ic"), b.alias("pc"), F.lit(bit).alias("role"), "id", "h2", "line", "first.nameless", named, "first.text_key", "first.line_no")
    blocks = both(1, mine, F.explode(every)).unionByName(both(2, F.explode(every), mine))
    at = ["key", "ic", "pc"]
    blocks = blocks.repartition(*at).sortWithinPartitions(*at, "role")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (r for pdf in batches for r in pdf.itertuples(index=False, name=None))
        for _, group in groupby(rows, key=lambda r: r[:3]):
            indexed, best = [], {}
            for _, _, _, role, i, h2, line, *order in group:
                order = tuple(order)
                if role == 1:
                    indexed.append((line, i, h2, order))
                    continue
                for other, j, g2, first in indexed:
                    if other != line and within(other, line, edits):
                        best[i, h2] = min(first, best.get((i, h2), first))
                        best[j, g2] = min(order, best.get((j, g2), order))
            if best:
                yield pd.DataFrame([(*k, *order) for k, order in best.items()], columns=["h1", "h2", "nameless", "doc_id", "text_key", "line_no"])

    near = blocks.mapInPandas(compare, f"h1 long, h2 long, nameless boolean, doc_id {kind.simpleString()}, text_key long, line_no int")
    near = near.withColumn("doc_id", F.when(~F.col("nameless"), F.col("doc_id")))
    return near.groupBy("h1", "h2").agg(F.min(F.struct("nameless", "doc_id", "text_key", "line_no")).alias("earliest"))


def repeated_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS, shortest: int = MIN_CHARS) -> DataFrame:
    """doc_id, text_key, dropped (array of struct(line_no, near, source)): a row for each document that has lines to drop.

    Lines are what newlines separate; those of fewer than `shortest` code points are left alone, those of fewer than MIN_CHARS have no near repeats. In order of (doc_id,
    hash of the text, line number), null ids last, a line is dropped if an equal one, or one within `edits` edits, stands before it
    anywhere; source is the id of the document of the first such. near: no equal one does. A document is an id and a text, so rows
    without an id, or with one id, are documents of their own where their texts differ; rows that repeat both are one. Null texts have no lines; an empty table gives no rows.
    Ids are whole numbers or texts; others are taken as texts. Other columns are not looked at.
    """
    with Scratch(docs.sparkSession) as scratch:
        lines = lines_of(docs, doc_id, text, shortest)
        rows = lines.select(line_hash(1).alias("h1"), line_hash(2).alias("h2"), "doc_id", "text_key", "line_no")
        classes = rows.groupBy("h1", "h2").agg(F.min(_order()).alias("first"), F.count("*").alias("n"))
        near = near_lines(lines.where(F.length("line") >= MIN_CHARS), scratch, edits)
        classes = classes.join(near, ["h1", "h2"], "left").where("n > 1 or earliest < first")
        classes = scratch.kept(classes.select("h1", "h2", "first", F.when(F.col("earliest") < F.col("first"), F.col("earliest")).alias("earlier")), "classes")
    own = F.col("first") == _order()
    gone = rows.join(maybe_broadcast(classes, classes.count(), BROADCAST_ROWS), ["h1", "h2"]).where(~own | F.col("earlier").isNotNull())
    gone = gone.select("doc_id", "text_key", F.struct("line_no", own.alias("near"), F.coalesce("earlier", "first")["doc_id"].alias("source")).alias("line"))
    return gone.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("line")).alias("dropped"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", edits: int = EDITS, shortest: int = MIN_CHARS) -> DataFrame:
    """docs without the lines that repeated_lines() names; all columns. Rows that lose every line have an empty text."""
    doc, key, lost = fresh(docs.columns, "doc", "key", "gone")
    gone = repeated_lines(docs, doc_id, text, edits, shortest).select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), F.col("dropped")["line_no"].alias(lost))
    rows = docs.join(gone, (F.xxhash64(text) == F.col(key)) & _id(docs, doc_id).eqNullSafe(F.col(doc)), "left")
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda line, i: ~F.array_contains(F.col(lost), i))
    return rows.withColumn(text, F.when(F.col(lost).isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document its lines, those dropped as exact and as near repeats, which, and the documents of their first occurrences.

    Null texts have one empty line and lose none; rows that repeat id and text are one document and show the same; an empty table gives none.
    """
    docs = table(spark, sf_dir, "documents")
    gone = Scratch(spark).kept(repeated_lines(docs, shortest=1), "dropped").withColumnRenamed("doc_id", "gone_id")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.size(lines).alias("n_lines"))
    near = lambda yes: F.coalesce(F.size(F.filter("dropped", lambda x: x["near"] if yes else ~x["near"])), F.lit(0))
    return rows.join(gone, (F.col("key") == F.col("text_key")) & F.col("doc_id").eqNullSafe(F.col("gone_id")), "left").select(
        "doc_id",
        "n_lines",
        near(False).alias("n_exact"),
        near(True).alias("n_near"),
        F.col("dropped")["line_no"].alias("dropped"),
        F.array_sort(F.array_distinct(F.col("dropped")["source"])).alias("sources"),
    )
