"""Approximate nearest neighbours through a permutation index."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import saved, table

#: Pivots (of the bounded sample of PIVOT_ROWS vectors with the least id hashes), and how many of the nearest a vector is posted under.
PIVOTS, PIVOT_ROWS, PREFIX = 256, 1024, 64
#: Of a block's vectors, the share that is ranked highest by footrule distance and reranked exactly, and the least number.
RERANK, RERANK_LEAST = 0.25, 512
#: Distinct vectors in a block of the index, and queries that are answered together.
BLOCK, QUERY_BLOCK = 8192, 4096


def clean(rows: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """vec_id, v (array<double>) of distinct rows; without null ids and vectors null, empty, zero or holding null or non-finite components."""
    v = F.col("v")
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where("vec_id is not null and v is not null").where(finite & F.exists(v, lambda x: x != 0)).distinct()


def pivots_of(vectors: DataFrame, pivots: int = PIVOTS) -> dict[int, np.ndarray]:
    """Pivots for each dimension, from a bounded sample."""
    some = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_ROWS).collect()
    found: dict[int, list] = {}
    for r in some:
        mine = found.setdefault(len(r["v"]), [])
        if len(mine) < pivots and tuple(r["v"]) not in mine:
            mine.append(tuple(r["v"]))
    return {d: np.array(x) for d, x in found.items()}


def indexed(vectors: DataFrame, copies: int, pivots: dict[int, np.ndarray]) -> DataFrame:
    """dim, v, ids (the least `copies` of its rows), near (PREFIX nearest pivots in order): a row for each distinct vector.

    The prefix is what is posted in the pivots' inverted files. Vectors of a dimension that the pivots' sample lacks have an
    empty prefix: they are all reranked.
    """
    order = Window.partitionBy("v").orderBy("vec_id")
    few = vectors.select("vec_id", "v", F.row_number().over(order).alias("n")).where(F.col("n") <= copies)
    few = few.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    known = vectors.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("array<short>")
    def nearest(rows: pd.Series) -> pd.Series:
        out: list = [None] * len(rows)
        dims = np.array([len(x) for x in rows])
        for d in np.unique(dims):
            at, p = np.flatnonzero(dims == d), known.value.get(int(d))
            for start in range(0, len(at), 2048):
                mine = at[start : start + 2048]
                order = np.argsort(-(np.stack([rows[i] for i in mine]) @ p.T), axis=1, kind="stable")[:, :PREFIX] if p is not None else np.zeros((len(mine), 0))
                for i, x in zip(mine, order.astype(np.int16)):
                    out[i] = x
        return pd.Series(out)

    return few.select(F.size("v").alias("dim"), "v", "ids", nearest("v").alias("near"))


def footrule_ranked(near: np.ndarray, posted: list[tuple[np.ndarray, np.ndarray]], size: int, count: int, queries: np.ndarray):
    """For each query prefix the `count` places of least footrule distance; a pivot outside a prefix counts as at its end.

    posted: for each pivot, the places of the block under it and the pivot's rank there.
    """
    width = near.shape[1]
    ranks = np.arange(width)
    for prefix in queries:
        # all of a place's own pivots miss the query's, and the other way round, until a posting list says otherwise
        total = np.full(size, 2 * int((width - ranks).sum()), np.int32)
        for rank, pivot in enumerate(prefix):
            places, theirs = posted[pivot]
            total[places] += np.abs(theirs - rank) - (width - rank) - (width - theirs)
        yield np.argpartition(total, count - 1)[:count] if count < size else np.arange(size)


def search(rows: DataFrame, queries: str, k: int, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every other row, for each row that `queries` holds for.

    Nearness is the inner product in double precision; ties go to the smaller vec_id. Each block of the index is ranked by
    footrule distance through its pivots' posting lists, its best quarter is reranked on the original vectors. Copies of a
    vector are indexed once with their least ids. Vectors of different dimensions don't meet. Rows without a vec_id or a proper
    vector take no part; repeated rows count once; an id with two vectors is two rows; an empty table gives none.
    Ids are whole numbers; a text that is none ends the job.
    """
    if not PREFIX < 256:
        raise ValueError("the prefix must be shorter than 256")
    copies = k + 1
    vectors = saved(clean(rows, vec_id, embedding), "vectors")
    index = saved(indexed(vectors, copies, pivots_of(vectors)), "index")
    asked = vectors.where(queries).select(F.col("vec_id").alias("query_id"), "v")
    wanted = asked.groupBy("v").agg(F.min("query_id").alias("key"))
    wanted = saved(index.join(wanted, "v").select("key", "dim", "v", "near"), "queries")
    blocks = max(1, math.ceil(index.count() / BLOCK))
    groups = max(1, math.ceil(wanted.count() / QUERY_BLOCK))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    spread = lambda n: F.pmod(F.xxhash64("v"), F.lit(n)).cast("int")
    left = index.select("dim", spread(blocks).alias("block"), every(groups, "group"), "v", "ids", "near")
    right = wanted.select("dim", every(blocks, "block"), spread(groups).alias("group"), "key", "v", "near")

    def answer(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if mine.empty or theirs.empty:
            return pd.DataFrame({"key": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        v, near, ids = np.stack(mine["v"].to_list()), np.stack(mine["near"].to_list()), mine["ids"].to_list()
        size = len(v)
        count = min(size, max(RERANK_LEAST, math.ceil(RERANK * size))) if near.shape[1] else size
        posted: list = [None] * (PIVOTS if near.size else 0)
        flat = near.ravel().astype(np.int64)
        order = np.argsort(flat, kind="stable")
        bounds = np.searchsorted(flat[order], np.arange(len(posted) + 1))
        for p in range(len(posted)):
            at = order[bounds[p] : bounds[p + 1]]
            posted[p] = at // near.shape[1], at % near.shape[1]
        prefixes = theirs["near"] if near.size else [()] * len(theirs)
        out = []
        for key, q, places in zip(theirs["key"], theirs["v"], footrule_ranked(near, posted, size, count, prefixes)):
            scores = v[places] @ q
            bar = np.partition(scores, -copies)[-copies] if len(scores) > copies else -np.inf
            best = places[scores >= bar]
            scored = v[best] @ q
            found = sorted((-s, i) for b, s in zip(best, scored) for i in ids[b])[:copies]
            out += [(key, i, -s) for s, i in found]
        return pd.DataFrame(out, columns=["key", "vec_id", "score"])

    at = ["dim", "block", "group"]
    found = left.groupBy(*at).cogroup(right.groupBy(*at)).applyInPandas(answer, "key long, vec_id long, score double")
    best = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    found = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= copies).drop("n")
    keys = asked.join(wanted.select("key", "v"), "v").select("query_id", "key")
    own = Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id")
    out = keys.join(found, "key").where("query_id != vec_id").withColumn("rank", F.row_number().over(own))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found of each query. What takes no part, repeats and ties: see search()."""
    return search(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", 20)
