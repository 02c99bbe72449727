"""Lloyd's clustering of integer vectors: exact sums, floors and distances."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import Scratch, table

K, DIMS, ROUNDS, SCALE, SEED = 16, 64, 3, 64, 1
#: Integer components beyond this could overflow a distance of 64 components; the job ends with an error then.
LARGEST = 2**27


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component x, as a double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def whole(vector: Column, dims: int = DIMS) -> Column:
    """Whether the vector has exactly dims components, none null or non-finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < F.lit(float("inf")))
    return F.coalesce((F.size(vector) == dims) & F.forall(vector, fine), F.lit(False))


def nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of each point (int64); of equal distances the lowest number."""
    far = np.empty((len(centroids), len(points)), np.int64)
    for i, c in enumerate(centroids):
        d = points - c
        far[i] = np.einsum("ij,ij->i", d, d)
    number = far.argmin(axis=0)
    return number, far[number, np.arange(len(points))]


def _points(column: pd.Series, dims: int) -> np.ndarray:
    points = np.stack(column.to_numpy()).astype(np.int64) if len(column) else np.zeros((0, dims), np.int64)
    if points.size and max(-int(points.min()), int(points.max())) > LARGEST:
        raise OverflowError(f"a component is beyond {LARGEST} after scaling")
    return points


def _moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: the floor of the mean of what is nearest to each; those without a vector stay."""
    k, dims = centroids.shape
    sent = points.sparkSession.sparkContext.broadcast(centroids)  # k vectors

    def summed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, count = np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            own = _points(batch["point"], dims)
            number, _ = nearest(own, sent.value)
            count += np.bincount(number, minlength=k)
            for i in np.unique(number):
                total[i] += own[number == i].sum(axis=0)
        seen = np.flatnonzero(count)
        if len(seen):
            yield pd.DataFrame({"cluster": seen, "n": count[seen], "total": list(total[seen])})

    parts = points.select("point").mapInPandas(summed, "cluster int, n long, total array<long>")
    exact = lambda c: F.sum(F.col(c).cast("decimal(38,0)")).alias(c)
    sums = parts.select("cluster", "n", F.posexplode("total").alias("dim", "x")).groupBy("cluster", "dim").agg(exact("n"), exact("x"))
    moved = centroids.copy()
    for r in sums.collect():  # k * dims rows
        moved[r.cluster, r.dim] = int(r.x) // int(r.n)
    sent.unpersist()
    return moved


def seeds(points: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k points of least sha256 of "seed:id", in that order; null ids come last, rows of one id in order of their points."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return [r.point for r in points.orderBy(F.asc_nulls_last(key), "point").select("point").limit(k).collect()]


def clustered(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = K, dims: int = DIMS, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> tuple[DataFrame, np.ndarray]:
    """id, point (integers), cluster, distance (squared) of each kept vector, and the final centroids, k rows of integers.

    Kept are vectors of exactly dims components, none null or non-finite. Of fewer than k of them each starts a centroid; of none,
    there are no rows and no centroids. Repeated rows are vectors of their own. Equal distances go to the smaller number.
    Columns that are not named do not matter. Scaled components beyond 2^27 raise an error.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession)
    points = vectors.where(whole(F.col(vector), dims)).select(F.col(vec_id).alias("id"), integers(F.col(vector), scale).alias("point"))
    points = scratch.kept(points, "points")
    centroids = np.array(seeds(points, k, seed), np.int64).reshape(-1, dims)
    if len(centroids):
        _points(pd.Series(list(centroids)), dims)
        for _ in range(rounds):
            centroids = _moved(points, centroids)
    sent = spark.sparkContext.broadcast(centroids)

    def assigned(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            number, far = nearest(_points(batch["point"], dims), sent.value)
            yield batch.assign(cluster=number.astype(np.int32), distance=far)

    kind = vectors.schema[vec_id].dataType.simpleString()
    return points.mapInPandas(assigned, f"id {kind}, point array<long>, cluster int, distance long"), centroids


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster, distance and inertias of each kept vector. Null and odd vectors take no part; repeated rows stay; an empty table gives none."""
    found, centroids = clustered(table(spark, sf_dir, "embeddings"))
    rows = Scratch(spark).kept(found.select(F.col("id").alias("vec_id"), "cluster", "distance"), "clusters")
    sums = {r.cluster: r.s for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # a row a cluster
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    sides = [(i, s, sum(sums.values()), digests[i]) for i, s in sums.items()]
    sides = spark.createDataFrame(sides, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(sides), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """Each round as a grouped minimum of distances and sums by place."""
    steps = [f"""p AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})::BIGINT) AS q FROM embeddings
    WHERE len(embedding) = {DIMS} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1)::INT AS k, q AS c FROM p QUALIFY row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) <= {K})"""]
    for i in range(ROUNDS + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT r, vec_id, q, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT r, vec_id, q, k, list_sum(list_transform(list_zip(q, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p, c{i}) GROUP BY r, vec_id, q)")
        if i < ROUNDS:
            steps.append(f"""m{i + 1} AS (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS c FROM (SELECT k, j, sum(q[j])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{i}, range(1, {DIMS + 1}) AS t(j) GROUP BY k, j) GROUP BY k),
  c{i + 1} AS MATERIALIZED (SELECT c{i}.k, coalesce(m{i + 1}.c, c{i}.c) AS c FROM c{i} LEFT JOIN m{i + 1} ON m{i + 1}.k = c{i}.k)""")
    return f"""WITH {", ".join(steps)}
  SELECT vec_id, a.k AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.c, ',')) AS centroid_sha256
  FROM a{ROUNDS} a JOIN c{ROUNDS} c ON c.k = a.k"""


ORACLE_SQL = _oracle()
