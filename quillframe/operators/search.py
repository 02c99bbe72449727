"""Search of query texts: an inverted index with impacts, top-k by bounds, and a chunk index on disk that grows by documents."""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import chunks
from .providers import Embedder, embedded
from .ranks import small, written
from .retrieval import hybrid_top_k, terms, tfidf
from .term_sums import term_hashes, term_sums

#: Characters of a text that are indexed, and of the one chunk that stands in where cutting fails.
MOST_CHARS, FALLBACK_CHARS = 1_000_000, 5000
#: Query vectors that are sent to every task.
MOST_QUERIES = 10_000


def inverted_index(rows: DataFrame, key: str, text: str, folder: str | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """Postings (term, key, weight) in ranges of term and falling weight, and terms (term, idf, peak, df), both written. A term of any number of rows is split over ranges.

    Weights are those of tfidf(), so a product with a query's is a cosine. options: min_df, max_df, stop_words.
    """
    rows = rows.where(F.col(text).isNotNull()).select(key, text)
    n = rows.count()
    found = tfidf(rows, [key], text, **options).select("term", key, "weight")
    postings = found.repartitionByRange("term", F.desc("weight"), key).sortWithinPartitions("term", F.desc("weight"))
    postings = written(postings, "postings") if folder is None else _saved(postings, f"{folder}/postings")
    stats = _stats(postings, n)
    return postings, written(stats, "terms") if folder is None else _saved(stats, f"{folder}/terms")


def asked_index(rows: DataFrame, key: str, text: str, queries: DataFrame, query: str = "query", **options) -> tuple[DataFrame, DataFrame]:
    """Postings and terms as those of inverted_index(), of the terms of `queries` alone: all that a search of them looks up.

    All terms of all rows are counted, and their weights' lengths are over all of them; only postings that no query asks for are not written.
    """
    rows = rows.where(F.col(text).isNotNull()).select(key, text)
    terms = written(term_hashes(queries, query, options.get("stop_words", ())), "terms")
    found = term_sums(rows, [key], text, wanted=terms, **options)
    postings = written(found.join(small(terms), ["h", "g"]).select("term", key, "weight"), "postings")
    return postings, written(_stats(postings, rows.count()), "terms")


def _stats(postings: DataFrame, n: int) -> DataFrame:
    stats = postings.groupBy("term").agg(F.max("weight").alias("peak"), F.count("*").alias("df"))
    return stats.select("term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"), "peak", "df")


def _saved(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def query_weights(queries: DataFrame, stats: DataFrame, query: str = "query_id", text: str = "query", stop_words: tuple[str, ...] = ()) -> DataFrame:
    """query, term, q, bound: the query's weights over known terms, of length 1, and the most that a term can give to a score."""
    counts = queries.select(query, F.explode(terms(F.col(text), stop_words)).alias("term")).groupBy(query, "term").agg(F.count("*").alias("tf"))
    known = counts.join(stats, "term").withColumn("w", F.col("tf") * F.col("idf"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(query)))
    return known.select(query, "term", (F.col("w") / length).alias("q"), (F.col("w") / length * F.col("peak")).alias("bound"))


def _rank(query: str, key: str) -> Column:
    return F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), F.desc(key)))


def lexical_search(postings: DataFrame, stats: DataFrame, queries: DataFrame, k: int, key: str, query: str = "query_id", text: str = "query", stop_words: tuple[str, ...] = (), places: int = 9) -> DataFrame:
    """query, key, score, rank (from 1): the k best rows of each query text by the cosine of TF-IDF weights, ties to the larger key.

    Max-score: a query's strongest term alone gives a k-th score that the true one cannot be under. Terms whose bounds together stay under it are not
    essential: no row that has none but these can be among the k. So candidates come from the other terms' postings; those that could not
    reach the limit with all that is left are dropped, and only the rest look up the remaining terms. The result is exact.
    Scores are rounded to `places` before they are ranked. Rows that share no term with a query are not found; null texts find nothing.
    """
    asked = written(query_weights(queries, stats, query, text, stop_words), "queries")  # terms of the queries
    strongest = asked.withColumn("n", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("bound"), "term"))).where("n = 1")
    single = postings.join(small(strongest.select(query, "term", "q")), "term").select(query, key, (F.col("q") * F.col("weight")).alias("score"))
    floor = single.withColumn("rank", _rank(query, key)).where(F.col("rank") == k).select(query, F.col("score").alias("floor"))
    rising = Window.partitionBy(query).orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bounds = asked.join(floor, query, "left").withColumn("sum", F.sum("bound").over(rising))
    # a margin for the rounding of sums
    bounds = bounds.withColumn("essential", F.coalesce(F.col("sum") >= F.col("floor") - 1e-6, F.lit(True)))
    bounds = written(bounds.select(query, "term", "q", "bound", "essential", F.coalesce("floor", F.lit(0.0)).alias("floor")), "bounds")
    of = lambda yes: postings.join(small(bounds.where("essential" if yes else "not essential").select(query, "term", "q")), "term").select(query, key, (F.col("q") * F.col("weight")).alias("part"))
    left = bounds.groupBy(query).agg(F.sum(F.when(~F.col("essential"), F.col("bound")).otherwise(0.0)).alias("rest"), F.max("floor").alias("floor"))
    near = of(True).groupBy(query, key).agg(F.sum("part").alias("part")).join(left, query).where(F.col("part") + F.col("rest") >= F.col("floor") - 1e-6)
    near = written(near.select(query, key, "part"), "candidates")
    # a row's parts are added up before they move; rows that are no candidates go after that
    parts = near.withColumn("near", F.lit(True)).unionByName(of(False).withColumn("near", F.lit(False)))
    scored = parts.groupBy(query, key).agg(F.round(F.sum("part"), places).alias("score"), F.max("near").alias("near")).where("near").drop("near")
    return scored.withColumn("rank", _rank(query, key)).where(F.col("rank") <= k).select(query, key, "score", "rank")


def vector_search(rows: DataFrame, queries: DataFrame, k: int, key: str, vector: str, query: str = "query_id", query_vector: str = "vector") -> DataFrame:
    """query, key, distance (squared L2), rank: the k nearest rows of each query vector, ties to the smaller key.

    The queries (MOST_QUERIES at most, more are an error) go to every task, which holds them against its rows in blocks and keeps k of each; so k rows a query and task
    meet. Rows whose vector is null or of another size take no part.
    """
    asked = [(r[0], r[1]) for r in queries.select(query, query_vector).where(F.col(query_vector).isNotNull()).limit(MOST_QUERIES + 1).collect()]
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"over {MOST_QUERIES} queries")
    sent = rows.sparkSession.sparkContext.broadcast(asked)
    kinds = [queries.schema[query].dataType.simpleString(), rows.schema[key].dataType.simpleString()]

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: list[list[tuple]] = [[] for _ in sent.value]
        for pdf in batches:
            sizes = pdf[vector].map(lambda v: -1 if v is None else len(v)).to_numpy()
            for size in {len(v) for _, v in sent.value} & set(sizes.tolist()):
                mine = pdf[sizes == size]
                points, keys = np.stack(mine[vector].to_numpy()).astype(np.float64), mine[key].to_numpy()
                for i, (_, v) in enumerate(sent.value):
                    if len(v) == size:
                        d = points - np.asarray(v, np.float64)
                        far = np.einsum("ij,ij->i", d, d)
                        some = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1]) if len(far) > k else np.arange(len(far))
                        best[i] = heapq.nsmallest(k, best[i] + [(far[j], keys[j]) for j in some])
        out = [(sent.value[i][0], key_, d) for i, found in enumerate(best) for d, key_ in found]
        if out:
            yield pd.DataFrame(out, columns=[query, key, "distance"])

    found = rows.select(key, vector).mapInPandas(nearest, f"{query} {kinds[0]}, {key} {kinds[1]}, distance double")
    place = F.row_number().over(Window.partitionBy(query).orderBy("distance", key))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


class ChunkIndex:
    """Chunks and their vectors in a folder that the cluster shares; documents are added or replaced by key, and nothing is rewritten.

    Every addition writes its chunks into buckets by key, then a row a document that names the addition: these rows are what counts, so one that
    died in between is as if it had never been. The last addition of a key wins. compact() writes what counts anew.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    _DOCS = "doc_id string, addition string, at timestamp, n_chunks int"
    _CHUNKS = "doc_id string, chunk_id int, start_char int, end_char int, text string, embedding array<float>, addition string, bucket int"

    def _read(self, name: str, schema: str) -> DataFrame:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        if not root.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(root):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def documents(self) -> DataFrame:
        """doc_id, addition, n_chunks of each document as it stands."""
        last = F.max(F.struct("at", "addition", "n_chunks"))
        return self._read("documents", self._DOCS).groupBy("doc_id").agg(last.alias("last")).select("doc_id", "last.addition", "last.n_chunks")

    def chunks(self) -> DataFrame:
        """doc_id, chunk_id, start_char, end_char, text, embedding of all documents as they stand."""
        current = self.documents().select("doc_id", "addition", self._bucket().alias("bucket"))
        return self._read("chunks", self._CHUNKS).join(current, ["bucket", "doc_id", "addition"], "left_semi").drop("bucket", "addition")

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", embedder: Embedder | None = None, size: int = 0, cut: Column | None = None) -> None:
        """Adds documents, or replaces those whose key is there: text up to MOST_CHARS characters in chunks, with vectors of `size` if an embedder is given.

        cut: chunks (as chunks() makes them) of the column `text`; where it is null for a text that is not blank, one chunk of the first FALLBACK_CHARS characters stands
        in. Null and empty texts, and null keys, are passed over; of rows of one key one with the longest text counts. Failing vectors are zeros.
        """
        rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.replace(F.col(text), F.lit("\x00"), F.lit("")).alias("text")).where("doc_id is not null and text != ''")
        rows = rows.groupBy("doc_id").agg(F.max(F.struct(F.length("text"), "text"))["text"].alias("text")).withColumn("text", F.substring("text", 1, MOST_CHARS))
        whole = F.substring("text", 1, FALLBACK_CHARS)
        one = F.array(F.struct(F.lit(0).alias("chunk_id"), F.lit(0).alias("start_char"), F.length(whole).alias("end_char"), whole.alias("text")))
        made = rows.select("doc_id", F.explode(F.coalesce(chunks(F.col("text")) if cut is None else cut, one)).alias("c")).select("doc_id", "c.*")
        if embedder is None:
            made = made.withColumn("embedding", F.lit(None).cast("array<float>"))
        else:
            made = embedded(made, "text", embedder, size).drop("embedding_error")
        addition = uuid.uuid4().hex
        made = made.select("doc_id", "chunk_id", "start_char", "end_char", "text", "embedding", F.lit(addition).alias("addition"), self._bucket().alias("bucket"))
        made.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "chunk_id").write.mode("append").partitionBy("bucket").parquet(f"{self.path}/chunks")
        mine = self._read("chunks", self._CHUNKS).where(F.col("addition") == addition).groupBy("doc_id").agg(F.count("*").cast("int").alias("n_chunks"))
        mine = rows.select("doc_id").join(mine, "doc_id", "left").select("doc_id", F.lit(addition).alias("addition"), F.current_timestamp().alias("at"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
        mine.coalesce(1).write.mode("append").parquet(f"{self.path}/documents")

    def compacted(self, path: str) -> ChunkIndex:
        """An index at another path with what counts in this one."""
        other, addition = ChunkIndex(self.spark, path, self.buckets), uuid.uuid4().hex
        rows = self.chunks().withColumns({"addition": F.lit(addition), "bucket": other._bucket()}).select(*[c.split()[0] for c in self._CHUNKS.split(", ")])
        rows.repartition("bucket").sortWithinPartitions("bucket", "doc_id", "chunk_id").write.partitionBy("bucket").parquet(f"{other.path}/chunks")
        self.documents().select("doc_id", F.lit(addition).alias("addition"), F.current_timestamp().alias("at"), "n_chunks").write.parquet(f"{other.path}/documents")
        return other

    def search(self, queries: DataFrame, k: int = 5, weight: float | None = 0.7, embedder: Embedder | None = None, size: int = 0, stop_words: tuple[str, ...] = ()) -> DataFrame:
        """query_id, doc_id, chunk_id, score, rank of the k best chunks of each row (query_id, query) of queries.

        weight: of the semantic list; 1 takes it alone, 0 or no embedder the lexical one alone. Otherwise the 2k best of both are scaled and weighed.
        """
        rows = written(self.chunks().withColumn("item", F.concat_ws("#", "doc_id", F.format_string("%09d", "chunk_id"))), "chunks")
        weight = 0.0 if embedder is None else 0.7 if weight is None else weight
        lists = []
        if weight > 0:
            vectors = embedded(queries, "query", embedder, size).select("query_id", F.col("embedding").alias("vector"))
            found = vector_search(rows, vectors, k * (1 if weight == 1 else 2), "item", "embedding")
            lists.append(found.select("query_id", "item", (-F.col("distance")).alias("score"), "rank"))
        if weight < 1:
            postings, stats = asked_index(rows, "item", "text", queries, stop_words=stop_words)
            lists.append(lexical_search(postings, stats, queries, k * (1 if weight == 0 else 2), "item", stop_words=stop_words))
        out = hybrid_top_k(*lists, ["query_id"], "item", k, weight, 2 * k) if len(lists) == 2 else lists[0]
        return out.select("query_id", F.regexp_extract("item", r"(?s)^(.*)#[0-9]+$", 1).alias("doc_id"), F.regexp_extract("item", r"#([0-9]+)$", 1).cast("int").alias("chunk_id"), "score", "rank")
