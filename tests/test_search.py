"""Searches of query texts and vectors against plain versions, and the chunk index."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillframe.operators import search


def features(text):
    words = re.findall(r"\w\w+", (text or "").lower())
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


def plain_search(docs, queries, k):
    docs = [(i, Counter(features(t))) for i, t in docs if t is not None]
    df = Counter(t for _, c in docs for t in c)
    idf = {t: math.log((1 + len(docs)) / (1 + n)) + 1 for t, n in df.items() if 2 <= n <= 0.85 * len(docs)}

    def unit(c):
        v = {t: n * idf[t] for t, n in c.items() if t in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {t: x / size for t, x in v.items()}

    vectors = [(i, unit(c)) for i, c in docs]
    out = []
    for q, text in queries:
        mine = unit(Counter(features(text)))
        scores = [(round(sum(x * v.get(t, 0) for t, x in mine.items()), 9), i) for i, v in vectors if any(t in v for t in mine)]
        out += [(q, i, n + 1) for n, (_, i) in enumerate(sorted(scores, reverse=True)[:k])]
    return sorted(out)


def corpus():
    r = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(words, weights=[1 / (j + 1) for j in range(60)], k=r.randint(0, 40)))) for i in range(300)]
    docs += [(300 + i, "same text of copies here") for i in range(40)] + [(400, None), (401, "")]
    queries = [(i, " ".join(r.choices(words, k=r.randint(1, 8)))) for i in range(12)] + [(20, "same text"), (21, "unknown"), (22, None), (23, ""), (24, "w0 w1 w2")]
    return docs, queries


@pytest.mark.parametrize("k", [1, 5, 50])
def test_lexical_search(spark, k):
    docs, queries = corpus()
    rows = spark.createDataFrame(docs, "id int, text string").withColumns({"term": F.lit("clash"), "weight": F.lit(1.0)})
    postings, stats = search.inverted_index(rows, "id", "text")
    got = search.lexical_search(postings, stats, spark.createDataFrame(queries, "query_id int, query string"), k, "id").collect()
    assert sorted((r.query_id, r.id, r["rank"]) for r in got) == plain_search(docs, queries, k)
    assert all(0 < r.score <= 1 for r in got)


def test_bounds_pass_over_documents(spark):
    docs = [(i, "rare pair common" if i < 3 else "common filler" if i % 2 else "filler only") for i in range(400)]
    postings, stats = search.inverted_index(spark.createDataFrame(docs, "id int, text string"), "id", "text")
    queries = spark.createDataFrame([(0, "rare common")], "query_id int, query string")
    asked = {r.term: r for r in search.query_weights(queries, stats).collect()}
    assert asked["rare"].bound > 2 * asked["common"].bound
    found = search.lexical_search(postings, stats, queries, 2, "id")
    assert [(r.id, r["rank"]) for r in found.orderBy("rank").collect()] == [(2, 1), (1, 2)]


def test_vector_search(spark):
    r = random.Random(2)
    rows = [(i, [float(r.randint(-3, 3)) for _ in range(4)]) for i in range(500)] + [(900, None), (901, [1.0])]
    asked = [(i, [float(r.randint(-3, 3)) for _ in range(4)]) for i in range(6)] + [(7, None), (8, [2.0])]
    df = spark.createDataFrame(rows, "id int, v array<float>").repartition(5)
    got = search.vector_search(df, spark.createDataFrame(asked, "query_id int, vector array<float>"), 7, "id", "v").collect()
    want = []
    for q, v in asked:
        near = sorted((sum((a - b) ** 2 for a, b in zip(v, w)), i) for i, w in rows if v is not None and w is not None and len(v) == len(w))[:7]
        want += [(q, i, d, n + 1) for n, (d, i) in enumerate(near)]
    assert sorted((x.query_id, x.id, x.distance, x["rank"]) for x in got) == sorted(want)


def rows_of(index):
    return sorted((r.doc_id, r.chunk_id, r.text) for r in index.chunks().collect())


def test_chunk_index_grows_by_documents(spark, tmp_path):
    index = search.ChunkIndex(spark, str(tmp_path / "index"), 4)
    assert rows_of(index) == [] and index.documents().count() == 0
    frame = lambda x: spark.createDataFrame(x, "doc_id string, text string").withColumn("addition", F.lit("clash"))
    index.add(frame([("a", "x" * 1700), ("b", "short"), ("c", None), ("d", ""), (None, "no key"), ("e", "  "), ("f", "n\x00ul"), ("b", "longer")]))
    first = [("a", 0, "x" * 1000), ("a", 1, "x" * 900), ("a", 2, "x" * 100), ("b", 0, "longer"), ("f", 0, "nul")]
    assert rows_of(index) == first
    files = {p for p in (tmp_path / "index").rglob("*.parquet")}
    index.add(frame([("a", "replaced"), ("g", "new")]))
    assert files <= {p for p in (tmp_path / "index").rglob("*.parquet")}  # nothing is rewritten
    want = [("a", 0, "replaced"), ("b", 0, "longer"), ("f", 0, "nul"), ("g", 0, "new")]
    assert rows_of(index) == want and {r.doc_id: r.n_chunks for r in index.documents().collect()} == {"a": 1, "b": 1, "e": 0, "f": 1, "g": 1}
    # an addition that died between its chunks and its documents
    index._read("chunks", index._CHUNKS).where("doc_id = 'g'").withColumns({"text": F.lit("lost"), "addition": F.lit("died")}).write.mode("append").partitionBy("bucket").parquet(f"{index.path}/chunks")
    assert rows_of(index) == want
    assert rows_of(index.compacted(str(tmp_path / "small"))) == want
    index.add(frame([]))
    assert rows_of(search.ChunkIndex(spark, index.path, 4)) == want


def test_chunks_that_cannot_be_cut(spark, tmp_path):
    index = search.ChunkIndex(spark, str(tmp_path / "index"), 2)
    long = spark.createDataFrame([("a", "y" * 6000), ("b", "z" * 1_000_900)], "doc_id string, text string")
    index.add(long.where("doc_id = 'a'"), cut=F.lit(None).cast("array<struct<chunk_id:int,start_char:int,end_char:int,text:string>>"))
    assert rows_of(index) == [("a", 0, "y" * 5000)]
    index.add(long.where("doc_id = 'b'"))
    assert index.chunks().where("doc_id = 'b'").agg(F.max("end_char")).first()[0] == search.MOST_CHARS


def test_index_search(spark, tmp_path):
    def embedder(texts):
        return [[float(t.count(c)) for c in "abc"] for t in texts]

    index = search.ChunkIndex(spark, str(tmp_path / "index"), 2)
    docs = [(f"d{i}", f"alpha beta w{i % 3} " + "abc"[i % 3] * (i + 1)) for i in range(12)]
    index.add(spark.createDataFrame(docs, "doc_id string, text string"), embedder=embedder, size=3)
    queries = spark.createDataFrame([(1, "alpha w1"), (2, "w2 cc")], "query_id int, query string")
    lexical = index.search(queries, 2, weight=0, embedder=embedder, size=3).collect()
    assert {r.query_id: r.doc_id for r in lexical if r["rank"] == 1}[1] in {"d1", "d4", "d7", "d10"}
    semantic = index.search(queries, 3, weight=1, embedder=embedder, size=3).collect()
    far = lambda q, t: sum((a - b) ** 2 for a, b in zip(*embedder([q, t])))
    for q, text in ((1, "alpha w1"), (2, "w2 cc")):
        near = sorted((far(text, t), f"{d}#000000000") for d, t in docs)[:3]
        assert [r.doc_id for r in sorted(semantic, key=lambda r: r["rank"]) if r.query_id == q] == [d.split("#")[0] for _, d in near]
    both = index.search(queries, 3, embedder=embedder, size=3).collect()
    assert sorted((r.query_id, r["rank"]) for r in both) == [(q, n) for q in (1, 2) for n in (1, 2, 3)] and all(r.chunk_id == 0 for r in both)
