"""Importance resampling, archives and exact clustering against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import clusters, resampling, warc
from quillframe.llm.catalog import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"

# Importance resampling

_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_LOW))
    return len(words), [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain_ranked(docs, target):
    """docs: (id, text). Multiset of (id, n_features, weight, score, rank), ties among equal ids broken by any."""
    mine = [(i, *plain_features(t)) for i, t in docs]
    raw, want = Counter(b for _, _, f in mine for b in f), Counter(b for t in target for b in plain_features(t)[1])
    S, T = sum(raw.values()), sum(want.values())
    gain = [math.floor(1000 * math.log((want[b] + 1) * (S + 10000) / ((raw[b] + 1) * (T + 10000)))) for b in range(10000)]
    rows = []
    for i, n, f in mine:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = able[: 5 * len(able) // 100]
    out = [(i, n, w, s, k + 1) for k, (i, _, n, w, s) in enumerate(drawn)]
    return out + [(i, n, w, s, None) for i, _, n, w, s in able[len(drawn) :] + [r for r in rows if r[1] < 20]]


def as_rows(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=repr)


def test_byte_automaton_against_regex_and_zlib():
    r = random.Random(5)
    texts = ["".join(r.choice("abcABZ 019_-.é語\x00\x7f\U0001f600") for _ in range(r.randint(0, 60))) for _ in range(400)]
    texts += ["", "x" * 5000, "é" * 3000, "a b", "a", "word " * 40, "ÀA", "z z"]
    for group in (texts, texts[:1], ["", ""], [], ["end", "start", "", "middle"], [" ".join("w" * i for i in range(1, 90))]):
        data = np.frombuffer("".join(group).encode(), np.uint8)
        ends = np.cumsum([len(t.encode()) for t in group]).astype(np.int64)
        n_words, found = resampling.features(data, ends)
        got = [[] for _ in group]
        for owner, bucket in found:
            for o, b in zip(owner.tolist(), bucket.tolist()):
                got[o].append(b)
        assert [(n, b) for n, b in zip(n_words.tolist(), got)] == [plain_features(t) for t in group]


def test_resampling_against_plain_version(spark, monkeypatch):
    monkeypatch.setattr(resampling, "PIECE", 500)
    r = random.Random(6)
    words = ["alpha", "Béta", "gamma", "delta", "x1", "long" * 30, "語"]
    docs = [(i, " ".join(r.choices(words, weights=[i % 7 + 1, 1, 1, 3, 1, 1, 1], k=r.randint(0, 60)))) for i in range(500)]
    docs += [(900, None), (901, ""), (None, "alpha " * 30), (902, "beta " * 3000), (7, docs[7][1]), (7, docs[7][1]), (8, "other " * 25), (903, "!?"), (904, "w" * 20000)]
    target = ["alpha alpha beta", None, "Alpha gamma", ""]
    frame = lambda rows, kind: spark.createDataFrame(rows, kind).repartition(5)
    df = frame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, own string, weight int")
    goal = frame([(t,) for t in target], "text string")
    assert as_rows(resampling.ranked(df, goal)) == sorted(plain_ranked(docs, target), key=repr)
    drawn = resampling.resampled(df, goal)
    assert drawn.columns == df.columns and drawn.count() == 5 * sum(plain_features(t)[0] >= 20 for _, t in docs) // 100
    assert as_rows(resampling.ranked(df, goal.limit(0))) == sorted(plain_ranked(docs, []), key=repr)
    assert resampling.ranked(df.limit(0), goal).count() == 0 and resampling.resampled(df.where("doc_id < 10"), goal).count() == 0
    same = frame([(i, "alpha " * 20) for i in range(200)] + [(3, "alpha " * 20)] * 100, "doc_id long, text string")  # ties, and one id in a third of the rows
    plain = [(i, "alpha " * 20) for i in range(200)] + [(3, "alpha " * 20)] * 100
    assert as_rows(resampling.ranked(same, goal)) == sorted(plain_ranked(plain, target), key=repr)


def test_resampling_query(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert as_rows(QUERIES["op11_resampling"](spark, SF)) == sorted(plain_ranked([tuple(r) for r in rows], target), key=repr)


# Archives

RECORD = "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


def plain_archive(rows, least):
    """Responses (id, payload) and revisits (id, id of the response) of rows (id, url, payload)."""
    seen = {}
    for i, u, p in sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")):
        seen.setdefault(p or b"", []).append(i)
    responses = [(i, p) for p, ids in seen.items() for i in (ids[:1] if len(p) >= least else ids)]
    return sorted(responses, key=repr), sorted(((i, ids[0]) for p, ids in seen.items() if len(p) >= least for i in ids[1:]), key=repr)


@pytest.mark.parametrize("split, files, least", [(4000, 1, 0), (4000, 4, 1), (10**8, 2, 30)])
def test_archives_round_trip(spark, tmp_path, split, files, least):
    r = random.Random(3)
    rows = [(1, "http://a/1", RECORD), (2, "http://a/2", RECORD * 3), (3, None, None), (None, "u", b"x\xff\xfe\r\n\r\nWARC/1."), (4, "a b\r\nc", "WARC/1." * 50), (4, "a b\r\nc", "WARC/1." * 50)]
    rows += [(5, "q", "WARC/1." * 50), (5, "q", RECORD * 400), (6, "q", ""), (7, "q", ""), (None, "v", "é"), (None, "v", "é")]
    rows += [(100 + i, "http://x", ("y" * r.randint(0, 2000) + RECORD) * r.randint(0, 4)) for i in range(60)]
    rows = [(i, u, p.encode() if isinstance(p, str) else p) for i, u, p in rows]
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    path = str(tmp_path / "archives")
    frame = spark.createDataFrame(rows, "page_id long, url string, html binary").withColumns({"digest": F.lit("clash"), "kind": F.lit(1)})
    warc.write_archives(frame.repartition(files), path, "page_id", "url", "html", least_bytes=least)
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = warc.read_archives(spark, path).collect()
        assert all(x.whole for x in warc.chain_ends(spark, path).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    number = lambda x: None if x is None else int(x)
    responses = sorted(((number(x.headers.get("page-id")), bytes(x.payload)) for x in got if x.headers["warc-type"] == "response"), key=repr)
    revisits = sorted(((number(x.headers.get("page-id")), number(x.headers.get("refers-to-page-id"))) for x in got if x.headers["warc-type"] == "revisit"), key=repr)
    assert (responses, revisits) == plain_archive(rows, least)
    ids = {x.headers["warc-record-id"]: x for x in got}
    assert len(ids) == len(rows) == len(got)
    for x in got:
        of = ids[x.headers["warc-refers-to"]] if x.headers["warc-type"] == "revisit" else x
        assert x.headers["warc-payload-digest"] == f"sha1:{of.payload_digest}" and of.payload_bytes == int(x.http["content-length"]) == len(of.payload)
        assert of.headers["warc-type"] == "response"


def test_archives_of_others(spark, tmp_path):
    """Chains end where a length leads nowhere; foreign records and odd files come back as they are."""
    info = b"WARC/1.0\r\nwarc-type: warcinfo\r\ncontent-length:  3 \r\n\r\na:b\r\n\r\n"
    hello = RECORD.encode()
    files = {
        "good": info + hello * 3, "cut": info + hello[:-6], "wrong": info + hello.replace(b": 5", b": 6") + hello, "garbage": b"no archive at all", "late": b"x" + hello, "empty": b"",
        "hidden": b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % (len(hello) * 2) + hello * 2 + b"\r\n\r\n" + hello, "none": b"WARC/1.1\r\n\r\n" + hello,
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = Counter((r.file.rsplit("/", 1)[1], r.headers["warc-type"], bytes(r.payload)) for r in warc.read_archives(spark, str(tmp_path)).collect())
    assert got == Counter({("good", "warcinfo", b"a:b"): 1, ("good", "response", b"hello"): 3, ("cut", "warcinfo", b"a:b"): 1, ("wrong", "warcinfo", b"a:b"): 1, ("hidden", "resource", hello * 2): 1, ("hidden", "response", b"hello"): 1})
    whole = {r.file.rsplit("/", 1)[1]: r.whole for r in warc.chain_ends(spark, str(tmp_path)).collect()}
    assert whole.pop("good") and whole.pop("hidden") and whole.pop("empty", True) and not any(whole.values())


def test_empty_archive(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "a"), "page_id", "url", "html")
    assert warc.read_archives(spark, str(tmp_path / "a")).count() == 0


# Clusters


def plain_clusters(rows, k=16, dims=64, rounds=3):
    """rows: (id, vector). Sorted (id, cluster, distance) and centroids, in whole numbers."""
    kept = [(i, [math.floor(64 * Fraction(float(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    seeds = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [list(v) for _, v in seeds]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for n in range(rounds + 1):
        best = [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
        if n < rounds:
            for j in range(len(centroids)):
                mine = [v for (_, v), (_, b) in zip(kept, best) if b == j]
                if mine:
                    centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted(((i, j, d) for (i, _), (d, j) in zip(kept, best)), key=repr), centroids


def test_clusters_against_plain_version(spark):
    r = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(r.normal(size=(300, 64)) * 3)]
    rows += [(400 + i, rows[i % 3][1]) for i in range(150)] + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[9][1])]  # a third are copies of three
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 65), (904, [float("nan")] + [0.0] * 63), (905, [float("inf")] + [0.0] * 63), (906, [None] + [0.0] * 63), (907, [0.0] * 64)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").withColumns({"id": F.lit("clash"), "point": F.lit(1)}).repartition(4)
    found, centroids = clusters.clustered(df)
    want, means = plain_clusters(rows + odd)
    assert sorted(((x.id, x.cluster, x.distance) for x in found.collect()), key=repr) == want and centroids.tolist() == means
    few, centroids = clusters.clustered(df.where("vec_id < 3"))
    want, means = plain_clusters(rows[:3])
    assert sorted((x.id, x.cluster, x.distance) for x in few.collect()) == want and centroids.tolist() == means
    assert clusters.clustered(df.limit(0))[0].count() == 0
    same = spark.createDataFrame([(i, [0.5] * 64) for i in range(40)], "vec_id long, embedding array<double>")  # ties: all to the first
    assert {(x.cluster, x.distance) for x in clusters.clustered(same)[0].collect()} == {(0, 0)}
    with pytest.raises(Exception, match="beyond"):
        clusters.clustered(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


@pytest.mark.parametrize("name", ["op12_warc", "op13_clusters"])
def test_queries_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(map(repr, (tuple(r[c] for c in names) for r in QUERIES[name](spark, SF).collect()))) == sorted(map(repr, want.fetchall()))
