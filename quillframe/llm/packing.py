"""Mixture-controlled packing: deficit round-robin over source queues, worked out from counts alone."""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import maybe_broadcast, saved, table

SEQUENCE = 2048
#: Sequences in a scheduling window; every window holds each source's tokens in the target proportion, to a token.
WINDOW_SEQUENCES = 64
END_ID = 1
#: Sources up to this many have a queue each; where there are more, sources share so many queues by hash.
MAX_QUEUES = 4096
#: Words that a worker remembers, and the rows that may be broadcast.
CACHE_WORDS, BROADCAST_ROWS = 600_000, 200_000

_encoders: dict[str, Encoder] = {}
_UNEVEN = re.compile(r"\s\s|^\s|\s$")


#: Fixed value: how a byte-level splitter cuts a text into words.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Ids of the tokenizer file; words that one space separates are encoded once and remembered.

    The file's splitter never joins what stands before a single space with what follows it, if neither neighbour is
    white space; so a text that has no two white-space characters together is the sum of its words. Where the file is a byte-level BPE whose
    ids are in order of its merges, new words are encoded by an engine that takes ids as ranks, many at a time.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4"
        self.known: dict[str, bytes] = {}
        self.ranked = self._ranked()

    def _ranked(self):
        own = json.loads(self.tokenizer.to_str())
        cut, model = own["pre_tokenizer"] or {}, own["model"]
        if model["type"] != "BPE" or own["normalizer"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            return None
        if model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("dropout") or model.get("ignore_merges"):
            return None
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printed)))}
        vocab = {t: i for t, i in model["vocab"].items() if all(c in byte for c in t)}
        merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
        special = {x["id"] for x in own["added_tokens"]}
        if None in merged or merged != sorted(set(merged)) or len(merged) + 256 != len(model["vocab"].keys() - {x["content"] for x in own["added_tokens"]}):
            return None
        import tiktoken

        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if i not in special}
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for t, i in ranks.items():
            self.sizes[i] = len(t)
        return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _learn(self, words: list[str]) -> None:
        spaced = [w for w in words if w[:1] == " "] if self.ranked else []
        for at in range(0, len(spaced), 2000):
            some = spaced[at : at + 2000]
            ids = self.ranked.encode_to_numpy("".join(some), disallowed_special=())
            ends = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum([len(w.encode()) for w in some])) + 1
            whole, width, start = ids.astype(self.kind).tobytes(), np.dtype(self.kind).itemsize, 0
            for word, end in zip(some, (width * ends).tolist()):
                self.known[word] = whole[start:end]
                start = end
        rest = [w for w in words if w[:1] != " "] if self.ranked else words
        self.known.update(zip(rest, map(self._ids, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False))))

    def many(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text, of `kind`."""
        even = ["\0" not in x and not _UNEVEN.search(x) for x in texts]
        parts = [x.replace(" ", "\0 ").split("\0") if ok else None for x, ok in zip(texts, even)]
        asked = set().union(*filter(None, parts))
        new = asked - self.known.keys()
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = asked
        self._learn(list(new))
        known = self.known.__getitem__
        return [b"".join(map(known, p)) if p else self._ids(self.tokenizer.encode(x, add_special_tokens=False)) for p, x in zip(parts, texts)]

    def _ids(self, encoding) -> bytes:
        return np.array(encoding.ids, self.kind).tobytes()


def encoder(path: str) -> Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenized(docs: DataFrame, path: str, doc_id: str, text: str, source: str) -> DataFrame:
    """part, queue, start (tokens of the queue before it in its part), doc_id, tokens, ids (binary, 2 bytes an id where all fit)."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, used = TaskContext.get().partitionId(), {}
        one = encoder(path)
        width = np.dtype(one.kind).itemsize
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                some = pdf.iloc[at : at + 256]
                starts, counts, ids = [], [], []
                for queue, found in zip(some["queue"], one.many(some["text"].fillna("").tolist())):
                    n = len(found) // width + 1
                    starts.append(used.get(queue, 0))
                    used[queue] = starts[-1] + n
                    counts.append(n)
                    ids.append(found)
                yield pd.DataFrame({"part": part, "queue": some["queue"].values, "start": starts, "doc_id": some["doc_id"].values, "tokens": counts, "ids": ids})

    rows = docs.select(F.col(doc_id).cast("string").alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("queue"))
    return rows.mapInPandas(encode, "part int, queue string, start long, doc_id string, tokens long, ids binary")


@dataclass
class Schedule:
    """Tokens that each queue has been served after each window, in closed form.

    In a round every queue with tokens left gets its share of the window as quantum and is served whole tokens of it; the
    rest stays as its deficit. So after window k a queue with share w has had floor(k * window * w) tokens. As a queue runs
    dry, the others share its quantum: phases holds (window tokens before, tokens served before, share) for each.
    """

    window: int
    names: list[str]
    totals: list[int]
    phases: list[list[tuple[Fraction, Fraction, Fraction]]]

    @classmethod
    def of(cls, totals: dict[str, int], weights: dict[str, float] | None, window: int) -> Schedule:
        names = sorted(totals)
        w = {x: Fraction(weights.get(x, 0)).limit_denominator(10**9) if weights else Fraction(totals[x]) for x in names}
        if weights and (bad := [x for x in names if w[x] <= 0]):
            raise ValueError(f"no weight for {bad[:5]}")
        served, phases, at = dict.fromkeys(names, Fraction(0)), {x: [] for x in names}, Fraction(0)
        active = [x for x in names if totals[x]]
        while active:
            whole = sum(w[x] for x in active)
            step = min((totals[x] - served[x]) * whole / w[x] for x in active)
            for x in active:
                phases[x].append((at, served[x], w[x] / whole))
                served[x] += step * w[x] / whole
            at += step
            active = [x for x in active if served[x] < totals[x]]
        return cls(window, names, [totals[x] for x in names], [phases[x] for x in names])

    def served(self, q: int, k: int) -> int:
        """Tokens of queue q in the first k windows."""
        at, found = k * self.window, 0
        for before, had, share in self.phases[q]:
            if before > at:
                break
            found = had + (at - before) * share
        return min(int(found), self.totals[q])

    def window_of(self, q: int, token: int) -> int:
        phases = self.phases[q]
        before, had, share = phases[max(0, bisect_right([p[1] for p in phases], token) - 1)]
        k = int((before + (token + 1 - had) / share) / self.window)
        while self.served(q, k + 1) <= token:
            k += 1
        while k and self.served(q, k) > token:
            k -= 1
        return k


class Layout:
    """Places runs of a queue's tokens in the stream of windows."""

    def __init__(self, schedule: Schedule):
        self.s, self.known = schedule, {}
        self.index = {x: i for i, x in enumerate(schedule.names)}

    def _window(self, k: int) -> tuple[list[int], list[int]]:
        """Tokens that each queue had before window k, and where its tokens stand in the stream."""
        if k not in self.known:
            if len(self.known) > 64:
                self.known.clear()
            had = [self.s.served(q, k) for q in range(len(self.s.names))]
            got = [self.s.served(q, k + 1) for q in range(len(self.s.names))]
            places, at = [], sum(had)
            for a, b in zip(had, got):
                places.append(at)
                at += b - a
            self.known[k] = had, got, places
        return self.known[k]

    def pieces(self, queue: str, start: int, n: int, sequence: int) -> Iterator[tuple[int, int, int, int]]:
        """(tokens before in the run, length, sequence, offset) for each piece of the queue's tokens from start on."""
        q, at = self.index[queue], start
        k = self.s.window_of(q, start)
        while at < start + n:
            had, got, places = self._window(k)
            end = min(got[q], start + n)
            while at < end:
                place = places[q] + at - had[q]
                size = min(end - at, sequence - place % sequence)
                yield at - start, size, place // sequence, place % sequence
                at += size
            k += 1


PIECE = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string, window_id long"


def pack(
    docs: DataFrame,
    tokenizer: str,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: dict[str, float] | None = None,
    sequence: int = SEQUENCE,
    window_sequences: int = WINDOW_SEQUENCES,
    with_ids: bool = False,
) -> DataFrame:
    """A row for each piece of a document's ids (END_ID after them): where it starts in the document and in which sequence.

    weights: target proportions of the sources; None: those of the tokens that there are, which all queues then keep to
    the end. Sequences are full but for the last one. Null texts count as empty (one id, the end); null sources are a
    queue of their own; null and repeated doc_ids do no harm, as a row is a document. An empty table gives no rows. Other columns are not
    looked at. with_ids adds the piece's ids (array<int>).
    """
    spark = docs.sparkSession
    window = sequence * window_sequences
    names = docs.select(F.coalesce(F.col(source).cast("string"), F.lit("")).alias("q")).distinct().count()
    if names > MAX_QUEUES:
        if weights:
            raise ValueError(f"weights are for {MAX_QUEUES} sources at most; there are {names}")
        docs = docs.withColumn(source, F.pmod(F.crc32(F.col(source).cast("string")), F.lit(MAX_QUEUES)).cast("string"))
    kind = dict(docs.dtypes)[doc_id]
    held = saved(tokenized(docs, tokenizer, doc_id, text, source), "ids")
    sums = saved(held.groupBy("part", "queue").agg(F.sum("tokens").alias("sum")), "sums")
    totals = {r["queue"]: r["sum"] for r in sums.groupBy("queue").agg(F.sum("sum").alias("sum")).collect()}
    schedule = spark.sparkContext.broadcast(Schedule.of(totals, weights, window))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("part", "queue", F.coalesce(F.sum("sum").over(before), F.lit(0)).alias("base"))
    n_bases = sums.count()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        layout = Layout(schedule.value)
        for pdf in batches:
            for at in range(0, len(pdf), 2000):
                out = []
                for base, queue, start, doc, n, ids in pdf.iloc[at : at + 2000].itertuples(index=False, name=None):
                    found = np.frombuffer(ids, "<u4" if len(ids) == 4 * (n - 1) and n > 1 else "<u2")
                    found = np.append(found.astype("<u4"), np.uint32(END_ID))
                    for a, size, seq, offset in layout.pieces(queue, base + start, n, sequence):
                        mine = found[a : a + size]
                        row = (doc, a, size, zlib.crc32(mine.tobytes()), n, seq, offset, queue, (seq * sequence + offset) // window)
                        out.append((*row, mine.astype(np.int32)) if with_ids else row)
                yield pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])

    schema = PIECE + (", ids array<int>" if with_ids else "")
    rows = held.join(maybe_broadcast(bases, n_bases, BROADCAST_ROWS), ["part", "queue"]).select("base", "queue", "start", "doc_id", "tokens", "ids")
    return rows.mapInPandas(place, schema).withColumn("doc_id", F.col("doc_id").cast(kind))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of the packed documents. Null texts are empty (the end id alone); null and repeated ids do no harm, as a row is a document; an empty table gives none."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
