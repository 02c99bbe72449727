"""Language ID: interpolated Kneser-Ney character models in sorted arrays of all n-grams."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import saved, table

ORDER = 4
#: A character is one of 2^16 symbols, so that ORDER of them fit into a long.
SYMBOL_BITS = 16
SPACE = 32
#: Labels beyond this many are an error: the arrays hold a float for each language.
MAX_LANGUAGES = 256
#: One labelled document of so many (by crc32 of its id) is kept out of the counts and calibrates the rejection.
CALIBRATION_MOD = 32
#: A text is rejected where its cross-entropy (bits a character) is over mean + SPREADS * deviation + SLACK of calibration texts of its length.
SPREADS, SLACK = 6.0, 0.35


@lru_cache(1)
def _symbols() -> np.ndarray:
    """Symbol of each code point: letters are themselves below 2^16 and hashed into the private area (no letters) above; all else is a space."""
    letters = np.fromiter(map(str.isalpha, map(chr, range(sys.maxunicode + 1))), bool, sys.maxunicode + 1)
    points = np.arange(sys.maxunicode + 1, dtype=np.int64)
    own = np.where(points < 1 << SYMBOL_BITS, points, 0xE000 + (points * 2654435761 >> 7) % 6400)
    return np.where(letters, own, SPACE).astype(np.uint16)


def encoded(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ORDER-grams of the texts as packed longs, the text that each belongs to, and the texts' letters.

    Texts are lower-cased, runs of anything but letters are one space, and ORDER-1 spaces stand before each text.
    """
    symbols = _symbols()
    pad = np.full(ORDER - 1, SPACE, np.uint16)
    parts, owner, letters = [], [], np.zeros(len(texts), np.int64)
    for i, x in enumerate(texts):
        s = symbols[np.frombuffer((x or "").lower().encode("utf-32-le", "replace"), np.uint32)]
        blank = s == SPACE
        letters[i] = len(s) - int(np.count_nonzero(blank))
        if not letters[i]:
            continue
        s = s[~(blank & np.concatenate([[True], blank[:-1]]))]
        parts += [pad, s]
        owner += [np.full(len(pad), -1, np.int32), np.full(len(s), i, np.int32)]
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), letters
    stream, owner = np.concatenate(parts).astype(np.int64), np.concatenate(owner)
    grams = stream[ORDER - 1 :].copy()
    for k in range(1, ORDER):
        grams |= stream[ORDER - 1 - k : len(stream) - k] << (SYMBOL_BITS * k)
    owner = owner[ORDER - 1 :]
    real = owner >= 0
    return grams[real], owner[real], letters


def gram_counts(docs: DataFrame) -> DataFrame:
    """Rows text, lang to lang, gram (packed), n; counted in each task before the shuffle."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def merge(lang: str) -> None:
            grams, n = (np.concatenate(x) for x in zip(*held[lang]))
            keys, at = np.unique(grams, return_inverse=True)
            held[lang] = [(keys, np.bincount(at, n, len(keys)).astype(np.int64))]

        for pdf in batches:
            for lang, texts in pdf.groupby("lang")["text"]:
                texts = texts.tolist()
                for at in range(0, len(texts), 500):
                    grams, _, _ = encoded(texts[at : at + 500])
                    held.setdefault(lang, []).append(np.unique(grams, return_counts=True))
                    if len(held[lang]) >= 16:
                        merge(lang)
        for lang in held:
            merge(lang)
            keys, n = held[lang][0]
            for at in range(0, len(keys), 100_000):
                yield pd.DataFrame({"lang": lang, "gram": keys[at : at + 100_000], "n": n[at : at + 100_000]})

    rows = docs.select("lang", "text").where("lang is not null and text is not null").mapInPandas(count, "lang string, gram long, n long")
    return rows.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _order_tables(counts: DataFrame) -> DataFrame:
    """Order k, lang, gram, count of all n-grams: raw at the top, continuations below."""
    out, now = None, counts
    for k in range(ORDER, 0, -1):
        rows = now.select(F.lit(k).alias("k"), "lang", "gram", "n")
        out = rows if out is None else out.unionByName(rows)
        suffix = F.col("gram").bitwiseAND(F.lit((1 << (SYMBOL_BITS * (k - 1))) - 1))
        now = now.select("lang", suffix.alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    return out


class GramArray:
    """Distinct packed n-grams in their order."""

    def __init__(self, grams: np.ndarray):
        self.order = np.argsort(grams, kind="stable")
        self.grams = grams[self.order]

    def find(self, grams: np.ndarray) -> np.ndarray:
        """Places of the n-grams; -1 where they are not there."""
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        return np.where(self.grams[at] == grams, at, -1)


@dataclass
class Model:
    """For each order, an array of all n-grams with log2 probabilities of all languages, and one of contexts with log2 back-off weights."""

    langs: list[str]
    known: dict[int, GramArray] = field(default_factory=dict)
    logs: dict[int, np.ndarray] = field(default_factory=dict)
    contexts: dict[int, GramArray] = field(default_factory=dict)
    weights: dict[int, np.ndarray] = field(default_factory=dict)
    floor: float = 0.0
    #: (language, doublings of the length) to mean and deviation of the cross-entropy
    limits: dict[tuple[str, int], tuple[float, float]] = field(default_factory=dict)

    def log_probabilities(self, grams: np.ndarray, k: int = ORDER) -> np.ndarray:
        """Per packed k-gram and language, log2 of the interpolated probability of its last symbol."""
        if k == 0:
            return np.full((len(grams), len(self.langs)), self.floor, np.float32)
        at = self.known[k].find(grams)
        out = self.logs[k][at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            lost = grams[miss]
            lower = self.log_probabilities(lost & np.int64((1 << (SYMBOL_BITS * (k - 1))) - 1), k - 1)
            at = self.contexts[k].find(lost >> np.int64(SYMBOL_BITS))
            out[miss] = lower + np.where((at >= 0)[:, None], self.weights[k][at], np.float32(0))
        return out

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text: cross-entropy in bits a symbol for each language (nan without letters), symbols, letters."""
        sums, n, letters = np.zeros((len(texts), len(self.langs))), np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
        first, held = 0, 0
        for i, x in enumerate(texts):
            held += len(x or "")
            if held > 200_000 or i == len(texts) - 1:
                grams, owner, letters[first : i + 1] = encoded(texts[first : i + 1])
                if len(grams):
                    mine, starts = np.unique(owner, return_index=True)
                    sums[first + mine] = np.add.reduceat(self.log_probabilities(grams), starts, axis=0, dtype=np.float64)
                    n[first + mine] = np.diff(np.append(starts, len(owner)))
                first, held = i + 1, 0
        with np.errstate(invalid="ignore", divide="ignore"):
            return -sums / n[:, None], n, letters

    def limit(self, lang: str, n: int) -> float:
        mean, spread = self.limits.get((lang, int(n).bit_length()), (float("inf"), 0.0))
        return mean + SPREADS * spread + SLACK


def _build(rows: pd.DataFrame) -> Model:
    model = Model(sorted(rows["lang"].unique()))
    if len(model.langs) > MAX_LANGUAGES:
        raise ValueError(f"{len(model.langs)} labels; at most {MAX_LANGUAGES}")
    model.floor = -float(SYMBOL_BITS)
    width = len(model.langs)
    for k in range(1, ORDER + 1):
        mine = rows[rows["k"] == k]
        grams, at = np.unique(mine["gram"].to_numpy(), return_inverse=True)
        n = np.zeros((len(grams), width))
        n[at, np.searchsorted(model.langs, mine["lang"].to_numpy().astype(str))] = mine["n"].to_numpy()
        own, context = np.unique(grams >> SYMBOL_BITS, return_inverse=True)
        total, kinds = np.zeros((len(own), width)), np.zeros((len(own), width))
        np.add.at(total, context, n)
        np.add.at(kinds, context, n > 0)
        one, two = (n == 1).sum(0), (n == 2).sum(0)
        discount = np.clip(one / np.maximum(one + 2 * two, 1), 0.05, 0.95)
        back = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
        direct = np.maximum(n - discount, 0) / np.maximum(total[context], 1)
        suffix = grams & np.int64((1 << (SYMBOL_BITS * (k - 1))) - 1)
        lower = np.exp2(model.log_probabilities(suffix, k - 1).astype(np.float64))
        model.known[k], model.contexts[k] = GramArray(grams), GramArray(own)
        model.logs[k] = np.log2(direct + back[context] * lower).astype(np.float32)[model.known[k].order]
        model.weights[k] = np.log2(np.maximum(back, 1e-9)).astype(np.float32)[model.contexts[k].order]
    return model


def train(labelled: DataFrame, calibration: DataFrame) -> Model | None:
    """Rows text, lang; the model counts all of the first and fits its rejection limits on all of the second.

    None without a labelled text. Languages or lengths that the second lacks reject nothing but texts without letters.
    """
    counts = saved(gram_counts(labelled), "grams")
    rows = _order_tables(counts).toPandas()
    if rows.empty:
        return None
    model = _build(rows)
    known = labelled.sparkSession.sparkContext.broadcast(model)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = known.value
        place = {x: i for i, x in enumerate(m.langs)}
        for pdf in batches:
            entropies, n, _ = m.entropies(pdf["text"].tolist())
            mine = np.array([place.get(x, -1) for x in pdf["lang"]], np.int64)
            real = (n > 0) & (mine >= 0)
            h = entropies[np.arange(len(n)), np.maximum(mine, 0)]
            yield pd.DataFrame({"lang": pdf["lang"], "size": [int(x).bit_length() for x in n], "h": h})[real]

    found = calibration.select("lang", "text").where("lang is not null").mapInPandas(measure, "lang string, size int, h double")
    found = found.groupBy("lang", "size").agg(F.count("*").alias("n"), F.avg("h").alias("mean"), F.stddev_pop("h").alias("spread")).collect()
    for lang in model.langs:
        mine = [r for r in found if r["lang"] == lang]
        for size in range(64):
            near = sorted(mine, key=lambda r: (abs(r["size"] - size), r["size"]))
            best = next((r for r in near if r["n"] >= 5), None)
            if best:  # shorter texts vary more: their spread grows as the root of the length ratio
                model.limits[lang, size] = best["mean"], best["spread"] * 2 ** (max(0, best["size"] - size) / 2)
    return model


RESULT = "lang_pred string, score double, cross_entropy double, rejected boolean"


def predicted(text, model: Model | None, spark: SparkSession):
    """A struct column: lang_pred, score (0 to 1), cross_entropy (bits), rejected.

    The language of the least cross-entropy; ties to the first by name. Its score is the share of its likelihood where a
    text counts as 64 symbols at most. Null texts and texts without letters, and all texts if there is no model, are
    `und`, score 0 and rejected. Others are rejected over the calibrated limit of their language and length.
    """
    known = spark.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def of(texts: pd.Series) -> pd.DataFrame:
        m, rows = known.value, []
        if m is None:
            return pd.DataFrame([("und", 0.0, None, True)] * len(texts), columns=["lang_pred", "score", "cross_entropy", "rejected"])
        entropies, n, letters = m.entropies(texts.tolist())
        for h, size, some in zip(entropies, n, letters):
            if not some:
                rows.append(("und", 0.0, None, True))
                continue
            best = int(np.argmin(h))
            share = 1 / np.exp2((h[best] - h) * min(int(size), 64)).sum()
            rows.append((m.langs[best], float(min(share, 1.0)), float(h[best]), bool(h[best] > m.limit(m.langs[best], size))))
        return pd.DataFrame(rows, columns=["lang_pred", "score", "cross_entropy", "rejected"])

    return of(text)


def split_model(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """Trained on the labelled rows of docs outside the held-out quarter (crc32 of the id mod 4 is 2)."""
    crc = F.crc32(F.col(doc_id).cast("string"))
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang"), crc.alias("crc")).where("lang is not null and text is not null and crc % 4 != 2")
    return train(rows.where(f"crc % {CALIBRATION_MOD} != 1"), rows.where(f"crc % {CALIBRATION_MOD} = 1"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each whole text by models of the rows outside the held-out quarter. Null and letterless texts are und with score 0; repeated rows are rows of their own; an empty table gives none."""
    docs = table(spark, sf_dir, "documents")
    found = predicted(F.col("text"), split_model(docs), spark).alias("p")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out")
    return docs.select("doc_id", held, found).select("doc_id", "held_out", "p.*")
