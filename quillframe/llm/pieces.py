"""SentencePiece encoding and decoding: N best segmentations by Viterbi scores and backward A-star search."""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

BEST = 4
#: A character without a piece is its UTF-8 bytes, all of them so much below the least score.
BYTE_PENALTY = 10.0
#: Units (words) that a worker remembers.
CACHE_UNITS = 1_000_000
SPACE = "\u2581"

_models: dict[str, Pieces] = {}


class Pieces:
    """The pieces and scores of a model file, and the lattice over them.

    A text is the sum of units that no piece crosses: a unit ends before each space that doesn't follow one (if spaces stand
    only at the starts of pieces) and around each character that no longer piece has. So the N best of a
    text follow from the best of each unit, and from the N best of the N - 1 units that lose least by their second choice.
    """

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text_of = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.byte_of = {i: int(x[3:5], 16) for i, x in enumerate(self.text_of) if sp.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.text_of[i]: i for i in plain}
        self.scores = {x: sp.get_score(i) for x, i in self.ids.items()}
        #: Score of each piece, and minus infinity for what only begins one.
        self.prefixes = {x[:n]: self.scores.get(x[:n], -float("inf")) for x in self.ids for n in range(1, len(x) + 1)}
        self.id_bytes = {x: np.uint32(i).tobytes() for x, i in self.ids.items()}
        self.bytes_score = min(self.scores.values(), default=0.0) - BYTE_PENALTY
        joined = {c for x in self.ids if len(x) > 1 for c in x}
        inside = "".join(map(re.escape, sorted(joined - {SPACE})))
        whole = all(SPACE not in x.lstrip(SPACE) for x in self.ids)
        self.unit = re.compile(f"{SPACE}*[{inside}]+|{SPACE}+|[^{inside}{SPACE}]" if whole else f"[{inside}{SPACE}]+|[^{inside}{SPACE}]")
        self.shown = [x.replace(SPACE, " ") for x in self.text_of]
        self.is_byte = np.array([i in self.byte_of for i in range(len(self.text_of))])
        self._forget()

    def _forget(self) -> None:
        """Drops what is known of units. Entry 0 stands for the character SPACE, which is its bytes."""
        self.place: dict[str | None, int] = {None: 0}
        self.unit_ids = [self.bytes_of(SPACE) if self.byte_ids else b""]
        self.totals, self.losses = np.full(1 << 12, self.bytes_score), np.full(1 << 12, np.inf)
        self.options: dict[str, list[tuple[float, bytes]]] = {}

    def _learn(self, unit: str) -> int:
        ids, score, loss = self.best(unit)
        i = self.place[unit] = len(self.unit_ids)
        self.unit_ids.append(ids)
        if i == len(self.totals):
            self.totals, self.losses = np.append(self.totals, np.zeros(i)), np.append(self.losses, np.zeros(i))
        self.totals[i], self.losses[i] = score, loss
        return i

    def edges(self, unit: str) -> list[list[tuple[int, float, str]]]:
        """For each end, the pieces that end there: (start, score, piece)."""
        into: list[list] = [[] for _ in range(len(unit) + 1)]
        scores, starts = self.scores, self.prefixes
        for a, c in enumerate(unit):
            if c not in scores:
                into[a + 1].append((a, self.bytes_score, c))
            for b in range(a + 1, len(unit) + 1):
                piece = unit[a:b]
                if piece in scores:
                    into[b].append((a, scores[piece], piece))
                elif piece not in starts:
                    break
        return into

    def ids_of(self, pieces: list[str]) -> bytes:
        known = self.id_bytes
        return b"".join([known[p] if p in known else self.bytes_of(p) for p in pieces])

    def bytes_of(self, char: str) -> bytes:
        return np.array([self.byte_ids[b] for b in char.encode("utf-8", "replace")], "<u4").tobytes()

    def best(self, unit: str) -> tuple[bytes, float, float]:
        """Ids and score of the best segmentation, and what the second best loses (infinite if there is none)."""
        size, none = len(unit), -float("inf")
        first, second, back = [0.0] + [none] * size, [none] * (size + 1), [0] * (size + 1)
        get = self.prefixes.get
        for a in range(size):
            one, two, b = first[a], second[a], a + 1
            score = self.scores.get(unit[a], self.bytes_score)
            while score is not None:
                if score != none:
                    x, y, best = one + score, two + score, first[b]
                    if x > best:
                        first[b], back[b] = x, a
                        second[b] = best if best > y else y
                    elif x > second[b]:
                        second[b] = x
                if b == size:
                    break
                b += 1
                score = get(unit[a:b])
        pieces, at = [], len(unit)
        while at:
            pieces.append(unit[back[at] : at])
            at = back[at]
        return self.ids_of(pieces[::-1]), first[-1], first[-1] - second[-1]

    def n_best(self, unit: str, n: int) -> list[tuple[float, bytes]]:
        """Scores and ids of the n best segmentations, best first.

        The forward scores bound exactly what a partial path from the end can still reach, so paths leave the queue in order of their totals.
        """
        into = self.edges(unit)
        forward = [0.0]
        for found in into[1:]:
            forward.append(max((forward[a] + s for a, s, _ in found), default=-np.inf))
        queue, made, out = [(-forward[-1], 0, len(unit), 0.0, None)], 1, []
        while queue and len(out) < n:
            total, _, at, done, tail = heapq.heappop(queue)
            if not at:
                pieces = []
                while tail:
                    pieces.append(tail[0])
                    tail = tail[1]
                out.append((-total, self.ids_of(pieces)))
                continue
            for a, score, piece in into[at]:
                heapq.heappush(queue, (-(done + score + forward[a]), made, a, done + score, (piece, tail)))
                made += 1
        return out

    def encode(self, text: str | None, n: int) -> list[tuple[float, bytes]]:
        """Scores and ids (uint32 little-endian) of the n best segmentations of the whole text, best first; one empty one for an empty text.

        Spaces are SPACE, with one before the text; the character SPACE itself is its bytes.
        """
        if not text:
            return [(0.0, b"")]
        units: list[str | None] = []
        for i, part in enumerate(text.split(SPACE)):
            units += [None] * (i > 0) + self.unit.findall((SPACE if not i else "") + part.replace(" ", SPACE))
        if len(self.place) > CACHE_UNITS:
            self._forget()
        places = list(map(self.place.get, units))
        if None in places:
            places = [self.place.get(u) or self._learn(u) if u is not None else 0 for u in units]
        at = np.array(places)
        parts, total, losses = list(map(self.unit_ids.__getitem__, places)), float(self.totals[at].sum()), self.losses[at]
        least = np.flatnonzero(losses <= np.partition(losses, n - 2)[n - 2]) if len(losses) > n - 1 > 0 else np.arange(len(losses))
        least = least[np.argsort(losses[least], kind="stable")][: n - 1]
        results: list[tuple[float, dict[int, bytes]]] = [(0.0, {})]
        for i in least[losses[least] < np.inf].tolist():
            options = self.options.get(units[i])
            if options is None or len(options) < n:
                options = self.options[units[i]] = self.n_best(units[i], n)
            results = heapq.nsmallest(n, ((loss + options[0][0] - score, taken if not k else taken | {i: ids}) for loss, taken in results for k, (score, ids) in enumerate(options[:n])), key=lambda r: r[0])
        out = []
        for loss, taken in results:
            mine = parts
            if taken:
                mine = parts.copy()
                for at, ids in taken.items():
                    mine[at] = ids
            out.append((total - loss, b"".join(mine)))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """The text of the ids of any segmentation: bytes are put together, SPACEs are spaces, the one before the text goes."""
        whole = self.is_byte[ids]
        if not whole.any():
            return "".join(map(self.shown.__getitem__, ids.tolist()))[1:]
        cuts = np.flatnonzero(np.diff(whole)) + 1
        out = []
        for some, bytewise in zip(np.split(ids, cuts), whole[np.append(0, cuts)]):
            if bytewise:
                out.append(bytes(map(self.byte_of.__getitem__, some.tolist())).decode("utf-8", "replace"))
            else:
                out.append("".join(map(self.shown.__getitem__, some.tolist())))
        return "".join(out)[1:]


def pieces(path: str) -> Pieces:
    if path not in _models:
        _models[path] = Pieces(path)
    return _models[path]


def encoded(text, path: str, n: int = BEST):
    """A column, array of struct(score double, ids array<int>): the n best segmentations of each text, best first.

    A segmentation's score is the sum of its pieces' scores in the model file; those of a model of merges are minus the ranks of its
    merges, so that the best has the least ranks, which is not always what the merges give. Of equal scores, the one whose changed units
    stand first comes first. Rows are on their own: repeats give the same, an empty table none. Null and empty texts have one segmentation without ids. Texts with fewer segmentations have fewer. Scores are the pieces' sums.
    """

    @F.pandas_udf("array<struct<score:double,ids:array<int>>>")
    def of(texts: pd.Series) -> pd.Series:
        model = pieces(path)
        return pd.Series([[{"score": s, "ids": np.frombuffer(ids, "<u4").astype(np.int32)} for s, ids in model.encode(x, n)] for x in texts])

    return of(text)


def decoded(ids, path: str):
    """A column of texts of arrays of ids; null for null."""

    @F.pandas_udf("string")
    def of(rows: pd.Series) -> pd.Series:
        model = pieces(path)
        return pd.Series([None if x is None else model.decode(np.asarray(x)) for x in rows])

    return of(ids)


DIGEST = "n_pieces long, ids_crc32 long, score double, best_scores array<double>, best_crc32 array<long>, decoded_sha256 string"


def digests(text, path: str, n: int = BEST):
    """A struct column of what encode and decode give, without the ids: the counts, CRCs and scores, and the SHA-256 of the worst one decoded."""

    @F.pandas_udf(DIGEST)
    def of(texts: pd.Series) -> pd.DataFrame:
        model, rows = pieces(path), []
        for x in texts:
            found = model.encode(x, n)
            crcs = [zlib.crc32(ids) for _, ids in found]
            back = model.decode(np.frombuffer(found[-1][1], "<u4"))
            rows.append((len(found[0][1]) // 4, crcs[0], found[0][0], [s for s, _ in found], crcs, hashlib.sha256(back.encode("utf-8", "replace")).hexdigest()))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")])

    return of(text)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, scores and checksums of the four best segmentations of each whole text, and the hash of the last one decoded. Null and empty texts have one, without ids; repeated rows stay; an empty table gives none."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", digests(F.col("text"), public_tokenizers.path("piece_bpe_32k.model")).alias("d")).select("doc_id", "d.*")
