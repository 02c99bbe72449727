"""Text expressions: each takes and returns a Column."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

WORD = r"[\p{L}\p{N}_]+"


#: Fixed value: white space as the strip of a text takes it.
BLANK = r"[\x09-\x0D\x1C-\x20\x85\p{Z}]"


def count_words(x: Column) -> Column:
    """Runs of letters, digits and underscores; 0 for null and empty."""
    return F.coalesce(F.regexp_count(x, F.lit(WORD)), F.lit(0))


def without_nul(x: Column) -> Column:
    return F.replace(x, F.lit("\x00"), F.lit(""))


def without_nul_in(df: DataFrame) -> DataFrame:
    """NUL bytes removed in every string column."""
    return df.select(*[without_nul(F.col(f"`{c}`")).alias(c) if t == "string" else F.col(f"`{c}`") for c, t in df.dtypes])


def squeezed(x: Column) -> Column:
    """Trimmed, runs of white space as one space; null gives the empty text."""
    return F.coalesce(F.trim(F.regexp_replace(x, r"(?U)\s+", " ")), F.lit(""))


def name_case(x: Column) -> Column:
    """Words, parted by hyphens or spaces, with a capital first letter and the rest in lower case; empty words go."""
    capital = lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 2**30)))
    words = lambda part: F.array_join(F.transform(F.filter(F.split(part, " "), lambda w: w != ""), capital), " ")
    return F.array_join(F.filter(F.transform(F.split(squeezed(x), "-"), words), lambda p: p != ""), "-")


@F.pandas_udf(StringType())
def without_accents(xs: pd.Series) -> pd.Series:
    """NFD without combining marks."""
    return xs.map(lambda x: None if x is None else "".join(c for c in unicodedata.normalize("NFD", x) if not unicodedata.combining(c)))


@F.pandas_udf(StringType())
def composed(xs: pd.Series) -> pd.Series:
    """NFC."""
    return xs.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def comparable(x: Column) -> Column:
    """Lower case without accents, only a-z, 0-9 and single spaces."""
    kept = F.regexp_replace(F.lower(without_accents(F.coalesce(x, F.lit("")))), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def for_embedding(x: Column, most: int = 8000) -> Column:
    """NUL, CR, LF and TAB as spaces, single spaces, cut to `most` characters."""
    spaced = F.translate(F.coalesce(x, F.lit("")), "\x00\r\n\t", "    ")
    return F.substring(F.trim(F.regexp_replace(spaced, " +", " ")), 1, most)


def is_readable(x: Column) -> Column:
    """Ten characters or more, 70 % of them printable, 30 % odd ones at most."""
    n = F.length(x)
    printable = F.regexp_count(x, F.lit(r"[\p{L}\p{N}\p{P}\p{S}\p{Zs}\n\r\t]"))
    odd = F.regexp_count(x, F.lit(r"[^\p{L}\p{N}\p{P}\p{S}\s]"))
    return F.coalesce((n >= 10) & (printable >= 0.7 * n) & (odd <= 0.3 * n), F.lit(False))


def stripped(x: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", "")


def chunks(x: Column, size: int = 1000, overlap: int = 200) -> Column:
    """array of struct(chunk_id, start_char, end_char, text): windows of `size`, each `overlap` into the one before; none for a blank text."""
    if overlap >= size:
        raise ValueError("overlap must be less than size")
    step = size - overlap
    text = stripped(without_nul(F.coalesce(x, F.lit(""))))

    def windows(t: Column) -> Column:
        n = t["n"]
        return F.transform(
            F.sequence(F.lit(0), F.ceil(n / step).cast("int") - 1),
            lambda i: F.struct(i.alias("chunk_id"), (i * step).alias("start_char"), F.least(i * step + size, n).alias("end_char"), F.substring(t["text"], i * step + 1, F.lit(size)).alias("text")),
        )

    # the stripped text and its length are bound to a name, else they would be worked out again for every window
    held = F.transform(F.array(text), lambda t: F.struct(t.alias("text"), F.length(t).alias("n")))
    return F.flatten(F.transform(F.filter(held, lambda t: t["n"] > 0), windows))


def kept_words(x: Column, stop_words: tuple[str, ...] = ()) -> Column:
    """Lower-case words of two characters and more, without stop words."""
    words = F.regexp_extract_all(F.lower(x), F.lit(r"(?U)\w\w+"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


def search_all(terms: str, *columns: Column) -> Column:
    """Every term (parted by white space) is in some column, whatever the case."""
    out = F.lit(True)
    for term in terms.split():
        one = F.lit(False)
        for c in columns:
            one = one | F.coalesce(F.contains(F.lower(c), F.lit(term.lower())), F.lit(False))
        out = out & one
    return out
