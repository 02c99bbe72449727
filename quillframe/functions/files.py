"""File names, hashes and kinds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: First bytes (hex) of each kind of file.
SIGNATURES = [
    ("25504446", "pdf"), ("FFD8FF", "jpg"), ("89504E470D0A1A0A", "png"), ("474946383761", "gif"), ("474946383961", "gif"),
    ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("504B0304", "zip"), ("504B0506", "zip"), ("D0CF11E0A1B11AE1", "ole"),
    ("377ABCAF271C", "7z"), ("526172211A07", "rar"), ("1F8B", "gz"), ("7B5C727466", "rtf"), ("424D", "bmp"),
]
SUPPORTED = ("pdf", "docx", "doc", "odt", "txt", "png", "jpg", "jpeg", "tiff", "tif", "xlsx", "xls", "ods")


def content_hash(x: Column) -> Column:
    return F.sha2(x, 256)


def order_number(name: Column) -> Column:
    """The ten digits that a file name begins with; null without them."""
    return F.nullif(F.regexp_extract(name, r"^\d{10}", 0), F.lit(""))


def size_in_mb(size: Column) -> Column:
    return F.bround(size / 1e6, 2)


def api_size(x: Column) -> Column:
    """The size as a number; -1 for what is not one."""
    return F.coalesce(F.when(F.trim(x).rlike(r"^[+-]?\d+$"), F.trim(x).try_cast("long")), F.lit(-1).cast("long"))


def name_extension(name: Column) -> Column:
    """Lower-case extension of up to ten characters; empty without one."""
    e = F.lower(F.regexp_extract(name, r"\.([^./\\]+)$", 1))
    return F.when(F.length(e) <= 10, e).otherwise(F.lit(""))


def content_extension(content: Column) -> Column:
    """Kind by the first bytes; `unknown` for others."""
    out = F.lit("unknown")
    for hexed, kind in reversed(SIGNATURES):
        out = F.when(F.hex(F.substring(content, 1, len(hexed) // 2)) == hexed, F.lit(kind)).otherwise(out)
    return out


def reconciled_extension(name: Column, content: Column) -> Column:
    """The name's where it agrees or the content's is unknown; else the content's."""
    return F.when(name == content, name).when(F.coalesce(name, F.lit("")) == "", content).when(content == "unknown", name).otherwise(content)


@F.pandas_udf(StringType())
def safe_name(xs: pd.Series) -> pd.Series:
    """Slashes as underscores, lower-case extension, ASCII but for é è ê à; over 250 characters cut with a mark."""
    import unicodedata

    kept = "éèêàÉÈÊÀ"  # fixed value: the accented letters that stay

    def plain(c: str) -> str:
        return c if c in kept or c.isascii() else unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()

    def one(x: str | None) -> str | None:
        if x is None:
            return None
        x = unicodedata.normalize("NFC", x).replace("/", "_").replace("\\", "_")
        stem, dot, ext = x.rpartition(".")
        stem, ext = (stem, dot + ext.lower()) if dot else (ext, "")
        stem, ext = "".join(map(plain, stem)), "".join(map(plain, ext))
        over = len(stem) + len(ext) > 250
        return stem[: 250 - len(ext) - len("[trunc]")] + "[trunc]" + ext if over else stem + ext

    return xs.map(one)


def path_depth(path: Column) -> Column:
    return F.size(F.split(path, "/"))
