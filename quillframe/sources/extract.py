"""Text of office files, from their bytes; scans and images go to a provider."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.files import SUPPORTED
from ..functions.text import count_words

#: Fewer words than this in a document's own text, and it is taken for a scan.
SCAN_WORDS = 50
Ocr = Callable[[bytes, str], str]


def _xml(content: bytes, member: str) -> ElementTree.Element:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return ElementTree.fromstring(z.read(member))


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _text(e: ElementTree.Element) -> str:
    return "".join(e.itertext())


def plain(content: bytes) -> str:
    return content.decode("utf-8", "ignore")


def docx(content: bytes) -> str:
    out = []
    for p in _xml(content, "word/document.xml").iter():
        if _local(p.tag) == "p":
            out.append("".join(e.text or "" if _local(e.tag) == "t" else "\t" if _local(e.tag) == "tab" else "\n" if _local(e.tag) == "br" else "" for e in p.iter()))
    return "\n".join(out)


def odt(content: bytes) -> str:
    return "\n".join(t for e in _xml(content, "content.xml").iter() if _local(e.tag) in ("p", "h") and (t := _text(e).strip()))


def _markdown(sheets: list[tuple[str, list[list[str]]]]) -> str:
    """A title and a table for each sheet; blank rows and blank columns on the right go."""
    out = []
    for name, rows in sheets:
        rows = [r for r in rows if any(c.strip() for c in r)]
        width = max((i + 1 for r in rows for i, c in enumerate(r) if c.strip()), default=0)
        if not rows:
            continue
        lines = ["| " + " | ".join(re.sub(r"\s+", " ", c).strip() for c in (r + [""] * width)[:width]) + " |" for r in rows]
        out.append("\n".join([f"## {name}", lines[0], "|" + " --- |" * width, *lines[1:]]))
    return "\n\n".join(out)


def ods(content: bytes) -> str:
    sheets = []
    for t in (e for e in _xml(content, "content.xml").iter() if _local(e.tag) == "table"):
        attr = lambda e, k: next((v for a, v in e.attrib.items() if _local(a) == k), None)
        rows = []
        for r in (e for e in t.iter() if _local(e.tag) == "table-row"):
            cells: list[str] = []
            for c in r:
                if _local(c.tag) == "covered-table-cell":
                    cells += ["#"] * min(int(attr(c, "number-columns-repeated") or 1), 64)
                elif _local(c.tag) == "table-cell":
                    text = "\n".join(_text(p) for p in c if _local(p.tag) == "p")
                    n = int(attr(c, "number-columns-repeated") or 1)
                    cells += [text] * (n if text else min(n, 64))
            rows.append(cells)
        sheets.append((attr(t, "name") or "", rows))
    return _markdown(sheets)


def xlsx(content: bytes) -> str:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = [_text(e) for e in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in names else []
        titles = [e.attrib.get("name", "") for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e.tag) == "sheet"]
        parts = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
        sheets = []
        for title, part in zip(titles, parts):
            rows = []
            for r in (e for e in ElementTree.fromstring(z.read(part)).iter() if _local(e.tag) == "row"):
                cells: dict[int, str] = {}
                for c in r:
                    letters = re.match(r"[A-Z]*", c.attrib.get("r", ""))[0]
                    at = 0
                    for x in letters:
                        at = 26 * at + ord(x) - 64
                    value = next((e.text or "" for e in c if _local(e.tag) == "v"), None)
                    text = _text(c) if c.attrib.get("t") == "inlineStr" else shared[int(value)] if c.attrib.get("t") == "s" and value else value or ""
                    cells[(at or len(cells) + 1) - 1] = text
                rows.append([cells.get(i, "") for i in range(max(cells, default=-1) + 1)])
            sheets.append((title, rows))
    return _markdown(sheets)


READERS: dict[str, Callable[[bytes], str]] = {"txt": plain, "docx": docx, "odt": odt, "ods": ods, "xlsx": xlsx}


def extracted(rows: DataFrame, content: str = "content", extension: str = "extension", ocr: Ocr | None = None) -> DataFrame:
    """rows with text, is_ocr, error and nb_mot.

    Kinds without a reader here, and texts of under SCAN_WORDS words of paged kinds, go to `ocr` (bytes, kind to text), if there is one.
    Unsupported kinds and broken files have an error and a null text.
    """

    @F.pandas_udf("text string, is_ocr boolean, error string")
    def of(contents: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        out = []
        for data, kind in zip(contents, kinds):
            if kind not in SUPPORTED:
                out.append((None, False, f"unsupported: {kind}"))
                continue
            try:
                data = bytes(data or b"")
                text, scanned = (READERS[kind](data), False) if kind in READERS and data else ("", False)
                if data and kind not in READERS and ocr:
                    text, scanned = ocr(data, kind), True
                out.append((text.replace("\x00", ""), scanned, None))
            except Exception as e:  # a broken file is a result of its row
                out.append((None, False, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["text", "is_ocr", "error"])

    found = rows.withColumn("__found", of(F.col(content), F.col(extension)))
    return found.select(*rows.columns, "__found.*").withColumn("nb_mot", count_words(F.col("text")))
