"""Kinds of compound documents and archives, made here byte by byte."""

from __future__ import annotations

import io
import struct
import zipfile

from pyspark.sql import functions as F

from quillframe.functions import containers

FREE, END = 0xFFFFFFFF, 0xFFFFFFFE


def compound(streams, filler=0, size=512, nested=()):
    """A compound document: streams at the top as a degenerate sibling tree, `nested` inside a storage; filler sectors stand between the directory's, out of order."""
    shift = size.bit_length() - 1
    entries = [("Root Entry", 5, FREE, FREE, 1 if streams or nested else FREE)]
    names = [(n, 2) for n in streams] + ([("ObjectPool", 1)] if nested else [])
    for i, (n, kind) in enumerate(names):
        after = len(entries) + 1 if i + 1 < len(names) else FREE
        entries.append((n, kind, FREE, after, len(names) + 1 if kind == 1 else FREE))
    for i, n in enumerate(nested):
        entries.append((n, 2, FREE, len(entries) + 1 if i + 1 < len(nested) else FREE, FREE))
    raw = b"".join(n.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBBIII", 2 * len(n) + 2, k, 1, left, right, child) + bytes(48) for n, k, left, right, child in entries)
    raw += bytes(-len(raw) % size)
    parts = [raw[i : i + size] for i in range(0, len(raw), size)]
    n_sectors = len(parts) + filler
    n_fat = 1
    while n_fat * (size // 4) < n_sectors + n_fat + max(0, -(-(n_fat - 109) // (size // 4 - 1))):
        n_fat += 1
    n_difat = max(0, -(-(n_fat - 109) // (size // 4 - 1)))
    total = n_sectors + n_fat + n_difat
    fats, difats = list(range(n_sectors, n_sectors + n_fat)), list(range(n_sectors + n_fat, total))
    places = [filler + i for i in range(len(parts))][::-1]  # the directory goes backwards
    fat = [FREE] * (n_fat * (size // 4))
    for i, p in enumerate(places):
        fat[p] = places[i + 1] if i + 1 < len(places) else END
    body = [bytes(size)] * total
    for p, part in zip(places, parts):
        body[p] = part
    packed = struct.pack(f"<{len(fat)}I", *fat)
    for i, p in enumerate(fats):
        body[p] = packed[i * size : (i + 1) * size]
    for i, p in enumerate(difats):
        mine = fats[109 + i * (size // 4 - 1) : 109 + (i + 1) * (size // 4 - 1)]
        body[p] = struct.pack(f"<{size // 4}I", *mine, *[FREE] * (size // 4 - 1 - len(mine)), difats[i + 1] if i + 1 < len(difats) else END)
    head = bytes.fromhex("D0CF11E0A1B11AE1") + bytes(16) + struct.pack("<HHHHH", 62, 3, 0xFFFE, shift, 6) + bytes(6) + struct.pack("<IIIIIIIIII", 0, n_fat, places[0], 0, 4096, END, 0, difats[0] if difats else END, n_difat, 0)[: 36]
    head += struct.pack("<109I", *(fats + [FREE] * 109)[:109])
    assert len(head) == 512
    return head.ljust(size, b"\0") + b"".join(body)


def archive(members, stored=("mimetype",), prefix=b"", comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name), data, zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED)
        z.comment = comment
    return prefix + out.getvalue()


def kinds(spark, rule, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, name string, content binary")
    return [r.k for r in df.select("i", rule(F.col("name"), F.col("content")).alias("k")).orderBy("i").collect()]


ODT = "application/vnd.oasis.opendocument."


def test_compound_documents_by_directory(spark):
    many = [f"s{i}" for i in range(30)]
    rows = [
        (compound(["WordDocument", "1Table"]), "doc"), (compound(["Workbook"]), "xls"), (compound(["x", "Book"]), "xls"), (compound(["PowerPoint Document"], size=4096), "ppt"),
        (compound(["__properties_version1.0"]), "msg"), (compound(["a", "__substg1.0_0037001F"]), "msg"), (compound(["other"]), "unknown"), (compound([]), "unknown"),
        (compound([*many, "Workbook"], filler=7), "xls"),  # a directory of several sectors, back to front
        (compound(["Workbook"], nested=["WordDocument"]), "xls"), (compound(["other"], nested=["WordDocument"]), "unknown"),  # what is inside a storage does not count
        (compound(["WordDocument"], filler=14_000), "doc"),  # an allocation table of over 109 sectors
        (compound(["WordDocument"])[:700], "unknown"), (bytes.fromhex("D0CF11E0A1B11AE1"), "unknown"), (compound(["WordDocument"])[:76] + b"\xff" * 436, "unknown"),
    ]
    got = kinds(spark, lambda name, content: containers.kind_of(content), [("a.xls", c) for c, _ in rows])
    assert got == [k for _, k in rows]


def test_archives_by_members(spark):
    rows = [
        (archive([("[Content_Types].xml", "x"), ("word/document.xml", "y" * 5000)]), "docx"), (archive([("xl/workbook.xml", "")], comment=b"c" * 300), "xlsx"), (archive([("ppt/presentation.xml", "")], prefix=b""), "pptx"),
        (archive([("mimetype", ODT + "text"), ("content.xml", "")]), "odt"), (archive([("mimetype", ODT + "spreadsheet")]), "ods"), (archive([("a", "b"), ("mimetype", ODT + "presentation")]), "odp"),
        (archive([("META-INF/manifest.xml", "")]), "odt"), (archive([("a.txt", "word/document.xml")], stored=("a.txt",)), "zip"), (archive([]), "zip"), (b"PK\x03\x04 cut", "zip"),
        (archive([(f"f{i}", "") for i in range(400)] + [("word/document.xml", "")]), "docx"), (archive([("é/word/document.xml", "")]), "docx"),
    ]
    assert kinds(spark, lambda name, content: containers.kind_of(content), [(None, c) for c, _ in rows]) == [k for _, k in rows]
    names = spark.createDataFrame([(archive([("a", "x"), ("b/c", "yy")]),)], "c binary").select(containers.archive_members(F.col("c")).alias("m")).first().m
    assert [(m.name, m.size > 0) for m in names] == [("a", True), ("b/c", True)]


def test_other_kinds(spark):
    rows = [(b"%PDF-1.4", "pdf"), (b"\xff\xd8\xff\xe0", "jpg"), (b"\x89PNG\r\n", "png"), (b"GIF89a", "gif"), (b"BM1", "bmp"), (b"Rar!\x1a", "rar"), (b"7z\xbc\xaf", "7z"), (b"\x1f\x8b\x08", "gz"), (b"plain \xe9 text\n", "txt"), (b"", "unknown"), (None, "unknown"), (b"\x00\x01\x02", "unknown")]
    assert kinds(spark, lambda name, content: containers.kind_of(content), [(None, c) for c, _ in rows]) == [k for _, k in rows]


def test_scores_of_patterns(spark):
    ole = bytes.fromhex("D0CF11E0")
    rows = [
        ("a.XLS", ole, "xls"), ("x/a.doc", ole, "doc"), ("a.ppt", ole, "ppt"), ("Thumbs.db", ole, "db"), ("a.msg", ole, "msg"), ("a.msg", ole + b"%PDF", "pdf"), ("a.msg", ole + b"." * 1200 + b"%PDF", "msg"),
        (None, ole, "doc"), ("a", ole + b"BOUNDSHEET", "xls"), ("a", ole + b"WordDocument", "doc"), ("a", ole + b"PowerPoint", "ppt"), ("a", ole + b"Sheet" * 2 + b"WordDocument", "doc"), ("a", ole + b"Sheet" * 3 + b"WordDocument", "xls"),
        ("a", ole + b"Message" + b"BOUNDSHEET" * 9, "msg"), ("a", ole + b"Mail" + b"Sender", "msg"), ("a", ole + b"Mail", "doc"), ("a", ole + b"Outlook %PDF", "pdf"), ("a", b"%PDF", "pdf"), ("a", None, "unknown"), ("a", archive([("xl/workbook.xml", "")]), "xlsx"),
    ]
    assert kinds(spark, containers.legacy_kind, [r[:2] for r in rows]) == [k for *_, k in rows]
