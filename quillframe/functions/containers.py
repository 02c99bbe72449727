"""Kinds of files by what is in them: compound documents by their directories, archives by their member lists, weighted patterns. Expressions over binary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

# First bytes (hex) of each kind, in order; patterns that tell kinds of compound documents apart, with their weights; members and media types of archives.
MAGIC = [
    ("25504446", "pdf"), ("504B0304", "zip"), ("504B0506", "zip"), ("504B0708", "zip"), ("FFD8FF", "jpg"), ("89504E47", "png"), ("47494638", "gif"), ("424D", "bmp"), ("D0CF11E0", "ole2"),
    ("00000100", "ico"), ("52494646", "avi"), ("4F676753", "ogg"), ("494433", "mp3"), ("FFFB", "mp3"), ("52617221", "rar"), ("377ABCAF", "7z"), ("1F8B08", "gz"), ("425A68", "bz2"),
]
PATTERNS = {
    "xls": {
        "Workbook": 10, "Book": 5, "Excel": 8, "Worksheet": 10, "xl/": 5, "xl/workbook": 15, "Microsoft Excel": 12, "BIFF": 8, "BOUNDSHEET": 15, "EXTERNBOOK": 10,
        "FONT": 3, "FORMAT": 3, "LABEL": 5, "NUMBER": 3, "STRING": 3, "XLS": 5, "Sheet": 8, "Cell": 5, "Row": 3, "Column": 3,
    },
    "msg": {"Message": 10, "Outlook": 8, "MSG": 5, "Mail": 5, "Email": 5, "Attachment": 3, "Recipient": 3, "Sender": 3, "Subject": 3},
    "doc": {"WordDocument": 15, "Document": 5, "Microsoft Word": 12, "word/": 5, "word/document": 15, "DOC": 5, "FIB": 10, "Table": 3, "1Table": 8, "0Table": 8, "Paragraph": 5, "Character": 3, "Section": 3},
    "ppt": {"PowerPoint": 12, "Presentation": 10, "ppt/": 5, "ppt/presentation": 15, "PPT": 5, "Current User": 3, "Pictures": 3, "Slide": 8},
}
MEMBERS = [("word/document.xml", "docx"), ("xl/workbook.xml", "xlsx"), ("ppt/presentation.xml", "pptx")]
MEDIA = [("application/vnd.oasis.opendocument.text", "odt"), ("application/vnd.oasis.opendocument.spreadsheet", "ods"), ("application/vnd.oasis.opendocument.presentation", "odp")]
#: Over this score a compound document is a message.
MESSAGE_SCORE = 5

_NO_NAMES = "cast(array() as array<string>)"


def _number(content: Column, at: Column, size: int) -> Column:
    """The little-endian number of `size` bytes at a place (from 0); null beyond the end."""
    digits = F.concat(*[F.lpad(F.hex(F.substring(content, (at + i + 1).try_cast("int"), F.lit(1))), 2, "0") for i in reversed(range(size))])
    return F.when((at >= 0) & (at + size <= F.octet_length(content)), F.conv(digits, 16, 10).cast("long"))


def _bytes(content: Column, at: Column, size: Column) -> Column:
    return F.substring(content, (at + 1).try_cast("int"), size.try_cast("int"))


def latin(content: Column) -> Column:
    """Bytes as a text of one character each."""
    return F.decode(content, "ISO-8859-1")


# Compound documents


def _sectors(content: Column) -> Column:
    """struct(size, fat, entries): sector size, the sectors that hold the allocation table, and the directory's sectors along their chain."""
    size = F.pow(F.lit(2.0), F.least(F.greatest(_number(content, F.lit(30), 2), F.lit(7)), F.lit(16))).cast("long")

    def with_size(s: Column) -> Column:
        per = (s / 4).cast("long")
        head = F.filter(F.transform(F.sequence(F.lit(0), F.lit(108)), lambda i: _number(content, 76 + 4 * i, 4)), lambda x: x < 0xFFFFFFFA)
        # tables of over 109 sectors go on in a chain of sectors that list further ones
        start = F.struct(_number(content, F.lit(68), 4).alias("at"), F.expr("cast(array() as array<bigint>)").alias("found"))

        def more(acc: Column, _: Column) -> Column:
            base = (acc["at"] + 1) * s
            items = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), per - 2), lambda i: _number(content, base + 4 * i, 4)), lambda x: x < 0xFFFFFFFA)
            usable = acc["at"] < 0xFFFFFFFA
            return F.struct(F.when(usable, _number(content, base + 4 * (per - 1), 4)).otherwise(acc["at"]).alias("at"), F.when(usable, F.concat(acc["found"], F.coalesce(items, F.expr("cast(array() as array<bigint>)")))).otherwise(acc["found"]).alias("found"))

        listed = F.least(F.coalesce(_number(content, F.lit(72), 4), F.lit(0)), F.octet_length(content) / s).cast("long")
        rest = F.when(listed > 0, F.aggregate(F.sequence(F.lit(1).cast("long"), listed), start, more, lambda acc: acc["found"])).otherwise(F.expr("cast(array() as array<bigint>)"))
        return let(F.concat(head, rest), lambda fat: F.struct(s.alias("size"), fat.alias("fat"), _chain(content, s, fat, _number(content, F.lit(48), 4)).alias("entries")))

    return let(size, with_size)


def _chain(content: Column, size: Column, fat: Column, first: Column) -> Column:
    """Sectors from the first one on, as the allocation table links them; a chain that comes back to itself ends after as many as the file has."""
    per = (size / 4).cast("long")
    start = F.struct(first.alias("at"), F.expr("cast(array() as array<bigint>)").alias("found"))

    def step(acc: Column, _: Column) -> Column:
        held = F.get(fat, (acc["at"] / per).try_cast("int"))
        after = _number(content, (held + 1) * size + (acc["at"] % per) * 4, 4)
        usable = F.coalesce(acc["at"] < 0xFFFFFFFA, F.lit(False))
        return F.struct(F.when(usable, after).otherwise(acc["at"]).alias("at"), F.when(usable, F.array_append(acc["found"], acc["at"])).otherwise(acc["found"]).alias("found"))

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1), (F.octet_length(content) / size).cast("long"))), start, step, lambda acc: acc["found"])


def compound_names(content: Column) -> Column:
    """Names of the streams and storages at the top of a compound document, streams first marked `+`, storages `-`; none where its directory can't be read.

    The directory's sectors are followed through the allocation table, its entries from the root's child through their siblings.
    """

    def walk(d: Column) -> Column:
        places = F.flatten(F.transform(d["entries"], lambda s: F.transform(F.sequence(F.lit(0).cast("long"), (d["size"] / 128).cast("long") - 1), lambda i: (s + 1) * d["size"] + 128 * i)))
        entry = lambda at: F.struct(
            F.decode(_bytes(content, at, F.greatest(F.lit(0), F.least(F.coalesce(_number(content, at + 64, 2), F.lit(2)), F.lit(64)) - 2)), "UTF-16LE").alias("name"),
            _number(content, at + 66, 1).alias("kind"), _number(content, at + 68, 4).alias("left"), _number(content, at + 72, 4).alias("right"), _number(content, at + 76, 4).alias("child"),
        )

        def visit(entries: Column) -> Column:
            start = F.struct(F.array(F.get(entries, F.lit(0))["child"]).alias("open"), F.expr(_NO_NAMES).alias("found"))

            def step(acc: Column, _: Column) -> Column:
                now = F.element_at(acc["open"], -1)
                e = F.get(entries, F.when((now >= 0) & (now < F.size(entries)), now).otherwise(F.lit(-1)).cast("int"))
                rest = F.slice(acc["open"], F.lit(1), F.size(acc["open"]) - 1)
                name = F.concat(F.when(e["kind"] == 2, F.lit("+")).otherwise(F.lit("-")), e["name"])
                moved = F.struct(F.when(e.isNull(), rest).otherwise(F.concat(rest, F.array(e["left"], e["right"]))).alias("open"), F.when(e.isNull(), acc["found"]).otherwise(F.array_append(acc["found"], name)).alias("found"))
                return F.when(F.size(acc["open"]) > 0, moved).otherwise(acc)

            # every entry opens two more, so the walk ends within twice as many steps and one
            return F.aggregate(F.sequence(F.lit(1), 2 * F.size(entries) + 1), start, step, lambda acc: acc["found"])

        return F.when(F.size(places) > 0, let(F.transform(places, entry), visit))

    return F.coalesce(F.when(F.hex(F.substring(content, 1, 4)) == "D0CF11E0", let(_sectors(content), walk)), F.expr(_NO_NAMES))


def office_kind(names: Column) -> Column:
    """doc, xls, ppt or msg by the streams at the top (as compound_names() gives them); `unknown` for others."""
    has = lambda n: F.array_contains(names, f"+{n}")
    message = has("__properties_version1.0") | F.exists(names, lambda n: F.substring(n, 2, 12) == "__substg1.0_")
    return F.when(has("WordDocument"), "doc").when(has("Workbook") | has("Book"), "xls").when(has("PowerPoint Document"), "ppt").when(message, "msg").otherwise("unknown")


def pattern_score(text: Column, patterns: dict[str, int]) -> Column:
    """Sum over the patterns of their weight times how often the text has them, each counted without overlaps."""
    n = lambda p: (F.length(text) - F.length(F.replace(text, F.lit(p), F.lit("")))) / len(p)
    out = F.lit(0.0)
    for p, weight in patterns.items():
        out = out + n(p) * weight
    return out


def legacy_office_kind(name: Column, content: Column) -> Column:
    """Of a compound document: by its name's ending if that is known, else by the scores of patterns; doc where nothing is found."""
    low = F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"(?s)([^/]*)$", 1))
    in_message = lambda whole: F.when(F.contains(whole, F.lit("%PDF")), "pdf").otherwise("msg")

    def scored(text: Column) -> Column:
        scores = F.struct(*[pattern_score(text, p).alias(kind) for kind, p in PATTERNS.items()])
        return let(scores, lambda s: F.when(s["msg"] > MESSAGE_SCORE, in_message(text)).when((s["xls"] > s["doc"]) & (s["xls"] > s["ppt"]), "xls").when(s["doc"] > s["ppt"], "doc").when(s["ppt"] > 0, "ppt").otherwise("doc"))

    named = F.when(low.endswith(".msg"), in_message(latin(F.substring(content, 1, 1000))))
    for kind in ("xls", "doc", "ppt"):
        named = named.when(low.endswith(f".{kind}"), kind)
    return named.when(low.endswith(".db") | F.contains(low, F.lit("thumbs.db")), "db").otherwise(let(latin(content), scored))


# Archives


def archive_members(content: Column) -> Column:
    """Members of a zip archive by its central directory: array of struct(name, method, size, at (of its local header)); none where there is no directory."""
    length = F.octet_length(content).cast("long")
    tail = F.greatest(F.lit(0), length - 65_557)
    back = F.locate("\x06\x05KP", F.reverse(latin(_bytes(content, tail, length - tail))))  # the last mark of a directory's end
    end = F.when(back > 0, length - back - 3)

    def listed(e: Column) -> Column:
        size, told = _number(content, e + 12, 4), _number(content, e + 16, 4)
        first = e - size
        start = F.struct(first.alias("at"), F.expr("cast(array() as array<struct<name:string,method:bigint,size:bigint,at:bigint>>)").alias("found"))

        def step(acc: Column, _: Column) -> Column:
            at = acc["at"]
            here = F.coalesce(_number(content, at, 4) == 0x02014B50, F.lit(False))
            n = _number(content, at + 28, 2)
            row = F.struct(F.decode(_bytes(content, at + 46, n), "UTF-8").alias("name"), _number(content, at + 10, 2).alias("method"), _number(content, at + 20, 4).alias("size"), (_number(content, at + 42, 4) + first - told).alias("at"))
            return F.when(here, F.struct((at + 46 + n + _number(content, at + 30, 2) + _number(content, at + 32, 2)).alias("at"), F.array_append(acc["found"], row).alias("found"))).otherwise(acc)

        return F.when((size >= 46) & (first >= 0), F.aggregate(F.sequence(F.lit(1).cast("long"), (size / 46).cast("long")), start, step, lambda acc: acc["found"]))

    return F.coalesce(let(end, listed), F.expr("cast(array() as array<struct<name:string,method:bigint,size:bigint,at:bigint>>)"))


def archive_kind(content: Column) -> Column:
    """docx, xlsx or pptx by members, odt, ods or odp by the media type (a member that is stored as it is), odt for another manifest; else zip."""

    def kind(members: Column) -> Column:
        has = lambda part: F.exists(members, lambda m: F.contains(m["name"], F.lit(part)))
        media = F.get(F.filter(members, lambda m: (m["name"] == "mimetype") & (m["method"] == 0)), F.lit(0))
        start = media["at"] + 30 + _number(content, media["at"] + 26, 2) + _number(content, media["at"] + 28, 2)
        told = F.when(media.isNotNull(), latin(_bytes(content, start, media["size"])))
        out = F.when(has(MEMBERS[0][0]), MEMBERS[0][1])
        for part, name in MEMBERS[1:]:
            out = out.when(has(part), name)
        for part, name in MEDIA:
            out = out.when(F.contains(told, F.lit(part)), name)
        return out.when(has("META-INF/manifest.xml"), "odt").otherwise("zip")

    return let(archive_members(content), kind)


# Both


def magic_kind(content: Column) -> Column:
    """Kind by the first bytes, zip and ole2 as they are; null for none."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.when(head.startswith(MAGIC[0][0]), MAGIC[0][1])
    for first, kind in MAGIC[1:]:
        out = out.when(head.startswith(first), kind)
    return out


def legacy_kind(name: Column, content: Column) -> Column:
    """Kind by the first bytes, of archives by their members, of compound documents by name and patterns; `unknown` for others and null content."""
    first = magic_kind(content)
    return F.when(first == "zip", archive_kind(content)).when(first == "ole2", legacy_office_kind(name, content)).otherwise(F.coalesce(first, F.lit("unknown")))


def kind_of(content: Column) -> Column:
    """As legacy_kind(), compound documents by their directory, whatever the name; texts without control characters are txt."""
    first = magic_kind(content)
    text = F.decode(F.substring(content, 1, 4096), "ISO-8859-1")
    plain = (F.length(text) > 0) & ~text.rlike("[\\x00-\\x08\\x0E-\\x1A\\x1C-\\x1F]")
    return F.when(first == "zip", archive_kind(content)).when(first == "ole2", office_kind(compound_names(content))).when(first.isNotNull(), first).when(plain, "txt").otherwise("unknown")
