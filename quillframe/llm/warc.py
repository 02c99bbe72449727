"""WARC archives: written with revisits of equal payloads, read by chains of record lengths from each file's start."""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import Scratch, maybe_broadcast, table

#: Fixed values of the format: what records begin with, what ends a header, what ends a record.
MAGIC, BLANK, END = "WARC/1.", "\r\n\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Payloads of fewer bytes are written whole each time.
LEAST_BYTES = 0
BROADCAST_ROWS = 200_000
#: Repeats of one row that one task writes.
REPEATS = 100_000
#: Rows of split, base and entry that are broadcast (about 170 bytes each); beyond, chunks are shuffled by split.
BROADCAST_SPLITS = 1_000_000

# Writing


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: each five hex digits are four base-32 digits."""
    digits = F.concat(*[F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def _record(kind: Column, record_id: Column, date: str, page_id: Column, uri: Column, digest: Column, size: Column, block_size: Column, refers: list[tuple[str, Column]]) -> Column:
    """Header of a record up to its blank line; fields whose value is null are left out."""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", F.concat(F.lit("<"), record_id, F.lit(">"))), ("WARC-Date", F.lit(date)), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), *refers]
    fields += [("Page-ID", page_id.cast("string")), ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", block_size.cast("string"))]
    lines = [F.concat(F.lit(f"\r\n{name}: "), value) for name, value in fields]
    return F.concat(F.lit(f"{MAGIC}1"), *[F.coalesce(line, F.lit("")) for line in lines])


def write_archives(rows: DataFrame, path: str, page_id: str, uri: str, payload: str, least_bytes: int = LEAST_BYTES, date: datetime.datetime | None = None) -> None:
    """Writes a record for each row to the files of a new folder; of rows with equal payloads (SHA-1) the one with the smallest
    page_id is a response, the others are revisits that name it and hold no payload. Payloads under least_bytes are responses.

    payload is text (UTF-8) or bytes; null is empty. Null ids count as largest, ties go to the smaller uri, then to any one row;
    line ends and spaces in a uri are percent-encoded; null uris are left out. An empty table writes a folder without records.
    Columns that are not named do not matter. Large tables of repeated payloads meet the rows by a join on the digest.
    """
    spark, day = rows.sparkSession, (date or datetime.datetime.now(datetime.timezone.utc)).strftime("%Y-%m-%dT%H:%M:%SZ")
    clean = F.col(uri).cast("string")
    for odd in "\r\n\t ":
        clean = F.replace(clean, F.lit(odd), F.lit(f"%{ord(odd):02X}"))
    rows = rows.select(F.col(page_id).alias("page_id"), clean.alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    digest = rows.select("*", base32_sha1(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    with Scratch(spark) as scratch:
        names = digest.groupBy("digest", "size", "page_id", "uri").agg(F.count("*").alias("n"))
        order = F.struct(F.col("page_id").isNull().alias("last"), "page_id", F.col("uri").isNull().alias("no_uri"), "uri", "n")
        firsts = names.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min(order).alias("first"), F.sum("n").alias("all")).where("all > 1")
        firsts = scratch.saved(firsts.select("digest", "size", F.col("first.page_id").alias("first_id"), F.col("first.uri").alias("first_uri"), F.col("first.n").alias("n")), "firsts")
        known = firsts.count()
        met = digest.join(maybe_broadcast(firsts, known, BROADCAST_ROWS), ["digest", "size"], "left")
        first = F.col("n").isNotNull() & F.col("page_id").eqNullSafe(F.col("first_id")) & F.col("uri").eqNullSafe(F.col("first_uri"))
        met = met.withColumn("kind", F.when(F.col("n").isNull() | first, F.lit("response")).otherwise(F.lit("revisit")))
        if not firsts.where("n > 1").isEmpty():  # rows repeated whole: one of them is the response
            once = met.where(first & (F.col("n") > 1)).groupBy("digest", "size", "page_id", "uri", "first_id", "first_uri", "n").agg(F.max("payload").alias("payload"))
            parts = firsts.where("n > 1").select("*", F.explode(F.sequence(F.lit(2).cast("long"), F.col("n"), F.lit(REPEATS))).alias("at")).hint("rebalance")
            again = parts.select("*", F.explode(F.sequence("at", F.least("n", F.col("at") + F.lit(REPEATS - 1))))).select("digest", "size", F.col("first_id").alias("page_id"), F.col("first_uri").alias("uri"), "first_id", "first_uri", "n", F.lit(b"").alias("payload"), F.lit("revisit").alias("kind"))
            met = met.where(~(first & (F.col("n") > 1))).unionByName(once.withColumn("kind", F.lit("response"))).unionByName(again)
        _written(met, path, day)


def _written(met: DataFrame, path: str, day: str) -> None:
    named = lambda *x: F.sha2(F.concat_ws("\x00", *[F.coalesce(c.cast("string"), F.lit("\x01")) for c in x]), 256)
    as_urn = lambda h: F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]))
    target = as_urn(named(F.col("digest"), F.col("first_id"), F.col("first_uri")))  # a response that others name can be worked out by them
    response = F.col("kind") == "response"
    record_id = F.when(response & F.col("n").isNotNull(), target).otherwise(F.concat(F.lit("urn:uuid:"), F.uuid()))
    of_first = lambda c: F.when(~response, c)
    refers = [("WARC-Profile", of_first(F.lit(PROFILE))), ("WARC-Refers-To", of_first(F.concat(F.lit("<"), target, F.lit(">")))), ("WARC-Refers-To-Target-URI", of_first(F.col("first_uri"))), ("Refers-To-Page-ID", of_first(F.col("first_id").cast("string")))]
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit(BLANK))
    block_size = F.length(http) + F.when(response, F.col("size")).otherwise(F.lit(0))
    header = _record(F.col("kind"), record_id, day, F.col("page_id"), F.col("uri"), F.col("digest"), F.col("size"), block_size, refers)
    body = F.when(response, F.col("payload")).otherwise(F.lit(b""))
    whole = F.concat(F.concat(header, F.lit(BLANK), http).cast("binary"), body)
    met.select(whole.cast("string").alias("value")).write.option("lineSep", END).text(path)


# Reading


def _chunks(spark: SparkSession, path: str) -> DataFrame:
    """file, split (where Spark's piece of the file begins), chunk: what stands between two magics, bytes."""
    rows = spark.read.option("lineSep", MAGIC).text(path)
    return rows.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.col("value").alias("chunk"))


def _lengths(chunks: DataFrame) -> DataFrame:
    """file, split, size of the chunk, and size of the record that begins with the magic before it (null: no record can)."""
    header = F.substring_index("chunk", BLANK, 1)
    size, held = F.octet_length("chunk").cast("long"), F.octet_length(header).cast("long")
    told = F.regexp_extract(header, "(?i)\r\nContent-Length:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|\\z)", 1).try_cast("long")
    record = F.when((held < size) & header.rlike("^[0-9]\r\n"), F.lit(len(MAGIC + BLANK + END)) + held + told)
    return chunks.select("file", "split", size.alias("size"), record.alias("record"))


_CANDIDATES = "file string, split long, size long, at long, exit long"


def _candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each split's candidate records (places within it) and the place beyond it that the chain from each leads to; last a row with the split's size."""

    def ended(file: str, split: int, sizes: list[np.ndarray], records: list[np.ndarray]) -> pa.RecordBatch:
        size, record = np.concatenate(sizes), np.concatenate(records)
        stops = np.cumsum(size + len(MAGIC))
        # the magic before chunk i ends the split's chunk i - 1; before the first it belongs to the split before, or there is none
        at = stops - size - 2 * len(MAGIC)
        kept = np.flatnonzero(record >= 0)
        own, to = at[kept], at[kept] + record[kept]
        last = stops[-1] - len(MAGIC)  # here the next split's first magic begins
        next_ = np.searchsorted(own, to)
        inside = (next_ < len(own)) & (to < last)
        inside[inside] = own[next_[inside]] == to[inside]
        exits = to.copy()
        for i in np.flatnonzero(inside)[::-1]:  # a chain leads forward, so later ones are known
            exits[i] = exits[next_[i]]
        whole = lambda v: pa.array(np.append(v, -1))
        n = len(own) + 1
        return pa.RecordBatch.from_arrays([pa.array([file] * n), pa.array(np.full(n, split)), pa.array(np.append(np.full(n - 1, -1), stops[-1])), whole(own), whole(exits)], ["file", "split", "size", "at", "exit"])

    name, sizes, records = None, [], []
    for batch in batches:
        file, split = batch.column(0), np.asarray(batch.column(1))
        files = np.asarray(file.dictionary_encode().indices)
        edges = np.flatnonzero((np.diff(files) != 0) | (np.diff(split) != 0)) + 1
        size, record = np.asarray(batch.column(2)), np.asarray(batch.column(3).fill_null(-1))
        for a, b in zip([0, *edges], [*edges, len(split)]):
            if a == b:
                continue
            here = (file[int(a)].as_py(), int(split[a]))
            if name is not None and here != name:
                yield ended(*name, sizes, records)
                sizes, records = [], []
            name = here
            sizes.append(size[a:b])
            records.append(record[a:b])
    if name is not None:
        yield ended(*name, sizes, records)


def entries(spark: SparkSession, path: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of each split: file, split, base (where its first chunk begins), entry (the first place of the chain from the file's start that is not
    before it); and of each file: file, size, end (where its chain ends).

    Every task emits the records that its split may hold and where each leads beyond it; pointers are then jumped from each
    file's start, twice as far each time, so a file of n splits takes about log2(n) rounds of joins over those pointers alone.
    """
    found = scratch.saved(_lengths(_chunks(spark, path)).mapInArrow(_candidates, _CANDIDATES), "candidates")
    splits = found.where("size >= 0").select("file", "split", "size")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = scratch.saved(splits.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))), "splits")  # a row a split
    nodes = found.where("size < 0").join(splits.select("file", "split", "base"), ["file", "split"])
    nodes = nodes.select("file", (F.col("base") + F.col("at")).alias("at"), (F.col("base") + F.col("exit")).alias("exit"))
    # only places that a chain can enter a split by matter further on
    entered = nodes.select("file", F.col("exit").alias("at")).union(splits.select("file", F.lit(0).cast("long").alias("at"))).distinct()
    jumps = scratch.saved(nodes.join(entered, ["file", "at"], "left_semi"), "jumps")
    reached = scratch.saved(splits.select("file", F.lit(0).cast("long").alias("at")).distinct(), "reached")
    known = reached.count()
    while True:
        further = reached.join(jumps, ["file", "at"]).select("file", F.col("exit").alias("at"))
        reached = scratch.saved(reached.union(further).distinct(), "reached")
        now = reached.count()
        if now == known:
            break
        known = now
        far = jumps.alias("a").join(jumps.alias("b"), F.expr("a.file = b.file and a.exit = b.at"), "left")
        jumps = scratch.saved(far.select("a.file", "a.at", F.coalesce("b.exit", "a.exit").alias("exit")), "jumps")
    # the least reached place from a split's first magic on, as a running minimum from the file's end
    first = splits.select("file", "split", "base", (F.col("base") - F.lit(len(MAGIC))).alias("at"))
    marks = first.unionByName(reached, allowMissingColumns=True)
    later = Window.partitionBy("file").orderBy(F.desc("at"), F.col("split").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    entry = F.min(F.when(F.col("split").isNull(), F.col("at"))).over(later)
    marked = scratch.kept(marks.withColumn("entry", entry).where("split is not null").select("file", "split", "base", "entry"), "entries")
    sizes = splits.groupBy("file").agg((F.max(F.col("base") + F.col("size")) - F.lit(len(MAGIC))).alias("size"))
    return marked, scratch.kept(sizes.join(reached.groupBy("file").agg(F.max("at").alias("end")), "file"), "ends")


_FIELDS = re.compile(rb"(?:^|\r\n)([^:\r\n]+):[ \t]*([^\r\n]*)")
_LENGTH = re.compile(rb"(?i)\r\nContent-Length:[ \t]*([0-9]{1,18})[ \t]*(?:\r\n|\Z)")
_PARSED = "headers map<string,string>, http map<string,string>, payload_bytes long, payload_digest string, payload binary"
_SCHEMA = pa.schema([("file", pa.string()), ("at", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("http", pa.map_(pa.string(), pa.string())), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("piece", pa.binary()), ("ends", pa.int64())])


def _record_size(chunk: bytes) -> int | None:
    """Bytes of the record whose magic stands before the chunk; None if no record begins there."""
    header = chunk.partition(b"\r\n\r\n")[0]
    told = _LENGTH.search(header)
    if len(header) == len(chunk) or told is None or not re.match(rb"[0-9]\r\n", chunk):
        return None
    return len(MAGIC + BLANK + END) + len(header) + int(told[1])


def _parsed(data: bytes, payloads: bool) -> dict:
    """Fields of the header and of the HTTP head (names in lower case; the first of a name counts), size, digest and bytes of the payload; data begins behind the magic."""

    def fields(part: bytes) -> list[tuple[str, str]]:
        found: dict[str, str] = {}
        for k, v in _FIELDS.findall(part):
            found.setdefault(k.decode("utf-8", "replace").strip().lower(), v.decode("utf-8", "replace").strip())
        return list(found.items())

    cut = data.index(b"\r\n\r\n")
    headers, block, http = fields(data[:cut]), data[cut + 4 : len(data) - len(END)], None
    if dict(headers).get("content-type", "").lower().startswith("application/http"):
        head, _, rest = block.partition(b"\r\n\r\n")
        http, block = fields(head.partition(b"\r\n")[2]), rest
    return {"headers": headers, "http": http, "payload_bytes": len(block), "payload_digest": base64.b32encode(hashlib.sha1(block).digest()).decode(), "payload": block if payloads else None}


def _follow(payloads: bool):
    """Follows each split's chain from its entry to whole records; what a record leaves to, or takes from, other splits comes out as pieces."""
    magic = MAGIC.encode()

    def follow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = None
        at = until = 0  # the place of this chunk; where the record at hand ends (or, while none has begun, where the first begins)
        held: list[bytes] = []
        begun = False

        def piece(end: int) -> list[dict]:
            text = magic.join(held)
            return [{"file": name[0], "at": end - len(text) - len(magic), "piece": text, "ends": until}] if held and until else []

        for batch in batches:
            out, size = [], 0
            file, split, chunks, base, entry = (batch.column(k) for k in ("file", "split", "chunk", "base", "entry"))
            for i in range(batch.num_rows):
                here = (file[i].as_py(), split[i].as_py())
                if here != name:
                    out += piece(at - len(magic))
                    name, at, until, held, begun = here, base[i].as_py(), entry[i].as_py(), [], False
                chunk = chunks[i].as_py()
                start, at = at - len(magic), at + len(chunk) + len(magic)
                if until is None:
                    continue
                if start == until:
                    out += piece(start)  # the end of a record that began in another split
                    record = _record_size(chunk)
                    until, held, begun = (None if record is None else start + record), [], True
                    if until is None:
                        continue
                held.append(chunk)
                end = at - len(magic)
                if begun and end == until:
                    whole = magic.join(held)
                    out.append({"file": name[0], "at": end - len(whole) - len(magic)} | _parsed(whole, payloads))
                    size += len(whole)
                    held = []
                elif end > until:
                    until, held = None, []  # the length told is wrong, the chain ends here
                if size > 8_000_000:
                    yield pa.RecordBatch.from_pylist(out, _SCHEMA)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, _SCHEMA)
        if out := piece(at - len(magic)):
            yield pa.RecordBatch.from_pylist(out, _SCHEMA)

    return follow


def _join_pieces(payloads: bool):
    def joined(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                whole = MAGIC.encode().join(p["piece"] for p in r["pieces"])
                at = r["pieces"][0]["at"]
                if at + len(MAGIC) + len(whole) == r["ends"] and _record_size(whole) == r["ends"] - at:
                    yield pa.RecordBatch.from_pylist([{"file": r["file"], "at": at} | _parsed(whole, payloads)], pa.schema(list(_SCHEMA)[:-2]))

    return joined


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """file, at (where the record begins), headers and http (maps of fields, names in lower case), payload_bytes, payload_digest and payload
    (without the HTTP head; null if payloads is false) of every record that the chain of record lengths reaches from its file's start.

    What looks like a record inside a payload is not reached and not returned. A chain ends where a length leads to no
    record (chain_ends() tells); a record that is cut short is not returned. Files without records give no rows. Any store that Spark
    reads will do; files are split, records may span splits.
    """
    with Scratch(spark) as scratch:
        marked, _ = entries(spark, path, scratch)
        return _read(spark, path, payloads, marked, scratch)


def _read(spark: SparkSession, path: str, payloads: bool, marked: DataFrame, scratch: Scratch) -> DataFrame:
    chunks = _chunks(spark, path).withColumn("chunk", F.col("chunk").cast("binary"))
    if marked.count() <= BROADCAST_SPLITS:
        rows = chunks.join(F.broadcast(marked), ["file", "split"])  # rows keep their places
    else:
        rows = chunks.withColumn("row", F.monotonically_increasing_id()).join(marked, ["file", "split"]).repartition("file", "split").sortWithinPartitions("file", "split", "row").drop("row")
    found = scratch.kept(rows.select("file", "split", "chunk", "base", "entry").mapInArrow(_follow(payloads), f"file string, at long, {_PARSED}, piece binary, ends long"), "records")
    pieces = found.where("piece is not null").groupBy("file", "ends").agg(F.array_sort(F.collect_list(F.struct("at", "piece"))).alias("pieces"))  # those of one record
    spanning = pieces.mapInArrow(_join_pieces(payloads), f"file string, at long, {_PARSED}")
    return found.where("piece is null").drop("piece", "ends").unionByName(spanning)


def chain_ends(spark: SparkSession, path: str) -> DataFrame:
    """file, size, end, whole: how far each file's chain of records leads; whole if to the file's end."""
    with Scratch(spark) as scratch:
        return entries(spark, path, scratch)[1].withColumn("whole", F.col("size") == F.col("end"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each page's record says, read from the archives. Null html is empty; null ids and urls are left out of the record and come back as null; repeated rows are records of their own; an empty table gives none."""
    scratch = Scratch(spark)
    path = scratch.folder("archives")
    write_archives(table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    rows = read_archives(spark, path, payloads=False)
    scratch.delete(path)
    field = lambda k: F.col("headers")[k]
    revisit = field("warc-type") == "revisit"
    return rows.select(
        field("page-id").cast("long").alias("page_id"),
        F.when(revisit, F.col("http")["content-length"].cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.substring_index(field("warc-payload-digest"), ":", -1)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        field("warc-type").alias("record_type"),
        field("refers-to-page-id").cast("long").alias("refers_to"),
    )


def _oracle() -> str:
    """SHA-1 in base 32: five bits of its 160 at a time."""
    digit = f"substr('{BASE32}', 1 + ((('0x' || substr(h || '0', 1 + (5 * i) // 4, 2))::BIGINT >> (3 - (5 * i) % 4)) & 31)::INT, 1)"
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
  r AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id) AS k, first_value(page_id) OVER (PARTITION BY h ORDER BY page_id) AS f FROM p)
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, list_aggregate(list_transform(range(32), lambda i: {digit}), 'string_agg', '') AS payload_digest,
    CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to FROM r"""


ORACLE_SQL = _oracle()
