"""File scans: folders as rows, delimited and JSON tables, archives."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import files

MAX_DEPTH = 8


def folder_profile(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file, filename, extension, size, hash, modified for each file below a folder; the extension is reconciled with the content's."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    extension = files.reconciled_extension(files.name_extension(name), files.content_extension(F.col("content")))
    return rows.select(F.col("path").alias("file"), name.alias("filename"), extension.alias("extension"), F.col("length").alias("size"), files.content_hash(F.col("content")).alias("hash"), F.col("modificationTime").alias("modified"))


def new_files(profile: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose path isn't known yet."""
    return profile.join(known.select("file"), "file", "left_anti")


def delimited(spark: SparkSession, path: str, schema: str, sep: str = ";") -> DataFrame:
    return spark.read.schema(schema).option("sep", sep).option("header", True).csv(path)


def ground_truth(spark: SparkSession, path: str, schema: str, nested: dict[str, str] | None = None) -> DataFrame:
    """A delimited table whose missing texts are empty; columns of `nested` are JSON texts, parsed by their schema, null where they are empty or no JSON. Quoted texts may hold lines and quotes."""
    rows = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")
    return rows.withColumns({c: F.from_json(F.nullif(F.col(c), F.lit("")), kind) for c, kind in (nested or {}).items()})


def json_cache(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Rows of a cache file: a JSON list of objects, or one object a line; columns of the schema, all that are there without one."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of `{"records": [{"id": .., "fields": {..}}]}` as rows of id and the fields."""
    rows = spark.read.schema(f"records array<struct<id:bigint,fields:struct<{schema}>>>").option("multiLine", True).json(path)
    return rows.select(F.explode("records").alias("r")).select("r.id", "r.fields.*")


def relational(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int = 8, **options: str) -> DataFrame:
    """A database table, read in ranges of its key."""
    return spark.read.jdbc(url, table, column=key, lowerBound=low, upperBound=high, numPartitions=partitions, properties=options)


def whole_table(spark: SparkSession, url: str, table: str, key: str, partitions: int = 8, quote: str = '"', **options: str) -> DataFrame:
    """All of a database table in ranges of its numeric key, whose ends the database tells first; no pages, and no row twice or never as pages of a changing table have it.

    quote: what the database puts around names. Rows with a null key come with the first range.
    """
    ends = spark.read.jdbc(url, f"(SELECT MIN({quote}{key}{quote}) AS low, MAX({quote}{key}{quote}) AS high FROM {table}) ends", properties=options).first()
    if ends[0] is None:
        return spark.read.jdbc(url, table, properties=options)
    return relational(spark, url, table, key, int(ends[0]), int(ends[1]) + 1, partitions, **options)


def selected(spark: SparkSession, url: str, table: str, columns: list[str] | None = None, where: str | None = None, order_by: list[str] | None = None, offset: int = 0, limit: int | None = None, **options: str) -> DataFrame:
    """Columns of a database table where a condition holds, in an order, without the first `offset` rows and `limit` at most. Spark pushes what the database can do."""
    rows = spark.read.jdbc(url, table, properties=options)
    rows = rows if where is None else rows.where(where)
    if order_by:
        rows = rows.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order_by])
    rows = rows.select(*columns) if columns else rows
    rows = rows.offset(offset) if offset else rows
    return rows if limit is None else rows.limit(limit)


def unzipped(rows: DataFrame) -> DataFrame:
    """file, content to file, parent, content: each row, and the members of archives, nested ones too, under `archive/member`.

    A broken archive is a row like any other file. Folders and hidden members have no rows.
    """

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def members(name: str, parent: str | None, content: bytes, depth: int) -> Iterator[tuple]:
            if depth < MAX_DEPTH and content[:4] == b"PK\x03\x04" and name.lower().endswith(".zip"):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        inner = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir() and not i.filename.rpartition("/")[2].startswith(".")]
                except (zipfile.BadZipFile, RuntimeError, EOFError):
                    inner = []
                for member, data in inner:
                    yield from members(f"{name}/{member}", name, data, depth + 1)
                if inner:
                    return
            yield name, parent, content

        for pdf in batches:
            for name, content in zip(pdf["file"], pdf["content"]):
                found = list(members(name, None, bytes(content), 0))
                yield pd.DataFrame(found, columns=["file", "parent", "content"])

    return rows.select("file", "content").mapInPandas(expand, "file string, parent string, content binary")
