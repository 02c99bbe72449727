"""A store of blobs whose rows appear only once their blobs are there."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date
from pathlib import Path

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: What a row of the store's metadata holds.
FILES = "external_id string, parent string, file string, filename string, original_filename string, folder string, extension string, size long, hash string, created_date date, batch string"


@dataclass
class Stored(WriterCommitMessage):
    """What one task has put under its attempt's name."""

    attempt: str
    rows: list[dict] = field(default_factory=list)


class BlobWriter(DataSourceWriter):
    """Tasks put blobs under names of their attempt; the commit moves those of the attempts that counted to their places, then writes the rows.

    A row thus has a blob, whatever fails; a blob without a row can only be left where a commit died, and a later write of the same name replaces it.
    An attempt that is lost, fails or is beaten by another one leaves no row, and its blobs go with the write's folder.
    """

    def __init__(self, options: dict, overwrite: bool):
        self.root, self.write_id = options["path"].rstrip("/"), uuid.uuid4().hex
        if overwrite:
            raise ValueError("the store is appended to; a blob of the same name is replaced")

    def write(self, iterator: Iterator[Row]) -> Stored:
        out = Stored(f"{self.root}/_attempts/{self.write_id}/{TaskContext.get().partitionId()}-{TaskContext.get().taskAttemptId()}")
        os.makedirs(out.attempt, exist_ok=True)
        for n, row in enumerate(iterator):
            if row.content is None:
                continue  # nothing was fetched, so nothing is known of it
            content = bytes(row.content)
            with open(f"{out.attempt}/{n}", "wb") as f:
                f.write(content)
                f.flush()
                os.fsync(f.fileno())
            name = row.filename
            out.rows.append({
                "external_id": row.external_id, "parent": row.parent, "file": f"{row.folder}/{name}", "filename": name, "original_filename": row.original_filename, "folder": row.folder,
                "extension": row.extension, "size": len(content), "hash": hashlib.sha256(content).hexdigest(), "created_date": date.today().isoformat(), "batch": self.write_id, "__blob": f"{out.attempt}/{n}",
            })
        return out

    def commit(self, messages: list[Stored | None]) -> None:
        rows = [r for m in messages if m is not None for r in m.rows]
        last = {r["file"]: i for i, r in enumerate(rows)}  # of blobs of one name the last counts
        kept = [r for i, r in enumerate(rows) if last[r["file"]] == i]
        for r in kept:
            place = Path(self.root, "blobs", r["file"])
            place.parent.mkdir(parents=True, exist_ok=True)
            os.replace(r.pop("__blob"), place)
        table = Path(self.root, "files")
        table.mkdir(parents=True, exist_ok=True)
        hidden = table / f".{self.write_id}.json"
        hidden.write_text("".join(json.dumps(r, ensure_ascii=False) + "\n" for r in kept), encoding="utf-8")
        os.replace(hidden, table / f"{self.write_id}.json")  # all rows appear at once
        shutil.rmtree(f"{self.root}/_attempts/{self.write_id}", ignore_errors=True)

    def abort(self, messages: list[Stored | None]) -> None:
        shutil.rmtree(f"{self.root}/_attempts/{self.write_id}", ignore_errors=True)


class BlobStore(DataSource):
    """df.write.format("blob_store").option("path", ...).mode("append").save(): rows external_id, parent, folder, filename, original_filename, extension, content. path is a folder that all executors and the driver share."""

    @classmethod
    def name(cls) -> str:
        return "blob_store"

    def schema(self) -> str:
        return "external_id string, parent string, folder string, filename string, original_filename string, extension string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> BlobWriter:
        return BlobWriter(self.options, overwrite)


def stored_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the store; of rows of one file those of all writes."""
    if not Path(path, "files").exists():
        return spark.createDataFrame([], FILES)
    return spark.read.schema(FILES).json(f"{path.rstrip('/')}/files")
