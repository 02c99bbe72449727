"""Synchronisation as staged writes: engagements, document metadata, downloads and first rows of documents, each step one commit over several tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import order_number
from ..sources.remote import downloaded
from . import dedup, merge, records, steps, workflow

#: Tables of a store and their columns.
TABLES = {
    "scopes": "pur_org string, pur_group string",
    "engagements": "num_ej string, external_updated_at timestamp",
    "engagement_scopes": "pur_org string, pur_group string, num_ej string",
    "metadata": "external_id string, name string, size long, date string",
    "metadata_links": "external_id string, num_ej string",
    "files": "external_id string, file string, filename string, hash string, size long",
    "download_errors": "external_id string, error string",
    "batches": "batch string, num_ej string",
    "documents": "document_id string, hash string, file string, filename string, text string, classification string, structured_data string",
    "document_engagements": "document_id string, num_ej string",
}


class Store:
    """Tables in a folder that the cluster shares, changed together: a commit writes new versions of some and then a row that names all; readers see the last row's.

    A commit that dies before its row changes nothing. One driver writes at a time. Old versions stay until vacuum().
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, str] | None = None):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables or TABLES

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def versions(self) -> dict[str, str]:
        """Table to the name of its version, as the last commit has them."""
        if not self._exists(f"{self.path}/commits"):
            return {}
        rows = self.spark.read.schema("n long, versions map<string,string>").json(f"{self.path}/commits")
        last = rows.orderBy(F.desc("n")).first()
        return dict(last.versions) if last else {}

    def read(self, name: str) -> DataFrame:
        version = self.versions().get(name)
        if version is None:
            return self.spark.createDataFrame([], self.tables[name])
        return self.spark.read.schema(self.tables[name]).parquet(f"{self.path}/{name}/{version}")

    def commit(self, changed: dict[str, DataFrame]) -> None:
        """Puts whole new versions in the place of tables, all at once."""
        new = {}
        for name, df in changed.items():
            columns = self.spark.createDataFrame([], self.tables[name]).schema
            new[name] = uuid.uuid4().hex
            df.select(*[F.col(c.name).cast(c.dataType).alias(c.name) for c in columns]).write.parquet(f"{self.path}/{name}/{new[name]}")
        commits = self.spark.read.schema("n long").json(f"{self.path}/commits").agg(F.max("n")).first()[0] if self._exists(f"{self.path}/commits") else 0
        row = self.spark.createDataFrame([((commits or 0) + 1, self.versions() | new)], "n long, versions map<string,string>")
        row.coalesce(1).write.mode("append").json(f"{self.path}/commits")

    def vacuum(self) -> None:
        """Deletes versions that the last commit does not name."""
        now, jvm = self.versions(), self.spark._jvm
        for name in self.tables:
            at = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for found in fs.listStatus(at) if fs.exists(at) else []:
                if found.getPath().getName() != now.get(name):
                    fs.delete(found.getPath(), True)


def sync_engagements(store: Store, activities: DataFrame) -> DataFrame:
    """num_ej of the engagements that activities (rows of the activity source) name. New engagements and scopes are added, later dates replace earlier ones, links of
    scopes are added once. Rows with an error are passed over."""
    rows = activities.where("error is null")
    newest = rows.groupBy("num_ej").agg(F.max("date_reception").alias("external_updated_at"))
    scopes, links = records.linked(store.read("engagement_scopes"), store.read("scopes"), rows.select("pur_org", "pur_group", "num_ej"), ["pur_org", "pur_group"], "num_ej")
    engagements = merge.upsert(store.read("engagements"), newest, "num_ej", ["external_updated_at"], newer="external_updated_at")
    store.commit({"engagements": engagements, "scopes": scopes, "engagement_scopes": links})
    return newest.select("num_ej")


def sync_documents(store: Store, metadata: DataFrame) -> DataFrame:
    """external_id of the documents that metadata (rows of the metadata source) name. Names, sizes and dates are replaced, links to engagements added once."""
    rows = metadata.select(F.col("id").alias("external_id"), F.col("filename").alias("name"), "size", F.col("created").alias("date"), "num_ej")
    # of a document's rows the one of the latest date counts
    last = rows.groupBy("external_id").agg(F.max(F.struct("date", "name", "size")).alias("last")).select("external_id", "last.name", "last.size", "last.date")
    table = merge.upsert(store.read("metadata"), last, "external_id", ["name", "size", "date"])
    links = merge.insert_ignore(store.read("metadata_links"), rows.select("external_id", "num_ej"), ["external_id", "num_ej"])
    store.commit({"metadata": table, "metadata_links": links})
    return last.select("external_id")


def download_documents(store: Store, ids: DataFrame, fetch: Callable[[str], bytes], place: Callable[[DataFrame], DataFrame], **retries) -> tuple[int, int]:
    """Fetches the documents of ids that the store has no file of; counts of what came and what failed.

    place: writes rows external_id, filename, content to where blobs are (BlobStore, for one) and gives them back as external_id, file, filename, hash, size; only then
    the rows are committed. Failures have a row with the error, which goes once the document comes.
    """
    known = store.read("files")
    wanted = store.read("metadata").join(ids, "external_id", "left_semi").join(known, "external_id", "left_anti")
    path = f"{store.path}/_downloads/{uuid.uuid4().hex}"
    downloaded(wanted.select("external_id", F.col("name").alias("filename"), "size"), fetch, "external_id", "size", **retries).write.parquet(path)  # once: servers are not asked again by later plans
    got = store.spark.read.parquet(path)
    files = place(got.where("error is null").select("external_id", "filename", "content"))
    errors = store.read("download_errors").join(got, "external_id", "left_anti").unionByName(got.where("error is not null").select("external_id", "error"))
    store.commit({"files": known.unionByName(files.select(*known.columns)), "download_errors": errors})
    n = {r.failed: r["count"] for r in got.groupBy(F.col("error").isNotNull().alias("failed")).count().collect()}
    at = store.spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(store.spark._jsc.hadoopConfiguration()).delete(at, True)
    return n.get(False, 0), n.get(True, 0)


def _init(store: Store, num_ejs: DataFrame, files: DataFrame, links: Callable[[DataFrame], DataFrame], batch: str) -> None:
    """New engagements, their batch, a document for each new content (the shortest path first), and links, in one commit."""
    known = store.read("documents")
    one = dedup.keep_preferred_path(files.where("hash is not null")).select(F.col("hash").alias("document_id"), "hash", "file", "filename")
    documents = merge.insert_ignore(known, one, ["hash"]).select(known.columns)
    keys = num_ejs.where("num_ej is not null").select("num_ej").distinct()
    store.commit({
        "engagements": merge.insert_ignore(store.read("engagements"), keys, ["num_ej"]),
        "batches": merge.insert_ignore(store.read("batches"), keys.select(F.lit(batch).alias("batch"), "num_ej"), ["batch", "num_ej"]),
        "documents": documents,
        "document_engagements": merge.insert_ignore(store.read("document_engagements"), links(documents).distinct(), ["document_id", "num_ej"]),
    })


def init_documents(store: Store, num_ejs: DataFrame, batch: str) -> None:
    """Documents of what was downloaded for these engagements, linked to all engagements that name one of a content's files."""
    ids = store.read("metadata_links").join(num_ejs.select("num_ej").distinct(), "num_ej", "left_semi").select("external_id").distinct()
    files = store.read("files").join(ids, "external_id", "left_semi")
    every, links = store.read("files"), store.read("metadata_links")
    engagements = merge.insert_ignore(store.read("engagements"), num_ejs.select("num_ej").distinct(), ["num_ej"])

    def linked(documents: DataFrame) -> DataFrame:
        mine = documents.join(files.select("hash").distinct(), "hash", "left_semi").select("document_id", "hash")
        return mine.join(every.select("hash", "external_id"), "hash").join(links, "external_id").join(engagements, "num_ej", "left_semi").select("document_id", "num_ej")

    _init(store, num_ejs, files, linked, batch)


def init_documents_in_folder(store: Store, profile: DataFrame, batch: str) -> None:
    """Documents of a folder's files (file, filename, hash), linked by the ten digits that their names begin with; one distributed pass, whatever the number of files."""
    rows = profile.withColumn("num_ej", order_number(F.col("filename")))
    linked = lambda documents: rows.where("num_ej is not null").join(documents.select("document_id", "hash"), "hash").select("document_id", "num_ej")
    _init(store, rows, rows, linked, batch)


def analyze(store: Store, num_ejs: DataFrame, batch: str, chain: Sequence[steps.Step | steps.NativeStep], supported: tuple[str, ...], folder: str, force: bool = False) -> DataFrame | None:
    """Runs the chain over the documents of these engagements that are not yet analysed and of no unsupported class (all if forced), and commits what the steps have set. None if there is none.

    The result is the table of jobs; a failed run goes on behind its last whole stage when it is called again with the same folder.
    """
    known = store.read("documents")
    mine = known.join(store.read("document_engagements").join(num_ejs, "num_ej", "left_semi").select("document_id").distinct(), "document_id", "left_semi")
    work = workflow.incremental_work(mine, supported, force)
    if work.isEmpty():
        return None
    work = work.withColumn("structured_data", F.from_json("structured_data", "map<string,string>"))
    done = steps.run_steps(steps.launched(work, batch, [s.name for s in chain]), chain, folder)
    kept = [c for c in known.columns if c in done.columns]
    data = {c: F.to_json(c) for c in kept if done.schema[c].dataType.typeName() in ("map", "struct", "array")}
    store.commit({"documents": known.join(done, "document_id", "left_anti").unionByName(done.withColumns(data).select(kept), allowMissingColumns=True)})
    return done


def sync_and_analyze(store: Store, activities: DataFrame, metadata_of: Callable[[DataFrame], DataFrame], fetch: Callable[[str], bytes], place: Callable[[DataFrame], DataFrame], batch: str, chain: Sequence[steps.Step | steps.NativeStep], supported: tuple[str, ...], folder: str, force: bool = False, **retries) -> dict:
    """All of it: activities to engagements, their documents' metadata (metadata_of their num_ej), downloads, first rows, and the steps. Counts, and the table of jobs (None if nothing is to be done)."""
    keys = sync_engagements(store, activities)
    ids = sync_documents(store, metadata_of(keys))
    success, errors = download_documents(store, ids, fetch, place, **retries)
    init_documents(store, keys, batch)
    return {"num_ejs": keys.count(), "doc_ids": ids.count(), "download_success": success, "download_errors": errors, "jobs": analyze(store, keys, batch, chain, supported, folder, force)}
