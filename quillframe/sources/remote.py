"""Remote activity and metadata scans as a Python data source; the transport is HTTP or, offline, a folder of JSON pages."""

from __future__ import annotations

import json
import re
import time
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from ..operators.ranks import numbered
from ..operators.retries import with_retries

ACTIVITY = "alerte string, num_ej string, date_reception timestamp, pur_org string, pur_group string, error string"


def odata_filter(start: datetime | None, end: datetime | None, organization: str, group: str) -> str:
    """The remote filter of one scope; bounds that are not asked for are left out, quotes in values doubled."""
    literal = lambda t: f"datetime'{t:%Y-%m-%dT%H:%M:%S}'"
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    parts = [f"date_reception {op} {literal(t)}" for op, t in (("ge", start), ("le", end)) if t is not None]
    return " and ".join([*parts, f"pur_org eq {quoted(organization)}", f"pur_group eq {quoted(group)}"])


def http_json(url: str, query: str) -> list[dict]:
    """The results of one page of a service; busy and failing servers are asked again."""
    return with_retries(lambda: json.load(urllib.request.urlopen(f"{url}?{query}", timeout=180)))["d"]["results"]


class Scope(InputPartition):
    def __init__(self, organization: str, group: str):
        super().__init__(f"{organization}/{group}")
        self.organization, self.group = organization, group


def _utc(x: str | datetime) -> datetime:
    t = datetime.fromisoformat(x) if isinstance(x, str) else x
    return t.astimezone(timezone.utc).replace(tzinfo=None) if t.tzinfo else t


def activity_row(raw: object) -> tuple:
    """A row of ACTIVITY; what is wrong with it, if anything, is its error: no object, a missing or empty field, or a date of another form."""
    fields = ("alerte", "num_ej", "date_reception", "pur_org", "pur_group")
    if not isinstance(raw, dict):
        return (None,) * len(fields) + ("no object",)
    values = {k: raw.get(k) for k in fields}
    wrong = [f"{k} is missing" for k, v in values.items() if v in (None, "")]
    told = re.fullmatch(r"/Date\((-?[0-9]{1,14})\)/", str(values["date_reception"]))
    if told is None and "date_reception is missing" not in wrong:
        wrong.append(f"date_reception is no date: {values['date_reception']}")
    when = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(milliseconds=int(told[1])) if told else None
    text = lambda v: None if v is None else str(v)
    return text(values["alerte"]), text(values["num_ej"]), when, text(values["pur_org"]), text(values["pur_group"]), "; ".join(wrong) or None


class ActivityReader(DataSourceReader):
    """A partition for each scope; start and end go into the remote filter."""

    def __init__(self, options: dict, fetch: Callable[[str, str], list[dict]]):
        self.url, self.folder, self.fetch = options.get("url"), options.get("folder"), fetch
        bound = lambda k: _utc(options[k]) if options.get(k) else None
        self.start, self.end = bound("start"), bound("end")
        self.scopes = [tuple(x.split("/", 1)) for x in options["scopes"].split(",")]

    def partitions(self) -> list[Scope]:
        return [Scope(*s) for s in self.scopes]

    def read(self, partition: Scope | None) -> Iterator[tuple]:
        if partition is None:  # no scope is left
            return
        if self.folder:
            page = Path(self.folder, f"{partition.organization}_{partition.group}.json")
            rows = json.loads(page.read_text()) if page.exists() else []
        else:
            rows = self.fetch(self.url, urllib.parse.urlencode({"$filter": odata_filter(self.start, self.end, partition.organization, partition.group), "$format": "json"}))
        for r in rows:
            out = activity_row(r)
            yield *out[:3], out[3] or partition.organization, out[4] or partition.group, out[5]


class FilteredActivityReader(ActivityReader):
    """A partition for each scope that the query's filters leave; bounds of the date go into the remote filter too."""

    def pushFilters(self, filters: list) -> Iterator:
        """Takes comparisons of date_reception with a value, and equality and lists of pur_org and pur_group; gives the others back to Spark.

        The service compares whole seconds and both ends count, so Spark looks at the date bounds again.
        """
        for f in filters:
            name, value = ".".join(getattr(f, "attribute", ())), getattr(f, "value", None)
            if name == "date_reception" and value is not None and isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                low = _utc(value).replace(microsecond=0)
                self.start = low if self.start is None else max(self.start, low)
            if name == "date_reception" and value is not None and isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                high = _utc(value).replace(microsecond=0) + timedelta(seconds=1)
                self.end = high if self.end is None else min(self.end, high)
            place = {"pur_org": 0, "pur_group": 1}.get(name)
            if place is not None and isinstance(f, (EqualTo, In)) and value is not None:
                wanted = value if isinstance(f, In) else (value,)
                self.scopes = [s for s in self.scopes if s[place] in wanted]
            elif not (isinstance(f, IsNotNull) and place is not None):
                yield f


class ActivitySource(DataSource):
    """spark.dataSource.register(ActivitySource); read.format("activity") with options scopes (`org/group,..`), start, end, and url or folder. A partition for each scope.

    Every row comes back; `error` says what is wrong with one, so `where error is null` has the valid ones. With option("pushdown", "true"), which needs
    spark.sql.python.filterPushdown.enabled, filters on date_reception, pur_org and pur_group choose scopes and go into the remote filter. Subclasses may set another `fetch`.
    """

    fetch = staticmethod(http_json)

    @classmethod
    def name(cls) -> str:
        return "activity"

    def schema(self) -> str:
        return ACTIVITY

    def reader(self, schema) -> ActivityReader:
        kind = FilteredActivityReader if self.options.get("pushdown", "").lower() == "true" else ActivityReader
        return kind(self.options, type(self).fetch)


METADATA = "num_ej string, id string, filename string, mime_type string, size long, created string"

#: Bytes under which a failed download is tried again, and how often.
SMALL, SMALL_RETRIES = 21 * 1024 * 1024, 2


class Key(InputPartition):
    def __init__(self, key: str):
        super().__init__(key)
        self.key = key


class MetadataReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url, self.folder, self.kind = options.get("url"), options.get("folder"), options.get("objecttype", "")
        self.keys = [k for k in options["keys"].split(",") if k]

    def partitions(self) -> list[Key]:
        return [Key(k) for k in self.keys]

    def read(self, partition: Key) -> Iterator[tuple]:
        if self.folder:
            page = Path(self.folder, f"{partition.key}.json")
            rows = json.loads(page.read_text()) if page.exists() else []
        else:
            query = urllib.parse.urlencode({"$filter": f"num_ej eq '{partition.key}' and object_type eq '{self.kind}'", "$format": "json"})
            rows = http_json(self.url, query)
        for r in rows:
            if r.get("id"):  # a row without an id names no document
                yield partition.key, *(r.get(c.split()[0]) for c in METADATA.split(", ")[1:])


class MetadataSource(DataSource):
    """read.format("document_metadata") with options keys (`a,b,..`), objectType, and url or folder: the documents of each key. A partition for each key."""

    @classmethod
    def name(cls) -> str:
        return "document_metadata"

    def schema(self) -> str:
        return METADATA

    def reader(self, schema) -> MetadataReader:
        return MetadataReader(self.options)


def downloaded(docs: DataFrame, fetch, doc_id: str = "id", size: str = "size", delay: float = 20.0, sleep=time.sleep) -> DataFrame:
    """docs with content and error: fetch(id) gives the bytes; small documents are tried again, large ones are not. A failure is that row's error."""

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            contents, errors = [], []
            for key, n in zip(pdf[doc_id], pdf[size]):
                retries = SMALL_RETRIES if n == n and n is not None and n < SMALL else 0
                try:
                    contents.append(with_retries(lambda k=key: fetch(k), retries, delay, delay, sleep))
                    errors.append(None)
                except Exception as e:  # goes to the row it concerns
                    contents.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield pdf.assign(content=contents, error=errors)

    return docs.mapInPandas(get, StructType([*docs.schema.fields, StructField("content", BinaryType()), StructField("error", StringType())]))


def listing_slice(names: DataFrame, name: str, number: int, size: int) -> DataFrame:
    """The names of one chunk (from 0) of so many, in their order. Places come from counts of ranges: a chunk far on is as cheap as the first, and no task sorts all names."""
    rows = numbered(names.select(name), [], [name], "__at")
    return rows.where((F.col("__at") >= number * size) & (F.col("__at") < (number + 1) * size)).orderBy(name).select(name)
