"""Keyed records: sentinels, projections, bridges, batches of ids, reports, and exports."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .merge import insert_ignore
from .ranks import numbered, small
from .retries import with_retries

#: Texts that stand for no value in spreadsheets.
SENTINELS = ("nan", "#", "")


def null_sentinels(df: DataFrame, columns: list[str], sentinels: tuple[str, ...] = SENTINELS) -> DataFrame:
    """Columns whose value is a sentinel as nulls."""
    return df.withColumns({c: F.when(~F.col(c).isin(*sentinels), F.col(c)) for c in columns})


def without_prefix(df: DataFrame, columns: list[str], *prefixes: str) -> DataFrame:
    """These columns under their names less the first prefix that they have; names may hold dots."""
    short = lambda c: next((c[len(p) :] for p in prefixes if c.startswith(p)), c)
    return df.select(*[F.col(f"`{c}`").alias(short(c)) for c in columns])


def joined_with_suffixes(a: DataFrame, b: DataFrame, left: str, right: str, suffixes: tuple[str, str]) -> DataFrame:
    """Inner join; columns that both have, but for a key of one name, get the sides' suffixes."""
    both = (set(a.columns) & set(b.columns)) - ({left} if left == right else set())
    x = a.withColumnsRenamed({c: c + suffixes[0] for c in both})
    y = b.withColumnsRenamed({c: c + suffixes[1] for c in both})
    if left == right:
        return x.join(y, left)
    return x.join(y, F.col(left + suffixes[0] * (left in both)) == F.col(right + suffixes[1] * (right in both)))


def skipped_unless_target(kind: Column, targets: tuple[str, ...], status: Column) -> Column:
    """SKIPPED where the class is not one of the targets, else the status."""
    return F.when(F.coalesce(kind.isin(*targets), F.lit(False)), status).otherwise(F.lit("SKIPPED"))


def split_displayed(data: Column, kind: Column, displayed: tuple[str, ...]) -> Column:
    """Whether there is data and its class is displayed; never null."""
    return F.coalesce((F.length(data) > 0) & kind.isin(*displayed), F.lit(False))


def linked(bridge: DataFrame, scopes: DataFrame, pairs: DataFrame, scope: list[str], item: str) -> tuple[DataFrame, DataFrame]:
    """Scopes and bridge with what `pairs` (scope columns and item) needs and they lack: each scope once, each pair once."""
    return insert_ignore(scopes, pairs.select(*scope).distinct(), scope), insert_ignore(bridge, pairs.select(*scope, item).distinct(), [*scope, item])


def patch_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values as a table service takes them: nulls and NaN as empty texts, lists as comma-joined texts."""
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        if kinds[c].startswith("array"):
            return F.coalesce(F.array_join(F.col(c), ", "), F.lit(""))
        plain = F.when(F.isnan(c), None).otherwise(F.col(c)) if kinds[c] in ("double", "float") else F.col(c)
        return F.coalesce(plain.cast("string"), F.lit(""))

    return df.withColumns({c: text(c) for c in columns})


def id_batches(ids: DataFrame, key: str, size: int) -> DataFrame:
    """key, batch (from 0): ids in their order, `size` a batch. Ranks come from counts of ranges, so no task sees all ids."""
    return numbered(ids.select(key), [], [key]).select(key, F.floor(F.col("number") / size).cast("int").alias("batch"))


def first_ids(rows: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """The least id of each key."""
    return rows.groupBy(*keys).agg(F.min(row_id).alias(row_id))


def under_other_key(rows: DataFrame, contracts: DataFrame, key: str, own: str, other: str) -> DataFrame:
    """Rows whose key is the other key of some contract, once each: another than the contract's own one, and no sentinel."""
    keys = contracts.where(F.col(other).isNotNull() & ~F.col(other).isin(*SENTINELS) & (F.col(other) != F.col(own))).select(F.col(other).alias(key)).distinct()
    return rows.join(keys, key, "left_semi")


def id_list(rows: DataFrame, row_id: str, most: int = 100_000) -> DataFrame:
    """The ids of a table, the `most` least of them."""
    return rows.select(row_id).orderBy(row_id).limit(most)


def fetched_by_keys(keys: DataFrame, key: str, fetch: Callable[[list], list[dict]], schema: str, size: int = 100) -> DataFrame:
    """Rows (of the schema) that fetch gives for batches of `size` distinct keys, each asked for in a task; error is null for them.

    A batch that keeps failing has one row, with its error and nothing else: it is passed over, the others come.
    """
    batches = id_batches(keys.select(key).where(F.col(key).isNotNull()).distinct(), key, size).groupBy("batch").agg(F.array_sort(F.collect_list(key)).alias("keys"))
    whole = StructType.fromDDL(f"{schema}, error string")

    def ask(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for mine in part.column("keys").to_pylist():
                try:
                    rows = [{**r, "error": None} for r in with_retries(lambda k=mine: fetch(k))]
                except Exception as e:  # goes to the batch it concerns
                    rows = [{"error": f"{type(e).__name__}: {e}"}]
                yield pa.RecordBatch.from_pylist([{f.name: r.get(f.name) for f in whole} for r in rows], to_arrow_schema(whole))

    return batches.repartition("batch").mapInArrow(ask, whole)


def by_keys(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is asked for."""
    return rows.join(keys.select(key).distinct(), key, "left_semi")


def added_to_sets(old: DataFrame, new: DataFrame, key: str, values: str) -> DataFrame:
    """Sets (arrays) of each key with the new ones' values, sorted; keys of either side."""
    both = old.select(key, values).unionByName(new.select(key, values))
    return both.groupBy(key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(values)))).alias(values))


def sets_edited(current: Column, added: Column, removed: Column) -> Column:
    """current with the added items and without the removed ones, each once, in order."""
    return F.array_sort(F.array_except(F.array_union(current, added), removed))


def sorted_items(m: Column) -> Column:
    """A map's entries by key."""
    return F.array_sort(F.map_entries(m))


def renamed_in(values: Column, old: str, new: str) -> Column:
    """An array with one value renamed."""
    return F.transform(values, lambda v: F.when(v == old, F.lit(new)).otherwise(v))


def coverage(tables: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """metric, value: the rows of each table, and the distinct values of each of its listed columns, in one aggregate a table."""
    out = []
    for name, (df, columns) in tables.items():
        row = df.agg(F.count("*").alias(name), *[F.count_distinct(c).alias(f"{name}.{c}") for c in columns])
        out.append(row.unpivot([], [f"`{c}`" for c in row.columns], "metric", "value"))
    return reduce(DataFrame.unionByName, out)


def table_of(items: Column, keys: list[str]) -> Column:
    """array of arrays of strings: the keys, then each item's values at them (dotted paths go into structs)."""
    at = lambda x, path: reduce(lambda v, k: v[k], path.split("."), x).cast("string")
    head = F.array(F.array(*[F.lit(k) for k in keys]))
    return F.concat(head, F.transform(items, lambda x: F.array(*[at(x, k) for k in keys])))


def field_report(matches: DataFrame, field: str, errors_only: bool = False) -> DataFrame:
    """The comparisons of one field, of all rows or of those that differ."""
    rows = matches.where(F.col("field") == field)
    return rows.where(~F.col("match")) if errors_only else rows


def row_report(matches: DataFrame, key: str, value) -> DataFrame:
    """The comparisons of one row."""
    return matches.where(F.col(key) == F.lit(value))


def error_list(x: Column) -> Column:
    """A recorded list of names as an array: JSON, a list in single quotes, or names with commas; empty for nothing, `nan` or `[]`."""
    plain = F.trim(F.coalesce(x, F.lit("")))
    parsed = F.from_json(F.replace(plain, F.lit("'"), F.lit('"')), "array<string>")
    split = F.transform(F.split(F.regexp_replace(plain, r"[\[\]'\"]", ""), ","), lambda v: F.trim(v))
    none = F.expr("cast(array() as array<string>)")
    names = F.when(F.lower(plain).isin("", "nan", "none", "[]"), none).when(plain.startswith("["), F.coalesce(parsed, split)).otherwise(split)
    return F.filter(names, lambda v: v.isNotNull() & (v != ""))


def closed_and_retried(jobs: DataFrame, stuck: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Jobs with the open ones of stuck batches cancelled; and the documents of those batches to run again: failed and cancelled jobs'."""
    held = stuck.select("batch_id").distinct().withColumn("stuck", F.lit(True))
    marked = jobs.join(held, "batch_id", "left")
    closed = marked.withColumn("status", F.when(F.col("stuck") & F.col("status").isin("PENDING", "STARTED"), "CANCELLED").otherwise(F.col("status")))
    again = closed.where(F.col("stuck") & F.col("status").isin("FAILURE", "CANCELLED")).select("batch_id", "document_id").distinct()
    return closed.drop("stuck"), again


def unique_names(rows: DataFrame, name: str, order: list[str]) -> DataFrame:
    """rows with each file name made unique: the first of a name (by `order`) keeps it, the others get `_1`, `_2`, ... before the extension.

    Numbers go on until a name is free: one that some row has for its own is passed over. Names that are made cannot meet, as a name tells its
    stem and number. Null names stay. A name of any number of rows is split over tasks.
    """
    stem, extension = F.regexp_replace(name, r"(?s)(\.[^.]*)?$", ""), F.regexp_extract(name, r"(?s)(\.[^.]*)$", 1)
    at = numbered(rows, [name], order, "__n")
    again = at.where(F.col("__n") > 0).select(F.col(name).alias("__name")).distinct()
    # own names of the form stem_number.extension, by the name whose copies they would be
    counter = F.regexp_extract(name, r"(?s)^.*_([1-9][0-9]{0,8})(\.[^.]*)?$", 1)
    base = F.regexp_replace(name, r"(?s)_[1-9][0-9]{0,8}(\.[^.]*)?$", "$1")
    own = rows.where(F.col(name).isNotNull() & (counter != "")).select(base.alias("__name"), counter.cast("int").alias("__taken"))
    taken = own.join(again, "__name", "left_semi").groupBy("__name").agg(F.array_sort(F.collect_set("__taken")).alias("__taken"))
    at = at.join(small(taken), at[name] == taken["__name"], "left")
    # the n-th number that is not taken: each taken one at or below it moves it on
    number = F.aggregate(F.coalesce("__taken", F.expr("cast(array() as array<int>)")), F.col("__n"), lambda n, t: F.when(t <= n, n + 1).otherwise(n))
    made = F.when(F.col("__n") == 0, F.col(name)).otherwise(F.concat(stem, F.lit("_"), number.cast("string"), extension))
    return at.withColumn(name, F.when(F.col(name).isNotNull(), made)).select(*[F.col(f"`{c}`") for c in rows.columns])


def expanded(rows: DataFrame, key: str, items: str, into: str) -> DataFrame:
    """key, into: a bridge row for each item of a list column, once; null lists, null items and empty lists give none."""
    return rows.select(key, F.explode(items).alias(into)).where(F.col(into).isNotNull()).distinct()


def flattened_name(path: Column, root: str) -> Column:
    """A path below the root as one file name, folders joined by `_`."""
    return F.replace(F.regexp_replace(path, f"^{root.rstrip('/')}/", ""), F.lit("/"), F.lit("_"))


def without_counter(name: Column) -> Column:
    """A name without ` (2)` or `_2` before its extension."""
    return F.regexp_replace(name, r"(?: \(\d+\)|_\d+)(\.[^.]*)$", "$1")


def json_dump(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def csv_dump(df: DataFrame, path: str) -> None:
    """Text with `;` between the columns and their names on top; nested columns as JSON."""
    nested = {c: F.to_json(c) for c, t in df.dtypes if t.startswith(("struct", "array", "map"))}
    df.withColumns(nested).write.mode("overwrite").option("sep", ";").option("header", True).csv(path)


def loaded(df: DataFrame) -> DataFrame:
    """Rows for a local table: distinct, with nested columns as JSON."""
    return df.withColumns({c: F.to_json(c) for c, t in df.dtypes if t.startswith(("struct", "array", "map"))}).dropDuplicates()
