"""Dates of the remote API, durations and activity kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def api_timestamp(x: Column) -> Column:
    """`/Date(ms)/` as a UTC timestamp; null for anything else."""
    return F.timestamp_millis(F.nullif(F.regexp_extract(x, r"^/Date\((-?\d+)\)/$", 1), F.lit("")).cast("long"))


def api_literal(t: Column) -> Column:
    return F.concat(F.lit("datetime'"), F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("'"))


def unpadded_date(d: Column) -> Column:
    return F.date_format(d, "y-M-d")


def activity_kind(x: Column) -> Column:
    """CREATE or UPDATE by the alert's ending; null for others."""
    return F.when(x.endswith("Création"), "CREATE").when(x.endswith("Modification"), "UPDATE")


def duration_seconds(x: Column) -> Column:
    """`24h`, `7d`, `30m` or `10s` as seconds; null for others."""
    n = F.regexp_extract(x, r"^(\d+)[smhd]$", 1).try_cast("long")
    unit = F.regexp_extract(x, r"^\d+([smhd])$", 1)
    return n * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400)


def contract_duration(m: Column) -> Column:
    """map of four durations to struct(duree_initiale, duree_reconduction, nb_reconductions, delai_tranche_optionnelle, error).

    Digit strings are numbers; a missing key or anything else is an error; null where all are null or 0.
    """
    keys = ("duree_initiale", "duree_reconduction", "nb_reconductions", "delai_tranche_optionnelle")
    raw = [F.try_element_at(m, F.lit(k)) for k in keys]
    values = [F.when(r.rlike(r"^\d+$"), r.try_cast("int")) for r in raw]
    bad = [F.when(~F.map_contains_key(m, k), F.lit(f"{k} is missing")).when(r.isNotNull() & v.isNull(), F.lit(f"{k} is not a number")) for k, r, v in zip(keys, raw, values)]
    error = F.coalesce(*bad)
    some = error.isNotNull()
    for v in values:
        some = some | (F.coalesce(v, F.lit(0)) != 0)
    return F.when(m.isNotNull() & some, F.struct(*[F.when(error.isNull(), v).alias(k) for k, v in zip(keys, values)], error.alias("error")))
