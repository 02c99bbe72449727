"""Postal addresses: struct of numero_voie, nom_voie, complement_adresse, code_postal, ville, pays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import name_case, squeezed

FIELDS = ("numero_voie", "nom_voie", "complement_adresse", "code_postal", "ville", "pays")


def postal_address(a: Column) -> Column:
    """Normalised: single spaces, the city in name case, a postcode of five digits or none, France where only the country is missing.

    Null where street number, street name, postcode and city are all empty.
    """
    text = {f: F.nullif(squeezed(a[f]), F.lit("")) for f in FIELDS}
    digits = F.regexp_replace(text["code_postal"], "[^0-9]", "")
    code = F.when(F.length(digits) == 5, digits)
    city = F.nullif(name_case(a["ville"]), F.lit(""))
    country = F.when(F.lower(text["pays"]) == "fr", F.lit("France")).when(text["pays"].isNull() & code.isNotNull(), F.lit("France")).otherwise(text["pays"])
    values = text | {"code_postal": code, "ville": city, "pays": country}
    some = values["numero_voie"].isNotNull() | values["nom_voie"].isNotNull() | code.isNotNull() | city.isNotNull()
    return F.when(some, F.struct(*[values[f].alias(f) for f in FIELDS]))


def address_line(a: Column) -> Column:
    """`number street, complement, postcode city, country` without what is blank."""
    part = lambda *fs: F.nullif(F.concat_ws(" ", *[F.nullif(F.trim(a[f]), F.lit("")) for f in fs]), F.lit(""))
    return F.concat_ws(", ", part("numero_voie", "nom_voie"), part("complement_adresse"), part("code_postal", "ville"), part("pays"))
