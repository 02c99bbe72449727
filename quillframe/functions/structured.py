"""Nested values: lots, contractors, JSON paths, and the cleaning registry of each class."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType

from . import address, dates, files, ids, money, text
from .binding import let


def contractors(xs: Column, need_siret: bool = False) -> Column:
    """array of struct(nom, siret): those with a name (and a proper siret, if asked for), cleaned; null if none is left."""
    clean = F.transform(xs, lambda x: F.struct(F.nullif(x["nom"], F.lit("")).alias("nom"), ids.siret(x["siret"]).alias("siret")))
    kept = F.filter(clean, lambda x: x["nom"].isNotNull() & (x["siret"].isNotNull() if need_siret else F.lit(True)))
    return F.when(F.size(kept) > 0, kept)


def bank_accounts(xs: Column) -> Column:
    """array of struct(societe, rib map): those whose account has a bank or a number; null if none."""
    clean = F.transform(xs, lambda x: F.struct(x["societe"].alias("societe"), ids.bank_account(x["rib"]).alias("rib")))
    kept = F.filter(clean, lambda x: x["rib"]["banque"].isNotNull() | x["rib"]["iban"].isNotNull())
    return F.when(F.size(kept) > 0, kept)


def merged_lots(lists: dict[str, tuple[Column, str]], key: str = "numero_lot") -> Column:
    """Full outer merge of lists of structs by their key, in order of it.

    lists: output field to (array, field of its items). A key that one list lacks has a null there; of items that repeat a key, the last counts.
    """
    keys = F.array_sort(F.array_distinct(reduce(F.array_union, [F.coalesce(F.transform(xs, lambda x: x[key]), F.expr("array()").cast("array<int>")) for xs, _ in lists.values()])))
    of = lambda xs, k, f: F.get(F.reverse(F.filter(xs, lambda x: x[key] == k)), F.lit(0))[f]
    return F.transform(F.filter(keys, lambda k: k.isNotNull()), lambda k: F.struct(k.alias(key), *[of(xs, k, f).alias(name) for name, (xs, f) in lists.items()]))


def at_path(v: Column, path: str, kind: str = "string") -> Column:
    """Value of a VARIANT at a dotted path; `*` goes through an array."""
    head, star, tail = path.partition("*")
    head = head.strip(".")
    if not star:
        return F.try_variant_get(v, f"$.{head}" if head else "$", kind)
    items = F.try_variant_get(v, f"$.{head}" if head else "$", "array<variant>")
    return F.transform(items, lambda x: at_path(x, tail.strip("."), kind))


def is_by_lot(value: Column) -> Column:
    """Whether a JSON text is a list whose first item is an object with a numero_lot."""
    first = F.try_variant_get(F.try_parse_json(value), "$[0]", "variant")
    return F.coalesce(F.map_contains_key(F.try_variant_get(first, "$", "map<string,variant>"), "numero_lot"), F.lit(False))


#: Main fields of a synthesis, by the names that they are shown under.
MAIN_FIELDS = {"Designation": "libelle", "Descriptif_prestations": "description_detaillee", "Date": "date_prestation", "Prestataire": "prestataire", "SIRET": "siret_prestataire", "Administration": "administration_beneficiaire"}


def main_fields(synthesis: Column) -> Column:
    """The `valeur` of each main field of a synthesis (JSON text): null where the field or its value is not there, empty where the field is no object."""
    value = F.try_parse_json(synthesis)

    def one(name: str) -> Column:
        field = F.try_variant_get(value, f"$.{name}", "variant")
        there = F.map_contains_key(F.try_variant_get(value, "$", "map<string,variant>"), name)
        is_object = F.schema_of_variant(field).startswith("OBJECT")
        return F.when(~F.coalesce(there, F.lit(False)), F.lit(None)).when(F.coalesce(is_object, F.lit(False)), F.try_variant_get(field, "$.valeur", "string")).otherwise(F.lit(""))

    return F.struct(*[one(source).alias(name) for name, source in MAIN_FIELDS.items()])


def raw_document(id_: Column, name: Column, size: Column) -> Column:
    """struct(id, name, size) of a document as the service tells it: the name composed, the size as a number or -1."""
    return F.struct(id_.alias("id"), text.composed(name).alias("name"), files.api_size(size).alias("size"))


def extraction_ratio(m: Column) -> Column:
    """Share of a map's values that are neither null nor empty; 0 for an empty map."""
    full = F.size(F.filter(F.map_values(m), lambda x: F.coalesce(x, F.lit("")) != ""))
    return F.when(F.size(m) > 0, full / F.size(m)).otherwise(F.lit(0.0))


def nested(schema: str, rule: Callable[[Column], Column]) -> Callable[[Column], Column]:
    """A rule of nested values for their JSON texts."""
    return lambda v: F.to_json(let(F.from_json(v, schema), rule))


_ADDRESS = "struct<" + ",".join(f"{f}:string" for f in address.FIELDS) + ">"
_PARTIES = "array<struct<nom:string,siret:string>>"
_LOT = "array<struct<numero_lot:int,"

postal = nested(_ADDRESS, address.postal_address)
duration = nested("map<string,string>", dates.contract_duration)
account = nested("map<string,string>", ids.bank_account)

#: Class to field to cleaning expression.
CLEANERS: dict[str, dict[str, Callable[[Column], Column]]] = {
    "acte_engagement": {
        "rib_mandataire": account, "montant_ttc": money.amount, "montant_ht": money.amount, "montant_tva": money.percentage, "cotraitants": nested(_PARTIES, contractors), "sous_traitants": nested(_PARTIES, contractors),
        "siret_mandataire": ids.siret, "duree": duration, "rib_autres": nested("array<struct<societe:string,rib:map<string,string>>>", bank_accounts),
    },
    "rib": {"iban": ids.iban, "bic": ids.bic, "adresse_postale_titulaire": postal},
    "fiche_navette": {"montant_ht": money.amount, "taux_tva": money.percentage},
    "sous_traitance": {
        "adresse_postale_titulaire": postal, "siret_titulaire": ids.siret, "adresse_postale_sous_traitant": postal, "siret_sous_traitant": ids.siret, "montant_tva": money.percentage, "montant_sous_traitance_ttc": money.amount,
        "montant_sous_traitance_ht": money.amount, "rib_sous_traitant": account, "duree_sous_traitance": duration,
    },
}

#: The lists of lots that are merged, with the fields that each gives.
LOT_LISTS = {"lots": "titre_lot:string", "forme_marche_lots": "structure:string,tranches:string,forme_prix:string,attributaires:string", "duree_lots": "duree_lot:string", "montant_ht_lots": "montant_ht_maximum:string,type_montant:string"}


def lots(m: Column) -> Column:
    """JSON of a map's four lists of lots as one list by lot number: titre, forme, duree_lot, montant_ht, each null inside where its list lacks the lot."""
    parsed = [F.coalesce(F.from_json(F.try_element_at(m, F.lit(k)), f"{_LOT}{fields}>>"), F.expr(f"cast(array() as {_LOT}{fields}>>)")).alias(k) for k, fields in LOT_LISTS.items()]

    def merged(p: Column) -> Column:
        lists = [p[k] for k in LOT_LISTS]
        keys = F.array_sort(F.array_distinct(F.flatten(F.array(*[F.transform(xs, lambda x: x["numero_lot"]) for xs in lists]))))
        last = lambda i, k: F.get(F.reverse(F.filter(lists[i], lambda x: x["numero_lot"] == k)), F.lit(0))
        part = lambda x, names: F.struct(*[x[n].alias(n) for n in names])

        def lot(k: Column) -> Column:
            found = F.array(F.struct(*[last(i, k).alias(f"l{i}") for i in range(4)]))
            return F.get(F.transform(found, lambda x: F.struct(
                k.alias("numero_lot"), x["l0"]["titre_lot"].alias("titre"), part(x["l1"], ("structure", "tranches", "forme_prix", "attributaires")).alias("forme"), x["l2"]["duree_lot"].alias("duree_lot"),
                part(x["l3"], ("montant_ht_maximum", "type_montant")).alias("montant_ht"),
            )), F.lit(0))

        return F.transform(F.filter(keys, lambda k: k.isNotNull()), lot)

    # the four lists are parsed once and bound to a name
    whole = let(F.struct(*parsed), merged)
    return F.to_json(whole, {"ignoreNullFields": "false"})


def with_lots(m: Column) -> Column:
    """A map whose four lists of lots are one; an empty map stays."""
    rest = F.map_filter(m, lambda k, v: ~k.isin(*LOT_LISTS))
    return F.when(F.size(m) > 0, F.map_concat(rest, F.create_map(F.lit("lots"), lots(m)))).otherwise(m)


#: Class to the rule for its whole object.
OBJECT_CLEANERS: dict[str, Callable[[Column], Column]] = {"ccap": with_lots}


def cleaned(df: DataFrame, class_column: str, data: str) -> DataFrame:
    """The map column `data` (texts; nested values as JSON) with the values that its class has a cleaner for cleaned, then the class's rule for the whole object.

    Unknown classes, other keys and null maps pass unchanged. A value that its cleaner rejects is null; no row is lost by another one's error.
    """

    def entry(rules: dict[str, Callable[[Column], Column]]) -> Callable[[Column, Column], Column]:
        return lambda k, v: reduce(lambda acc, r: F.when(k == r[0], r[1](v)).otherwise(acc), rules.items(), v)

    out = F.col(data)
    for name in CLEANERS | OBJECT_CLEANERS:
        mine = F.transform_values(F.col(data), entry(CLEANERS[name])) if name in CLEANERS else F.col(data)
        mine = OBJECT_CLEANERS[name](mine) if name in OBJECT_CLEANERS else mine
        out = F.when((F.col(class_column) == name) & F.col(data).isNotNull(), mine).otherwise(out)
    return df.withColumn(data, out)


@F.pandas_udf(MapType(StringType(), StringType()))
def json_leaves(texts: pd.Series) -> pd.Series:
    """Dotted path to value (JSON text) of every leaf of a JSON text; items of lists by number; null for what is no JSON."""

    def walk(v, path: str, out: dict[str, str]) -> None:
        below = v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()
        if not below:
            out[path] = json.dumps(v, ensure_ascii=False)
        for k, x in below:
            walk(x, f"{path}.{k}" if path else str(k), out)

    def leaves(x: str | None) -> dict[str, str] | None:
        try:
            value = json.loads(x)
        except (TypeError, ValueError):
            return None
        out: dict[str, str] = {}
        walk(value, "", out)
        return out

    return texts.map(leaves)


def leaf_diff(a: Column, b: Column) -> Column:
    """Of two maps of leaves: struct(only_a, only_b, changed), sorted paths; null maps are empty."""
    empty = F.expr("cast(map() as map<string,string>)")
    x, y = F.coalesce(a, empty), F.coalesce(b, empty)
    shared = F.array_intersect(F.map_keys(x), F.map_keys(y))
    return F.struct(
        F.array_sort(F.array_except(F.map_keys(x), F.map_keys(y))).alias("only_a"), F.array_sort(F.array_except(F.map_keys(y), F.map_keys(x))).alias("only_b"),
        F.array_sort(F.filter(shared, lambda k: F.try_element_at(x, k) != F.try_element_at(y, k))).alias("changed"),
    )
