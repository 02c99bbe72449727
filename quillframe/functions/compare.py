"""Equality rules of the quality harness: empty values (null, empty text or list) are all equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let
from .text import comparable, without_accents

Rule = Callable[[Column, Column], Column]


def _empty(x: Column) -> Column:
    return F.nullif(x, F.lit(""))


def exact(a: Column, b: Column) -> Column:
    return _empty(a).eqNullSafe(_empty(b))


def normalized(a: Column, b: Column) -> Column:
    """Without case, accents, punctuation and spaces."""
    plain = lambda x: F.replace(comparable(x), F.lit(" "), F.lit(""))
    return plain(a).eqNullSafe(plain(b))


def fields(names: tuple[str, ...], rule: Rule = exact) -> Rule:
    """All of these fields of two structs."""

    def all_equal(a: Column, b: Column) -> Column:
        out = F.lit(True)
        for n in names:
            out = out & rule(a[n], b[n])
        return out

    return all_equal


duration = fields(("duree_initiale", "duree_reconduction", "nb_reconductions", "delai_tranche_optionnelle"), lambda a, b: a.eqNullSafe(b))


def address(a: Column, b: Column) -> Column:
    fold = lambda x: F.translate(comparable(F.translate(x, "-'", "  ")), " ", "")
    return fields(("numero_voie", "nom_voie", "complement_adresse", "code_postal", "ville", "pays"), lambda x, y: fold(x).eqNullSafe(fold(y)))(a, b)


def mandatee_account(a: Column, b: Column) -> Column:
    """Both accounts by number; neither by bank; one alone is a difference."""
    x, y = _empty(a["iban"]), _empty(b["iban"])
    same = lambda p, q: plain_ascii(p) == plain_ascii(q)
    return F.when(x.isNotNull() & y.isNotNull(), same(x, y)).when(x.isNull() & y.isNull(), same(a["banque"], b["banque"])).otherwise(F.lit(False))


def plain_ascii(x: Column) -> Column:
    """Lower case, only a-z and 0-9, without spaces: native, for texts whose accents are gone. Null is empty."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]", "")


def same_multiset(a: Column, b: Column) -> Column:
    """Lists with the same items as often, in any order; equal items pair up one to one."""
    none = lambda x: F.coalesce(x, F.expr("array()").cast("array<string>"))
    return F.array_sort(none(a)) == F.array_sort(none(b))


def contained(a: Column, b: Column) -> Column:
    """Every item of a is in b."""
    return F.coalesce(F.forall(a, lambda x: F.array_contains(b, x)), F.lit(True))


def both(rule: Rule, empty: Callable[[Column], Column]) -> Rule:
    """Two empty values are equal, an empty and another one are not; the rule has the rest, null of it is a difference."""
    return lambda a, b: F.when(empty(a) & empty(b), True).when(empty(a) | empty(b), False).otherwise(F.coalesce(rule(a, b), F.lit(False)))


def _no_text(x: Column) -> Column:
    return F.coalesce(F.trim(x).isin("", "null", '""', "[]", "{}"), F.lit(True))


def of_json(schema: str, rule: Rule, folded: bool = False) -> Rule:
    """A native rule of nested values for their JSON texts; folded: accents go from the whole text before it is parsed, as Python has no place inside a list's rule.

    Both are parsed once and bound to a name, however often the rule looks at them.
    """
    parse = lambda x: F.from_json(without_accents(x) if folded else x, schema)

    def bound(a: Column, b: Column) -> Column:
        return let(F.struct(parse(a).alias("a"), parse(b).alias("b")), lambda p: rule(p["a"], p["b"]))

    return both(bound, _no_text)


def _no_items(x: Column) -> Column:
    return F.coalesce(F.size(x) == 0, F.lit(True))


def matched(rule: Rule) -> Rule:
    """Two lists whose items pair up one to one: each item of the second, in order, takes the first item of the first that is still free and
    fits by the rule; all must find one, and none may be left. The rule needs to be no equivalence: what an item takes depends on the order.
    """

    def pair_up(a: Column, b: Column) -> Column:
        def take(left: Column, item: Column) -> Column:
            first = F.array_position(F.transform(left, lambda x: F.coalesce(rule(x, item), F.lit(False))), F.lit(True))
            return let(first, lambda at: F.when(at > 0, F.filter(left, lambda _, i: i != at - 1)))  # null: an item found none

        return (F.size(a) == F.size(b)) & F.aggregate(b, a, take).isNotNull()

    return both(pair_up, _no_items)


def matched_by(key: Callable[[Column], Column]) -> Rule:
    """As matched, where items fit if their keys are equal texts: any order gives the same, so sorted keys are compared."""
    keys = lambda x: F.array_sort(F.transform(x, key))
    return both(lambda a, b: (F.size(a) == F.size(b)) & (keys(a) == keys(b)), _no_items)


def each_in_by(key: Callable[[Column], Column]) -> Rule:
    """As each_in, where items fit if their keys are equal texts."""
    return both(lambda a, b: F.size(F.array_except(F.transform(a, key), F.transform(b, key))) == 0, _no_items)


def each_in(rule: Rule) -> Rule:
    """Every item of the first list fits some item of the second; items that the first lacks do no harm."""
    return both(lambda a, b: F.forall(a, lambda x: F.exists(b, lambda y: F.coalesce(rule(x, y), F.lit(False)))), _no_items)


def positional(a: Column, b: Column) -> Column:
    return in_place(lambda x, y: x.eqNullSafe(y))(a, b)


def in_place(rule: Rule) -> Rule:
    """Lists of one length whose items fit place by place."""
    return lambda a, b: (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, rule), lambda x: F.coalesce(x, F.lit(False)))


_null_safe = lambda a, b: a.eqNullSafe(b)
_DURATION = ("duree_initiale", "duree_reconduction", "nb_reconductions", "delai_tranche_optionnelle")
_of = lambda names: "struct<" + ",".join(f"`{n}`:string" for n in names) + ">"


def _words(x: Column) -> Column:
    """As plain_ascii, with single spaces between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9\s]", ""), r"\s+", " "))


def _line(x: Column) -> Column:
    """Of an address: upper case, hyphens and apostrophes as spaces, double spaces as one."""
    return F.regexp_replace(F.translate(F.upper(F.trim(F.coalesce(x, F.lit("")))), "-'", "  "), r"\s\s", " ")


def contractor(a: Column, b: Column) -> Column:
    """One contractor: the name without case, signs and spaces (accents are gone by then), the siret exactly."""
    return (plain_ascii(a["nom"]) == plain_ascii(b["nom"])) & exact(a["siret"], b["siret"])


def contractor_key(x: Column) -> Column:
    """Equal for what contractor takes for one."""
    return F.concat(plain_ascii(x["nom"]), F.lit("/"), F.coalesce(x["siret"], F.lit("")))


def account_key(x: Column) -> Column:
    """Equal for what mandatee_account takes for one."""
    return F.when(_empty(x["iban"]).isNotNull(), F.concat(F.lit("iban/"), plain_ascii(x["iban"]))).otherwise(F.concat(F.lit("bank/"), plain_ascii(x["banque"])))


def annexes(a: Column, b: Column) -> Column:
    """Whether amounts are in an annex, and the classes of it in any order."""
    x, y = a["classification"], b["classification"]
    lists = F.when(x.isNull() & y.isNull(), True).when(x.isNull() | y.isNull(), False).otherwise(F.array_sort(x) == F.array_sort(y))
    return a["annexe_financière"].eqNullSafe(b["annexe_financière"]) & lists


def lot_duration(a: Column, b: Column) -> Column:
    """Of one lot: two texts exactly, two objects by their four fields; a text and an object, or nothing, differ."""
    is_object = lambda x: F.ltrim(x).startswith("{")
    parse = lambda x: F.from_json(x, _of(_DURATION))
    return F.when(is_object(a) & is_object(b), fields(_DURATION, _null_safe)(parse(a), parse(b))).when(~is_object(a) & ~is_object(b), a == b).otherwise(F.lit(False))


_PARTY, _ACCOUNT, _FORM = "struct<nom:string,siret:string>", "struct<banque:string,iban:string>", ("structure", "tranches", "forme_prix", "attributaires")
_AMOUNT = ("numero_lot", "montant_ht_maximum", "type_montant")
normal = both(normalized, _no_text)
_POSTAL = ("numero_voie", "nom_voie", "complement_adresse", "code_postal", "ville", "pays")
postal = of_json(_of(_POSTAL), fields(_POSTAL, lambda a, b: _line(a) == _line(b)), folded=True)
months = of_json(_of(_DURATION), duration)
account = of_json(_ACCOUNT, mandatee_account, folded=True)
co_contractors = of_json(f"array<{_PARTY}>", matched_by(contractor_key), folded=True)
sub_contractors = of_json(f"array<{_PARTY}>", each_in_by(contractor_key), folded=True)
other_accounts = of_json(f"array<struct<societe:string,rib:{_ACCOUNT}>>", matched_by(lambda x: account_key(x["rib"])), folded=True)
#: As the harness has it: the rule reads bank and number beside `rib`, where they never are, so lists of one length are equal.
other_accounts_by_size = of_json("array<string>", lambda a, b: F.size(a) == F.size(b))
amounts_in_annex = of_json("struct<`annexe_financière`:string,classification:array<string>>", annexes)
contract_form = of_json("struct<lot_concerne:struct<numero_lot:string,titre_lot:string>,marche_subsequent:string,marche_parent:string>", fields(("lot_concerne", "marche_subsequent", "marche_parent"), _null_safe))
price_form = of_json(_of(_FORM), fields(_FORM, _null_safe))
lot_titles = of_json("array<string>", in_place(lambda a, b: _words(a) == _words(b)), folded=True)
lot_forms = of_json(f"array<{_of(_FORM)}>", in_place(both(fields(_FORM, _null_safe), lambda x: x.isNull())))
lot_durations = of_json("array<string>", in_place(lot_duration))
lot_amounts = of_json(f"array<{_of(_AMOUNT)}>", lambda a, b: (F.size(a) == F.size(b)) & each_in(fields(_AMOUNT, _null_safe))(a, b))


def registry(judge: Callable[[str], Rule] | None = None, as_harness: bool = False) -> dict[str, dict[str, Rule]]:
    """Class to field to rule of JSON or plain texts. `judge` gives the rule of "object" and "administration", whose meaning counts; without one
    they are compared normalized. as_harness: the slip of the studied harness in `rib_autres` is kept.
    """
    asked = judge or (lambda subject: normal)
    purpose, buyer, others = asked("object"), asked("administration"), other_accounts_by_size if as_harness else other_accounts
    # Fields of each class with their rules.
    return {
        "acte_engagement": {
            "objet_marche": purpose, "administration_beneficiaire": buyer, "societe_principale": normal, "siret_mandataire": exact, "siren_mandataire": exact, "rib_mandataire": account, "cotraitants": co_contractors,
            "sous_traitants": sub_contractors, "rib_autres": others, "montant_ttc": exact, "montant_ht": exact, "date_signature_mandataire": exact, "date_signature_administration": exact, "date_notification": exact,
            "duree": months, "conserve_avance": exact, "montants_en_annexe": amounts_in_annex, "forme_marche": contract_form, "code_cpv": exact, "montant_tva": exact, "mode_consultation": exact, "mode_reconduction": exact,
            "ligne_imputation_budgetaire": exact,
        },
        "ccap": {
            "id_marche": exact, "objet_marche": purpose, "forme_marche": price_form, "lots.*.titre": lot_titles, "lots.*.forme": lot_forms, "lots.*.duree_lot": lot_durations, "lots.*.montant_ht": lot_amounts,
            "duree_marche": months, "formule_revision_prix": exact, "index_reference": exact, "avance": exact, "revision_prix": exact, "montant_ht": exact, "ccag": exact, "mode_consultation": exact, "regle_attribution_bc": exact,
            "penalites": exact, "code_cpv": exact, "type_reconduction": exact, "debut_execution": exact, "retenue_garantie": exact, "mois_zero_revision": exact, "clause_sauvegarde_revision": exact,
        },
        "sous_traitance": {
            "administration_beneficiaire": buyer, "objet_marche": purpose, "societe_principale": normal, "adresse_postale_titulaire": postal, "siret_titulaire": normal, "societe_sous_traitant": normal,
            "adresse_postale_sous_traitant": postal, "siret_sous_traitant": normal, "montant_sous_traitance_ht": normal, "montant_sous_traitance_ttc": normal, "description_prestations": normal, "date_signature": normal,
            "montant_tva": normal, "paiement_direct": normal, "rib_sous_traitant": account, "conserve_avance": normal, "duree_sous_traitance": months,
        },
        "devis": {"numero_devis": exact, "objet": purpose, "date_emission": exact, "titulaire": exact, "administration_beneficiaire": buyer, "montants": exact, "duree_validite": exact, "date_signature": exact, "dernier_signataire": normal},
        "fiche_navette": {"objet": purpose, "administration_beneficiaire": buyer} | dict.fromkeys(("societe_principale", "accord_cadre", "id_accord_cadre", "montant_ht", "reconduction", "taux_tva", "centre_cout", "centre_financier", "activite", "domaine_fonctionnel", "localisation_interministerielle", "groupe_marchandise"), normal),
        "rib": {"iban": normal, "bic": normal, "titulaire_compte": normal, "adresse_postale_titulaire": postal, "domiciliation": normal, "banque": normal},
    }


#: The registry without a judge.
REGISTRY: dict[str, dict[str, Rule]] = registry()
