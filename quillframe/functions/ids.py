"""Company and bank identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: Account number lengths of ISO 13616, by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MD": 24,
    "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25, "QA": 29,
    "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24,
    "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}
#: The same as a map in SQL: one parsed text instead of two calls an entry.
_LENGTHS = "map(" + ", ".join(f"'{k}', {n}" for k, n in IBAN_LENGTHS.items()) + ")"
_VALUES = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fixed value: the digits that the bank key rule puts for A-Z.
_KEY_DIGITS = "12345678912345678923456789"


#: The checks of national account numbers, by country: kind, first character (from 0), weights of the characters from there on (the last is the check's own)
#: or how many they are, modulus, remainder. sum: weighted sum; ten: as sum, a check of 10 is written 1; luhn: as sum, of the digits of each product; mod: the characters
#: as one number; own: the last two digits are the others' remainder, 97 for 0; iso: ISO 7064 MOD 11,10; cin: the letter before of the odd and even table.
NATIONAL = {
    "BA": [("mod", 0, 16, 97, 1)],
    "BE": [("own", 0, 12, 97, 0)],
    "CZ": [("sum", 4, (10, 5, 8, 4, 2, 1), 11, 0), ("sum", 10, (6, 3, 7, 9, 10, 5, 8, 4, 2, 1), 11, 0)],
    "EE": [("sum", 2, (7, 1, 3, 7, 1, 3, 7, 1, 3, 7, 1, 3, 7, 1), 10, 0)],
    "ES": [("ten", 0, (4, 8, 5, 10, 9, 7, 3, 6, 1), 11, 0), ("ten", 9, (1, 1, 2, 4, 8, 5, 10, 9, 7, 3, 6), 11, 0)],
    "FI": [("luhn", 0, (2, 1) * 7, 10, 0)],
    "HR": [("iso", 0, 7, 10, 1), ("iso", 7, 10, 10, 1)],
    "HU": [("sum", 0, (9, 7, 3, 1) * 2, 10, 0), ("sum", 8, (9, 7, 3, 1) * 4, 10, 0)],
    "IS": [("sum", 12, (3, 2, 7, 6, 5, 4, 3, 2, 1), 11, 0)],
    "IT": [("cin", 0, 23, 26, 0)],
    "ME": [("mod", 0, 18, 97, 1)],
    "MK": [("mod", 0, 15, 97, 1)],
    "MR": [("mod", 0, 23, 97, 0)],
    "NO": [("sum", 0, (5, 4, 3, 2, 7, 6, 5, 4, 3, 2, 1), 11, 0)],
    "PL": [("sum", 0, (3, 9, 7, 1, 3, 9, 7, 1), 10, 0)],
    "PT": [("mod", 0, 21, 97, 1)],
    "RS": [("mod", 0, 18, 97, 1)],
    "SI": [("mod", 0, 15, 97, 1)],
    "SK": [("sum", 4, (10, 5, 8, 4, 2, 1), 11, 0), ("sum", 10, (6, 3, 7, 9, 10, 5, 8, 4, 2, 1), 11, 0)],
    "SM": [("cin", 0, 23, 26, 0)],
    "TL": [("mod", 0, 19, 97, 1)],
    "TN": [("mod", 0, 20, 97, 0)],
}
#: What the odd and even table puts for the characters 0-9 and A-Z at odd places.
ODD_VALUES = (1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23)


def _national_map() -> str:
    """NATIONAL as a map in SQL, weights always a list."""
    one = lambda c: f"named_struct('kind', '{c[0]}', 'at', {c[1]}, 'weights', array({', '.join(map(str, c[2] if isinstance(c[2], tuple) else (1,) * c[2]))}), 'modulus', {c[3]}, 'rest', {c[4]})"
    return "map(" + ", ".join(f"'{k}', array({', '.join(map(one, checks))})" for k, checks in NATIONAL.items()) + ")"


_CHECKS = _national_map()


def national_is_valid(country: Column, number: Column) -> Column:
    """All checks that the country has for its account numbers (without the four first characters of an IBAN); true where it has none. A character that a check can't take fails it."""
    values = F.transform(F.filter(F.split(number, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(_VALUES)) - 1)

    def holds(check: Column, all_values: Column) -> Column:
        n = F.size(check["weights"])
        part = F.slice(all_values, check["at"] + 1, n)
        digits = F.forall(part, lambda v: (v >= 0) & (v <= 9))
        last, body = F.element_at(part, -1), F.slice(part, F.lit(1), n - 1)
        total = lambda product: F.aggregate(F.zip_with(part, check["weights"], product), F.lit(0), lambda a, x: a + x)
        plain = total(lambda v, w: v * w) % check["modulus"]
        ten = F.when(last == 1, (plain == 2) | (plain == 0)).otherwise(plain == 0)
        luhn = total(lambda v, w: F.when(v * w > 9, v * w - 9).otherwise(v * w)) % check["modulus"] == check["rest"]
        number97 = lambda xs: F.aggregate(xs, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97)
        own = F.slice(part, F.lit(1), n - 2)
        told = F.element_at(part, -2) * 10 + last
        remainder = number97(own)
        iso = F.aggregate(body, F.lit(10), lambda p, v: F.when((p + v) % 10 == 0, 20 % F.lit(11)).otherwise(((p + v) % 10) * 2 % 11))
        odd = F.array(*[F.lit(v) for v in ODD_VALUES])
        rest = F.slice(part, F.lit(2), n - 1)
        cin = F.aggregate(F.transform(rest, lambda v, i: F.when(i % 2 == 0, F.get(odd, v)).otherwise(F.when(v > 9, v - 10).otherwise(v))), F.lit(0), lambda a, v: a + v) % 26
        return (
            F.when(F.size(part) < n, False)
            .when(check["kind"] == "sum", digits & (plain == check["rest"]))
            .when(check["kind"] == "ten", digits & ten)
            .when(check["kind"] == "luhn", digits & luhn)
            .when(check["kind"] == "mod", digits & (number97(part) == check["rest"]))
            .when(check["kind"] == "own", digits & (told == F.when(remainder == 0, 97).otherwise(remainder)))
            .when(check["kind"] == "iso", digits & ((iso + last) % 10 == 1))
            .otherwise((F.element_at(part, 1) == cin + 10))
        )

    checks = F.try_element_at(F.expr(_CHECKS), country)
    return F.coalesce(let(values, lambda vs: F.forall(checks, lambda c: F.coalesce(holds(c, vs), F.lit(False)))), F.lit(True))


def siret(x: Column) -> Column:
    """14 digits, without spaces (also U+00A0, U+202F) and a trailing .0; else null."""
    return F.nullif(F.regexp_extract(F.translate(x, "   ", ""), r"^(\d{14})(?:\.0+)?$", 1), F.lit(""))


def bic(x: Column) -> Column:
    """Without white space, in upper case; null unless it has 8 or 11 characters."""
    v = F.upper(F.regexp_replace(x, r"(?U)\s", ""))
    return F.when(F.length(v).isin(8, 11), v)


def mod97(x: Column) -> Column:
    """The text's characters, letters as 10 to 35, as a number modulo 97; null if it has other characters."""
    step = lambda acc, v: F.pmod(acc * F.when(v > 9, 100).otherwise(10) + v, F.lit(97))
    values = F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.position(c, F.lit(_VALUES)) - 1)
    return F.when(x.rlike("^[0-9A-Z]+$"), F.aggregate(values, F.lit(0), step))


def rib_key(bank: Column, branch: Column, account: Column) -> Column:
    """The two-digit key of a French account."""
    digits = F.translate(account, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", _KEY_DIGITS).try_cast("long")
    return 97 - F.pmod(89 * bank.try_cast("long") + 15 * branch.try_cast("long") + 3 * digits, F.lit(97))


def _iban_checks(v: Column) -> Column:
    length = F.try_element_at(F.expr(_LENGTHS), F.substring(v, 1, 2))
    shape = v.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z]+$") & F.coalesce(F.length(v) == length, F.lit(False))
    french = F.substring(v, 1, 2).isin("FR", "MC")
    parts = v.rlike("^[A-Z]{2}[0-9]{12}[0-9A-Z]{11}[0-9]{2}$")
    key = rib_key(F.substring(v, 5, 5), F.substring(v, 10, 5), F.substring(v, 15, 11)) == F.substring(v, 26, 2).try_cast("long")
    whole = mod97(F.concat(F.substring(v, 5, 64), F.substring(v, 1, 4))) == 1
    return F.when(~shape, F.lit(False)).when(french, F.coalesce(parts & key & whole, F.lit(False))).otherwise(F.coalesce(whole & national_is_valid(F.substring(v, 1, 2), F.substring(v, 5, 64)), F.lit(False)))


def iban_is_valid(x: Column) -> Column:
    """Shape and length of the country, modulo 97, and the national checks of French and of 22 other countries' accounts; true for null and empty."""
    return F.when(F.coalesce(x, F.lit("")) == "", F.lit(True)).otherwise(_iban_checks(x))


def iban_corrected(x: Column) -> Column:
    """For 27 characters, the only valid account that one substitution (letters in the first two places, digits elsewhere) gives; else null.

    As a number modulo 97 the account must be 1, so what stands before and after a place leaves at most one character for it: 27 tries are checked.
    """
    return F.when(F.length(x) == 27, let(x, _one_substitution))


def _one_substitution(x: Column) -> Column:
    values = F.transform(F.filter(F.split(F.concat(F.substring(x, 5, 23), F.substring(x, 1, 4)), ""), lambda c: c != ""), lambda c: F.position(c, F.lit(_VALUES)) - 1)
    power = lambda n: F.get(F.array(*[F.lit(pow(10, k, 97)) for k in range(96)]), n % 96)
    start = F.struct(F.lit(0).alias("rest"), F.lit(0).alias("digits"), F.expr("cast(array() as array<struct<rest: int, digits: int>>)").alias("all"))

    def before(acc: Column, v: Column) -> Column:
        all_ = F.array_append(acc["all"], F.struct(acc["rest"].alias("rest"), acc["digits"].alias("digits")))
        return F.struct(F.pmod(acc["rest"] * F.when(v > 9, 100).otherwise(10) + v, F.lit(97)).alias("rest"), F.lit(0).alias("digits"), all_.alias("all"))

    def after(acc: Column, v: Column) -> Column:
        all_ = F.array_append(acc["all"], F.struct(acc["rest"].alias("rest"), acc["digits"].alias("digits")))
        return F.struct(F.pmod(acc["rest"] + v * power(acc["digits"]), F.lit(97)).alias("rest"), (acc["digits"] + F.when(v > 9, 2).otherwise(1)).alias("digits"), all_.alias("all"))

    def tried(at: Column, sides: Column) -> Column:
        """The account with the one character that place `at` (from 0, the first four places last) can have; null for none."""
        low, high = F.get(sides["before"], at), F.element_at(sides["after"], -1 - at)
        place = F.when(at < 23, at + 5).otherwise(at - 22)
        wide = F.when(place <= 2, 100).otherwise(10)
        value = F.pmod((1 - high["rest"]) * power(96 - high["digits"] % 96) - low["rest"] * wide, F.lit(97))
        fits = F.when(place <= 2, (value >= 10) & (value <= 35)).otherwise(value <= 9)
        return F.when(fits, F.concat(F.substring(x, F.lit(1), place - 1), F.substring(F.lit(_VALUES), value + 1, F.lit(1)), F.substring(x, place + 1, F.lit(64))))

    sides = let(values, lambda vs: F.struct(F.aggregate(vs, start, before, lambda a: a["all"]).alias("before"), F.aggregate(F.reverse(vs), start, after, lambda a: a["all"]).alias("after")))
    tries = let(sides, lambda s: F.transform(F.sequence(F.lit(0), F.lit(26)), lambda at: tried(at, s)))
    good = F.array_distinct(F.filter(tries, lambda v: F.coalesce((v != x) & _iban_checks(v), F.lit(False))))
    return let(good, lambda g: F.when(F.size(g) == 1, F.element_at(g, 1)))


def iban(x: Column) -> Column:
    """Without white space, in upper case; corrected where one substitution alone makes it valid; else null."""
    whole = F.upper(F.regexp_replace(x, r"(?U)\s+", ""))
    return let(whole, lambda v: F.when(F.coalesce(v, F.lit("")) == "", F.lit(None)).when(_iban_checks(v), v).otherwise(iban_corrected(v)))


def french_iban(bank: Column, branch: Column, account: Column) -> Column:
    """The account number of a bank, branch and account, with computed keys."""
    b, g, c = F.lpad(bank, 5, "0"), F.lpad(branch, 5, "0"), F.upper(F.lpad(account, 11, "0"))
    national = F.concat(b, g, c, F.lpad(rib_key(b, g, c).cast("string"), 2, "0"))
    check = 98 - mod97(F.concat(national, F.lit("FR00")))
    return F.concat(F.lit("FR"), F.lpad(check.cast("string"), 2, "0"), national)


def bank_account(m: Column) -> Column:
    """map of banque, iban, code_banque, code_guichet, numero_compte, cle_rib to struct(banque, iban, error).

    A present iban key, null too, wins; else the four national parts make the number; a number alone is not enough. Null where
    neither a bank nor an account is left. error: the map has no banque.
    """
    get = lambda k: F.nullif(F.trim(F.try_element_at(m, F.lit(k))), F.lit(""))
    parts = [get(k) for k in ("code_banque", "code_guichet", "numero_compte", "cle_rib")]
    whole = parts[0].isNotNull() & parts[1].isNotNull() & parts[2].isNotNull() & parts[3].isNotNull()
    number = iban(F.when(F.map_contains_key(m, "iban"), get("iban")).when(whole, french_iban(*parts[:3])))
    error = F.when(~F.map_contains_key(m, "banque"), F.lit("banque is missing"))
    out = F.struct(get("banque").alias("banque"), number.alias("iban"), error.alias("error"))
    some = lambda o: o["banque"].isNotNull() | o["iban"].isNotNull() | o["error"].isNotNull()
    return F.when(m.isNotNull() & (F.size(m) > 0), let(out, lambda o: F.when(some(o), o)))


def in_groups(x: Column, size: int) -> Column:
    """Groups of `size` characters with spaces between."""
    return F.trim(F.regexp_replace(F.regexp_replace(x, r"\s", ""), f"(.{{{size}}})", "$1 "))
