"""National checks of account numbers: published examples, and the same with another check under a right overall one."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quillframe.functions import ids

#: The published example of each country.
EXAMPLES = [
    "BA391290079401028494", "BE68539007547034", "CZ6508000000192000145399", "EE382200221020145685", "ES9121000418450200051332", "FI2112345600000785", "FR1420041010050500013M02606", "HR1210010051863000160",
    "HU42117730161111101800000000", "IS140159260076545510730339", "IT60X0542811101000000123456", "MC5811222000010123456789030", "ME25505000012345678951", "MK07250120000058984", "MR1300020001010000123456753",
    "NO9386011117947", "PL61109010140000071219812874", "PT50000201231234567890154", "RS35260005601001611379", "SI56263300012039086", "SK3112000000198742637541", "SM86U0322509800000000270100", "TL380080012345678910157", "TN5910006035183598478831",
]


def number(x):
    return int("".join(str(int(c, 36)) for c in x))


def with_checks(country, bban):
    return f"{country}{98 - number(bban + country + '00') % 97:02d}{bban}"


def valid(spark, xs):
    df = spark.createDataFrame(list(enumerate(xs)), "i int, x string")
    return [r.v for r in df.select("i", ids.iban_is_valid(F.col("x")).alias("v")).orderBy("i").collect()]


def test_examples(spark):
    assert set(ids.NATIONAL) | {"FR", "MC"} == {x[:2] for x in EXAMPLES}
    wrong = [x for x, v in zip(EXAMPLES, valid(spark, EXAMPLES)) if not v]
    assert wrong == []
    assert valid(spark, ["DE89370400440532013000", "GB29NWBK60161331926819", None, "", "DE88370400440532013000", "XX12"]) == [True, True, True, True, False, False]


@pytest.mark.parametrize("step", [1, 7])
def test_another_digit_fails_the_national_check(spark, step):
    bad, kept = [], []
    for x in EXAMPLES:
        bban = x[4:]
        covered = [i for k, a, w, *_ in ids.NATIONAL.get(x[:2], [("mod", 0, 23, 97, 0)]) for i in range(a, a + (len(w) if isinstance(w, tuple) else w))]
        for i in covered:
            if bban[i].isdigit() and not (x[:2] in ("IT", "SM") and i == 0):
                bad.append(with_checks(x[:2], bban[:i] + str((int(bban[i]) + step) % 10) + bban[i + 1 :]))
        free = [i for i in range(len(bban)) if i not in covered and bban[i].isdigit()]
        kept += [with_checks(x[:2], bban[:i] + str((int(bban[i]) + step) % 10) + bban[i + 1 :]) for i in free]
    assert all(number(x[4:] + x[:4]) % 97 == 1 for x in bad + kept)
    assert [x for x, v in zip(bad, valid(spark, bad)) if v] == [] and all(valid(spark, kept))


def test_letters_where_digits_belong(spark):
    xs = [with_checks("NO", "A6011117947"), with_checks("BE", "5390075470AB"), with_checks("IT", "10542811101000000123456"), with_checks("HR", "1001005186300016A")]
    assert valid(spark, xs) == [False] * 4
