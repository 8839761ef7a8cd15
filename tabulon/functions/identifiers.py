"""Bank and tax identifiers."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: After each country's letters: 9 is a digit, X a letter or digit, A a letter, other signs themselves;
#: several shapes are separated by a bar.
VAT_SHAPES = (
    "ATU99999999 BE0999999999 BE1999999999 BG999999999 BG9999999999 CY99999999A CZ99999999 CZ999999999 CZ9999999999 "
    "DE999999999 DK99999999 EE999999999 EL999999999 ESX9999999X FI99999999 FRXX999999999 HR99999999999 HU99999999 "
    "IE9999999A IE9999999AA IE9A99999A IT99999999999 LT999999999 LT999999999999 LU99999999 LV99999999999 MT99999999 "
    "NL999999999B99 PL9999999999 PT999999999 SE999999999999 SI99999999 SK9999999999 "
) + " ".join("RO" + "9" * n for n in range(2, 11))


def _shape(shape: str) -> str:
    kinds = {"9": "[0-9]", "X": "[A-Z0-9]", "A": "[A-Z]"}
    body = "".join(f"{kinds.get(m[0][0], m[0][0])}{{{len(m[0])}}}" for m in re.finditer(r"(.)\1*", shape[2:]))
    return shape[:2] + body


VAT = "^(?:" + "|".join(map(_shape, VAT_SHAPES.replace("ATU", "AT\0").split())).replace("\0", "U") + r")\z"
IBAN = r"^[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}\z"
BIC = r"^[A-Z]{6}[0-9A-Z]{2}(?:[0-9A-Z]{3})?\z"


def normalize(value: Column) -> Column:
    """Upper case without white space."""
    return F.upper(F.regexp_replace(value, r"(?U)\s+", ""))


def mod97(identifier: Column) -> Column:
    """Remainder by 97 of the identifier with its first four signs last and letters as 10 to 35."""
    turned = F.concat(F.substring(identifier, 5, 100), F.substring(identifier, 1, 4))
    digits = F.transform(F.filter(F.split(turned, "(?!^)"), lambda c: c != ""), lambda c: F.conv(c, 36, 10).cast("int"))
    return F.aggregate(digits, F.lit(0), lambda a, d: (a * F.when(d < 10, 10).otherwise(100) + d) % 97)


def is_iban(value: Column) -> Column:
    plain = normalize(value)
    return F.when(plain.rlike(IBAN), mod97(plain) == 1).otherwise(F.lit(False))


def is_vat(value: Column) -> Column:
    return F.coalesce(normalize(value).rlike(VAT), F.lit(False))


def is_bic(value: Column) -> Column:
    return F.coalesce(normalize(value).rlike(BIC), F.lit(False))


def classify(value: Column) -> Column:
    """iban, vat or bic, the first that holds; else null."""
    return F.when(is_iban(value), "iban").when(is_vat(value), "vat").when(is_bic(value), "bic")
