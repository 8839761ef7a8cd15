"""What is added to line items: canonical names, unit codes, tax rates and amounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions.binding import let, literal_map
from tabulon.functions.numbers import round_cents
from tabulon.functions.text import strip

#: Other name to canonical name; the canonical one wins where a row has both.
ALIASES = {other: canonical for canonical, others in {"name": "description", "price_unit": "unit_price unitprice", "line_tax_percent": "vat_rate tax_percent"}.items() for other in others.split()}

_UNITS = {
    "LTR": "l lt ltr liter liters litre litres ℓ", "MLT": "ml milliliter millilitre", "KGM": "kg kgm kgs kilogram kilograms",
    "GRM": "g gr gram grams grm", "MTR": "m meter meters metre metres mtr", "CMT": "cm", "MMT": "mm", "KMT": "km",
    "H87": "each ea pc pcs piece pieces ps st stk stk. stueck stueckliste stuk stuks stück unit units x", "SET": "set sets",
    "HUR": "h hour hours hr hrs uren uur", "MIN": "min minute minutes", "DAY": "d dag dagen day days",
    "MON": "maand maanden mnd month months", "ANN": "jaar year years",
}
#: Printed unit to UN/ECE recommendation 20 code.
UNIT_CODES = {printed: code for code, several in _UNITS.items() for printed in several.split()}


def unit_code(printed: Column) -> Column:
    """The unit's code; null for units that are not known."""
    return stripped_unit_code(strip(printed))


def stripped_unit_code(printed: Column) -> Column:
    return F.try_element_at(literal_map(UNIT_CODES), F.lower(printed))


def _rebuild(rows: Column, columns: Sequence[str], new: dict[str, "callable"]) -> Column:
    every = [*columns, *[c for c in new if c not in columns]]
    return F.transform(rows, lambda r: F.struct(*[(new[c](r) if c in new else r[c]).alias(c) for c in every]))


def rename_aliases(rows: Column, columns: Sequence[str]) -> tuple[Column, list[str]]:
    """Rows with canonical names, and their columns. Null cells count as absent."""
    new: dict = {}
    left = list(columns)
    for canonical in dict.fromkeys(ALIASES.values()):
        others = [a for a, c in ALIASES.items() if c == canonical and a in columns]
        if not others:
            continue
        sources = [*([canonical] if canonical in columns else []), *others]
        new[canonical] = lambda r, s=tuple(sources): F.coalesce(*[r[c] for c in s])
        for k, alias in enumerate(others):
            before = sources[: sources.index(alias)]
            if before:  # an alias stays where another name was there first
                new[alias] = lambda r, a=alias, b=tuple(before): F.when(F.coalesce(*[r[c].cast("string") for c in b]).isNotNull(), r[a])
            else:
                left.remove(alias)
    if not new:
        return rows, left
    every = [*left, *[c for c in new if c not in left]]
    out = F.transform(rows, lambda r: F.struct(*[(new[c](r) if c in new else r[c]).alias(c) for c in every]))
    return out, every


def with_unit_codes(rows: Column, columns: Sequence[str]) -> tuple[Column, list[str]]:
    """Adds ``unece_code`` from ``uom`` where it is known and none is there."""
    if "uom" not in columns:
        return rows, list(columns)
    had = "unece_code" in columns
    new = {"unece_code": lambda r: F.coalesce(r["unece_code"], unit_code(r["uom"])) if had else unit_code(r["uom"])}
    return _rebuild(rows, columns, new), list(columns) + ([] if had else ["unece_code"])


def _number(row: Column, name: str, columns: Sequence[str]) -> Column:
    return row[name].try_cast("double") if name in columns else F.lit(None).cast("double")


def tax_amount(subtotal: Column, percent: Column) -> Column:
    return round_cents(subtotal * percent / 100)


def single_active_rate(taxes: Column, columns: Sequence[str]) -> Column:
    """The only rate other than zero of tax rows that tax something; null if there are none or several."""
    active = F.filter(taxes, lambda t: (_number(t, "line_tax_percent", columns) != 0) & ((F.coalesce(_number(t, "price_subtotal", columns), F.lit(0.0)) != 0) | (F.coalesce(_number(t, "line_tax_amount", columns), F.lit(0.0)) != 0)))
    rates = F.array_distinct(F.transform(active, lambda t: _number(t, "line_tax_percent", columns)))
    return let(rates, lambda r: F.when(F.size(r) == 1, r[0]))


def apply_tax(rows: Column, columns: Sequence[str], taxes: Column, tax_columns: Sequence[str]) -> tuple[Column, list[str]]:
    """Gives lines without a rate the rate of their tax code (the last such tax row), else the only active rate.

    A line that is given a rate is also given the tax amount, if it has a subtotal and no amount.
    """
    every = [*columns, *[c for c in ("line_tax_percent", "line_tax_amount") if c not in columns]]

    def taxed(both: Column) -> Column:
        return _apply(rows, columns, both["taxes"], tax_columns, both["single"])

    known = let(taxes, lambda t: F.struct(t.alias("taxes"), single_active_rate(t, tax_columns).alias("single")))
    return let(known, taxed), every


def _apply(rows: Column, columns: Sequence[str], taxes: Column, tax_columns: Sequence[str], single: Column) -> Column:
    def given(r: Column) -> Column:
        if "line_tax_code" not in columns or "line_tax_code" not in tax_columns or "line_tax_percent" not in tax_columns:
            return single
        code = r["line_tax_code"].cast("string")
        same = F.filter(taxes, lambda t: (t["line_tax_code"].cast("string") == code) & t["line_tax_percent"].isNotNull())
        return F.coalesce(F.try_element_at(F.transform(same, lambda t: t["line_tax_percent"].try_cast("double")), F.lit(-1)), single)

    def rate(r: Column) -> Column:
        own = _number(r, "line_tax_percent", columns)
        return F.coalesce(own, given(r))

    def amount(r: Column) -> Column:
        own = _number(r, "line_tax_amount", columns)
        fresh = F.when(_number(r, "line_tax_percent", columns).isNull(), tax_amount(_number(r, "price_subtotal", columns), given(r)))
        return F.coalesce(own, fresh)

    return _rebuild(rows, columns, {"line_tax_percent": rate, "line_tax_amount": amount})


def compute_tax(taxes: Column, columns: Sequence[str]) -> tuple[Column, list[str]]:
    """Fills in the tax amount of tax rows with rate and subtotal."""
    if not {"line_tax_percent", "price_subtotal"} <= set(columns):
        return taxes, list(columns)
    amount = lambda r: F.coalesce(_number(r, "line_tax_amount", columns), tax_amount(_number(r, "price_subtotal", columns), _number(r, "line_tax_percent", columns)))
    return _rebuild(taxes, columns, {"line_tax_amount": amount}), [*columns, *(["line_tax_amount"] if "line_tax_amount" not in columns else [])]


def tax_total_differs(taxes: Column, columns: Sequence[str], total: Column) -> Column:
    """The tax rows' amounts sum to something other than zero that is over 0.02 off the stated total."""
    if "line_tax_amount" not in columns:
        return F.lit(False)
    cents = F.aggregate(taxes, F.lit(0).cast("decimal(20,2)"), lambda a, t: (a + F.coalesce(_number(t, "line_tax_amount", columns).cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)"))).cast("decimal(20,2)"))
    return F.coalesce((cents != 0) & (F.abs(cents - total.cast("decimal(18,2)")) > F.lit("0.02").cast("decimal(4,2)")), F.lit(False))
