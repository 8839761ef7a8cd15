"""Which field names are known, and whether what must be there is there."""

from __future__ import annotations

import difflib
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.sources.templates import Template

INVOICE_FIELDS = frozenset(
    "amount amount_tax amount_untaxed bic company_vat country_code currency currency_symbol date date_due date_end date_start desc iban incoterm "
    "invoice_number issuer lines mandate_id mobile narration note partner_city partner_coc partner_email partner_name partner_ref partner_street "
    "partner_street2 partner_street3 partner_website partner_zip payment_reference payment_unece_code siren state_code tax_lines telephone template_name vat".split()
)
LINE_FIELDS = frozenset("barcode code date_end date_start discount line_note line_tax_amount line_tax_percent name price_subtotal price_total price_unit product qty sectionheader taxes unece_code uom".split())
TAX_LINE_FIELDS = frozenset("line_tax_amount line_tax_code line_tax_percent price_subtotal".split())
#: Names that start so are always known.
PREFIXES = ("amount", "date")
CUTOFF = 0.88


def unknown(names: Iterable[str], known: Iterable[str] = INVOICE_FIELDS, extra: Iterable[str] = ()) -> dict[str, str | None]:
    """Names outside the vocabulary, each with the known one that is close to it, if one is."""
    vocabulary = sorted({*known, *extra})
    out = {}
    for name in names:
        if name not in vocabulary and not name.startswith(PREFIXES):
            near = difflib.get_close_matches(name, vocabulary, n=1, cutoff=CUTOFF)
            out[name] = near[0] if near else None
    return out


def unknown_present(present: Column, template: Template, names: Sequence[str]) -> Column:
    """The unknown ones of the names that a document has."""
    odd = list(unknown(names, extra=template.options.extra_fields))
    return F.array_intersect(present, F.array(*map(F.lit, odd)).cast("array<string>"))


def missing(present: Column, required: Sequence[str]) -> Column:
    """Required names that a document lacks."""
    return F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), present)
