"""Units of measure: canonical names, conversions, prices for one canonical unit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionary import INGESTED_UNITS, MORE_UNITS, SERVICE_UNITS, SHOWN_UNITS
from .expressions import extract, lookup
from .lexicon import MEASURES, OLD_UNITS, UNITS


def unit_key(unit: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(unit)), r"[.\s]", "")


def canonical_unit(unit: Column) -> Column:
    return lookup({u: v[0] for u, v in UNITS.items()}, unit_key(unit))


def unit_factor(unit: Column) -> Column:
    return lookup({u: v[1] for u, v in UNITS.items()}, unit_key(unit))


def unit_kind(unit: Column) -> Column:
    return lookup({u: v[2] for u, v in UNITS.items()}, unit_key(unit))


def is_known_unit(unit: Column) -> Column:
    return canonical_unit(unit).isNotNull()


def comparable_units(a: Column, b: Column) -> Column:
    return F.coalesce(canonical_unit(a) == canonical_unit(b), F.lit(False))


def convert_quantity(quantity: Column, a: Column, b: Column) -> Column:
    """A quantity of unit ``a`` in unit ``b``; null if they don't compare or it is not positive."""
    return F.when(comparable_units(a, b) & (quantity > 0), quantity * unit_factor(a) / unit_factor(b))


def unit_price(amount: Column, quantity: Column, unit: Column) -> Column:
    """The price of one canonical unit; null if the amount or quantity is not positive or the unit is unknown."""
    return F.when((amount > 0) & (quantity > 0), F.try_divide(amount, quantity * unit_factor(unit)))


def old_unit_price(amount: Column, quantity: Column, unit: Column) -> Column:
    """As the older converter has it: no quantity counts as 1, an unknown unit as itself, a dozen as one box; null where that one fails (amount not positive, quantity 0)."""
    q = F.coalesce(quantity, F.lit(1.0))
    factor = F.coalesce(lookup({u: v[1] for u, v in OLD_UNITS.items()}, F.trim(F.lower(unit))), F.lit(1.0))
    return F.when((amount > 0) & (q != 0), F.try_divide(amount, q * factor))


def simple_unit_price(price: Column, quantity: Column, unit: Column) -> Column:
    """By kilogram, litre or piece: grams and millilitres in thousands, milligrams in millions, a dozen as twelve; null without a positive quantity or a unit."""
    u = F.lower(F.trim(unit))
    per = F.when(u.isin("g", "gr", "gram", "ml"), F.lit(0.001)).when(u == "mg", F.lit(0.000001)).when(u == "dozen", F.lit(12.0)).otherwise(F.lit(1.0))
    return F.when((quantity > 0) & u.isNotNull() & (u != ""), F.try_divide(price, quantity * per))


def standard_unit(unit: Column, litre: str = "L", millilitre: str = "mL") -> Column:
    """The unit as it is shown: known names by the table, a quantity before a unit goes, nothing is ``pcs``; the two litre signs are the caller's."""
    key = unit_key(unit)
    key = F.coalesce(extract(key, r"^\d+(?:[.,]\d+)?([a-z]+)$"), key)
    shown = lookup({u: {"ltr": litre}.get(v[0], v[0]) if u not in ("g", "gr", "gram", "ml", "milliliter", "mg", "milligram") else {"gram": "g", "gr": "g", "milliliter": millilitre, "ml": millilitre, "milligram": "mg"}.get(u, u) for u, v in UNITS.items()}, key)
    return F.when(F.coalesce(F.trim(unit), F.lit("")) == "", "pcs").otherwise(F.coalesce(shown, key))


def service_unit(unit: Column) -> Column:
    """The unit as the service shows it: points and slashes go; a known unit, else the one after a number (``330ml``), else what is left; nothing is ``pcs``."""
    key = F.trim(F.regexp_replace(F.lower(unit), r"[./]", ""))
    inner = lookup(SERVICE_UNITS, extract(key, r"\d+\s*([a-z]+)"))
    return F.when(F.coalesce(unit, F.lit("")) == "", "pcs").otherwise(F.coalesce(lookup(SERVICE_UNITS, key), lookup(MORE_UNITS, key), inner, key))


def ingested_unit(unit: Column) -> Column:
    """The unit as the store of an upload keeps it: plurals and other spellings by the table, litres in lower case; others as they are, null for null."""
    key = F.lower(F.trim(unit))
    return F.coalesce(lookup(INGESTED_UNITS, key), key)


def formatted_unit(unit: Column) -> Column:
    """The canonical unit as it is shown (``L``, ``pack``, ``box``); an unknown one as given."""
    canonical = canonical_unit(unit)
    return F.coalesce(lookup(SHOWN_UNITS, canonical), canonical, unit)


def units_of_kind(kind: Column) -> Column:
    """All unit names of a kind, in the table's order; empty for an unknown kind."""
    kinds = dict.fromkeys(v[2] for v in UNITS.values())
    named = F.create_map(*[x for k in kinds for x in (F.lit(k), F.array(*[F.lit(u) for u, v in UNITS.items() if v[2] == k]))])
    return F.coalesce(F.try_element_at(named, kind), F.array().cast("array<string>"))


def normalize_weight(text: Column) -> Column:
    """``500 gr`` or ``1,5 kg`` as a struct of value (grams, millilitres or pieces) and unit."""
    s = F.lower(F.trim(text))
    number = F.replace(extract(s, r"(\d+(?:[.,]\d+)?)\s*([a-zA-Z]+)"), F.lit(","), F.lit(".")).cast("double")
    unit = extract(s, r"(\d+(?:[.,]\d+)?)\s*([a-zA-Z]+)", 2)
    known = lookup({u: v[0] for u, v in MEASURES.items()}, unit)
    bare = F.replace(extract(s, r"(\d+(?:[.,]\d+)?)"), F.lit(","), F.lit(".")).cast("double")

    def pair(value: Column, name: Column) -> Column:
        return F.struct(value.cast("double").alias("value"), name.cast("string").alias("unit"))

    return (
        F.when(known.isNotNull(), pair(number * known, lookup({u: v[1] for u, v in MEASURES.items()}, unit)))
        .when(bare.isNotNull(), pair(bare, F.lit("pcs")))
        .when(s.rlike("kg|kilo"), pair(F.lit(1000), F.lit("kg")))
        .when(s.rlike("gram| g "), pair(F.lit(1), F.lit("g")))
        .otherwise(pair(F.lit(None), F.lit("pcs")))
    )
