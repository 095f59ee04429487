"""Standard product names: spelling, size, brand and language taken apart and put together in one order."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionary import BRANDS, DESCRIPTORS, MAIN_PRODUCTS, MISSPELLINGS, PHRASES, PRODUCTS
from .expressions import extract, lookup, once
from .names import squeezed
from .units import service_unit

#: Words that a standard name leaves out.
FILLERS = ("the", "and", "or", "with")
#: Units in upper case, as exports show them. Fixed values.
UPPER_UNITS = {
    **dict.fromkeys(("KG", "KILOGRAM", "KILO"), "KG"),
    **dict.fromkeys(("G", "GRAM", "GR"), "GRAM"),
    **dict.fromkeys(("L", "LITER", "LTR"), "LITER"),
    **dict.fromkeys(("ML", "MILLILITER"), "ML"),
    **dict.fromkeys(("PCS", "PIECE", "PC", "UNIT", "EA", "EACH"), "PIECE"),
    **dict.fromkeys(("PACK", "PKT", "PACKET"), "PACK"),
    **dict.fromkeys(("CARTON", "CTN"), "CARTON"),
    **dict.fromkeys(("BOTTLE", "BTL"), "BOTTLE"),
    **dict.fromkeys(("DOZEN", "DZ"), "DOZEN"),
    **dict.fromkeys(("BAG", "SACK"), "BAG"),
}


def upper_unit(unit: Column) -> Column:
    """``500 g`` as ``500GRAM``, ``pcs`` as ``PIECE``; others in upper case; nothing is ``PIECE``."""
    u = F.trim(F.upper(unit))
    sized = r"^(\d+(?:\.\d+)?)\s*(KG|G|L|ML)$"
    return (
        F.when(F.coalesce(u, F.lit("")) == "", "PIECE")
        .when(u.rlike(sized), F.concat(F.regexp_extract(u, sized, 1), lookup(UPPER_UNITS, F.regexp_extract(u, sized, 2))))
        .otherwise(F.coalesce(lookup(UPPER_UNITS, u), u))
    )


def _words(text: Column) -> Column:
    return F.split(text, r"\s+")


def _spelled(word: Column) -> Column:
    """A word without its slip of the pen; one before a plural s too."""
    single = lookup(MISSPELLINGS, F.regexp_replace(word, "s$", ""))
    return F.coalesce(lookup(MISSPELLINGS, word), F.when(word.endswith("s"), F.concat(single, F.lit("s"))), word)


def standardize(name: Column, unit: Column) -> Column:
    """A struct of name, unit, brand, size, language and confidence.

    The name is cleaned, spelled, its phrases replaced, its size and brand taken out and its words translated. It then
    holds the main product (the first known one, else the first word), the brand, the other words
    sorted and once each, and the size. The language is id where over seven tenths of the known words are
    Indonesian, en under three tenths, else mixed. Confidence: 0.5, 0.2 more for one language, 0.1 for a known
    product, 0.2 less for a single word, 0.1 less for over six; 0.1 at least and 1 at most. A null name is an empty one.
    """
    raw = F.coalesce(name, F.lit(""))
    size_of = r"\b(\d+(?:\.\d+)?\s*(?:ml|l|g|kg|gr|mg|oz|pcs|pack|box|butir|buah|lembar|potong|ekor|bungkus|dus|karton|botol|kaleng|liter|mililiter|kilogram|gram|ons))\b"

    def with_brand(x: Column) -> Column:
        """The brand, and the translated words of the name without it."""
        words = _words(x["bare"])
        brand = F.try_element_at(F.filter(F.array(*map(F.lit, BRANDS)), lambda b: F.array_contains(words, b)), F.lit(1))
        rest = F.when(brand.isNull(), x["bare"]).otherwise(squeezed(F.regexp_replace(x["bare"], F.concat(F.lit(r"(?i)\b"), brand, F.lit(r"\b")), F.lit(""))))
        said = F.transform(_words(rest), lambda w: F.coalesce(lookup(PRODUCTS, w), lookup(DESCRIPTORS, w), w))
        return F.struct(x["size"].alias("size"), brand.alias("brand"), said.alias("said"))

    def assembled(x: Column) -> Column:
        said, brand = x["said"], x["brand"]
        main = F.coalesce(F.try_element_at(F.filter(said, lambda w: w.isin(*MAIN_PRODUCTS)), F.lit(1)), F.try_element_at(said, F.lit(1)))
        rest = F.array_sort(F.array_distinct(F.filter(said, lambda w: (F.length(w) > 1) & ~w.isin(*FILLERS) & (w != main) & ~w.eqNullSafe(brand))))
        shown = F.array_join(F.filter(F.concat(F.array(main, F.coalesce(brand, F.lit(""))), rest, F.array(F.coalesce(x["size"], F.lit("")))), lambda w: w != ""), " ")
        own = F.regexp_extract(x["size"], r"^\d+(?:\.\d+)?\s*(.+)$", 1)
        return F.struct(shown.alias("name"), service_unit(F.coalesce(F.nullif(unit, F.lit("")), own, F.lit("pcs"))).alias("unit"), brand.alias("brand"), x["size"].alias("size"))

    clean = squeezed(F.regexp_replace(F.trim(F.lower(raw)), r"[^\w\s-]", " "))
    clean = F.array_join(F.transform(_words(clean), _spelled), " ")
    for pattern, product in PHRASES:
        clean = F.regexp_replace(clean, pattern, product)

    def sized(x: Column) -> Column:
        size = extract(x, size_of)
        return F.struct(size.alias("size"), F.when(size.isNull(), x).otherwise(squeezed(F.regexp_replace(x, size_of, ""))).alias("bare"))

    def judged(words: Column) -> Column:
        foreign = F.size(F.filter(words, lambda w: lookup(PRODUCTS, w).isNotNull() | lookup(DESCRIPTORS, w).isNotNull()))
        english = F.size(F.filter(words, lambda w: lookup(PRODUCTS, w).isNull() & lookup(DESCRIPTORS, w).isNull() & w.rlike("^[a-z]+$") & (F.length(w) > 2)))
        ratio = F.try_divide(foreign.cast("double"), foreign + english)
        language = F.when(ratio.isNull() | (ratio < 0.3), "en").when(ratio > 0.7, "id").otherwise("mixed")
        score = F.lit(0.5) + F.when(language != "mixed", 0.2).otherwise(0.0) + F.when(F.exists(words, lambda w: lookup(PRODUCTS, w).isNotNull()), 0.1).otherwise(0.0) - F.when(F.size(words) < 2, 0.2).otherwise(0.0) - F.when(F.size(words) > 6, 0.1).otherwise(0.0)
        return F.struct(language.alias("language"), F.greatest(F.lit(0.1), F.least(F.lit(1.0), score)).alias("confidence"))

    made, verdict = once(once(once(clean, sized), with_brand), assembled), once(_words(F.lower(raw)), judged)
    return F.struct(*[made[f].alias(f) for f in ("name", "unit", "brand", "size")], *[verdict[f].alias(f) for f in ("language", "confidence")])


def translation_quality(original: Column, standard: Column, critical: Mapping[str, str], forbidden: Mapping[str, Sequence[str]] | None = None) -> Column:
    """100, less 20 for each critical word that lost its meaning and 30 for each forbidden translation of one, at least 0."""
    a, b = F.lower(original), F.lower(standard)
    lost = sum((F.when(F.contains(a, F.lit(k)) & ~F.contains(b, F.lit(v.lower())), 20).otherwise(0) for k, v in critical.items()), F.lit(0))
    wrong = sum((F.when(F.contains(a, F.lit(k)) & F.contains(b, F.lit(v.lower())), 30).otherwise(0) for k, vs in (forbidden or {}).items() for v in vs), F.lit(0))
    return F.greatest(F.lit(0), 100 - lost - wrong)


def fixed_translation(original: Column, standard: Column, critical: Mapping[str, str], forbidden: Mapping[str, Sequence[str]]) -> Column:
    """The standard name with forbidden translations of words in the original put right."""
    for word, wrong in forbidden.items():
        for w in wrong:
            standard = F.when(F.contains(F.lower(original), F.lit(word)), F.regexp_replace(standard, rf"(?i)\b{w}\b", critical[word])).otherwise(standard)
    return standard
