"""Product names: cleaning, translation, core nouns, categories, predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionary import INDONESIAN, KNOWN_SUPPLIERS
from .expressions import contains_any, lookup
from .lexicon import HEADING_WORDS, NOUN_DESCRIPTIVE, NOUN_EXCLUSIVE, PRICE_BOUNDS, PRODUCT_WORDS, TRANSLATIONS, UPLOAD_CATEGORIES


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def matching_name(name: Column) -> Column:
    """For matching: lower case, anything but ASCII letters, digits and ``_`` a space."""
    return squeezed(F.regexp_replace(F.lower(name), r"[^\w\s]", " "))


def tokens(name: Column) -> Column:
    return F.filter(F.split(matching_name(name), " "), lambda w: w != "")


def translated_name(name: Column, words: Mapping[str, str] = TRANSLATIONS) -> Column:
    """For the catalogue: Unicode letters and digits, each word translated, a word that repeats the one before it dropped."""
    plain = squeezed(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}\s]", " "))
    said = F.transform(F.split(plain, " "), lambda w: F.coalesce(lookup(words, w), w))
    return F.array_join(F.filter(said, lambda w, i: (i == 0) | (w != F.element_at(said, F.greatest(i, F.lit(1))))), " ")


def data_name(name: Column) -> Column:
    """For storage: single spaces, plain quotes and dashes, no marks at the ends."""
    s = squeezed(F.coalesce(name, F.lit("")))
    s = F.regexp_replace(F.regexp_replace(s, "[“”‘’\"']", '"'), "[–—]", "-")
    return F.trim(F.regexp_replace(s, r"^\W+|\W+$", ""))


def core_noun(name: Column) -> Column:
    """The first word that is no modifier, of the translated name; empty without one."""
    words = F.split(translated_name(name), " ")
    rest = F.filter(words, lambda w: ~w.isin(*NOUN_EXCLUSIVE) & ~w.isin(*NOUN_DESCRIPTIVE) & (w != ""))
    return F.coalesce(F.try_element_at(rest, F.lit(1)), F.lit(""))


def modifiers(name: Column) -> Column:
    words = F.split(translated_name(name), " ")
    return F.struct(F.filter(words, lambda w: w.isin(*NOUN_EXCLUSIVE)).alias("exclusive"), F.filter(words, lambda w: w.isin(*NOUN_DESCRIPTIVE)).alias("descriptive"))


def different_core_noun(a: Column, b: Column) -> Column:
    x, y = core_noun(a), core_noun(b)
    return (x != "") & (y != "") & (x != y)


def is_category_heading(text: Column, priced: Column) -> Column:
    s = F.lower(F.trim(text))
    likely = contains_any(s, HEADING_WORDS) | (~s.rlike(r"\d") & ~contains_any(s, PRODUCT_WORDS))
    return F.coalesce(~priced & F.length(s).between(3, 50) & likely, F.lit(False))


def bound_category(name: Column, hint: Column | None = None) -> Column:
    """The first category of the price bounds that the hint names or a word of the name belongs to."""
    h = F.lower(F.coalesce(hint, F.lit(""))) if hint is not None else F.lit("")

    def first(s: Column) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for category, (words, *_) in PRICE_BOUNDS.items():
            out = out.when((F.contains(h, F.lit(category)) | contains_any(s, words)) if hint is not None else contains_any(s, words), category)
        return out

    # the name is put in lower case once, not for each word
    return F.element_at(F.transform(F.array(F.lower(name)), first), 1)


def categorize(name: Column, rules: Mapping[str, Sequence[str]] | None = None, otherwise: str = "Other", whole_words: bool = False) -> Column:
    """The first rule with a word that the name contains (as a whole word, if asked for). Without rules those of the upload."""
    s = F.lower(name)
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for category, words in (rules or UPLOAD_CATEGORIES).items():
        out = out.when(s.rlike(rf"\b(?:{'|'.join(words)})\b") if whole_words else contains_any(s, words), category)
    return F.coalesce(out, F.lit(otherwise))


def name_fault(name: Column) -> Column:
    """What is suspicious about a name: number, weight, currency or short (at most two characters, but for units and a few words); null for others and for an empty name."""
    return (
        F.when(name.isNull() | (name == ""), F.lit(None).cast("string"))
        .when(name.rlike(r"^\d+$"), "number")
        .when(name.rlike(r"(?i)^\d+\s*(?:gr|g|kg|ml|l|oz|lb)$"), "weight")
        .when(name.rlike(r"(?i)^(?:idr|usd|eur|gbp|aud|sgd|myr)$"), "currency")
        .when((F.length(name) <= 2) & ~name.rlike(r"(?i)^(?:ok|id|kg|ml|gr|oz|lb)$"), "short")
    )


def is_product_name(name: Column) -> Column:
    """Whether a text may be a product's name: three characters or more with a letter, no number, no amount of a unit, no code of digits and letters; false for null."""
    s = F.regexp_replace(name, r"^\s+|\s+$", "")
    low = F.lower(s)
    amount = low.rlike(r"^\d+\s*(?:x\s*)?\d*\s*(?:kg|gr|g|ltr|l|ml|pcs|pc|pack|box|bottle)s?$")
    measure = low.rlike(r"^\d+[.,]?\d*\s*(?:x\s*\d+[.,]?\d*\s*)?[a-z]+$")
    coded = (F.length(s) <= 3) & s.rlike(r"\d")
    return F.coalesce((F.length(name) >= 2) & ~coded & ~amount & ~measure & s.rlike(r"\p{L}") & (F.length(s) >= 3), F.lit(False))


def title_words(name: Column, words: Mapping[str, str] = TRANSLATIONS) -> Column:
    """Word-by-word translation at word borders, then a capital for each word."""
    parts = F.split(F.lower(squeezed(name)), " ")
    return F.initcap(F.array_join(F.transform(parts, lambda w: F.coalesce(lookup(words, w), w)), " "))


def shortened(name: Column, most: int = 30) -> Column:
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most - 3), F.lit("..."))).otherwise(name)


def escaped_html(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def is_email(text: Column) -> Column:
    return text.rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")


def is_phone(text: Column) -> Column:
    return F.regexp_replace(text, r"[\s().\-]", "").rlike(r"^\+?\d{8,15}$")


def safe_file_name(name: Column) -> Column:
    """A file name for storage: ASCII letters, digits, ``_``, ``.`` and ``-`` in lower case, blanks as one ``_``."""
    kept = F.regexp_replace(F.regexp_replace(name, r"[^\w\s.-]", ""), r"\s+", "_")
    return F.lower(F.regexp_replace(kept, r"_{2,}", "_"))


def needs_translation(original: Column, standard: Column) -> Column:
    """Whether a name should be shown with its standard name: they differ (case aside), and it holds an Indonesian word. False without a standard name."""
    differs = (F.coalesce(standard, F.lit("")) != "") & (F.lower(original) != F.lower(standard))
    return F.coalesce(differs & original.rlike(rf"(?i)\b(?:{'|'.join(INDONESIAN)})\b"), F.lit(False))


def first_word_of_file(name: Column) -> Column:
    """The supplier by the sheets' rule: a file name's first word, its marks as blanks."""
    base = F.regexp_replace(name, r"(?i)\.(?:xlsx?|csv)$", "")
    return F.trim(F.regexp_replace(F.element_at(F.split(base, r"[-_\s]+"), 1), r"[^a-zA-Z0-9\s]", " "))


def title_of_file(name: Column) -> Column:
    """The supplier by the shared rule: a file name without extension, dates, versions and words for price lists; all of it if nothing is left, null for an empty one."""
    base = F.regexp_replace(name, r"\.[^/.]+$", "")
    # what is taken out, in this order; fixed values
    out = base
    for pattern in (
        r"(?i)price[\s_-]?list",
        r"(?i)catalog",
        r"(?i)inventory",
        r"(?i)products",
        r"\d{4}[-_]\d{2}[-_]\d{2}",
        r"\d{2}[-_]\d{2}[-_]\d{4}",
        r"(?i)\bv\d+\b",
        r"(?i)\bfinal\b",
        r"(?i)\bdraft\b",
        r"(?i)\bupdated?\b",
        r"(?i)\bnew\b",
        r"(?i)\bcopy\b",
    ):
        out = F.regexp_replace(out, pattern, " ")
    # of numbers in brackets only the first goes
    out = F.regexp_replace(out, r"^(.*?)\(\d+\)", "$1 ")
    bare = squeezed(F.regexp_replace(out, r"[_-]+", " "))
    return F.coalesce(F.nullif(bare, F.lit("")), F.nullif(F.trim(F.regexp_replace(base, r"[_-]+", " ")), F.lit("")))


def supplier_from_file(name: Column) -> Column:
    """The supplier by the upload's rule: without extension, a date and what follows it, a last number and the legal form, in capitals; known suppliers by their own name, ``Temporary Processing`` for nothing."""
    s = F.regexp_replace(name, r"(?i)\.(?:pdf|xlsx|xls|csv|jpg|jpeg|png|docx)$", "")
    s = F.regexp_replace(F.regexp_replace(s, r"\s+\d{2}_\d{2}.*$", ""), r"\s+\d+$", "")
    s = F.replace(F.regexp_replace(squeezed(s), r"^(?i:PT\.?|CV)\s*", ""), F.lit("+"), F.lit(" "))
    shown = F.initcap(F.lower(s))
    known = F.when(F.lit(False), F.lit(None).cast("string"))
    for part, supplier in KNOWN_SUPPLIERS.items():
        known = known.when(F.contains(F.lower(s), F.lit(part.lower())), supplier)
    return F.coalesce(known, F.nullif(shown, F.lit("")), F.lit("Temporary Processing"))


def supplier_from_text(text: Column) -> Column:
    """The name after a label such as ``Supplier:``, or with a legal form before it."""
    labelled = F.regexp_extract(text, r"(?im)^\s*(?:supplier|vendor|from|company)\s*[:\-]\s*([^\n\r]+)", 1)
    legal = F.regexp_extract(text, r"(?m)\b((?:PT|CV|UD)\.?\s+[A-Z][^\n\r,;]*)", 1)
    return F.coalesce(F.nullif(F.trim(labelled), F.lit("")), F.nullif(F.trim(legal), F.lit("")))
