"""Prices out of the strings of price lists (Indonesian and international notation), and their formats."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expressions import extract, half_up, lookup, once
from .lexicon import MODEL_NAMES, SERVICE_RATES, TOKEN_RATES

#: Currency marks before or after an amount. Fixed values.
MARKS = r"(?i)rp\.?\s*|idr\.?\s*|\$\s*|rupiah\.?\s*|€\s*|£\s*"
LEAST, MOST = 100.0, 10_000_000.0


def _thousand(suffix: Column) -> Column:
    return F.when(suffix == "m", 1e6).when(suffix.isin("k", "rb", "ribu"), 1e3).otherwise(1.0)


def normalize_price(text: Column) -> Column:
    """``50K``, ``Rp. 25k``, ``100 ribu``, ``2.5M`` or ``1.500.000`` as a double; null outside 100 to 10 million.

    A point or comma before exactly three digits separates thousands. Text around a
    number is let go, but not a sign before it.
    """
    s = F.trim(F.regexp_replace(text, MARKS, ""))
    s = F.regexp_replace(s, r"[.,](?=\d{3}(?!\d))", "")
    whole = r"(?i)^(\d+(?:[.,]\d+)?)\s*(k|m|rb|ribu)?$"
    loose = F.when(~s.rlike(r"^-|^[a-zA-Z]\d"), extract(s, r"(\d+(?:[.,]\d+)?)"))
    number = F.coalesce(extract(s, whole), loose)
    value = F.replace(number, F.lit(","), F.lit(".")).cast("double") * F.when(s.rlike(whole), _thousand(F.lower(F.regexp_extract(s, whole, 2)))).otherwise(1.0)
    return F.when(value.between(LEAST, MOST), value)


def sheet_price(text: Column) -> Column:
    """A sheet's cell: all separators go, decimals with them; null if nothing is left or it is not positive."""
    digits = F.regexp_replace(F.regexp_replace(text, MARKS, ""), r"[.,\s]", "")
    value = F.when(digits.rlike(r"^\d+$"), digits.cast("double"))
    return F.when(value > 0, value)


def signed_price(text: Column) -> Column:
    """Commas separate thousands, the point decimals, a sign is kept."""
    s = F.regexp_replace(text, r"[^0-9.\-]", "")
    return F.when(s.rlike(r"^-?\d*\.?\d+$"), s.cast("double"))


def is_valid_price(price: Column) -> Column:
    return price.isNotNull() & (price > 0) & (price < MOST)


def suffix_price(text: Column) -> Column:
    """The dictionary's reading: thousands (k, rb, ribu) and millions (jt, juta) by suffix; points go first, so ``1.5k`` is 15000."""
    s = F.regexp_replace(F.lower(text), r"rp|idr|[.,\s]", "")
    number, suffix = extract(s, r"^(\d+)(?:k|rb|ribu|jt|juta)?$"), F.regexp_extract(s, r"^\d+(k|rb|ribu|jt|juta)?$", 1)
    return number.cast("double") * F.when(suffix.isin("k", "rb", "ribu"), 1e3).when(suffix.isin("jt", "juta"), 1e6).otherwise(1.0)


def local_number(text: Column) -> Column:
    """Points are thousands before three last digits, else decimals; with both marks the comma is the decimal one."""
    s = F.regexp_replace(text, r"[^\d.,]", "")
    both = F.contains(s, F.lit(".")) & F.contains(s, F.lit(","))
    plain = (
        F.when(both, F.replace(F.replace(s, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(s.rlike(r"\.\d{3}$"), F.replace(s, F.lit("."), F.lit("")))
        .when(F.contains(s, F.lit(",")), F.replace(s, F.lit(","), F.lit(".")))
        .otherwise(s)
    )
    return F.when(plain.rlike(r"^\d+\.?\d*$"), plain.cast("double"))


def trailing_price(line: Column) -> Column:
    """The price at the end of a text line, such as ``Tomato cherry 25.000`` or ``... 25K``."""
    found = F.regexp_extract(line, r"(\d+(?:\.\d{3})*)([Kk]?)\s*$", 1)
    value = F.nullif(F.replace(found, F.lit("."), F.lit("")), F.lit("")).cast("double")
    return value * F.when(F.regexp_extract(line, r"(\d+(?:\.\d{3})*)([Kk]?)\s*$", 2) != "", 1e3).otherwise(1.0)


def appended_price(text: Column) -> Column:
    """Marks, points and commas go, and a suffix stands for zeros: ``1.5jt`` is 15 and six zeros. 0 without a leading number; a capital R, a small p or s go too, wherever they stand."""
    s = F.trim(F.regexp_replace(text, r"[Rp$€£¥₹,.\\s]", ""))
    for suffix, zeros in (("rb", "000"), ("jt", "000000"), ("juta", "000000"), ("ribu", "000")):
        s = F.regexp_replace(s, rf"(?i){suffix}$", zeros)
    s = F.regexp_replace(s, r"(?i)k$", "000")
    return F.coalesce(extract(s, r"^\s*([+-]?\d+(?:[eE][+-]?\d+)?)").try_cast("double"), F.lit(0.0))


def pdf_price(text: Column) -> Column:
    """A price in a text of several numbers: one after or before ``IDR``, else one with points for thousands, else the first of at least 1000, else what digits and points are left; 0 without any."""
    grouped = r"\d+(?:,\d{3})*"
    marked = F.coalesce(extract(text, rf"(?i)IDR\s*({grouped})"), extract(text, rf"(?i)({grouped})\s*IDR"))
    pointed = F.replace(extract(text, r"(\d+(?:\.\d{3})+)"), F.lit("."), F.lit(""))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(rf"({grouped})"), 1), lambda x: F.replace(x, F.lit(","), F.lit("")).cast("double"))
    large = F.try_element_at(F.filter(numbers, lambda x: x >= 1000), F.lit(1))
    bare = F.trim(F.regexp_replace(text, r"Rp|\$|,", ""))
    thousands = F.contains(bare, F.lit(".")) & F.forall(F.slice(F.split(bare, r"\."), 2, 100_000), lambda x: F.length(x) == 3)
    rest = F.regexp_replace(F.when(thousands, F.replace(bare, F.lit("."), F.lit(""))).otherwise(bare), r"[^\d.]", "")
    left = F.when(rest.rlike(r"^(?:\d+\.?\d*|\.\d+)$"), rest.cast("double"))
    return F.coalesce(F.replace(marked, F.lit(","), F.lit("")).cast("double"), pointed.cast("double"), large, left, F.lit(0.0))


def table_price(text: Column) -> Column:
    """A cell of a PDF's table: marks go, and points and commas before three last digits; then the first number, with one or two decimals; null without one."""
    s = F.regexp_replace(F.trim(text), r"(?i)Rp\.?\s*|IDR\.?\s*|\$\s*|rupiah\.?\s*", "")
    s = F.regexp_replace(s, r"[,.](?=\d{3}(?!\d))", "")
    return F.replace(extract(s, r"(\d+(?:[.,]\d{1,2})?)"), F.lit(","), F.lit(".")).cast("double")


def _written_number(digits: Column) -> Column:
    """``15.000``, ``15,000.50`` or ``15.000,50``: of two marks the last is the decimal one; a single kind before three digits each separates thousands."""
    plain = (
        F.when(digits.rlike(r"\..*,"), F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(digits.rlike(r",.*\.") | digits.rlike(r"^\d+(?:,\d{3})+$"), F.replace(digits, F.lit(","), F.lit("")))
        .when(digits.rlike(r"^\d+(?:\.\d{3})+$"), F.replace(digits, F.lit("."), F.lit("")))
        .otherwise(F.replace(digits, F.lit(","), F.lit(".")))
    )
    return plain.try_cast("double")


def cleaned_price_text(text: Column) -> Column:
    """Without a label such as ``Harga:`` or ``Cost =`` before it, and with single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"(?i)^\s*(?:harga|price|cost)\s*[:=]\s*", ""))


def detect_currency(text: Column) -> Column:
    """Of the rich grammar, which tells more dollars apart than :func:`extract_currency`; IDR without a mark."""
    s = F.lower(F.coalesce(text, F.lit("")))
    return F.when(s.rlike(r"s\$|sgd"), "SGD").when(s.rlike(r"\brm\b|myr"), "MYR").when(s.rlike(r"\$|usd"), "USD").when(s.rlike("€|eur"), "EUR").when(s.rlike("£|gbp"), "GBP").otherwise("IDR")


def parse_price_text(text: Column) -> Column:
    """The rich grammar: a struct of kind, primary, secondary, low, high, quantity, unit, discount and currency.

    Kinds: conditional (``min 5pcs = 15k``), discount (``20k (disc 15%)``, ``20k -> 15k``; secondary
    is the price before it), fraction (``17k/15k``: wholesale and retail), range (``15-20k``; primary
    is the middle), bulk (``250@10pcs``, ``3 for 50k``), unit_price (``15.000/kg``), single, or unknown. A number
    without a suffix takes that of the number it is paired with. ``low`` and ``high`` are the least and the largest
    amount named; ``high`` is null where there is one. Amounts outside 1 to a billion are unknown.
    """
    n, quantity, unit = r"(\d[\d.,]*)\s*(k|rb|ribu|jt|juta|m|b)?", r"(\d+(?:\.\d+)?)", r"([a-z]+)"
    # kind, pattern, and the groups of the first amount, the second one, the quantity, the unit and the percentage (0: none)
    forms = (
        ("conditional", rf"^(?:min|max)(?:imum)?\.?\s*{quantity}\s*{unit}\s*=\s*{n}$", 3, 0, 1, 2, 0),
        ("discount", rf"^{n}\s*\(?\s*(?:-|disc|diskon|discount)\.?\s*{quantity}\s*%\s*\)?$", 1, 0, 0, 0, 3),
        ("discount", rf"^{n}\s*(?:->|→|now)\s*{n}$", 1, 3, 0, 0, 0),
        ("fraction", rf"^{n}\s*/\s*{n}$", 1, 3, 0, 0, 0),
        ("range", rf"^{n}\s*(?:-|–|to|s/d)\s*{n}$", 1, 3, 0, 0, 0),
        ("bulk", rf"^{n}\s*(?:@|per|/)\s*{quantity}\s*{unit}$", 1, 0, 3, 4, 0),
        ("bulk", rf"^{quantity}\s*(?:for|pcs|x|@)\s*{n}$", 2, 0, 1, 0, 0),
        ("unit_price", rf"^{n}\s*(?:/|per)\s*{unit}$", 1, 0, 0, 3, 0),
        ("single", rf"^{n}$", 1, 0, 0, 0, 0),
    )

    def parts(s: Column) -> Column:
        out = None
        for kind, pattern, one, two, many, word, percent in forms:
            groups = {"a": one, "as": one and one + 1, "b": two, "bs": two and two + 1, "q": many, "u": word, "p": percent}
            fields = [(F.nullif(F.regexp_extract(s, pattern, g), F.lit("")) if g else F.lit(None).cast("string")).alias(f) for f, g in groups.items()]
            found = F.struct(F.lit(kind).alias("kind"), *fields)
            out = F.when(s.rlike(pattern), found) if out is None else out.when(s.rlike(pattern), found)
        return out

    def factor(suffix: Column) -> Column:
        return F.when(suffix.isin("k", "rb", "ribu"), 1e3).when(suffix.isin("jt", "juta", "m"), 1e6).when(suffix == "b", 1e9).otherwise(1.0)

    def amounts(r: Column) -> Column:
        a, b = _written_number(r["a"]) * factor(F.coalesce(r["as"], r["bs"])), _written_number(r["b"]) * factor(r["bs"])
        return F.struct(r["kind"].alias("kind"), a.alias("a"), b.alias("b"), r["q"].try_cast("double").alias("q"), r["u"].alias("u"), r["p"].try_cast("double").alias("p"))

    def result(r: Column) -> Column:
        lowered = (r["kind"] == "discount") & r["b"].isNotNull()
        primary = F.when(r["kind"] == "range", (r["a"] + r["b"]) / 2).when(lowered, r["b"]).otherwise(r["a"])
        secondary = F.when(lowered, r["a"]).when(r["kind"] == "discount", F.try_divide(r["a"], 1 - r["p"] / 100)).when(r["kind"] == "fraction", r["b"])
        discount = F.when(lowered, F.try_divide((r["a"] - r["b"]) * 100, r["a"])).otherwise(r["p"])
        values = {"primary": primary, "secondary": secondary, "low": F.least(r["a"], r["b"]), "high": F.when(r["b"].isNotNull(), F.greatest(r["a"], r["b"])), "quantity": r["q"], "unit": r["u"], "discount": discount}
        fits = F.coalesce(primary.between(1.0, 1e9), F.lit(False))
        return F.struct(F.when(fits, r["kind"]).otherwise("unknown").alias("kind"), *[F.when(fits, v).alias(f) for f, v in values.items()], detect_currency(text).alias("currency"))

    bare = F.trim(F.regexp_replace(F.lower(cleaned_price_text(text)), r"rp\.?\s*|idr|\brm\b|[su]?s?\$|€|£", ""))
    return once(once(once(bare, parts), amounts), result)


def extract_currency(text: Column) -> Column:
    s = F.lower(F.coalesce(text, F.lit("")))
    return F.when(s.rlike("rp|rupiah|idr"), "IDR").when(s.rlike(r"\$|usd"), "USD").when(s.rlike("€|eur"), "EUR").when(s.rlike("£|gbp"), "GBP").otherwise("IDR")


def repair_invoice(unit: Column, quantity: Column, total: Column) -> Column:
    """A struct of unit and total after repairs: amounts under 1000 were meant in thousands; a unit price over 5 % off the total gives way to total / quantity if that is at least 1000."""
    u = F.when((unit > 0) & (unit < 1000), unit * 1000).otherwise(unit)
    t = F.when((total > 0) & (total < 1000), total * 1000).otherwise(total)
    off = F.try_divide(F.abs(u * quantity - t), t) > 0.05
    each = F.try_divide(t, quantity)
    return F.struct(F.when(off & (each >= 1000), each).otherwise(u).alias("unit"), t.alias("total"))


def plain_number(price: Column) -> Column:
    """A double as people write it: ``5`` and ``5.25``."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.6f", price), r"0+$", ""), r"\.$", "")


def looks_misread(price: Column) -> Column:
    """Prices such as 316.35, where the point may have stood for thousands: two decimals under 1000, or any part over 0.09 after the point."""
    rest = price - F.floor(price)

    def whole(x: Column) -> Column:
        return F.abs(x - F.floor(x + 0.5)) < 1e-6

    return (whole(price * 100) & ~whole(price * 10) & (price < 1000)) | ((rest > 0.09) & (rest < 1) & ~whole(price))


def suggest_price(price: Column) -> Column:
    s = plain_number(price)
    decimals = extract(s, r"\.(\d{1,3})$")
    joined = F.concat(F.regexp_extract(s, r"^(\d+)", 1), F.rpad(decimals, 3, "0")).cast("double")
    return F.when(s.rlike(r"\.\d{2}$") & (price < 1000), half_up(price * 1000)).when(decimals.isNotNull(), joined)


def short_price(price: Column) -> Column:
    """``1.5M``, ``25K`` or the number."""
    return F.when(price >= 1e6, F.concat(F.format_string("%.1f", half_up(price / 1e6, 1)), F.lit("M"))).when(price >= 1e3, F.concat(F.format_string("%.0f", half_up(price / 1e3)), F.lit("K"))).otherwise(plain_number(price))


def long_price(price: Column) -> Column:
    """``Rp 25.000``."""
    return F.concat(F.lit("Rp "), F.replace(F.format_number(half_up(price), 0), F.lit(","), F.lit(".")))


def shown_price(price: Column) -> Column:
    """:func:`long_price`, ``N/A`` for none."""
    return F.coalesce(long_price(price), F.lit("N/A"))


def idr_price(price: Column) -> Column:
    """``25.000 IDR``."""
    return F.concat(F.replace(F.format_number(half_up(price), 0), F.lit(","), F.lit(".")), F.lit(" IDR"))


def _model_rates(model: Column) -> tuple[Column, Column]:
    name = model
    for part, known in reversed(MODEL_NAMES):
        name = F.when(F.contains(model, F.lit(part)), known).otherwise(name)
    return _rates(TOKEN_RATES, name)


def _rates(table: Mapping[str, tuple[float, float]], model: Column) -> tuple[Column, Column]:
    first = next(iter(table.values()))
    return tuple(F.coalesce(lookup({m: r[i] for m, r in table.items()}, model), F.lit(first[i])) for i in (0, 1))


def token_cost(model: Column, prompt: Column, answer: Column) -> Column:
    """Dollars for a model call; the model is told by a part of its name."""
    rates = _model_rates(model)
    return prompt / 1000 * rates[0] + answer / 1000 * rates[1]


def total_token_cost(model: Column, tokens: Column) -> Column:
    """Dollars for a number of tokens, all of them answers."""
    return tokens / 1000 * _model_rates(model)[1]


def service_cost(model: Column, prompt: Column, answer: Column) -> Column:
    """Dollars for a call of the second service, whose models go by their whole names."""
    rates = _rates(SERVICE_RATES, model)
    return prompt / 1000 * rates[0] + answer / 1000 * rates[1]


def shown_cost(cost: Column) -> Column:
    """Dollars with six places under a tenth of a cent, five under a cent, else four."""
    return F.concat(F.lit("$"), F.when(cost < 0.001, F.format_string("%.6f", cost)).when(cost < 0.01, F.format_string("%.5f", cost)).otherwise(F.format_string("%.4f", cost)))
