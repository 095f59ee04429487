"""Checks of products and prices, reports on them, and repairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import any_of, half_up, lookup, share
from ..functions.dictionary import UNTRANSLATED, VALID_UNITS
from ..functions.lexicon import HIGH_PRICE, LEAST_PRICE, LOW_PRICE, MOST_PRICE, PRICE_BOUNDS
from ..functions.names import bound_category, is_product_name, name_fault
from ..functions.prices import looks_misread, plain_number
from ..functions.units import service_unit, unit_price


def validate_price(name: Column, price: Column, unit: Column | None = None, hint: Column | None = None) -> Column:
    """A struct of is_valid, category, warnings, errors and confidence.

    Errors end the check: no positive price, or one beyond the absolute bounds. Warnings
    multiply the confidence: 0.7 outside the category's bounds, 0.8 for an unusual unit, or
    without a category for a suspicious price, 0.6 for what a misplaced point would give.
    """
    # the category is looked up in the name once: as an argument of a lambda it is a value, not an expression copied into each check
    once = F.transform(F.array(F.struct(bound_category(name, hint).alias("category"))), lambda x: price_verdict(x["category"], price, unit))
    return F.element_at(once, 1)


def price_verdict(category: Column, price: Column, unit: Column | None = None, texts: bool = True) -> Column:
    """:func:`validate_price` for a category that is known, best a column of its own. Without ``texts`` errors and warnings are true for each, for counting."""
    least, most = (lookup({c: float(v[i]) for c, v in PRICE_BOUNDS.items()}, category) for i in (1, 2))
    shown = plain_number(price)
    # the texts of errors and warnings are fixed values
    error = (
        F.when(price.isNull() | (price <= 0), F.lit("Price must be greater than 0"))
        .when(price < LEAST_PRICE, F.concat(F.lit("Price "), shown, F.lit(f" is below absolute minimum {LEAST_PRICE}")))
        .when(price > MOST_PRICE, F.concat(F.lit("Price "), shown, F.lit(f" exceeds absolute maximum {MOST_PRICE}")))
    )
    odd_unit = F.lit(False)
    if unit is not None:
        u = F.lower(unit)
        odd_unit = F.coalesce(any_of((category == c) & ~any_of(F.contains(u, F.lit(x)) | F.contains(F.lit(x), u) for x in v[3]) for c, v in PRICE_BOUNDS.items()) & (u != ""), F.lit(False))
    found = [
        (price < least, 0.7, F.concat(F.lit("Price "), shown, F.lit(" is below typical minimum "), plain_number(least), F.lit(" for category"))),
        (price > most, 0.7, F.concat(F.lit("Price "), shown, F.lit(" exceeds typical maximum "), plain_number(most), F.lit(" for category"))),
        (odd_unit, 0.8, F.concat(F.lit("Unit '"), F.coalesce(unit if unit is not None else F.lit(None).cast("string"), F.lit("")), F.lit("' is unusual for this category"))),
        (category.isNull() & (price < LOW_PRICE), 0.8, F.concat(F.lit("Price "), shown, F.lit(" seems suspiciously low"))),
        (category.isNull() & (price > HIGH_PRICE), 0.8, F.concat(F.lit("Price "), shown, F.lit(" seems suspiciously high"))),
        (looks_misread(price), 0.6, F.lit("Price might have decimal point parsing error")),
    ]
    if not texts:
        error = F.when(price.isNull() | (price <= 0) | (price < LEAST_PRICE) | (price > MOST_PRICE), True)
    fine = error.isNull()
    warnings = F.array_compact(F.array(*[F.when(fine & F.coalesce(c, F.lit(False)), text if texts else F.lit(True)) for c, _, text in found]))
    confidence = F.lit(1.0)
    for c, factor, _ in found:
        confidence = confidence * F.when(F.coalesce(c, F.lit(False)), factor).otherwise(1.0)
    return F.struct(fine.alias("is_valid"), category.alias("category"), warnings.alias("warnings"), F.array_compact(F.array(error)).alias("errors"), F.when(fine, confidence).otherwise(0.0).alias("confidence"))


def validation_summary(validated: DataFrame, verdict: str, price: str) -> DataFrame:
    """One row: counts, mean confidence, and prices by size."""
    v, p = F.col(verdict), F.col(price)
    return validated.agg(
        F.count(F.lit(1)).alias("products"),
        F.count_if(v["is_valid"]).alias("valid"),
        F.count_if(F.size(v["warnings"]) > 0).alias("with_warnings"),
        F.count_if(F.size(v["errors"]) > 0).alias("with_errors"),
        F.avg(v["confidence"]).alias("avg_confidence"),
        F.count_if(p < 1e4).alias("below_10k"),
        F.count_if((p >= 1e4) & (p < 1e5)).alias("from_10k"),
        F.count_if((p >= 1e5) & (p < 1e6)).alias("from_100k"),
        F.count_if(p >= 1e6).alias("from_1m"),
    )


def issues(products: DataFrame, key: str, price: str, unit: str, standard_unit: str | None = None, quantity: str | None = None) -> DataFrame:
    """(key, issue, severity): a row for each fault of each product. The unit checked is the standard one, where there is one, else what the service makes of the unit."""

    def issue(kind: str, severity: str) -> Column:
        return F.struct(F.lit(kind).alias("issue"), F.lit(severity).alias("severity"))

    p, u = F.col(price), service_unit(F.col(unit))
    if standard_unit:
        u = F.coalesce(F.nullif(F.col(standard_unit), F.lit("")), u)
    all_ = [
        F.when(p.isNull(), issue("null_price", "critical")),
        F.when((p < 100) | (p > 1e7), issue("out_of_range_price", "warning")),
        F.when(~u.isin(*VALID_UNITS), issue("invalid_unit", "warning")),
    ]
    if quantity:
        all_.append(F.when(F.col(quantity) == 0, issue("zero_quantity", "critical")))
    return products.select(key, F.explode(F.array_compact(F.array(*all_))).alias("i")).select(key, "i.*")


def quality_report(products: DataFrame, found: DataFrame) -> DataFrame:
    """One row: products, issues of each kind, critical ones, and whether people should look (any critical issue, or missing prices and invalid units over a tenth)."""
    counts = found.agg(*[F.count_if(F.col("issue") == k).alias(k) for k in ("null_price", "invalid_unit", "out_of_range_price", "zero_quantity")], F.count_if(F.col("severity") == "critical").alias("critical"))
    total = products.agg(F.count(F.lit(1)).alias("total"))
    return total.crossJoin(counts).withColumn("needs_review", (F.col("critical") > 0) | ((F.col("null_price") + F.col("invalid_unit")) > 0.1 * F.col("total")))


def name_faults(products: DataFrame, name: str) -> DataFrame:
    """(fault, n): products by what is wrong with their names."""
    return products.select(name_fault(F.col(name)).alias("fault")).where("fault IS NOT NULL").groupBy("fault").agg(F.count(F.lit(1)).alias("n"))


def review_flags(name: Column, price: Column, unit: Column) -> Column:
    """A struct of flags and severity (high for more than two flags, medium for one or two, else low) for the review of an upload. A null counts as an empty name, a price of 0, no unit."""
    n, p = F.coalesce(name, F.lit("")), F.coalesce(price, F.lit(0))
    flags = F.array_compact(
        F.array(
            F.when(F.length(n) < 3, F.lit("short name")),
            F.when(n.rlike(r"^\d+\s+\w+\s+\d+\s+\w+"), F.lit("pack code in name")),
            F.when(F.contains(F.lower(n), F.lit("rp ")) | F.contains(F.lower(n), F.lit("idr")), F.lit("price in name")),
            F.when(p <= 0, F.lit("no price")),
            F.when(p > 1e7, F.lit("high price")),
            F.when(F.coalesce(unit, F.lit("")) == "", F.lit("no unit")),
        )
    )
    return F.struct(flags.alias("flags"), F.when(F.size(flags) > 2, "high").when(F.size(flags) > 0, "medium").otherwise("low").alias("severity"))


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def product_errors(name: Column, standard_name: Column, unit: Column) -> Column:
    """Why a product may not be stored (an array, empty if it may): a name, a standard name and a unit are required."""
    # the texts are fixed values
    return F.array_compact(
        F.array(
            F.when(_blank(name), F.lit("Product name is required and cannot be empty")),
            F.when(_blank(standard_name), F.lit("Standardized product name is required")),
            F.when(_blank(unit), F.lit("Product unit is required")),
        )
    )


def price_errors(amount: Column, supplier_id: Column, product_id: Column | None = None, least: float = 0.01) -> Column:
    """Why a price may not be stored: no more than the least amount, no supplier, no product (where its column is given)."""
    ids = [F.when(_blank(supplier_id), F.lit("Supplier ID is required"))]
    if product_id is not None:
        ids.append(F.when(_blank(product_id), F.lit("Product ID is required")))
    return F.array_compact(F.array(F.when(~F.coalesce((amount > least) & ~F.isnan(amount.cast("double")), F.lit(False)), F.lit(f"Price amount must be greater than {least}")), *ids))


def accepted(rows: DataFrame, errors: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without errors (of :func:`product_errors` and :func:`price_errors`), and the rest with theirs in a column ``errors``."""
    judged = rows.withColumn("errors", errors)
    return judged.where(F.size("errors") == 0).drop("errors"), judged.where(F.size("errors") > 0)


def repaired_names(products: DataFrame, name: str = "name", raw: str = "raw_name") -> DataFrame:
    """Empty names from the raw ones; products without either go."""
    fixed = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(raw), F.lit("")))
    return products.withColumn(name, fixed).where(F.col(name).isNotNull())


def backfilled_units(prices: DataFrame, amount: str = "amount", quantity: str = "quantity", unit: str = "unit", target: str = "unit_price") -> DataFrame:
    """Missing or zero unit prices worked out."""
    made = unit_price(F.col(amount).cast("double"), F.col(quantity).cast("double"), F.col(unit))
    return prices.withColumn(target, F.coalesce(F.nullif(F.col(target).cast("double"), F.lit(0.0)), made))


def duplicates(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keys of more than one row, and how many."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(parents: DataFrame, key: str, *children: DataFrame) -> DataFrame:
    """Parents that no row of any child table belongs to."""
    for child in children:
        parents = parents.join(child.select(key).distinct(), key, "left_anti")
    return parents


def clean_catalogue(products: DataFrame, prices: DataFrame, suppliers: DataFrame, uploads: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Products, prices and suppliers after the clean-up, in its order: products without prices, faulty names, prices of at most 0, suppliers without prices and uploads."""
    kept = products.join(prices.select(F.col("product_id").alias("id")).distinct(), "id", "left_semi").where(is_product_name(F.col("name")))
    good = prices.where(F.col("amount") > 0).join(kept.select(F.col("id").alias("product_id")), "product_id", "left_semi")
    named = suppliers.withColumnRenamed("id", "supplier_id")
    used = good.select("supplier_id").unionByName(uploads.select("supplier_id")).distinct()
    return kept, good, named.join(used, "supplier_id", "left_semi").withColumnRenamed("supplier_id", "id").select(*suppliers.columns)


def merge_products(products: DataFrame, prices: DataFrame, by: Sequence[str] = ("standardized_name", "standardized_unit")) -> tuple[DataFrame, DataFrame]:
    """Products of one key as the oldest of them, with the first name and the first description that are longer than its own, and the first category, in the order of their age, then of their ids.

    Of all prices of a supplier in a unit, ended ones too, the latest begun goes to the product that is kept (ties: the
    oldest product's, then by id); that product's own prices all stay, and the others' other prices go.
    Keys compare with nulls equal; a null name is never merged.
    """
    w = Window.partitionBy(*by).orderBy("created_at", "id")
    mergeable = F.col(by[0]).isNotNull()

    def of_kept(column: str) -> Column:
        return F.when(mergeable, F.first(column).over(w)).otherwise(F.col(column))

    def longer(column: str) -> Column:
        is_longer = F.length(F.coalesce(column, F.lit(""))) > F.length(F.coalesce(f"kept_{column}", F.lit("")))
        return F.min(F.when(is_longer, F.struct("created_at", "id", column)))[column].alias(f"b_{column}")

    named = products.withColumns({f"kept_{c}": of_kept(c) for c in ("id", "name", "description")})
    best = named.groupBy("kept_id").agg(longer("name"), longer("description"), F.min(F.when(F.col("category").isNotNull(), F.struct("created_at", "id", "category")))["category"].alias("b_category"))
    merged = named.where("id = kept_id").join(best, "kept_id").withColumns({"name": F.coalesce("b_name", "name"), "category": F.coalesce("b_category", "category"), "description": F.coalesce("b_description", "description")}).select(*products.columns)
    theirs = prices.join(named.select(F.col("id").alias("product_id"), "kept_id", F.col("created_at").alias("made")), "product_id")
    latest = F.row_number().over(Window.partitionBy("kept_id", "supplier_id", "unit").orderBy(F.col("valid_from").desc_nulls_last(), "made", "product_id", "id"))
    kept = theirs.withColumn("r", latest).where("product_id = kept_id OR r = 1").withColumn("product_id", F.col("kept_id")).select(*prices.columns)
    return merged, kept


def repointed(prices: DataFrame, mapping: DataFrame, order: Sequence[str] = ("product_id", "id")) -> DataFrame:
    """Prices of merged products under the kept one, unless that has a current price of the supplier by then. ``mapping``: id, kept_id.

    The prices are gone through in the given order: where the kept product has no current price of its
    own they move, ended ones too, until a current one has; those after it go, and so do all where it has.
    """
    moves = mapping.where("id <> kept_id").select(F.col("id").alias("product_id"), "kept_id")
    theirs = prices.join(moves, "product_id")
    stay = prices.join(moves, "product_id", "left_anti")
    current = stay.where("valid_to IS NULL").select(F.col("product_id").alias("kept_id"), "supplier_id").distinct()
    free = theirs.join(current, ["kept_id", "supplier_id"], "left_anti")
    before = Window.partitionBy("kept_id", "supplier_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.max(F.col("valid_to").isNull()).over(before), F.lit(False))
    return stay.unionByName(free.withColumn("taken", taken).where("NOT taken").withColumn("product_id", F.col("kept_id")).select(*prices.columns))


def renamed(products: DataFrame, new_name: Column, name: str = "standardized_name", unit: str = "standardized_unit") -> DataFrame:
    """Products under new names, but for those whose new name and unit another one has or takes first."""
    w = Window.partitionBy("target", unit).orderBy((F.col("target") == F.col(name)).desc(), "id")
    taken = F.row_number().over(w) > 1
    return products.withColumn("target", new_name).withColumn("taken", taken).withColumn(name, F.when(F.col("taken"), F.col(name)).otherwise(F.col("target"))).drop("target", "taken")


def overall_score(checks: DataFrame, scores: Sequence[str]) -> DataFrame:
    """The rounded mean of each row's least score."""
    return checks.agg(F.floor(F.avg(F.least(*scores)) + 0.5).alias("score"))


def term_quality(text: Column, required: Sequence[str], forbidden: Sequence[str]) -> Column:
    """100, less 20 for each required term that is missing and 30 for each forbidden one, at least 0."""
    s = F.lower(text)
    missing = sum((F.when(F.contains(s, F.lit(t)), 0).otherwise(20) for t in required), F.lit(0))
    wrong = sum((F.when(F.contains(s, F.lit(t)), 30).otherwise(0) for t in forbidden), F.lit(0))
    return F.greatest(F.lit(0), 100 - missing - wrong)


def saved_share(rows: DataFrame) -> DataFrame:
    """Current and ended prices, and the ended ones' share in percent."""
    ended = F.count_if(F.col("valid_to").isNotNull())
    return rows.agg(F.count(F.lit(1)).alias("prices"), ended.alias("expired"), share(ended, F.count(F.lit(1))).alias("expired_percent"))


def extraction_quality(rows: DataFrame, by: Sequence[str], confidence: str = "confidence") -> DataFrame:
    """The mean confidence of each upload's rows (a missing one counts 0.9), to two places."""
    return rows.groupBy(*by).agg(half_up(F.avg(F.coalesce(confidence, F.lit(0.9))), 2).alias("quality"), F.count(F.lit(1)).alias("rows"))


def data_quality_report(products: DataFrame, prices: DataFrame) -> DataFrame:
    """(issue, n, percent): the six classes of the data report, and their share.

    Of products: standard names with an Indonesian word, standard units that are not valid or not what the service makes of
    the unit, and products beyond the first of their standard name and unit. Of prices: 0, no unit
    price, out of range. The percent, the same in each row, is that of the three counts of products among all
    products (0 without any), so it may exceed 100. One pass over each table; products are counted by name and unit in the tasks first.
    """
    unit, shown = F.col("standardized_unit"), service_unit(F.col("unit"))
    low = F.lower("standardized_name")
    faults = products.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(any_of(F.contains(low, F.lit(w)) for w in UNTRANSLATED)).alias("indonesian_names"),
        F.count_if(~F.coalesce(unit.isin(*VALID_UNITS) & (unit == shown), F.lit(False))).alias("invalid_units"),
    )
    groups = products.where("standardized_name IS NOT NULL AND standardized_unit IS NOT NULL").groupBy("standardized_name", "standardized_unit").agg((F.count(F.lit(1)) - 1).alias("n"))
    doubled = groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_products"))
    amount = F.col("amount")
    faulty = prices.agg(F.count_if(amount == 0).alias("null_prices"), F.count_if(F.col("unit_price").isNull() | (F.col("unit_price") == 0)).alias("missing_unit_prices"), F.count_if((amount < 100) | (amount > 1e7)).alias("out_of_range_prices"))
    whole = faults.crossJoin(doubled).crossJoin(faulty)  # one row each
    whole = whole.withColumn("percent", F.coalesce(share(F.col("indonesian_names") + F.col("invalid_units") + F.col("duplicate_products"), F.col("total")), F.lit(0.0)))
    return whole.unpivot(["percent"], ["indonesian_names", "null_prices", "invalid_units", "missing_unit_prices", "duplicate_products", "out_of_range_prices"], "issue", "n").select("issue", "n", "percent")
