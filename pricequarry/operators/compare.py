"""Price comparison: what scanned items cost against all suppliers' current prices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import half_up, share
from ..functions.names import tokens
from ..functions.similarity import modifier_clash
from ..functions.units import canonical_unit, unit_price
from .search import candidates, scored


@dataclass(frozen=True)
class Limits:
    """When prices count. Fixed values of the domain."""

    fresh_days: int = 30
    saving_percent: float = 5.0
    suspiciously_low: float = 0.7
    overpriced: float = 1.15
    above_average: float = 1.05
    below_average: float = 0.95
    deals: int = 3


def is_fresh(created: Column, as_of: Column, days: int = 30) -> Column:
    return created >= as_of - F.make_dt_interval(F.lit(days))


def price_status(price: Column, low: Column, high: Column, mean: Column, limits: Limits = Limits()) -> Column:
    """A struct of status and deviation in percent (one place): the first rule that fits; no_data without market prices."""
    rules = (
        ("suspiciously_low", price < low * limits.suspiciously_low, -share(low - price, low)),
        ("overpriced", price > high * limits.overpriced, share(price - high, high)),
        ("above_average", price > mean * limits.above_average, share(price - mean, mean)),
        ("below_average", price < mean * limits.below_average, -share(mean - price, mean)),
    )
    status, deviation = F.when(low.isNull() | price.isNull(), "no_data"), F.when(low.isNull() | price.isNull(), F.lit(None).cast("double"))
    for name, fits, percent in rules:
        status, deviation = status.when(fits, name), deviation.when(fits, half_up(percent, 1))
    return F.struct(status.otherwise("normal").alias("status"), deviation.otherwise(0.0).alias("deviation"))


def compare_prices(items: DataFrame, products: DataFrame, prices: DataFrame, suppliers: DataFrame | None, as_of: Column, aliases: DataFrame | None = None, limits: Limits = Limits()) -> DataFrame:
    """One row for each item: its match, the market's prices, a status, and better deals; without a match, none of these.

    Prices of all candidates count, not just the best match's, but for those of another
    product by its modifiers and those that are not fresh. Deals are by unit price where
    the item's unit and the price's (else the product's) are the same canonical one, else by total, at least ``saving_percent`` cheaper,
    of another supplier; without ``suppliers`` they name none. Candidates are found once, and all that is said of an item comes from
    one exchange of its entries: what the market's prices are, which candidate is best, and its deals.
    """
    asked = items.withColumn("scanned_unit_price", F.coalesce(unit_price(F.col("scanned_price"), F.col("quantity"), F.col("unit")), F.col("scanned_price")))
    found = scored(asked, products, candidates(asked, products, aliases))
    current = prices.where("valid_to IS NULL").select("product_id", F.col("supplier_id").alias("by"), F.col("amount").cast("double").alias("amount"), F.col("unit").alias("price_unit"), F.col("unit_price").cast("double").alias("u_price"), "created_at").where(is_fresh(F.col("created_at"), as_of, limits.fresh_days))
    entries = found.join(current.hint("merge"), "product_id", "left").join(asked.select("item_id", "product_name", "unit", "scanned_price", "scanned_unit_price", "supplier_id").hint("merge"), "item_id")
    entries = entries.withColumn("counts", F.col("amount").isNotNull() & ~modifier_clash(tokens(F.col("product_name")), tokens(F.col("p_name")))).withColumn("own_unit", F.coalesce("price_unit", "p_unit"))
    entries = entries.withColumns({"unit_match": F.coalesce(canonical_unit(F.col("unit")) == canonical_unit(F.col("own_unit")), F.lit(False)), "u_price": F.coalesce(F.nullif("u_price", F.lit(0.0)), unit_price(F.col("amount"), F.lit(1.0), F.col("own_unit")))})
    by_unit = F.col("unit_match") & F.col("u_price").isNotNull()
    saving = F.when(by_unit, share(F.col("scanned_unit_price") - F.col("u_price"), F.col("scanned_unit_price"))).otherwise(share(F.col("scanned_price") - F.col("amount"), F.col("scanned_price")))
    deal = F.col("counts") & (F.col("saving") >= limits.saving_percent) & ~F.coalesce(F.col("by") == F.col("supplier_id"), F.lit(False))
    entries = entries.withColumn("saving", saving).withColumn("deal", F.coalesce(deal, F.lit(False)))
    # the same price of a supplier for a product is one deal; all windows are over the entries as dealt out by item
    order = [F.col("unit_match").desc(), F.when(by_unit, F.col("u_price")).asc_nulls_last(), F.col("amount"), F.col("by"), F.col("product_id")]
    again = F.row_number().over(Window.partitionBy("item_id", "by", "amount", "product_id").orderBy(F.col("deal").desc(), *order[:2]))
    dealt = entries.repartition("item_id").withColumn("deal", F.col("deal") & (again == 1))
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("deal").desc(), *order))
    ranked = dealt.withColumn("rank", rank)
    if suppliers is None:
        ranked = ranked.withColumn("supplier_name", F.lit(None).cast("string"))
    else:
        ranked = ranked.join(suppliers.select(F.col("id").alias("by"), F.col("name").alias("supplier_name")), "by", "left")
    offered = F.struct("rank", F.col("by").alias("supplier_id"), "supplier_name", "product_id", "amount", F.col("u_price").alias("unit_price"), half_up(F.col("saving")).alias("saving_percent"))
    amount = F.when(F.col("counts"), F.col("amount"))
    said = ranked.groupBy("item_id").agg(
        F.max_by(F.struct("product_id", "score"), "better").alias("match"),
        F.min(amount).alias("low"),
        F.max(amount).alias("high"),
        F.avg(amount).alias("mean"),
        F.count(amount).alias("supplier_count"),
        F.array_sort(F.collect_list(F.when(F.col("deal") & (F.col("rank") <= limits.deals), offered))).alias("better_deals"),
    )
    matched = F.col("match.score") > 0
    said = said.withColumns({"matched_id": F.when(matched, F.col("match.product_id")), "score": F.when(matched, F.col("match.score"))}).drop("match")
    out = asked.join(said.hint("merge"), "item_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    known = F.col("matched_id").isNotNull()
    status = price_status(F.col("scanned_price"), F.col("low"), F.col("high"), F.col("mean"), limits)
    return out.select(
        *items.columns,
        "matched_id",
        half_up(F.col("score"), 1).alias("score"),
        F.when(F.col("matched_id").isNull(), F.struct(F.lit("not_found").alias("status"), F.lit(None).cast("double").alias("deviation"))).otherwise(status).alias("verdict"),
        F.when(known, F.col("low")).alias("low"),
        F.when(known, F.col("high")).alias("high"),
        F.when(known, half_up(F.col("mean"))).alias("mean"),
        F.when(known, F.coalesce("supplier_count", F.lit(0))).otherwise(0).alias("supplier_count"),
        F.coalesce(F.when(known, F.col("better_deals")), F.array().cast("array<struct<rank:int,supplier_id:string,supplier_name:string,product_id:string,amount:double,unit_price:double,saving_percent:double>>")).alias("better_deals"),
    ).select("*", "verdict.status", "verdict.deviation").drop("verdict")


def summarize(compared: DataFrame) -> DataFrame:
    """One row: items by outcome, and what the best deals would save. An item not found counts as new, one with deals as improvable, else as best priced or otherwise."""
    new = F.col("status") == "not_found"
    deals = ~new & (F.size("better_deals") > 0)
    best = ~new & ~deals & (F.coalesce(F.col("scanned_price") <= F.col("low"), F.lit(False)))
    saved = F.when(deals, F.greatest(F.lit(0.0), F.col("scanned_price") - F.col("better_deals")[0]["amount"])).otherwise(0.0)
    return compared.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(new).alias("new_items"),
        F.count_if(deals).alias("with_better_deals"),
        F.count_if(best).alias("best_priced"),
        F.count_if(F.col("status") == "overpriced").alias("overpriced"),
        F.coalesce(F.sum(saved), F.lit(0.0)).alias("total_savings"),
        half_up(F.coalesce(share(F.sum(saved), F.sum("scanned_price")), F.lit(0.0)), 1).alias("savings_percent"),
    )


def invoice_totals(lines: DataFrame, invoice: str, price: str, quantity: str, best: str) -> DataFrame:
    """For each invoice: what it costs, what the best prices would save, and that in percent."""
    saved = F.greatest(F.lit(0.0), F.col(price) - F.col(best)) * F.col(quantity)
    sums = lines.groupBy(invoice).agg(F.sum(F.col(price) * F.col(quantity)).alias("total"), F.sum(F.coalesce(saved, F.lit(0.0))).alias("savings"))
    return sums.withColumn("savings_percent", share(F.col("savings"), F.col("total")))


def not_found(compared: DataFrame) -> DataFrame:
    """Items without a match as rows for the queue of unmatched names."""
    return _queued(compared.where("status = 'not_found'"))


def unmatched(items: DataFrame, products: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """:func:`not_found` of items that have not been compared: no price or supplier has a say in whether an item has a match."""
    matched = scored(items, products, candidates(items, products, aliases)).where("score > 0")
    return _queued(items.join(matched.select("item_id").hint("merge"), "item_id", "left_anti"))


def _queued(items: DataFrame) -> DataFrame:
    context = F.to_json(F.struct("scanned_price", "unit", "quantity"))
    return items.select(F.col("product_name").alias("raw_name"), F.lower(F.trim("product_name")).alias("normalized_name"), context.alias("context"), "supplier_id")
