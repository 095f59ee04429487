"""The store of an upload's products: standard names, one price for each product and supplier, products found or made, prices and history that follow them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import matching_name
from ..functions.units import ingested_unit
from .history import store
from .quality import price_errors, product_errors


class Stored(NamedTuple):
    products: DataFrame
    prices: DataFrame
    history: DataFrame
    #: What was not stored: supplier_id, standardized_name, standardized_unit, errors.
    rejected: DataFrame


def cheapest(rows: DataFrame) -> DataFrame:
    """One row for each supplier, standard name and standard unit: the one of the least amount, of equal ones the first by ``position``.

    ``rows``: supplier_id, position, name, raw_name, standardized_name (null where nobody gave one: then the cleaned
    name is taken), category, unit, description, amount. Rows without a positive amount go. The minimum is
    taken in the tasks before the exchange, so a name or supplier that holds many rows costs no task more than its share.
    """
    fields = ["name", "raw_name", "category", "unit", "description"]
    keyed = rows.where(F.col("amount") > 0).select(
        "supplier_id",
        F.coalesce(F.nullif(F.trim("standardized_name"), F.lit("")), matching_name(F.col("name"))).alias("standardized_name"),
        ingested_unit(F.col("unit")).alias("standardized_unit"),
        F.struct("amount", "position", *fields).alias("row"),
    )
    best = keyed.groupBy("supplier_id", "standardized_name", "standardized_unit").agg(F.min("row").alias("row"))
    return best.select("supplier_id", "standardized_name", "standardized_unit", "row.*")


def with_products(best: DataFrame, products: DataFrame) -> DataFrame:
    """:func:`cheapest` rows with ``product_id``: that of the known product of the same standard name and unit (the least, should several be so), else one made from both, the same wherever it is made."""
    known = products.where("standardized_name IS NOT NULL AND standardized_unit IS NOT NULL").groupBy("standardized_name", "standardized_unit").agg(F.min("id").alias("known"))
    made = F.sha2(F.concat_ws("|", "standardized_name", "standardized_unit"), 256)
    return best.join(known, ["standardized_name", "standardized_unit"], "left").withColumn("product_id", F.coalesce("known", made)).withColumn("is_new", F.col("known").isNull()).drop("known")


def products_after(found: DataFrame, products: DataFrame, now: Column) -> DataFrame:
    """The product table with the names, units, categories and descriptions of :func:`with_products` rows, and the products they make.

    Of several suppliers' rows for a product those of the greatest supplier_id count, as if uploads came in that
    order. A missing category or description leaves what is there.
    """
    last = [F.max(F.struct("supplier_id", "standardized_name", "standardized_unit", *[F.trim(c).alias(c) for c in ("name", "unit")], F.coalesce(F.nullif(F.trim("raw_name"), F.lit("")), F.trim("name")).alias("raw_name"), "is_new")).alias("n")]
    last += [F.max(F.when(F.col(c).isNotNull(), F.struct("supplier_id", F.trim(c).alias("v"))))["v"].alias(f"new_{c}") for c in ("category", "description")]
    changes = found.groupBy("product_id").agg(*last)
    new = changes.where("NOT n.is_new")
    given = {**{c: F.coalesce(f"n.{c}", F.col(c)) for c in ("name", "raw_name", "unit")}, **{c: F.coalesce(f"new_{c}", F.col(c)) for c in ("category", "description")}}
    kept = products.join(new, products.id == new.product_id, "left").select(*[given.get(c, F.col(c)).alias(c) for c in products.columns])
    values = {"id": F.col("product_id"), **{c: F.col(f"n.{c}") for c in ("name", "raw_name", "unit", "standardized_name", "standardized_unit")}, "category": F.col("new_category"), "description": F.col("new_description"), "created_at": now}
    added = changes.where("n.is_new").select(*[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in products.schema])
    return kept.unionByName(added)


def stored(rows: DataFrame, products: DataFrame, prices: DataFrame, now: Column, upload_id: str | None = None) -> Stored:
    """All tables after an upload of :func:`cheapest`'s rows, as one chain of joins: ids of products that it makes never pass through the driver.

    A supplier's best row of a product is stored if product and price are valid (``quality.product_errors``,
    ``price_errors``); if not, the product's other rows of that supplier are not tried, and it comes back in ``rejected``. Prices
    are stored by ``history.store``: one like a current price of product and supplier changes nothing,
    another ends the current ones. So a repeated upload changes no price. An empty upload leaves all
    as it is; rows that repeat count once; columns that ``rows`` has beside those named are not read.
    """
    best = cheapest(rows).withColumn("errors", F.concat(product_errors(F.col("name"), F.col("standardized_name"), F.col("unit")), price_errors(F.col("amount"), F.col("supplier_id"))))
    found = with_products(best.where(F.size("errors") == 0), products)
    incoming = found.select("product_id", "supplier_id", "amount", "unit", F.lit(None).cast(prices.schema["unit_price"].dataType).alias("unit_price"))
    after, log = store(incoming, prices, now, upload_id=upload_id)
    return Stored(products_after(found, products, now), after, log, best.where(F.size("errors") > 0).select("supplier_id", "standardized_name", "standardized_unit", "errors"))
