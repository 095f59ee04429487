"""Prices over time: valid-time intervals, change logs, and the upkeep of current prices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import share


def active(prices: DataFrame, valid_to: str = "valid_to") -> DataFrame:
    return prices.where(F.col(valid_to).isNull())


def change_percent(new: Column, old: Column) -> Column:
    """Null where there was no price, one of 0, or the same one."""
    return F.when(old.isNotNull() & (old != 0) & (old != new), share(new - old, old))


def change_log(prices: DataFrame, by: Sequence[str], at: Sequence[str], price: str) -> DataFrame:
    """Each price with the one before it (changed_from) and the change in percent."""
    before = F.lag(price).over(Window.partitionBy(*by).orderBy(*at))
    return prices.withColumn("changed_from", before).withColumn("change_percentage", change_percent(F.col(price), F.col("changed_from")))


def intervals(prices: DataFrame, by: Sequence[str], valid_from: str, tie: Sequence[str]) -> DataFrame:
    """``valid_to`` from the start of the next price of the same key; null for the current one."""
    return prices.withColumn("valid_to", F.lead(valid_from).over(Window.partitionBy(*by).orderBy(valid_from, *tie)))


def as_of(prices: DataFrame, moment: Column, valid_from: str = "valid_from", valid_to: str = "valid_to") -> DataFrame:
    return prices.where((F.col(valid_from) <= moment) & (F.col(valid_to).isNull() | (F.col(valid_to) > moment)))


def latest(prices: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key, by a struct maximum that is taken before the shuffle."""
    rest = [c for c in prices.columns if c not in by]
    best = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("b")
    return prices.groupBy(*by).agg(best).select(*by, "b.*").select(*prices.columns)


def store(incoming: DataFrame, prices: DataFrame, now: Column, by: Sequence[str] = ("product_id", "supplier_id"), upload_id: str | None = None, skip_equal: bool = True) -> tuple[DataFrame, DataFrame]:
    """The new price table and the history rows after an upload.

    ``incoming``: product_id, supplier_id, amount, unit, unit_price. Prices that are not positive go; of those
    that share ``by`` the cheapest stays, with its own product, supplier and unit. ``by`` says what a
    new price ends: the current prices of the product alone, with supplier, or with unit too. A price like a
    current one of the same ``by`` changes nothing (unless ``skip_equal`` is false); another ends the current ones at ``now`` and begins
    a new one, and the history gets a row for each that it ends, or an initial one. A full new table, as a
    table without transactions needs.
    """
    by = list(by)
    keys = ["product_id", "supplier_id", "unit"]
    fresh = incoming.where(F.col("amount") > 0).groupBy(*by).agg(F.min(F.struct("amount", "unit_price", *[k for k in keys if k not in by])).alias("n"))
    fresh = fresh.select(*by, "n.*").select(*keys, F.col("amount").cast(prices.schema["amount"].dataType).alias("amount"), "unit_price")
    on = [F.col(f"n.{k}").eqNullSafe(F.col(f"c.{k}")) for k in by]
    current = active(prices).alias("c")
    n = fresh.alias("n")
    equal = [F.col("n.amount") == F.col("c.amount"), F.col("n.unit").eqNullSafe(F.col("c.unit"))]
    changed = n.join(current, [*on, *equal], "left_anti") if skip_equal else n
    changed = changed.alias("n")
    ends = changed.select(*[F.col(f"n.{k}").alias(f"e_{k}") for k in by], F.lit(True).alias("ends"))
    open_ = F.when(F.col("valid_to").isNull() & F.col("ends"), now).otherwise(F.col("valid_to"))
    ended = prices.join(ends, [F.col(k).eqNullSafe(F.col(f"e_{k}")) for k in by], "left").withColumn("valid_to", open_.cast(prices.schema["valid_to"].dataType)).select(*prices.columns)
    made = {"id": F.sha2(F.concat_ws("|", *keys, now.cast("string"), F.col("amount").cast("string")), 256), "upload_id": F.lit(upload_id), "valid_from": now, "valid_to": F.lit(None), "created_at": now}
    added = changed.select(*[(F.col(f"n.{f.name}") if f.name in fresh.columns else made.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in prices.schema])
    old, new = F.col("c.amount").cast("double"), F.col("n.amount").cast("double")
    log = changed.join(current, on, "left").select(
        *[F.col(f"n.{k}").alias(k) for k in ("product_id", "supplier_id")],
        F.col("n.amount").alias("price"),
        F.col("n.unit").alias("unit"),
        F.col("n.unit_price").alias("unit_price"),
        F.col("c.amount").alias("changed_from"),
        F.when(old > 0, share(new - old, old)).when(old.isNotNull(), F.lit(0.0)).alias("change_percentage"),
        F.when(old.isNull(), "initial").otherwise("api").alias("change_reason"),
        F.lit(upload_id).alias("upload_id"),
        now.alias("created_at"),
    )
    return ended.unionByName(added), log


def backfill(prices: DataFrame, history: DataFrame) -> DataFrame:
    """An ``initial`` history row for every price of a pair that history lacks."""
    missing = prices.join(history.select("product_id", "supplier_id").distinct(), ["product_id", "supplier_id"], "left_anti")
    return missing.select("product_id", "supplier_id", F.col("amount").alias("price"), "unit", "unit_price", F.lit("initial").alias("change_reason"), "created_at")


def expire_duplicates(prices: DataFrame, by: Sequence[str], order: Sequence[Column], end: str = "kept") -> DataFrame:
    """One current price for each key: the first by ``order`` stays, the others end a second before it began (``kept``) or, for ``end`` a timestamp, then."""
    w = Window.partitionBy(*by, F.col("valid_to").isNull()).orderBy(*order)
    until = F.first("valid_from").over(w) - F.expr("INTERVAL 1 SECOND") if end == "kept" else F.lit(end).cast("timestamp_ntz")
    surplus = F.col("valid_to").isNull() & (F.row_number().over(w) > 1)
    return prices.withColumn("valid_to", F.when(surplus, until).otherwise(F.col("valid_to")))


def table_changes(before: DataFrame, after: DataFrame, key: Sequence[str]) -> DataFrame:
    """What changed between two versions of a table: the key, ``change`` (created, updated, deleted) and the row ``before`` and ``after`` it.

    Rows are compared with nulls equal, in the columns that both versions have; a null key is a key like any other. Of
    rows that repeat a key the greatest by those columns counts. Both versions are reduced in the tasks and meet in one exchange.
    """
    rest = [c for c in before.columns if c not in key and c in after.columns]

    def side(df: DataFrame, old: bool) -> DataFrame:
        row = F.struct(*rest)
        return df.select(*key, row.alias("before") if old else F.lit(None).alias("before"), F.lit(None).alias("after") if old else row.alias("after"))

    both = side(before, True).unionByName(side(after, False)).groupBy(*key).agg(F.max("before").alias("before"), F.max("after").alias("after"))
    change = F.when(F.col("before").isNull(), "created").when(F.col("after").isNull(), "deleted").otherwise("updated")
    return both.where(~F.col("before").eqNullSafe(F.col("after"))).select(*key, change.alias("change"), "before", "after")


def history_of_changes(changes: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """History rows for the :func:`table_changes` of prices (amount, unit, unit_price, product_id, supplier_id): one for each price created, and for each whose amount is another now.

    ``changed_from`` is the last price of the pair in ``history`` (product_id, supplier_id, price, created_at), else the amount before. Prices that were deleted, or changed in other columns only, leave none.
    """
    new = F.col("change") == "created"
    kept = changes.where(new | ((F.col("change") == "updated") & (F.col("before.amount") != F.col("after.amount"))))
    rows = kept.select(
        *[F.col(f"after.{c}").alias(c) for c in ("product_id", "supplier_id")],
        F.col("after.amount").alias("price"),
        *[F.col(f"after.{c}").alias(c) for c in ("unit", "unit_price")],
        F.col("before.amount").alias("changed_from"),
        F.lit("api").alias("change_reason"),
        F.when(new, "New price created via API").otherwise("Price updated via API").alias("notes"),
    )
    if history is not None:
        last = history.groupBy("product_id", "supplier_id").agg(F.max(F.struct("created_at", "price"))["price"].alias("last"))
        rows = rows.join(last, ["product_id", "supplier_id"], "left").withColumn("changed_from", F.coalesce("last", "changed_from")).drop("last")
    return rows.withColumn("change_percentage", change_percent(F.col("price"), F.col("changed_from")))
