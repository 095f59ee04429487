"""Aggregates and windows over prices: market position, savings, trends, volatility, metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import half_up, share


def price_stats(prices: DataFrame, by: Sequence[str], price: str) -> DataFrame:
    """Count, mean, least, most and spread for each group."""
    p = F.col(price)
    return prices.groupBy(*by).agg(F.count(p).alias("price_count"), F.avg(p).alias("avg_price"), F.min(p).alias("min_price"), F.max(p).alias("max_price"), (F.max(p) - F.min(p)).alias("spread"))


def zero_stats(stats: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """All groups, those without prices with zeros."""
    return groups.join(stats, list(by), "left").fillna(0)


def best_offers(prices: DataFrame, product: str, supplier: str, price: str, tie: Sequence[str] = ()) -> DataFrame:
    """The best price for each product and supplier; of equal ones the first by ``tie``. Least values are found before the shuffle."""
    best = F.min(F.struct(F.col(price).alias("p"), *tie)) if tie else F.min(F.struct(F.col(price).alias("p")))
    return prices.groupBy(product, supplier).agg(best.alias("b")).select(product, supplier, F.col("b.p").alias(price), *[F.col(f"b.{t}") for t in tie])


def savings(offers: DataFrame, product: str, supplier: str, price: str) -> DataFrame:
    """For each product the best and the highest offer and what lies between, in percent of the highest (one place)."""
    low, high = F.min(F.struct(price, supplier)), F.max(price)
    out = offers.groupBy(product).agg(low.alias("low"), high.alias("highest_price"), F.count(F.lit(1)).alias("offers"))
    saving = half_up(F.coalesce(share(F.col("highest_price") - F.col(f"low.{price}"), F.col("highest_price")), F.lit(0.0)), 1)
    return out.select(product, F.col(f"low.{supplier}").alias("best_supplier"), F.col(f"low.{price}").alias("best_price"), "highest_price", "offers", saving.alias("savings_percent"))


def average_savings(prices: DataFrame, group: str, price: str) -> DataFrame:
    """One row: the mean, over groups with more than one price, of what the least saves against the most."""
    g = prices.groupBy(group).agg(F.min(price).alias("lo"), F.max(price).alias("hi"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return g.agg(F.count(F.lit(1)).alias("groups"), F.avg(share(F.col("hi") - F.col("lo"), F.col("hi"))).alias("avg_savings"))


def market_share(price: Column, low: Column, high: Column) -> Column:
    """100 for the least price, 0 for the most; 100 where they are equal."""
    return F.when(high == low, F.lit(100.0)).otherwise(half_up(F.try_divide((high - price) * 100.0, high - low)))


def market_position(prices: DataFrame, product: str, supplier: str, price: str) -> DataFrame:
    """Products of more than one price: each row's rank (1 the least; ties by supplier), share, and distance from the mean."""
    w = Window.partitionBy(product)
    p, mean = F.col(price), F.avg(price).over(w)
    return (
        prices.withColumns({"n": F.count(F.lit(1)).over(w), "mean": mean, "low": F.min(p).over(w), "high": F.max(p).over(w), "rank": F.row_number().over(w.orderBy(price, supplier))})
        .where("n > 1")
        .select(product, supplier, price, F.col("rank").cast("long").alias("rank"), market_share(p, F.col("low"), F.col("high")).alias("market_share"), (p - F.col("mean")).alias("difference"), share(p - F.col("mean"), F.col("mean")).alias("percent_diff"))
    )


def supplier_competitiveness(position: DataFrame, supplier: str) -> DataFrame:
    """For each supplier the mean distance from the market, and its position: cheaper (under -5 %), expensive (over 5 %) or average."""
    mean = F.avg("percent_diff")
    return position.groupBy(supplier).agg(F.count(F.lit(1)).alias("products"), mean.alias("avg_diff"), F.avg("rank").alias("avg_rank"), F.when(mean < -5, "cheaper").when(mean > 5, "expensive").otherwise("average").alias("position"))


def daily_average(history: DataFrame, at: str, price: str, today: DataFrame | None = None) -> DataFrame:
    """Mean (two places), least, most, spread and count by day; ``today`` (the same columns of current prices) stands in for a day that history lacks."""

    def days(df: DataFrame) -> DataFrame:
        p = F.col(price)
        return df.groupBy(F.to_date(at).alias("day")).agg(half_up(F.avg(p), 2).alias("avg_price"), F.min(p).alias("min_price"), F.max(p).alias("max_price"), (F.max(p) - F.min(p)).alias("spread"), F.count(p).alias("price_count"))

    out = days(history)
    return out if today is None else out.unionByName(days(today).join(out, "day", "left_anti"))


def trend_summary(history: DataFrame, by: Sequence[str], at: str, price: str, tie: str, stable: float = 5.0) -> DataFrame:
    """Mean, least, most, population deviation, first and last price, the change between in percent, and its direction."""
    p = F.col(price)
    order = F.struct(at, tie)
    out = history.groupBy(*by).agg(F.avg(p).alias("avg_price"), F.min(p).alias("min_price"), F.max(p).alias("max_price"), F.stddev_pop(p).alias("volatility"), F.min_by(p, order).alias("first_price"), F.max_by(p, order).alias("last_price"), F.count(p).alias("points"))
    change = F.coalesce(share(F.col("last_price") - F.col("first_price"), F.col("first_price")), F.lit(0.0))
    return out.withColumn("overall_change", change).withColumn("trend", F.when(F.abs("overall_change") < stable, "stable").when(F.col("overall_change") > 0, "increasing").otherwise("decreasing"))


def change_report(changes: DataFrame, by: Sequence[str], percent: str = "change_percentage") -> DataFrame:
    """For each group: rows with a change, rises, falls, and the mean change in percent."""
    c = F.col(percent)
    return changes.where(c.isNotNull()).groupBy(*by).agg(F.count(F.lit(1)).alias("total_changes"), F.count_if(c > 0).alias("increases"), F.count_if(c < 0).alias("decreases"), F.avg(c).alias("avg_change"))


def volatility(changes: DataFrame, by: Sequence[str], percent: str = "change_percentage") -> DataFrame:
    """The root mean square of changes other than 0, and the number of all."""
    c = F.nullif(F.col(percent), F.lit(0.0))
    return changes.where(F.col(percent).isNotNull()).groupBy(*by).agg(F.coalesce(F.sqrt(F.avg(c * c)), F.lit(0.0)).alias("volatility"), F.count(F.lit(1)).alias("changes"))


def period_start(as_of: Column, period: str) -> Column:
    """7d, 30d, 90d or 1y before; six months (6m) as the calendar has them."""
    days = {"7d": 7, "30d": 30, "90d": 90, "1y": 365}
    return F.add_months(as_of, -6).cast("timestamp_ntz") if period == "6m" else as_of - F.make_dt_interval(F.lit(days[period]))


def upload_metrics(uploads: DataFrame) -> DataFrame:
    """One row of success rate, completeness (a missing one is 0), cost, tokens and time; nulls without uploads."""
    return uploads.agg(
        F.count(F.lit(1)).alias("uploads"),
        share(F.count_if(F.col("status") == "completed"), F.count(F.lit(1))).alias("success_rate"),
        F.avg(F.coalesce("completeness_ratio", F.lit(0.0))).alias("avg_completeness"),
        F.coalesce(F.sum("processing_cost_usd"), F.lit(0.0)).alias("total_cost"),
        F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("total_tokens"),
        F.avg(F.coalesce("processing_time_ms", F.lit(0))).alias("avg_time_ms"),
    )


def stuck_uploads(uploads: DataFrame, now: Column, minutes: int = 10) -> DataFrame:
    """Uploads that have been processing without a change for longer than that."""
    return uploads.where((F.col("status") == "processing") & (F.col("updated_at") < now - F.make_dt_interval(mins=F.lit(minutes))))


def classification_stats(uploads: DataFrame, kind: str, status: str, means: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Uploads of a known kind by (kind, status) with their number and means, and those again by kind: the number, and the means of the last status by name (0 without any)."""
    by = uploads.where(F.col(kind).isNotNull()).groupBy(kind, status).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"avg_{m}") for m in means])
    last = F.max(F.struct(status, *[F.coalesce(f"avg_{m}", F.lit(0.0)).alias(f"avg_{m}") for m in means])).alias("last")
    kinds = by.groupBy(kind).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("statuses"), last)
    return by, kinds.select(kind, "total", "statuses", *[f"last.avg_{m}" for m in means])


def monthly_cost(calls: DataFrame, at: str, model: str, cost: str) -> DataFrame:
    return calls.groupBy(F.date_format(at, "yyyy-MM").alias("month"), model).agg(F.sum(cost).alias("cost"), F.count(F.lit(1)).alias("calls"))


def relation_counts(parents: DataFrame, key: str, **children: DataFrame) -> DataFrame:
    """Parents with the number of rows of each child table (0 without any); every child is counted before it is joined."""
    for name, child in children.items():
        parents = parents.join(child.groupBy(key).agg(F.count(F.lit(1)).alias(name)), key, "left").fillna(0, [name])
    return parents


def nested(parents: DataFrame, children: DataFrame, key: str, fields: Sequence[str], name: str, part: str | None = None) -> DataFrame:
    """Parents with their children as a sorted array of structs; an empty one without any.

    ``part``, a column of the children, nests each parent in several rows, so that one with very many children is no single array.
    """
    lists = children.groupBy(key, *([part] if part else [])).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
    return parents.join(lists, key, "left").withColumn(name, F.coalesce(F.col(name), F.array().cast(lists.schema[name].dataType)))


def histogram(df: DataFrame, price: str, edges: Sequence[float] = (10_000, 100_000, 1_000_000)) -> DataFrame:
    """One row of counts: below the first edge, between neighbours, and from the last on."""
    p, bounds = F.col(price), [None, *edges, None]
    counts = []
    for lo, hi in zip(bounds, bounds[1:], strict=False):
        inside = (p >= lo if lo is not None else F.lit(True)) & (p < hi if hi is not None else F.lit(True))
        counts.append(F.count_if(inside).alias(f"from_{int(lo or 0)}"))
    return df.agg(*counts)
