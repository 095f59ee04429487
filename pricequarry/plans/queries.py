"""Queries over the star-schema fixtures, each with the SQL that gives the same rows.

Suppliers are ``supplier``, products ``part``, prices ``lineitem`` (amount
l_extendedprice, quantity l_quantity, valid from l_shipdate), uploads ``orders`` and
``events``. Sums and means are rounded as decimals, by each engine's own function.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, prices, similarity, units
from ..functions.expressions import half_up, rounded, share
from ..operators import analytics, compare, history, mutations, quality, search, vectors
from ..sources import documents, grids
from .registry import QUERIES, SQL, query, table

def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best unit price of each supplier for each part, to the cent."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 0").select("l_partkey", "l_suppkey", half_up(F.col("l_extendedprice") / F.col("l_quantity"), 2).alias("price"))
    return analytics.best_offers(lines, "l_partkey", "l_suppkey", "price")


OFFERS = "o AS (SELECT l_partkey, l_suppkey, min(J2(l_extendedprice / l_quantity)) AS price FROM lineitem WHERE l_quantity > 0 GROUP BY l_partkey, l_suppkey)"


# ---------------------------------------------------------------- market


@query(
    f"""WITH {OFFERS},
m AS (SELECT *, count(*) OVER w AS n, avg(price) OVER w AS mean, min(price) OVER w AS lo, max(price) OVER w AS hi,
             row_number() OVER (PARTITION BY l_partkey ORDER BY price, l_suppkey) AS rank FROM o WINDOW w AS (PARTITION BY l_partkey))
SELECT l_partkey, l_suppkey, price, rank, CASE WHEN hi = lo THEN 100.0::DOUBLE ELSE J0((hi - price) * 100.0 / (hi - lo)) END AS market_share,
       R2(price - mean) AS difference, R2((price - mean) * 100.0 / mean) AS percent_diff FROM m WHERE n > 1"""
)
def supplier_price_ranking(spark, sf_dir):
    m = analytics.market_position(offers(spark, sf_dir), "l_partkey", "l_suppkey", "price")
    return m.withColumns({c: rounded(F.col(c), 2) for c in ("difference", "percent_diff")})


@query(
    f"""WITH {OFFERS}, m AS (SELECT *, count(*) OVER w AS n, avg(price) OVER w AS mean, row_number() OVER (PARTITION BY l_partkey ORDER BY price, l_suppkey) AS rank FROM o WINDOW w AS (PARTITION BY l_partkey)),
d AS (SELECT l_suppkey, (price - mean) * 100.0 / mean AS diff, rank FROM m WHERE n > 1)
SELECT l_suppkey, count(*) AS products, R2(avg(diff)) AS avg_diff, R2(avg(rank)) AS avg_rank, CASE WHEN avg(diff) < -5 THEN 'cheaper' WHEN avg(diff) > 5 THEN 'expensive' ELSE 'average' END AS position FROM d GROUP BY l_suppkey"""
)
def supplier_competitiveness(spark, sf_dir):
    m = analytics.market_position(offers(spark, sf_dir), "l_partkey", "l_suppkey", "price")
    return analytics.supplier_competitiveness(m, "l_suppkey").withColumns({c: rounded(F.col(c), 2) for c in ("avg_diff", "avg_rank")})


@query(
    """SELECT p_partkey, count(*) AS price_count, R2(avg(l_extendedprice)) AS avg_price, min(l_extendedprice) AS min_price, max(l_extendedprice) AS max_price, R2(max(l_extendedprice) - min(l_extendedprice)) AS spread
FROM part JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey"""
)
def product_price_stats(spark, sf_dir):
    # aggregated before the join, so that one row for each part meets the parts
    stats = analytics.price_stats(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_extendedprice").withColumnRenamed("l_partkey", "p_partkey")
    return stats.join(table(spark, sf_dir, "part").select("p_partkey"), "p_partkey", "left_semi").withColumns({c: rounded(F.col(c), 2) for c in ("avg_price", "spread")})


@query(
    f"""WITH {OFFERS}, b AS (SELECT l_partkey, min(price) AS best_price, max(price) AS highest_price, count(*) AS offers FROM o GROUP BY l_partkey),
s AS (SELECT o.l_partkey, min(o.l_suppkey) AS best_key FROM o JOIN b ON o.l_partkey = b.l_partkey AND o.price = b.best_price GROUP BY o.l_partkey)
SELECT p_partkey, p_name, s_name AS best_supplier, best_price, highest_price, offers, J1((highest_price - best_price) * 100.0 / highest_price) AS savings_percent
FROM b JOIN s ON b.l_partkey = s.l_partkey JOIN part ON p_partkey = b.l_partkey JOIN supplier ON s_suppkey = best_key"""
)
def best_supplier_savings(spark, sf_dir):
    s = analytics.savings(offers(spark, sf_dir), "l_partkey", "l_suppkey", "price")
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    out = s.join(part, s.l_partkey == part.p_partkey).join(supplier, s.best_supplier == supplier.s_suppkey)
    return out.select("p_partkey", "p_name", F.col("s_name").alias("best_supplier"), "best_price", "highest_price", "offers", "savings_percent")


@query(
    f"""WITH {OFFERS}, g AS (SELECT p_name, min(price) AS lo, max(price) AS hi, count(*) AS n FROM o JOIN part ON p_partkey = l_partkey GROUP BY p_name HAVING count(*) > 1)
SELECT count(*) AS groups, R2(avg((hi - lo) * 100.0 / hi)) AS avg_savings FROM g"""
)
def avg_savings_by_name(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    named = offers(spark, sf_dir).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return analytics.average_savings(named, "p_name", "price").withColumn("avg_savings", rounded(F.col("avg_savings"), 2))


@query(
    """WITH m AS (SELECT l_partkey, min(l_extendedprice) AS low, max(l_extendedprice) AS high, avg(l_extendedprice) AS mean FROM lineitem GROUP BY l_partkey),
i AS (SELECT DISTINCT l_orderkey, l_partkey, l_extendedprice * 1.3 AS p FROM lineitem)
SELECT l_orderkey, i.l_partkey, J2(p) AS scanned_price,
  CASE WHEN p < low * 0.7 THEN 'suspiciously_low' WHEN p > high * 1.15 THEN 'overpriced' WHEN p > mean * 1.05 THEN 'above_average' WHEN p < mean * 0.95 THEN 'below_average' ELSE 'normal' END AS status,
  CASE WHEN p < low * 0.7 THEN J1(-((low - p) * 100.0 / low)) WHEN p > high * 1.15 THEN J1((p - high) * 100.0 / high) WHEN p > mean * 1.05 THEN J1((p - mean) * 100.0 / mean) WHEN p < mean * 0.95 THEN J1(-((mean - p) * 100.0 / mean)) ELSE 0.0 END AS deviation
FROM i JOIN m ON i.l_partkey = m.l_partkey"""
)
def price_status(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    market = lines.groupBy("l_partkey").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.avg("l_extendedprice").alias("mean"))
    items = lines.select("l_orderkey", "l_partkey", (F.col("l_extendedprice") * 1.3).alias("p")).distinct()
    verdict = compare.price_status(F.col("p"), F.col("low"), F.col("high"), F.col("mean"))
    return items.join(market, "l_partkey").select("l_orderkey", "l_partkey", half_up(F.col("p"), 2).alias("scanned_price"), verdict.alias("v")).select("l_orderkey", "l_partkey", "scanned_price", "v.status", "v.deviation")


@query(
    """WITH m AS (SELECT l_partkey, min(l_extendedprice) AS low, max(l_extendedprice) AS high, avg(l_extendedprice) AS mean FROM lineitem GROUP BY l_partkey),
i AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * 1.3 AS p FROM lineitem)
SELECT l_orderkey, l_linenumber, i.l_partkey, J2(p) AS scanned_price,
  CASE WHEN p < low * 0.7 THEN 'suspiciously_low' WHEN p > high * 1.15 THEN 'overpriced' WHEN p > mean * 1.05 THEN 'above_average' WHEN p < mean * 0.95 THEN 'below_average' ELSE 'normal' END AS status,
  CASE WHEN p < low * 0.7 THEN J1(-((low - p) * 100.0 / low)) WHEN p > high * 1.15 THEN J1((p - high) * 100.0 / high) WHEN p > mean * 1.05 THEN J1((p - mean) * 100.0 / mean) WHEN p < mean * 0.95 THEN J1(-((mean - p) * 100.0 / mean)) ELSE 0.0 END AS deviation
FROM i JOIN m ON i.l_partkey = m.l_partkey"""
)
def price_status_all(spark, sf_dir):
    """Every line judged by its market, repeated ones too."""
    lines = table(spark, sf_dir, "lineitem")
    market = lines.groupBy("l_partkey").agg(F.min("l_extendedprice").alias("low"), F.max("l_extendedprice").alias("high"), F.avg("l_extendedprice").alias("mean"))
    items = lines.select("l_orderkey", "l_linenumber", "l_partkey", (F.col("l_extendedprice") * 1.3).alias("p"))
    verdict = compare.price_status(F.col("p"), F.col("low"), F.col("high"), F.col("mean"))
    return items.join(market, "l_partkey").select("l_orderkey", "l_linenumber", "l_partkey", half_up(F.col("p"), 2).alias("scanned_price"), verdict.alias("v")).select("l_orderkey", "l_linenumber", "l_partkey", "scanned_price", "v.status", "v.deviation")


@query(
    f"""WITH {OFFERS}, i AS (SELECT l_partkey AS item, max(price) AS asked FROM o GROUP BY l_partkey),
d AS (SELECT item, l_suppkey, price, (asked - price) * 100.0 / asked AS saving FROM i JOIN o ON item = l_partkey),
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY price, l_suppkey) AS rank FROM d WHERE saving >= 5)
SELECT item, l_suppkey, price, J1(saving) AS saving_percent, rank FROM r WHERE rank <= 3"""
)
def better_deals(spark, sf_dir):
    part = Window.partitionBy("l_partkey")
    o = offers(spark, sf_dir).withColumns({"asked": F.max("price").over(part), "rank": F.row_number().over(part.orderBy("price", "l_suppkey")).cast("long")})
    # who saves enough stands before who does not, so ranks among all are ranks among those
    return o.withColumn("saving", share(F.col("asked") - F.col("price"), F.col("asked"))).where("saving >= 5 AND rank <= 3").select(F.col("l_partkey").alias("item"), "l_suppkey", "price", half_up(F.col("saving"), 1).alias("saving_percent"), "rank")


@query(
    f"""WITH {OFFERS}, b AS (SELECT l_partkey, min(price) AS best FROM o GROUP BY l_partkey),
l AS (SELECT l_orderkey, l_extendedprice / l_quantity AS price, l_quantity AS q, best FROM lineitem JOIN b USING (l_partkey) WHERE l_quantity > 0)
SELECT l_orderkey, R2(sum(price * q)) AS total, R2(sum(greatest(0.0, price - best) * q)) AS savings, R1(sum(greatest(0.0, price - best) * q) * 100.0 / sum(price * q)) AS savings_percent FROM l GROUP BY l_orderkey"""
)
def invoice_totals(spark, sf_dir):
    best = offers(spark, sf_dir).groupBy("l_partkey").agg(F.min("price").alias("best"))
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 0").join(best, "l_partkey").withColumn("price", F.col("l_extendedprice") / F.col("l_quantity"))
    t = compare.invoice_totals(lines, "l_orderkey", "price", "l_quantity", "best")
    return t.select("l_orderkey", rounded(F.col("total"), 2).alias("total"), rounded(F.col("savings"), 2).alias("savings"), rounded(F.col("savings_percent"), 1).alias("savings_percent"))


# ---------------------------------------------------------------- prices over time

CHANGES = """c AS (SELECT l_partkey, l_suppkey, l_shipdate, l_extendedprice AS price, l_orderkey, l_linenumber,
  lag(l_extendedprice) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS changed_from FROM lineitem),
h AS (SELECT *, CASE WHEN changed_from IS NOT NULL AND changed_from <> 0 AND changed_from <> price THEN (price - changed_from) * 100.0 / changed_from END AS pct FROM c)"""


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price"))
    return history.change_log(lines, ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "price"], "price")


@query(f"WITH {CHANGES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, price, changed_from, J2(pct) AS change_percentage FROM h")
def price_change_log(spark, sf_dir):
    return changes(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price", "changed_from", half_up(F.col("change_percentage"), 2).alias("change_percentage"))


@query(f"WITH {CHANGES} SELECT l_suppkey, count(*) AS total_changes, count(*) FILTER (pct > 0) AS increases, count(*) FILTER (pct < 0) AS decreases, R2(avg(pct)) AS avg_change FROM h WHERE pct IS NOT NULL GROUP BY l_suppkey")
def supplier_change_report(spark, sf_dir):
    return analytics.change_report(changes(spark, sf_dir), ["l_suppkey"]).withColumn("avg_change", rounded(F.col("avg_change"), 2))


@query(f"WITH {CHANGES} SELECT l_partkey, R2(coalesce(sqrt(avg(nullif(pct, 0) * nullif(pct, 0))), 0.0)) AS volatility, count(*) AS changes FROM h WHERE pct IS NOT NULL GROUP BY l_partkey")
def product_volatility(spark, sf_dir):
    return analytics.volatility(changes(spark, sf_dir), ["l_partkey"]).withColumn("volatility", rounded(F.col("volatility"), 2))


@query(
    f"""WITH {CHANGES}, v AS (SELECT l_partkey, coalesce(sqrt(avg(nullif(pct, 0) * nullif(pct, 0))), 0.0) AS v, count(*) AS changes FROM h WHERE pct IS NOT NULL GROUP BY l_partkey)
SELECT l_partkey, R2(v) AS volatility, changes FROM v ORDER BY v DESC, l_partkey LIMIT 10"""
)
def volatile_products(spark, sf_dir):
    top = analytics.volatility(changes(spark, sf_dir), ["l_partkey"]).orderBy(F.col("volatility").desc(), "l_partkey").limit(10)
    return top.withColumn("volatility", rounded(F.col("volatility"), 2))


@query(
    """WITH g AS (SELECT l_suppkey, avg(l_extendedprice) AS a, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi, stddev_pop(l_extendedprice) AS v, count(*) AS points,
  arg_min(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS f, arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_extendedprice)) AS l FROM lineitem GROUP BY l_suppkey),
t AS (SELECT *, (l - f) * 100.0 / f AS change FROM g)
SELECT l_suppkey, R2(a) AS avg_price, lo AS min_price, hi AS max_price, R2(v) AS volatility, f AS first_price, l AS last_price, points, R2(change) AS overall_change,
  CASE WHEN abs(change) < 5 THEN 'stable' WHEN change > 0 THEN 'increasing' ELSE 'decreasing' END AS trend FROM t"""
)
def price_trend_summary(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("tie", F.struct("l_orderkey", "l_linenumber", "l_extendedprice"))
    t = analytics.trend_summary(lines, ["l_suppkey"], "l_shipdate", "l_extendedprice", "tie")
    return t.withColumns({c: rounded(F.col(c), 2) for c in ("avg_price", "volatility", "overall_change")})


@query("SELECT strftime(ts, '%Y-%m-%d') AS day, J2(avg(value)) AS avg_price, min(value) AS min_price, max(value) AS max_price, R2(max(value) - min(value)) AS spread, count(value) AS price_count FROM events GROUP BY 1")
def daily_average(spark, sf_dir):
    d = analytics.daily_average(table(spark, sf_dir, "events"), "ts", "value")
    return d.withColumns({"day": F.date_format("day", "yyyy-MM-dd"), "spread": rounded(F.col("spread"), 2)})


INTERVALS = """v AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice, l_shipdate AS valid_from,
  lead(l_shipdate) OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS valid_to FROM lineitem)"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", F.col("l_shipdate").alias("valid_from"))
    return history.intervals(lines, ["l_partkey", "l_suppkey"], "valid_from", ["l_orderkey", "l_linenumber", "l_extendedprice"])


@query(f"WITH {INTERVALS} SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice, strftime(valid_from, '%Y-%m-%d') AS valid_from, strftime(valid_to, '%Y-%m-%d') AS valid_to FROM v")
def scd2_intervals(spark, sf_dir):
    return versions(spark, sf_dir).withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("valid_from", "valid_to")})


@query(f"WITH {INTERVALS} SELECT l_partkey, l_suppkey, l_extendedprice AS amount, strftime(valid_from, '%Y-%m-%d') AS valid_from FROM v WHERE valid_to IS NULL")
def active_prices(spark, sf_dir):
    return history.active(versions(spark, sf_dir)).select("l_partkey", "l_suppkey", F.col("l_extendedprice").alias("amount"), F.date_format("valid_from", "yyyy-MM-dd").alias("valid_from"))


@query(f"WITH {INTERVALS}, t AS (SELECT max(l_shipdate) - INTERVAL 365 DAY AS moment FROM lineitem) SELECT l_partkey, l_suppkey, l_extendedprice AS amount FROM v, t WHERE valid_from <= moment AND (valid_to IS NULL OR valid_to > moment)")
def prices_as_of(spark, sf_dir):
    at = table(spark, sf_dir, "lineitem").agg((F.max("l_shipdate") - F.expr("INTERVAL 365 DAYS")).alias("at"))
    return history.as_of(versions(spark, sf_dir).crossJoin(F.broadcast(at)), F.col("at")).select("l_partkey", "l_suppkey", F.col("l_extendedprice").alias("amount"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC) AS rn FROM lineitem)
SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM r WHERE rn = 1"""
)
def keep_latest(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice")
    return history.latest(lines, ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_extendedprice"]).drop("l_shipdate")


@query("SELECT count(*) AS prices, count(*) FILTER (l_shipdate >= t.moment - INTERVAL 30 DAY) AS fresh, count(*) FILTER (l_shipdate < t.moment - INTERVAL 30 DAY) AS stale FROM lineitem, (SELECT max(l_shipdate) AS moment FROM lineitem) t")
def freshness(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem")
    at = lines.agg(F.max("l_shipdate").alias("at"))
    fresh = compare.is_fresh(F.col("l_shipdate"), F.col("at"))
    return lines.crossJoin(F.broadcast(at)).agg(F.count(F.lit(1)).alias("prices"), F.count_if(fresh).alias("fresh"), F.count_if(~fresh).alias("stale"))


# ---------------------------------------------------------------- duplicates, orphans, joins


@query("SELECT p_name, p_brand, count(*) AS n FROM part GROUP BY p_name, p_brand HAVING count(*) > 1")
def duplicate_products(spark, sf_dir):
    return quality.duplicates(table(spark, sf_dir, "part"), ["p_name", "p_brand"])


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey HAVING count(*) > 1")
def duplicate_prices(spark, sf_dir):
    return quality.duplicates(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_suppkey"])


@query("SELECT p_partkey, p_name FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity >= 45)")
def orphan_parts(spark, sf_dir):
    sold = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' AND l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return quality.orphans(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", sold)


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_orderstatus = 'P')")
def customers_without_orders(spark, sf_dir):
    """Customers without an urgent order that is pending."""
    made = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return quality.orphans(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey", made)


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem GROUP BY l_partkey HAVING count(DISTINCT l_suppkey) > 28)")
def semi_multi_supplier(spark, sf_dir):
    many = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.countDistinct("l_suppkey").alias("n")).where("n > 28")
    return table(spark, sf_dir, "part").join(many, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey", "p_name")


@query("SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def left_join_counts(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return analytics.relation_counts(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", orders=o)


@query(
    """SELECT a.p_partkey, count(*) AS related, R2(min(b.p_retailprice)) AS best FROM part a JOIN part b ON a.p_name = b.p_name AND a.p_brand IS NOT DISTINCT FROM b.p_brand GROUP BY a.p_partkey"""
)
def related_products(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    b = p.groupBy("p_name", "p_brand").agg(F.count(F.lit(1)).alias("related"), rounded(F.min("p_retailprice"), 2).alias("best"))
    a = p.select("p_partkey", F.col("p_name").alias("n"), F.col("p_brand").alias("b"))
    return a.join(b, (F.col("n") == F.col("p_name")) & F.col("b").eqNullSafe(F.col("p_brand"))).select("p_partkey", "related", "best")


@query(
    """WITH l AS (SELECT l_suppkey, l_partkey // 100 AS part, array_to_string(list_sort(list(format('{:012.2f}:{}', l_extendedprice, l_orderkey))), ',') AS prices FROM lineitem GROUP BY 1, 2)
SELECT s_suppkey, part, coalesce(prices, '') AS prices FROM supplier LEFT JOIN l ON l_suppkey = s_suppkey"""
)
def nested_prices(spark, sf_dir):
    """Every supplier with all its prices, nested in parts of 100 products."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.expr("l_partkey div 100").alias("part"), F.format_string("%012.2f:%d", "l_extendedprice", "l_orderkey").alias("p"))
    n = analytics.nested(table(spark, sf_dir, "supplier").select("s_suppkey"), lines, "s_suppkey", ["p"], "list", "part")
    return n.select("s_suppkey", "part", F.array_join(F.transform("list", lambda x: x["p"]), ",").alias("prices"))


@query(
    """WITH l AS (SELECT l_suppkey, l_orderkey // 1000 AS part, array_to_string(list_sort(list(format('{:012.2f}:{}', l_extendedprice, l_orderkey))), ',') AS prices FROM lineitem GROUP BY 1, 2)
SELECT s_suppkey, coalesce(part, 0) AS part, coalesce(prices, '') AS prices FROM supplier LEFT JOIN l ON l_suppkey = s_suppkey"""
)
def nested_prices_all(spark, sf_dir):
    """Every price of every supplier, nested in parts of 1000 order keys, so that no supplier is one array."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("s_suppkey"), F.expr("l_orderkey div 1000").alias("part"), F.format_string("%012.2f:%d", "l_extendedprice", "l_orderkey").alias("p"))
    parts = lines.groupBy("s_suppkey", "part").agg(F.array_join(F.array_sort(F.collect_list("p")), ",").alias("prices"))
    return table(spark, sf_dir, "supplier").select("s_suppkey").join(parts, "s_suppkey", "left").select("s_suppkey", F.coalesce("part", F.lit(0)).alias("part"), F.coalesce("prices", F.lit("")).alias("prices"))


@query(
    """SELECT s_suppkey, s_name, n_name, r_name, R2(sum(l_extendedprice)) AS amount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL"""
)
def supplier_turnover(spark, sf_dir):
    # the sum comes before the joins, so one row for each supplier meets the dimensions
    sums = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(rounded(F.sum("l_extendedprice"), 2).alias("amount"))
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    return sums.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "s_name", "n_name", "r_name", "amount")


# ---------------------------------------------------------------- search and similarity


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_type), 'red') ORDER BY p_name, p_partkey LIMIT 20")
def product_search(spark, sf_dir):
    return table(spark, sf_dir, "part").where(search.contains_text(["p_name", "p_type"], "RED")).orderBy("p_name", "p_partkey").limit(20).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'small') AND contains(lower(p_name), 'ring')")
def search_all_words(spark, sf_dir):
    words = names.tokens(F.lit("Small  RING!"))
    return table(spark, sf_dir, "part").where(F.forall(words, lambda w: F.contains(F.lower("p_name"), w))).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 50 OFFSET 50")
def paged_products(spark, sf_dir):
    rows, _, _ = search.page(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice"), [F.col("p_retailprice").desc(), F.col("p_partkey")], 2, 50)
    return rows


@query("SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 10 AND 20 AND p_brand = (SELECT min(p_brand) FROM part)")
def filtered_products(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    first = p.agg(F.min("p_brand").alias("b"))
    return p.join(F.broadcast(first), p.p_brand == first.b).where(F.col("p_size").between(10, 20)).select("p_partkey", "p_name")


TRIGRAMS = """g AS (SELECT s_suppkey AS k, list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower(s_name), '[^\\p{L}\\p{N}]+', ' ', 'g'), ' '), lambda w: w <> ''),
  lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))) AS t FROM supplier)"""


@query(
    f"""WITH {TRIGRAMS}, q AS (SELECT k, t FROM g WHERE k % 20 = 0)
SELECT q.k AS asked, g.k AS found, J4(len(list_intersect(q.t, g.t))::DOUBLE / (len(q.t) + len(g.t) - len(list_intersect(q.t, g.t)))) AS similarity FROM q, g
WHERE len(list_intersect(q.t, g.t))::DOUBLE / (len(q.t) + len(g.t) - len(list_intersect(q.t, g.t))) > 0.3"""
)
def trigram_suppliers(spark, sf_dir):
    """A stated set of questions (keys divisible by 20) against all suppliers."""
    s = table(spark, sf_dir, "supplier")
    asked = s.where("s_suppkey % 20 = 0").select(F.col("s_suppkey").alias("asked"), F.col("s_name").alias("q"))
    m = search.trigram_matches(asked, s.withColumnRenamed("s_suppkey", "found"), "asked", "q", "found", "s_name")
    return m.withColumn("similarity", half_up(F.col("similarity"), 4))


@query("WITH q AS (SELECT DISTINCT lower(p_name) AS n FROM part WHERE p_partkey % 20 = 0), n AS (SELECT DISTINCT lower(p_name) AS n FROM part) SELECT a.n AS a, b.n AS b, levenshtein(a.n, b.n)::BIGINT AS distance, J4(1 - levenshtein(a.n, b.n) / greatest(length(a.n), length(b.n))) AS similarity FROM q a JOIN n b ON a.n <> b.n")
def edit_distance(spark, sf_dir):
    """A stated set of questions (names of parts whose key is divisible by 20) against all names, whatever letter they begin with."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("n"))
    asked = p.where("p_partkey % 20 = 0").select(F.col("n").alias("a")).distinct()
    return search.against(p.select(F.col("n").alias("b")).distinct(), asked, "a").where("a <> b").select("a", "b", F.levenshtein("a", "b").cast("long").alias("distance"), half_up(similarity.edit_similarity(F.col("a"), F.col("b")), 4).alias("similarity"))


@query(
    """WITH n AS (SELECT DISTINCT p_name AS n, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part), q AS (SELECT DISTINCT p_name AS n, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part WHERE p_partkey % 20 = 0)
SELECT a.n AS a, b.n AS b, J4(len(list_intersect(a.w, b.w))::DOUBLE / len(list_distinct(list_concat(a.w, b.w)))) AS jaccard FROM q a JOIN n b ON a.n <> b.n WHERE len(list_intersect(a.w, b.w)) > 0"""
)
def token_jaccard(spark, sf_dir):
    """A stated set of questions (names of parts whose key is divisible by 20) against all names; no pair is made by a frequent word."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    asked = p.where("p_partkey % 20 = 0").select(F.col("p_name").alias("a")).distinct()
    pairs = search.against(p.select(F.col("p_name").alias("b")).distinct(), asked, "a").where("a <> b")
    return pairs.withColumn("jaccard", half_up(similarity.token_jaccard(F.col("a"), F.col("b")), 4)).where("jaccard > 0")


@query()
def soundex_names(spark, sf_dir):
    """Distinct part names that sound like a fixed one."""
    return table(spark, sf_dir, "part").where(search.sounds_like("p_name", F.lit("smal ring"))).select("p_name").distinct()


QUESTIONS = ["small ring", "ring", "red widget", "large fresh bolt", "sweet gear", "gear small", "wigdet"]


@query()
def similar_products(spark, sf_dir):
    """Fixed questions against all distinct names by the domain's similarity; tests hold it against worked examples."""
    n = table(spark, sf_dir, "part").select("p_name").distinct()
    asked = spark.createDataFrame([(q,) for q in QUESTIONS], "q string")
    score = similarity.parts_similarity(F.col("qp"), F.col("np"))
    asked, n = asked.withColumn("qp", similarity.name_parts(F.col("q"))), n.withColumn("np", similarity.name_parts(F.col("p_name")))
    return search.against(n, asked, "q").select("q", "p_name", rounded(score, 2).alias("score")).where("score > 0")


@query(
    """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 20 = 0),
c AS (SELECT q.vec_id AS asked, e.vec_id AS found, list_cosine_similarity(q.v, e.v) AS s FROM q JOIN e ON q.label = e.label AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY s DESC, found) AS rn FROM c)
SELECT asked, found, R4(s) AS similarity FROM r WHERE rn = 1 AND s >= 0.2"""
)
def nearest_vectors(spark, sf_dir):
    """A stated set of questions (ids divisible by 20) against all vectors of their label, in blocks; the nearest from a cosine of 0.2 on."""
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "asked")
    near = search.nearest_vector(asked, e.withColumnRenamed("vec_id", "found"), "asked", "found", "embedding", "label", lambda _: F.lit(0.2), others_only=True)
    return near.withColumn("similarity", rounded(F.col("similarity"), 4))


@query(
    """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v, CASE label % 6 WHEN 0 THEN 'Vegetables' WHEN 1 THEN 'Meat' WHEN 2 THEN 'Seafood' WHEN 3 THEN 'Dairy' WHEN 4 THEN 'Grains' ELSE 'Other' END AS c FROM embeddings WHERE label IS NOT NULL),
q AS (SELECT vec_id AS asked, c, list_transform(v, lambda x, i: CASE WHEN i <= vec_id // 20 % 26 THEN 0.0 ELSE x END) AS w FROM e WHERE vec_id % 20 = 0),
s AS (SELECT asked, vec_id AS found, c, list_cosine_similarity(w, v) AS s FROM q JOIN e USING (c)),
r AS (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY s DESC, found) AS rn FROM s)
SELECT asked, found, c AS category, R4(s) AS similarity FROM r WHERE rn = 1 AND s >= CASE c WHEN 'Vegetables' THEN 0.85 WHEN 'Meat' THEN 0.82 WHEN 'Seafood' THEN 0.82 WHEN 'Dairy' THEN 0.83 ELSE 0.8 END"""
)
def matched_vectors(spark, sf_dir):
    """Every twentieth vector with up to 25 of its numbers missing, matched by the index of angles under the limit of its category."""
    category = F.element_at(F.array(*map(F.lit, ("Vegetables", "Meat", "Seafood", "Dairy", "Grains", "Other"))), F.col("label") % 6 + 1)
    e = table(spark, sf_dir, "embeddings").where("label IS NOT NULL").select("vec_id", "embedding", category.alias("category"))
    missing = F.floor(F.col("vec_id") / 20) % 26
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("asked"), "category", F.transform("embedding", lambda x, i: F.when(i < missing, 0.0).otherwise(x)).alias("embedding"))
    index = vectors.angular_index(e, "vec_id", "embedding", "category")
    if index is None:
        return spark.createDataFrame([], "asked long, found long, category string, similarity double")
    near = vectors.nearest_by_angle(asked, index, "asked", "found", "embedding", "category")
    return near.join(asked.select("asked", "category"), "asked").select("asked", "found", "category", rounded(F.col("similarity"), 4).alias("similarity"))


# ---------------------------------------------------------------- quality and reports


@query(
    """SELECT count(*) FILTER (l_extendedprice < 10000) AS from_0, count(*) FILTER (l_extendedprice >= 10000 AND l_extendedprice < 100000) AS from_10000,
count(*) FILTER (l_extendedprice >= 100000 AND l_extendedprice < 1000000) AS from_100000, count(*) FILTER (l_extendedprice >= 1000000) AS from_1000000 FROM lineitem"""
)
def price_histogram(spark, sf_dir):
    return analytics.histogram(table(spark, sf_dir, "lineitem"), "l_extendedprice")


ISSUES = """x AS (SELECT l_orderkey, l_linenumber, nullif(l_extendedprice, 0) AS p, CASE l_linenumber % 5 WHEN 0 THEN 'K' WHEN 1 THEN 'Kg.' WHEN 2 THEN 'furlong' WHEN 3 THEN '330ml' ELSE 'karton' END AS u, CASE WHEN l_linenumber % 5 = 2 AND l_tax = 0 THEN 'box' END AS std, CASE WHEN l_discount = 0 THEN 0 ELSE l_quantity END AS q FROM lineitem),
i AS (SELECT l_orderkey, l_linenumber, 'null_price' AS issue, 'critical' AS severity FROM x WHERE p IS NULL UNION ALL SELECT l_orderkey, l_linenumber, 'out_of_range_price', 'warning' FROM x WHERE p < 100 OR p > 10000000
UNION ALL SELECT l_orderkey, l_linenumber, 'invalid_unit', 'warning' FROM x WHERE u = 'furlong' AND std IS NULL UNION ALL SELECT l_orderkey, l_linenumber, 'zero_quantity', 'critical' FROM x WHERE q = 0)"""


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    unit = F.element_at(F.array(*map(F.lit, ("K", "Kg.", "furlong", "330ml", "karton"))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    standard = F.when((F.col("l_linenumber") % 5 == 2) & (F.col("l_tax") == 0), "box")
    return table(spark, sf_dir, "lineitem").select(F.struct("l_orderkey", "l_linenumber").alias("key"), F.nullif("l_extendedprice", F.lit(0.0)).alias("p"), unit.alias("u"), standard.alias("std"), F.when(F.col("l_discount") == 0, 0.0).otherwise(F.col("l_quantity")).alias("q"))


@query(f"WITH {ISSUES} SELECT * FROM i")
def quality_issues(spark, sf_dir):
    return quality.issues(checked(spark, sf_dir), "key", "p", "u", "std", "q").select("key.*", "issue", "severity")


@query(
    f"""WITH {ISSUES}, c AS (SELECT count(*) FILTER (issue = 'null_price') AS null_price, count(*) FILTER (issue = 'invalid_unit') AS invalid_unit, count(*) FILTER (issue = 'out_of_range_price') AS out_of_range_price, count(*) FILTER (issue = 'zero_quantity') AS zero_quantity, count(*) FILTER (severity = 'critical') AS critical FROM i)
SELECT (SELECT count(*) FROM x) AS total, c.*, critical > 0 OR null_price + invalid_unit > 0.1 * (SELECT count(*) FROM x) AS needs_review FROM c"""
)
def quality_report(spark, sf_dir):
    rows = checked(spark, sf_dir)
    return quality.quality_report(rows, quality.issues(rows, "key", "p", "u", "std", "q"))


@query(
    """WITH l AS (SELECT l_extendedprice AS p, l_linenumber % 4 AS k, l_extendedprice - floor(l_extendedprice) AS rest FROM lineitem),
b AS (SELECT *, CASE k WHEN 0 THEN 50000 WHEN 1 THEN 5000 WHEN 2 THEN 2000 END AS lo, CASE k WHEN 0 THEN 5000000 WHEN 1 THEN 200000 WHEN 2 THEN 1000000 END AS hi,
  (p < 1000 AND abs(p * 100 - round(p * 100)) < 1e-6 AND abs(p * 10 - round(p * 10)) >= 1e-6) OR (rest > 0.09 AND abs(p - round(p)) >= 1e-6) AS misread FROM l),
v AS (SELECT p, p >= 500 AND p <= 50000000 AS fine, coalesce(p < lo, false) AS below, coalesce(p > hi, false) AS above, k = 3 AND p < 1000 AS low, k = 3 AND p > 10000000 AS high, misread FROM b)
SELECT count(*) AS products, count(*) FILTER (fine) AS valid, count(*) FILTER (fine AND (below OR above OR low OR high OR misread)) AS with_warnings,
R4(avg(CASE WHEN fine THEN (CASE WHEN below OR above THEN 0.7 ELSE 1 END) * (CASE WHEN low OR high THEN 0.8 ELSE 1 END) * (CASE WHEN misread THEN 0.6 ELSE 1 END) ELSE 0 END)) AS avg_confidence, count(*) FILTER (NOT fine) AS with_errors, count(*) FILTER (p < 1e4) AS below_10k, count(*) FILTER (p >= 1e4 AND p < 1e5) AS from_10k, count(*) FILTER (p >= 1e5 AND p < 1e6) AS from_100k, count(*) FILTER (p >= 1e6) AS from_1m FROM v"""
)
def price_validation(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("Cheddar cheese", "Fresh tomato", "Beef steak", "thing"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("p"), name.alias("name")).withColumn("category", names.bound_category(F.col("name")))
    lines = lines.select("p", quality.price_verdict(F.col("category"), F.col("p"), texts=False).alias("v"))
    return quality.validation_summary(lines, "v", "p").withColumn("avg_confidence", rounded(F.col("avg_confidence"), 4))


@query("SELECT o_orderstatus, count(*) AS n, R2(avg(o_totalprice)) AS mean FROM orders GROUP BY o_orderstatus")
def status_counts(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("o_totalprice"), 2).alias("mean"))


@query(
    """WITH u AS (SELECT CASE WHEN event_type = 'purchase' THEN 'completed' ELSE 'failed' END AS s, CASE WHEN value > 50 THEN value / 100 END AS c, value / 1000 AS cost, user_id::INTEGER AS t, CASE WHEN value > 10 THEN floor(value)::INTEGER END AS ms FROM events)
SELECT count(*) AS uploads, R2(count(*) FILTER (s = 'completed') * 100.0 / count(*)) AS success_rate, R4(avg(coalesce(c, 0.0))) AS avg_completeness, R2(sum(cost)) AS total_cost, sum(t)::BIGINT AS total_tokens, R2(avg(coalesce(ms, 0))) AS avg_time_ms FROM u"""
)
def upload_metrics(spark, sf_dir):
    u = table(spark, sf_dir, "events").select(
        F.when(F.col("event_type") == "purchase", "completed").otherwise("failed").alias("status"),
        F.when(F.col("value") > 50, F.col("value") / 100).alias("completeness_ratio"),
        (F.col("value") / 1000).alias("processing_cost_usd"),
        F.col("user_id").cast("int").alias("tokens_used"),
        F.when(F.col("value") > 10, F.floor("value").cast("int")).alias("processing_time_ms"),
    )
    m = analytics.upload_metrics(u)
    return m.select("uploads", rounded(F.col("success_rate"), 2).alias("success_rate"), rounded(F.col("avg_completeness"), 4).alias("avg_completeness"), rounded(F.col("total_cost"), 2).alias("total_cost"), "total_tokens", rounded(F.col("avg_time_ms"), 2).alias("avg_time_ms"))


@query("SELECT strftime(ts, '%Y-%m') AS month, event_type, R2(sum(value)) AS cost, count(*) AS calls FROM events GROUP BY 1, 2")
def monthly_cost(spark, sf_dir):
    return analytics.monthly_cost(table(spark, sf_dir, "events"), "ts", "event_type", "value").withColumn("cost", rounded(F.col("cost"), 2))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n, R2(avg(o_totalprice)) AS mean, R2(avg(o_custkey)) AS mean_customer, R2(avg(nullif(o_orderkey % 10, 0))) AS mean_digit FROM orders GROUP BY 1, 2")
def two_key_averages(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("digit", F.nullif(F.col("o_orderkey") % 10, F.lit(0)))
    by, _ = analytics.classification_stats(o, "o_orderpriority", "o_orderstatus", ["o_totalprice", "o_custkey", "digit"])
    return by.select("o_orderpriority", "o_orderstatus", "n", *[rounded(F.col(f"avg_{a}"), 2).alias(b) for a, b in (("o_totalprice", "mean"), ("o_custkey", "mean_customer"), ("digit", "mean_digit"))])


@query(
    """WITH s AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n, avg(o_totalprice) AS mean FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, sum(n)::BIGINT AS total, count(*) AS statuses, R2(arg_max(mean, o_orderstatus)) AS last_mean FROM s GROUP BY 1"""
)
def kinds_of_uploads(spark, sf_dir):
    _, kinds = analytics.classification_stats(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", ["o_totalprice"])
    return kinds.select("o_orderpriority", "total", "statuses", rounded(F.col("avg_o_totalprice"), 2).alias("last_mean"))


@query("SELECT count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(*) AS rows FROM lineitem")
def distinct_counts(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.countDistinct("l_partkey").alias("parts"), F.countDistinct("l_suppkey").alias("suppliers"), F.count(F.lit(1)).alias("rows"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


# ---------------------------------------------------------------- names, units, text


@query(
    """SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM (SELECT doc_id, text FROM documents)"""
)
def name_clean(spark, sf_dir):
    """Whole texts as names for matching."""
    return table(spark, sf_dir, "documents").select("doc_id", names.matching_name(F.col("text")).alias("name"))


@query(
    """SELECT doc_id, substr(regexp_replace(regexp_replace(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '[^a-z0-9_\\s]', ' ', 'g'), '\\s+', ' ', 'g'), 1, 200) AS name FROM (SELECT doc_id, text FROM documents)"""
)
def embedding_names(spark, sf_dir):
    """The text that an embedding of a name is made of: the whole text is cleaned, and 200 characters are taken last."""
    return table(spark, sf_dir, "documents").select("doc_id", similarity.embedding_text(F.col("text")).alias("name"))


@query(
    """SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') OR contains(lower(p_name), 'gear') THEN 'Metal' WHEN contains(lower(p_name), 'small') THEN 'Small' ELSE 'Other' END AS category FROM part"""
)
def categories(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", names.categorize(F.col("p_name"), {"Metal": ["ring", "gear"], "Small": ["small"]}).alias("category"))


@query("SELECT c, count(*) AS n FROM (SELECT CASE l_linenumber % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'ltr' WHEN 2 THEN 'pcs' END AS c FROM lineitem) GROUP BY c")
def canonical_units(spark, sf_dir):
    u = F.element_at(F.array(F.lit("Kilo "), F.lit("m.l."), F.lit("dozen"), F.lit("?")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").groupBy(units.canonical_unit(u).alias("c")).agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT l_orderkey, l_linenumber, l_extendedprice, J2(CASE l_linenumber % 4 WHEN 0 THEN l_extendedprice / l_quantity WHEN 1 THEN l_extendedprice / (l_quantity * 0.001) WHEN 2 THEN l_extendedprice / (l_quantity * 12) END) AS unit_price FROM lineitem"""
)
def unit_prices(spark, sf_dir):
    u = F.element_at(F.array(F.lit("kg"), F.lit("ML"), F.lit("dozen"), F.lit("?")), (F.col("l_linenumber") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", half_up(units.unit_price(F.col("l_extendedprice"), F.col("l_quantity"), u), 2).alias("unit_price"))


@query(
    """SELECT l_orderkey, l_linenumber, l_extendedprice, CASE WHEN floor(l_extendedprice) * 1000 BETWEEN 100 AND 10000000 THEN floor(l_extendedprice) * 1000 END AS parsed FROM lineitem"""
)
def parsed_prices(spark, sf_dir):
    text = F.concat(F.lit("Rp. "), F.floor("l_extendedprice").cast("string"), F.lit(" rb"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", prices.normalize_price(text).alias("parsed"))


@query("SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'excel' WHEN 1 THEN 'pdf' WHEN 2 THEN 'image' ELSE 'unknown' END AS kind FROM pages")
def page_kinds(spark, sf_dir):
    """What a page's files would be routed to, by endings of all kinds."""
    ending = F.element_at(F.array(*map(F.lit, (".XLSX", ".pdf", ".Jpg", ".exe"))), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", documents.route(F.concat("url", ending)).alias("kind"))


# ---------------------------------------------------------------- changes, feeds


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'changed' ELSE p_name END AS p_name, p_brand FROM part WHERE p_partkey % 7 <> 0")
def bulk_changes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    kept = mutations.deleted(p, p.where("p_partkey % 7 = 0"), "p_partkey")
    after, _ = mutations.updated(kept, p.where("p_partkey % 10 = 0").select("p_partkey", F.lit("changed").alias("p_name")), "p_partkey")
    return after


@query("SELECT l_orderkey, l_linenumber, l_extendedprice, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_extendedprice, l_partkey, l_suppkey) - 1) // 3 AS chunk FROM lineitem")
def chunks(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").withColumn("at", F.struct("l_linenumber", "l_extendedprice", "l_partkey", "l_suppkey"))
    return grids.chunked(lines, ["l_orderkey"], "at", 3).select("l_orderkey", "l_linenumber", "l_extendedprice", "chunk")


@query(
    """SELECT user_id, event_id, carried FROM (SELECT user_id, event_id, event_type, max(CASE WHEN event_type = 'click' THEN event_id END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS carried FROM events) WHERE event_type <> 'click'"""
)
def filled_forward(spark, sf_dir):
    """The heading above a row, as category rows of a price list are carried down."""
    click = F.col("event_type") == "click"
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.when(click, F.col("event_id").cast("string")).alias("name"), F.when(~click, F.col("value")).alias("price"))
    return grids.with_headings(rows, ["user_id"], "event_id", "name", "price", "carried").select("user_id", "event_id", F.col("carried").cast("long").alias("carried"))


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, R2(avg(value)) AS mean FROM events GROUP BY 1, 2")
def hourly_events(spark, sf_dir):
    """What :func:`pricequarry.streaming.uploads.tumbling` gives for a whole table at once."""
    from ..streaming.uploads import tumbling

    t = tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", "10 minutes", "event_type", "value")
    return t.select(F.date_format("start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", rounded(F.col("mean"), 2).alias("mean"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_price_ranking(spark, sf_dir)

