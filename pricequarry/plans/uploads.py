"""Queries of what happens to an upload: units and names as its store keeps them, products found or made with their prices, the data report and the export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, prices, units
from ..functions.expressions import rounded
from ..operators import catalogue, history, ingest, quality
from .domain import chosen, day, pick, shown
from .registry import query, table

#: The units given, and as the store keeps them.
GIVEN = ("Kilograms", " BOXES", "pounds", "btl", "Litre")
KEPT = ("kg", "box", "lb", "bottle", "l")

# ---------------------------------------------------------------- the store with its products

UPLOAD = f"""g AS (SELECT p_partkey, p_name, p_size, lower(p_name) AS n, {chosen("p_size", *KEPT)} AS su, {chosen("p_size", *GIVEN)} AS unit FROM part),
e AS (SELECT min(p_partkey)::VARCHAR AS id, n, su FROM g WHERE p_partkey % 3 <> 0 GROUP BY n, su),
h AS (SELECT e.id AS product_id, l_suppkey::VARCHAR AS supplier_id, l_extendedprice AS amount, g.unit, l_shipdate AS valid_from, lead(l_shipdate) OVER (PARTITION BY e.id, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_extendedprice) AS valid_to, e.n, e.su FROM lineitem JOIN g ON l_partkey = p_partkey JOIN e ON e.n = g.n AND e.su = g.su WHERE l_linestatus = 'F'),
x AS (SELECT CASE WHEN l_suppkey % 50 <> 7 THEN l_suppkey::VARCHAR END AS supplier_id, l_orderkey * 8 + l_linenumber AS position, CASE WHEN l_quantity = 1 THEN ' ' ELSE upper(p_name) || ' !' END AS name, CASE WHEN l_quantity <> 2 THEN p_name END AS raw_name,
    CASE WHEN p_size % 4 = 0 THEN n || ' std' WHEN l_quantity = 1 THEN '' ELSE n END AS sn, CASE WHEN l_quantity % 2 = 0 THEN 'Cat' || l_linenumber END AS category, CASE WHEN l_linenumber <> 7 THEN unit END AS unit, CASE WHEN l_linenumber <> 7 THEN su END AS su, CASE WHEN l_tax > 0.02 THEN 'd' || l_linenumber END AS description,
    CASE WHEN l_discount = 0 THEN 0.005 WHEN l_tax = 0 THEN 0 ELSE l_extendedprice END AS amount FROM lineitem JOIN g ON l_partkey = p_partkey WHERE l_linestatus = 'O'
  UNION ALL SELECT supplier_id, 1000000000000, 'SAME', 'same', n, NULL, unit, su, NULL, amount FROM h WHERE valid_to IS NULL AND product_id::BIGINT % 3 = 1),
b AS (SELECT * FROM x WHERE amount > 0 QUALIFY row_number() OVER (PARTITION BY supplier_id, sn, su ORDER BY amount, position, name, raw_name NULLS FIRST, category NULLS FIRST, unit NULLS FIRST, description NULLS FIRST) = 1),
v AS (SELECT *, list_filter([CASE WHEN name = ' ' THEN 'Product name is required and cannot be empty' END, CASE WHEN sn = '' THEN 'Standardized product name is required' END, CASE WHEN unit IS NULL THEN 'Product unit is required' END, CASE WHEN amount <= 0.01 THEN 'Price amount must be greater than 0.01' END, CASE WHEN supplier_id IS NULL THEN 'Supplier ID is required' END], lambda x: x IS NOT NULL) AS errors FROM b),
f AS (SELECT v.*, coalesce(e.id, sha256(v.sn || '|' || v.su)) AS product_id, e.id IS NULL AS is_new FROM v LEFT JOIN e ON e.n = v.sn AND e.su = v.su WHERE len(errors) = 0),
c AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.valid_to IS NULL AND h.product_id = f.product_id AND h.supplier_id = f.supplier_id AND h.amount = f.amount AND h.unit = f.unit))"""


def uploaded(spark: SparkSession, sf_dir: str) -> ingest.Stored:
    """Open lines as an upload's rows, some of them prices as they are already, closed ones as the prices held, two thirds of the parts as the products known."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", F.lower("p_name").alias("n"), pick(F.col("p_size"), *KEPT).alias("su"), pick(F.col("p_size"), *GIVEN).alias("unit"))
    known = part.where("p_partkey % 3 <> 0").groupBy("n", "su").agg(F.min("p_partkey").cast("string").alias("id"))
    text = F.lit(None).cast("string")
    products = known.select("id", F.col("n").alias("raw_name"), F.concat(F.lit("old "), "n").alias("name"), F.col("n").alias("standardized_name"), F.lit("Old").alias("category"), F.col("su").alias("unit"), F.col("su").alias("standardized_unit"), F.concat(F.lit("kept "), "id").alias("description"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    lines = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    closed = lines.where("l_linestatus = 'F'").join(known, ["n", "su"]).select("id", "n", "l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "unit", F.col("l_shipdate").cast("timestamp_ntz").alias("valid_from"))
    held = history.intervals(closed, ["id", "l_suppkey"], "valid_from", ["l_orderkey", "l_linenumber", "l_extendedprice"])
    stored_prices = held.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), F.col("l_extendedprice").alias("amount"), "unit", F.lit(None).cast("double").alias("unit_price"), F.col("l_suppkey").cast("string").alias("supplier_id"), F.col("id").alias("product_id"), text.alias("upload_id"), "valid_from", "valid_to", F.col("valid_from").alias("created_at"))
    quantity, number = F.col("l_quantity"), F.col("l_linenumber")
    new = lines.where("l_linestatus = 'O'").select(
        F.when(F.col("l_suppkey") % 50 != 7, F.col("l_suppkey").cast("string")).alias("supplier_id"),
        (F.col("l_orderkey") * 8 + number).alias("position"),
        F.when(quantity == 1, " ").otherwise(F.concat(F.upper("p_name"), F.lit(" !"))).alias("name"),
        F.when(quantity != 2, F.col("p_name")).alias("raw_name"),
        F.when(F.col("p_size") % 4 == 0, F.concat("n", F.lit(" std"))).alias("standardized_name"),
        F.when(quantity % 2 == 0, F.concat(F.lit("Cat"), number.cast("string"))).alias("category"),
        F.when(number != 7, F.col("unit")).alias("unit"),
        F.when(F.col("l_tax") > 0.02, F.concat(F.lit("d"), number.cast("string"))).alias("description"),
        F.when(F.col("l_discount") == 0, 0.005).when(F.col("l_tax") == 0, 0.0).otherwise(F.col("l_extendedprice")).alias("amount"),
    )
    same = held.where("valid_to IS NULL AND id % 3 = 1").select(F.col("l_suppkey").cast("string").alias("supplier_id"), F.lit(1000000000000).alias("position"), F.lit("SAME").alias("name"), F.lit("same").alias("raw_name"), F.col("n").alias("standardized_name"), text.alias("category"), "unit", text.alias("description"), F.col("l_extendedprice").alias("amount"))
    return ingest.stored(new.unionByName(same), products, stored_prices, F.lit("2030-01-01").cast("timestamp_ntz"), "u1")


@query(
    f"""WITH {UPLOAD}, l AS (SELECT product_id, arg_max(trim(name), supplier_id) AS name, arg_max(trim(unit), supplier_id) AS unit, arg_max(coalesce(raw_name, trim(name)), supplier_id) AS raw_name, arg_max(category, supplier_id) FILTER (category IS NOT NULL) AS category, arg_max(description, supplier_id) FILTER (description IS NOT NULL) AS description, any_value(sn) AS sn, any_value(su) AS su, bool_or(is_new) AS is_new FROM f GROUP BY product_id)
SELECT e.id, coalesce(l.raw_name, e.n) AS raw_name, coalesce(l.name, 'old ' || e.n) AS name, e.n AS standardized_name, coalesce(l.category, 'Old') AS category, coalesce(l.unit, e.su) AS unit, e.su AS standardized_unit, coalesce(l.description, 'kept ' || e.id) AS description FROM e LEFT JOIN l ON l.product_id = e.id
UNION ALL SELECT product_id, raw_name, name, sn, category, unit, su, description FROM l WHERE is_new"""
)
def upserted_products(spark, sf_dir):
    return uploaded(spark, sf_dir).products.select("id", "raw_name", "name", "standardized_name", "category", "unit", "standardized_unit", "description")


@query(
    f"""WITH {UPLOAD} SELECT h.product_id, h.supplier_id, h.amount, h.unit, strftime(h.valid_from, '%Y-%m-%d') AS valid_from, strftime(CASE WHEN h.valid_to IS NULL AND c.product_id IS NOT NULL THEN TIMESTAMP '2030-01-01' ELSE h.valid_to END, '%Y-%m-%d') AS valid_to
FROM h LEFT JOIN c ON c.product_id = h.product_id AND c.supplier_id = h.supplier_id UNION ALL SELECT product_id, supplier_id, amount, unit, '2030-01-01', NULL FROM c"""
)
def upserted_prices(spark, sf_dir):
    return shown(uploaded(spark, sf_dir).prices)


@query(
    f"""WITH {UPLOAD} SELECT c.product_id, c.supplier_id, c.amount AS price, c.unit, h.amount AS changed_from, J2(CASE WHEN h.amount > 0 THEN (c.amount - h.amount) * 100.0 / h.amount WHEN h.amount IS NOT NULL THEN 0 END) AS change_percentage, CASE WHEN h.amount IS NULL THEN 'initial' ELSE 'api' END AS change_reason, '2030-01-01' AS created
FROM c LEFT JOIN h ON h.valid_to IS NULL AND c.product_id = h.product_id AND c.supplier_id = h.supplier_id"""
)
def upserted_history(spark, sf_dir):
    percent = (F.floor(F.col("change_percentage") * 100.0 + 0.5) / 100.0).alias("change_percentage")
    return uploaded(spark, sf_dir).history.select("product_id", "supplier_id", "price", "unit", "changed_from", percent, "change_reason", day("created_at").alias("created"))


@query(f"WITH {UPLOAD} SELECT supplier_id, sn AS standardized_name, su AS standardized_unit, array_to_string(errors, '; ') AS errors FROM v WHERE len(errors) > 0")
def rejected_products(spark, sf_dir):
    return uploaded(spark, sf_dir).rejected.withColumn("errors", F.array_join("errors", "; "))


# ---------------------------------------------------------------- units, names, texts

UNITS = ("Boxes", "pack", "lb", "L", "ml", "dozen", "ounces", "carton", "xyz", "btl")


@query(
    f"""SELECT p_partkey, {chosen("p_partkey", *UNITS)} AS unit, {chosen("p_partkey", "box", "pack", "lb", "l", "ml", "dozen", "oz", "carton", "xyz", "bottle")} AS ingested, {chosen("p_partkey", "Boxes", "pack", "lb", "L", "L", "pcs", "ounces", "box", "xyz", "btl")} AS formatted,
{chosen("p_partkey", 0, 8, 0, 6, 6, 12, 0, 8, 0, 0)} AS of_kind FROM part"""
)
def unit_forms(spark, sf_dir):
    """Units as an upload keeps them, as they are shown, and how many are of their kind."""
    u = F.col("unit")
    return table(spark, sf_dir, "part").select("p_partkey", pick(F.col("p_partkey"), *UNITS).alias("unit")).select("*", units.ingested_unit(u).alias("ingested"), units.formatted_unit(u).alias("formatted"), F.size(units.units_of_kind(units.unit_kind(u))).alias("of_kind"))


@query(
    """WITH w AS (SELECT p_partkey, p_partkey % 6 AS k, p_name AS n, string_split(p_name, ' ') AS w, CASE WHEN string_split(p_name, ' ')[1] = 'new' THEN string_split(p_name, ' ')[2] ELSE p_name END AS m FROM part), c AS (SELECT *, list_transform(w, lambda x: upper(x[1]) || x[2:]) AS t FROM w), s AS (SELECT *, t[1] || ' ' || t[2] AS shown FROM c)
SELECT p_partkey, CASE k WHEN 1 THEN 'PT' WHEN 2 THEN 'CV ' || w[1] WHEN 3 THEN 'bali' WHEN 4 THEN '2024' ELSE w[1] END AS first_word,
CASE k WHEN 0 THEN m WHEN 1 THEN 'PT. ' || m || ' 12 05' WHEN 2 THEN 'CV+' || CASE WHEN m = n THEN n ELSE ' ' || m END || ' 7' WHEN 3 THEN 'bali seafood ' || m WHEN 4 THEN '2024 01 05' ELSE m || ' (2)' END AS title,
CASE k WHEN 0 THEN shown || ' Price List V2 Final' WHEN 1 THEN shown WHEN 2 THEN ' ' || shown WHEN 3 THEN 'Bali_seafood' WHEN 4 THEN '2024-01-05' ELSE shown || '_price_list (1) (2)' END AS supplier,
CASE k WHEN 0 THEN replace(n, ' ', '_') || '_price_list_v2_final.xlsx' WHEN 1 THEN 'pt._' || replace(n, ' ', '_') || '_12_05_new.pdf' WHEN 2 THEN 'cv' || replace(n, ' ', '_') || '_7.csv' WHEN 3 THEN 'bali_seafood_' || replace(n, ' ', '_') || '.jpg' WHEN 4 THEN '2024-01-05.xlsx' ELSE replace(n, ' ', '_') || '_price_list_1_2.docx' END AS stored FROM s"""
)
def file_suppliers(spark, sf_dir):
    """Three rules for the supplier that a file name holds, and the name that the file is stored by."""
    n = F.col("p_name")
    forms = [F.concat(n, F.lit(" price list v2 FINAL.xlsx")), F.concat(F.lit("PT. "), n, F.lit(" 12_05 new.pdf")), F.concat(F.lit("CV+"), n, F.lit(" 7.csv")), F.concat(F.lit("bali seafood "), n, F.lit(".jpg")), F.lit("2024-01-05.xlsx"), F.concat(n, F.lit("_price_list (1) (2).docx"))]
    file = F.element_at(F.array(*forms), (F.col("p_partkey") % 6 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", names.first_word_of_file(file).alias("first_word"), names.title_of_file(file).alias("title"), names.supplier_from_file(file).alias("supplier"), names.safe_file_name(file).alias("stored"))


@query(
    """WITH x AS (SELECT p_partkey, CASE WHEN p_size % 3 > 0 THEN p_retailprice * p_size END AS p FROM part), t AS (SELECT *, replace(format('{:,}', floor(p + 0.5)::BIGINT), ',', '.') AS n FROM x)
SELECT p_partkey, coalesce('Rp ' || n, 'N/A') AS shown, n || ' IDR' AS idr, p_partkey % 3 = 0 AS translated FROM t"""
)
def shown_texts(spark, sf_dir):
    """Prices as they are shown, and whether a name is shown with its translation."""
    price, key = F.when(F.col("p_size") % 3 > 0, F.col("p_retailprice") * F.col("p_size")), F.col("p_partkey") % 3
    name = F.when(key == 0, F.concat("p_name", F.lit(" Merah"))).when(key == 1, F.concat("p_name", F.lit(" ikan"))).otherwise(F.concat("p_name", F.lit(" hijauan")))
    standard = F.when(key == 0, F.col("p_name")).when(key == 1, F.upper(F.concat("p_name", F.lit(" ikan")))).otherwise("other")
    return table(spark, sf_dir, "part").select("p_partkey", prices.shown_price(price).alias("shown"), prices.idr_price(price).alias("idr"), names.needs_translation(name, standard).alias("translated"))


# ---------------------------------------------------------------- report and export


@query(
    """WITH p AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Wortel ' || p_name WHEN 1 THEN NULL ELSE p_name END AS n, CASE p_size % 4 WHEN 0 THEN 'kg' WHEN 1 THEN 'L' WHEN 2 THEN 'furlong' END AS u, p_size % 4 = 0 OR p_size % 4 = 1 AND p_size % 3 > 0 AS fits FROM part),
l AS (SELECT l_extendedprice * CASE WHEN l_discount = 0 THEN 0.001 ELSE 1 END * sign(l_tax) AS a, CASE WHEN l_quantity > 40 THEN NULL WHEN l_quantity < 5 THEN 0 ELSE 1 END AS up FROM lineitem),
c AS (SELECT (SELECT count(*) FROM p) AS total, (SELECT count(*) FROM p WHERE n LIKE 'Wortel%') AS indonesian_names, (SELECT count(*) FROM p WHERE NOT fits) AS invalid_units, (SELECT coalesce(sum(k - 1), 0)::BIGINT FROM (SELECT count(*) AS k FROM p WHERE n IS NOT NULL AND u IS NOT NULL GROUP BY n, u)) AS duplicate_products,
  (SELECT count(*) FROM l WHERE a = 0) AS null_prices, (SELECT count(*) FROM l WHERE up IS NULL OR up = 0) AS missing_unit_prices, (SELECT count(*) FROM l WHERE a < 100 OR a > 10000000) AS out_of_range_prices)
SELECT issue, n, R4((indonesian_names + invalid_units + duplicate_products) * 100.0 / total) AS percent FROM c, LATERAL (VALUES ('indonesian_names', indonesian_names), ('null_prices', null_prices), ('invalid_units', invalid_units), ('missing_unit_prices', missing_unit_prices), ('duplicate_products', duplicate_products), ('out_of_range_prices', out_of_range_prices)) t(issue, n)"""
)
def data_quality_classes(spark, sf_dir):
    """The data report's six classes of issues."""
    key, size = F.col("p_partkey") % 5, F.col("p_size")
    given = pick(size, "Kilo", "Liter", "furlong", "")
    products = table(spark, sf_dir, "part").select(
        F.when(key == 0, F.concat(F.lit("Wortel "), "p_name")).when(key != 1, F.col("p_name")).alias("standardized_name"),
        F.when((size % 4 == 1) & (size % 3 == 0), "gram").otherwise(given).alias("unit"),
        F.when(size % 4 == 0, "kg").when(size % 4 == 1, "L").when(size % 4 == 2, "furlong").alias("standardized_unit"),
    )
    amount = F.col("l_extendedprice") * F.when(F.col("l_discount") == 0, 0.001).otherwise(1.0) * F.signum("l_tax")
    lines = table(spark, sf_dir, "lineitem").select(amount.alias("amount"), F.when(F.col("l_quantity") < 5, 0.0).when(F.col("l_quantity") <= 40, 1.0).alias("unit_price"))
    return quality.data_quality_report(products, lines).withColumn("percent", rounded(F.col("percent"), 4))


@query(
    """WITH l AS (SELECT l_partkey, l_extendedprice AS a, s_name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linestatus = 'O'),
b AS (SELECT l_partkey, min(a) AS lo, max(a) AS hi, count(*) AS n FROM l GROUP BY l_partkey)
SELECT p_name AS standardized_name, p_type AS category, p_brand AS unit, lo AS best_price, (SELECT min(s_name) FROM l WHERE l.l_partkey = p_partkey AND a = lo) AS best_supplier, hi AS highest_price, (SELECT min(s_name) FROM l WHERE l.l_partkey = p_partkey AND a = hi) AS highest_supplier, coalesce(n, 0) AS supplier_count, coalesce(J1((hi - lo) * 100.0 / hi), 0.0) AS savings_percent
FROM part LEFT JOIN b ON l_partkey = p_partkey"""
)
def exported_products(spark, sf_dir):
    """The export of all products by amount."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("standardized_name"), F.col("p_type").alias("category"), F.col("p_brand").alias("unit"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("supplier_id"), F.col("l_extendedprice").alias("amount"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("valid_to"))
    return catalogue.export_rows(part, lines, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")))
