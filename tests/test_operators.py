"""Order-sensitive operators on small hand-built tables."""

import math
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pricequarry import schemas
from pricequarry.functions import similarity, standardize
from pricequarry.operators import analytics, catalogue, compare, history, mutations, quality, search, vectors

T0 = datetime(2025, 1, 1)


def day(n):
    return T0 + timedelta(days=n)


@pytest.fixture(scope="module")
def suppliers(spark):
    return spark.createDataFrame([("s1", "Bali Boga", None, None, None, T0), ("s2", "Island Organics", "a@b.co", None, None, T0), ("s3", "Boga Jaya", None, None, None, T0)], schemas.SUPPLIERS)


@pytest.fixture(scope="module")
def products(spark):
    rows = [("p1", "Wortel", "carrot", "carrot", "Vegetables", "kg", "kg", None), ("p2", "Baby carrot", "baby carrot", "baby carrot", None, "kg", "kg", None), ("p3", "Mozzarella", "mozzarella cheese", "mozzarella cheese", "Dairy", "kg", "kg", "soft"), ("p4", "Carrot local", "carrot", "carrot", None, "kg", "kg", "longer text"), ("p5", "12", "12", "12", None, "pcs", None, None)]
    return spark.createDataFrame([(*r, day(i)) for i, r in enumerate(rows)], schemas.PRODUCTS)


@pytest.fixture(scope="module")
def prices(spark):
    rows = [("a", 9600, "s1", "p1", 0, None), ("b", 9500, "s2", "p1", 1, None), ("c", 9000, "s3", "p1", 2, None), ("d", 20000, "s1", "p2", 2, None), ("e", 8000, "s1", "p1", -90, 0), ("f", 90000, "s2", "p3", -60, None), ("g", 9700, "s1", "p4", 1, None)]
    return spark.createDataFrame([(i, Decimal(a), "kg", Decimal(a), s, p, None, day(f), day(t) if t is not None else None, day(f)) for i, a, s, p, f, t in rows], schemas.PRICES)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "Carrot", None, 10000.0, "kg", 1.0), (2, "Mozarella", None, 1e5, "kg", 1.0), (3, "unicorn", None, 5.0, None, None), (4, "carrot", "s3", 9000.0, "kg", 1.0), (5, "Mozzarella", None, 1e5, "kg", 1.0)], schemas.ITEMS)


def test_candidates_by_tier(items, products, spark):
    aliases = spark.createDataFrame([("x", "p3", "unicorn", "en")], schemas.ALIASES)
    found = search.candidates(items, products, aliases).collect()
    assert {(r["item_id"], r["product_id"], r["tier"]) for r in found} == {(1, "p1", 2), (1, "p2", 2), (1, "p4", 2), (2, "p3", 7), (3, "p3", 1), (4, "p1", 2), (4, "p2", 2), (4, "p4", 2), (5, "p3", 2)}
    assert {r["position"] for r in found if r["item_id"] == 1} == {1, 2, 3}


def test_candidates_take_the_first_that_finds_any(spark):
    products = spark.createDataFrame([("p1", "Pizzanna"), ("p2", "Pizana"), ("p3", "Café Crème"), ("p4", None), ("p5", "ab cd"), ("p6", "x")], "id string, name string").withColumns({"standardized_name": F.lit(None).cast("string"), "raw_name": F.lit("").cast("string")})
    asked = spark.createDataFrame([(1, "pizanna"), (2, "x"), (3, "d a"), (4, ""), (5, None), (6, "crème, fresh"), (7, "nick"), (8, "Pizana")], "item_id long, product_name string")
    aliases = spark.createDataFrame([("p5", "nick"), ("p6", " Nick ")], "product_id string, alias string")
    found = {(r["item_id"], r["product_id"], r["tier"], r["position"]) for r in search.candidates(asked, products, aliases).collect()}
    # the first variant of pizanna that any product has is pizzanna; words of less than three letters only count together
    assert found == {(1, "p1", 7, 1), (2, "p6", 2, 1), (3, "p5", 4, 1), (7, "p5", 1, 1), (7, "p6", 1, 2), (8, "p2", 2, 1)}
    assert search.candidates(asked, products.limit(0)).collect() == search.candidates(asked.limit(0), products).collect() == []


def test_products_with_looks_up_the_rarest_letters(spark):
    products = spark.createDataFrame([(f"{i:03}", f"common {'rare' if i == 77 else 'name'} {i}") for i in range(100)], "id string, name string").withColumns({"standardized_name": F.lit(""), "raw_name": F.lit(None).cast("string")})
    needles = spark.createDataFrame([(["common"],), (["common", "rare"],), (["e 5"],), (["7", "m"],), (["zzz"],)], "texts array<string>")
    got = {}
    for r in search.products_with(needles, products, 5).collect():
        got.setdefault(tuple(r["texts"]), []).append(r["product_id"])
    assert {k: sorted(v) for k, v in got.items()} == {("common",): ["000", "001", "002", "003", "004"], ("common", "rare"): ["077"], ("e 5",): ["005", "050", "051", "052", "053"], ("7", "m"): ["007", "017", "027", "037", "047"]}


def test_compare(items, products, prices, suppliers):
    got = {r["item_id"]: r for r in compare.compare_prices(items, products, prices, suppliers, F.lit(day(10)).cast("timestamp_ntz")).collect()}
    one = got[1]
    # p2 is another product by its modifier; the ended price doesn't count
    assert (one["low"], one["high"], one["supplier_count"], one["matched_id"]) == (9000.0, 9700.0, 4, "p1")
    assert one["status"] == "above_average" and one["deviation"] == pytest.approx(5.8)
    assert [d["amount"] for d in one["better_deals"]] == [9000.0, 9500.0]
    assert [d["saving_percent"] for d in one["better_deals"]] == [10.0, 5.0]
    # found by a misreading undone, but no word of it is a product's
    assert got[2]["status"] == "not_found"
    # its price is older than 30 days
    assert got[5]["status"] == "no_data" and got[5]["matched_id"] == "p3" and got[5]["better_deals"] == []
    assert got[3]["status"] == "not_found" and got[3]["matched_id"] is None
    assert got[4]["better_deals"] == [] and got[4]["score"] == 100.0
    total = compare.summarize(compare.compare_prices(items, products, prices, suppliers, F.lit(day(10)).cast("timestamp_ntz"))).first()
    assert (total["items"], total["new_items"], total["with_better_deals"], total["total_savings"]) == (5, 2, 1, 1000.0)


def test_suppliers_by_tier(spark, suppliers):
    asked = spark.createDataFrame([(1, "bali boga"), (2, "Boga"), (3, "Organics Ltd"), (4, "zz")], "item_id long, name string")
    got = {(r["item_id"], r["supplier_id"], r["tier"]) for r in search.match_supplier(asked, suppliers).collect()}
    assert got == {(1, "s1", 1), (2, "s1", 2), (2, "s3", 2), (3, "s2", 3)}


def test_store_keeps_one_current_price(spark, prices):
    new = spark.createDataFrame([("p1", "s1", 9000.0, "kg", 9000.0), ("p1", "s1", 8800.0, "kg", 8800.0), ("p1", "s2", 9500.0, "kg", 9500.0), ("p9", "s1", 5.0, "kg", 5.0), ("p9", "s2", -1.0, "kg", 1.0)], "product_id string, supplier_id string, amount double, unit string, unit_price double")
    after, log = history.store(new, prices, F.lit(day(20)).cast("timestamp_ntz"), upload_id="u")
    assert after.columns == prices.columns
    current = {(r["product_id"], r["supplier_id"]): float(r["amount"]) for r in after.where("valid_to IS NULL").collect()}
    assert current[("p1", "s1")] == 8800.0 and current[("p1", "s2")] == 9500.0 and current[("p9", "s1")] == 5.0 and ("p9", "s2") not in current
    assert after.count() == prices.count() + 2
    assert quality.duplicates(after.where("valid_to IS NULL"), ["product_id", "supplier_id"]).count() == 0
    logged = {(r["product_id"], r["supplier_id"]): (r["change_reason"], r["change_percentage"]) for r in log.collect()}
    assert logged == {("p1", "s1"): ("api", pytest.approx(-100 / 12)), ("p9", "s1"): ("initial", None)}
    assert history.backfill(prices, log).count() == prices.count() - 2
    # again: nothing changes
    again, log = history.store(new, after, F.lit(day(21)).cast("timestamp_ntz"))
    assert log.count() == 0 and again.count() == after.count()


def test_a_price_by_product_ends_all_suppliers_and_keeps_its_own(spark, prices):
    new = spark.createDataFrame([("p1", "s9", 70.0, "kg", 70.0), ("p1", "s1", 80.0, "kg", 80.0)], "product_id string, supplier_id string, amount double, unit string, unit_price double")
    after, log = history.store(new, prices, F.lit(day(20)).cast("timestamp_ntz"), by=("product_id",), skip_equal=False)
    current = [(r["supplier_id"], float(r["amount"])) for r in after.where("valid_to IS NULL AND product_id = 'p1'").collect()]
    assert current == [("s9", 70.0)]
    assert {r["supplier_id"] for r in log.collect()} == {"s9"}


def test_expiry_and_intervals(prices):
    both = history.expire_duplicates(prices, ["product_id"], [F.col("valid_from").desc(), F.col("id")])
    current = both.where("valid_to IS NULL").collect()
    assert sorted(r["id"] for r in current) == ["c", "d", "f", "g"]
    assert {r["valid_to"] for r in both.where("id = 'b'").collect()} == {day(2) - timedelta(seconds=1)}
    v = history.intervals(prices.where("supplier_id = 's1' AND product_id = 'p1'").drop("valid_to"), ["product_id"], "valid_from", ["id"]).orderBy("valid_from").collect()
    assert [r["valid_to"] for r in v] == [day(0), None]
    assert history.as_of(prices, F.lit(day(-80)).cast("timestamp_ntz")).count() == 1


def test_merge_and_clean_up(products, prices, suppliers, spark):
    merged, kept = quality.merge_products(products, prices)
    rows = {r["id"]: r for r in merged.collect()}
    assert set(rows) == {"p1", "p2", "p3", "p5"} and rows["p1"]["description"] == "longer text"
    assert sorted((r["product_id"], r["id"]) for r in kept.where("valid_to IS NULL AND supplier_id = 's1'").collect()) == [("p1", "a"), ("p1", "g"), ("p2", "d")]  # the kept product's own price stays beside the latest
    uploads = spark.createDataFrame([], schemas.UPLOADS)
    p, a, s = quality.clean_catalogue(products, prices.where("supplier_id <> 's3'"), suppliers, uploads)
    assert {r["id"] for r in p.collect()} == {"p1", "p2", "p3", "p4"} and a.count() == 6 and {r["id"] for r in s.collect()} == {"s1", "s2"}
    mapping = spark.createDataFrame([("p4", "p1"), ("p2", "p1")], "id string, kept_id string")
    assert {r["id"] for r in quality.repointed(prices, mapping).where("product_id = 'p1'").collect()} == {"a", "b", "c", "e"}


PRICE = "id string, product_id string, supplier_id string, unit string, amount double, valid_from timestamp_ntz, valid_to timestamp_ntz"


def test_repointing_loses_no_current_price(spark):
    rows = [
        ("a", "k", "s1", "kg", 1.0, day(0), day(1)),  # the kept product's price has ended
        ("b", "d1", "s1", "kg", 2.0, day(1), None),
        ("c", "d2", "s1", "kg", 3.0, day(2), None),
        ("d", "k", "s2", "kg", 4.0, day(0), None),
        ("e", "d1", "s2", "kg", 5.0, day(1), None),
        ("f", "d1", "s3", "kg", 6.0, day(0), day(1)),  # ended ones move until a current one has
        ("g", "d1", "s3", "kg", 7.0, day(1), None),
        ("h", "d2", "s3", "kg", 8.0, day(2), day(3)),
        ("i", "other", "s1", "kg", 9.0, day(0), None),
    ]
    mapping = spark.createDataFrame([("d1", "k"), ("d2", "k"), ("k", "k")], "id string, kept_id string")
    got = {(r["id"], r["product_id"]) for r in quality.repointed(spark.createDataFrame(rows, PRICE), mapping).collect()}
    assert got == {("a", "k"), ("b", "k"), ("d", "k"), ("f", "k"), ("g", "k"), ("i", "other")}


def test_merging_takes_the_latest_price_and_leaves_the_kept_product_its_own(spark):
    products = spark.createDataFrame(
        [("k", "ab", "n", "kg", None, None, day(0)), ("d1", "abc", "n", "kg", "c1", "text", day(1)), ("d2", "abcd", "n", "kg", "c2", "longer text", day(2)), ("x", "q", None, "kg", None, None, day(0)), ("y", "q", None, "kg", None, None, day(1))],
        "id string, name string, standardized_name string, standardized_unit string, category string, description string, created_at timestamp_ntz",
    )
    rows = [
        ("a", "k", "s1", "kg", 1.0, day(0), None),
        ("b", "d1", "s1", "kg", 2.0, day(5), day(6)),  # the latest, though it has ended
        ("c", "d2", "s1", "kg", 3.0, day(1), None),
        ("d", "d1", "s2", "kg", 4.0, day(1), None),
        ("e", "d2", "s2", "kg", 5.0, day(1), None),
        ("f", "d2", "s2", "g", 6.0, day(0), None),
        ("g", "y", "s1", "kg", 7.0, day(0), None),
    ]
    merged, kept = quality.merge_products(products, spark.createDataFrame(rows, PRICE))
    # the first name and description that are longer than the oldest product's
    assert {(r["id"], r["name"], r["category"], r["description"]) for r in merged.collect()} == {("k", "abc", "c1", "text"), ("x", "q", None, None), ("y", "q", None, None)}
    assert {(r["id"], r["product_id"]) for r in kept.collect()} == {("a", "k"), ("b", "k"), ("d", "k"), ("f", "k"), ("g", "y")}


def test_table_changes(spark):
    schema = "id string, product_id string, supplier_id string, amount double, unit string, unit_price double"
    before = [("a", "p", "s", 1.0, "kg", 1.0), ("b", "p", "s", 2.0, "kg", None), ("c", "p", "t", 3.0, "kg", 1.0), ("d", "p", "u", 4.0, None, None), ("d", "p", "u", 5.0, None, None), (None, "q", "s", 6.0, "g", None)]
    after = [("a", "p", "s", 1.0, "kg", 1.0), ("b", "p", "s", 2.5, "kg", None), ("d", "p", "u", 5.0, "g", None), ("d", "p", "u", 5.0, "g", None), ("e", "r", "s", 7.0, "kg", 7.0), (None, "q", "s", 0.0, "g", None)]
    changes = history.table_changes(spark.createDataFrame(before, schema), spark.createDataFrame(after, schema).withColumn("extra", F.lit(1)), ["id"])
    assert {(r["id"], r["change"], r["before"] and r["before"]["amount"], r["after"] and r["after"]["amount"]) for r in changes.collect()} == {("b", "updated", 2.0, 2.5), ("c", "deleted", 3.0, None), ("d", "updated", 5.0, 5.0), ("e", "created", None, 7.0), (None, "updated", 6.0, 0.0)}
    log = spark.createDataFrame([("p", "s", 1.25, day(0)), ("p", "s", 2.0, day(1)), ("r", "s", 5.0, day(0))], "product_id string, supplier_id string, price double, created_at timestamp_ntz")
    got = {(r["product_id"], r["price"], r["changed_from"], r["change_percentage"], r["notes"][:3]) for r in history.history_of_changes(changes, log).collect()}
    assert got == {("p", 2.5, 2.0, 25.0, "Pri"), ("r", 7.0, 5.0, 40.0, "New"), ("q", 0.0, 6.0, -100.0, "Pri")}
    assert {r["changed_from"] for r in history.history_of_changes(changes).collect()} == {2.0, None, 6.0}
    none = spark.createDataFrame([], schema)
    assert history.table_changes(none, none, ["id"]).collect() == []


def test_listing(products, prices, suppliers):
    got = {r["id"]: r for r in catalogue.listing(products, prices, suppliers).collect()}
    assert (got["p1"]["best_price"], got["p1"]["best_supplier"], got["p1"]["supplier_count"], got["p1"]["highest_price"]) == (9000.0, "Boga Jaya", 3, 9600.0)
    assert got["p4"]["best_price"] == 9000.0 and got["p5"]["best_price"] is None and got["p5"]["supplier_count"] == 0
    assert catalogue.listing(products, prices, suppliers, search="%").count() == 0


def test_validation(spark):
    df = spark.createDataFrame([("Cheddar", 60000.0, "kg"), ("Cheddar", 400000.0, "crate"), ("Cheddar", 1000.0, "kg"), ("thing", 100.0, None), ("thing", 0.0, None), ("thing", 700.25, None), ("thing", 6e7, None)], "n string, p double, u string")
    got = [r["v"] for r in df.select(quality.validate_price(F.col("n"), F.col("p"), F.col("u")).alias("v")).collect()]
    assert [g["is_valid"] for g in got] == [True, True, True, False, False, True, False]
    assert [g["confidence"] for g in got] == pytest.approx([1.0, 0.8, 0.7, 0.0, 0.0, 0.48, 0.0])
    assert [len(g["warnings"]) for g in got] == [0, 1, 1, 0, 0, 2, 0]


def test_trends_and_volatility(spark):
    h = spark.createDataFrame([("x", day(i), i, p) for i, p in enumerate([100.0, 110.0, 99.0])], "k string, at timestamp_ntz, tie int, price double")
    t = analytics.trend_summary(h, ["k"], "at", "price", "tie").first()
    assert (t["first_price"], t["last_price"], t["trend"]) == (100.0, 99.0, "stable") and t["overall_change"] == pytest.approx(-1)
    log = history.change_log(h, ["k"], ["at"], "price")
    v = analytics.volatility(log, ["k"]).first()
    assert v["volatility"] == pytest.approx(10) and v["changes"] == 2
    today = spark.createDataFrame([(day(2), 5.0), (day(9), 7.0)], "at timestamp_ntz, price double")
    assert analytics.daily_average(h, "at", "price", today).count() == 4


def test_mutations(spark, suppliers):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    patch = spark.createDataFrame([(2, "c"), (9, "d")], "id int, v string")
    after, failed = mutations.updated(t, patch)
    assert {tuple(r) for r in after.collect()} == {(1, "a"), (2, "c")} and [r["id"] for r in failed.collect()] == [9]
    assert {tuple(r) for r in mutations.upserted(t, patch, ["id"]).collect()} == {(1, "a"), (2, "c"), (9, "d")}
    assert {tuple(r) for r in mutations.inserted_new(t, patch, ["id"]).collect()} == {(1, "a"), (2, "b"), (9, "d")}
    queue = spark.createDataFrame([("Foo", "foo", None, None, 2, "pending", None), ("Bar", "bar", None, None, 1, "ignored", None)], schemas.UNMATCHED)
    new = spark.createDataFrame([(" foo",), ("bar",), ("bar",)], "raw_name string")
    got = {(r["normalized_name"], r["status"], r["frequency"]) for r in mutations.count_unmatched(queue, new).collect()}
    assert got == {("foo", "pending", 3), ("bar", "ignored", 1), ("bar", "pending", 2)}
    named = spark.createDataFrame([("BALI boga", "x@y.z", None, None), ("New", None, "1", None), (" ", "no", None, None), ("organics", "other@b.co", "77", None)], "name string, email string, phone string, address string")
    made = {r["name"]: r["email"] for r in mutations.found_or_made(named, suppliers).collect()}
    # the name given is part of the one known; what is known stays
    assert made["Bali Boga"] == "x@y.z" and made["Island Organics"] == "a@b.co" and "New" in made and len(made) == suppliers.count() + 1
    assert {r["name"]: r["phone"] for r in mutations.found_or_made(named, suppliers).collect()}["Island Organics"] == "77"
    uploads = spark.createDataFrame([("u1",), ("u2",)], "id string").select("id", F.lit("pending_review").alias("approval_status"), F.lit("processing").alias("status"))
    out, late = mutations.reviewed(uploads, spark.createDataFrame([("u1",), ("u9",)], "id string"), "approved")
    assert {(r["id"], r["status"]) for r in out.collect()} == {("u1", "completed"), ("u2", "processing")} and late.count() == 1


def test_quality_report(spark):
    df = spark.createDataFrame([(1, None, "kg", None, 1.0), (2, 500.0, "furlong", None, 0.0), (3, 50.0, "K", "crate", None), (4, 2e7, "5 kg", "", 2.0)], "k int, p double, u string, s string, q double")
    found = quality.issues(df, "k", "p", "u", "s", "q")
    assert {(r["k"], r["issue"], r["severity"]) for r in found.collect()} == {(1, "null_price", "critical"), (2, "invalid_unit", "warning"), (2, "zero_quantity", "critical"), (3, "out_of_range_price", "warning"), (3, "invalid_unit", "warning"), (4, "out_of_range_price", "warning")}
    report = quality.quality_report(df, found).first()
    assert (report["critical"], report["invalid_unit"], report["needs_review"]) == (2, 2, True)
    fine = df.where("k = 4")
    assert not quality.quality_report(fine, quality.issues(fine, "k", "p", "u")).first()["needs_review"]
    assert not quality.quality_report(df.limit(0), quality.issues(df.limit(0), "k", "p", "u")).first()["needs_review"]


def test_review_flags(spark):
    df = spark.createDataFrame([("10 pack 5 kg", 5.0, "kg"), ("Tomato IDR 5000", 5.0, "kg"), ("Beef Rp 5", 5.0, "kg"), ("ab", 0.0, ""), (None, None, None), ("Tomato", 2e7, "kg"), ("Tomato 2 x 5", 5.0, "kg")], "n string, p double, u string")
    got = [(r["f"]["flags"], r["f"]["severity"]) for r in df.select(quality.review_flags(F.col("n"), F.col("p"), F.col("u")).alias("f")).collect()]
    worst = (["short name", "no price", "no unit"], "high")
    assert got == [(["pack code in name"], "medium"), (["price in name"], "medium"), (["price in name"], "medium"), worst, worst, (["high price"], "medium"), ([], "low")]


def test_export_rows_compare_amounts(spark):
    items = spark.createDataFrame([("p", "tea", "Drinks", "kg"), ("q", "salt", "Other", "g")], "id string, standardized_name string, category string, unit string")
    held = spark.createDataFrame([("p", "s1", 300.0, 3.0, None), ("p", "s2", 200.0, 9.0, None), ("p", "s1", 50.0, 1.0, "2020-01-01")], "product_id string, supplier_id string, amount double, unit_price double, valid_to string")
    by = spark.createDataFrame([("s1", "A"), ("s2", "B")], "id string, name string")
    got = {r["standardized_name"]: r for r in catalogue.export_rows(items, held, by).collect()}
    assert [got["tea"][c] for c in ("best_price", "best_supplier", "highest_price", "highest_supplier", "supplier_count", "savings_percent")] == [200.0, "B", 300.0, "A", 2, 33.3]
    assert (got["salt"]["best_price"], got["salt"]["supplier_count"], got["salt"]["savings_percent"]) == (None, 0, 0.0)
    assert [r["standardized_name"] for r in catalogue.export_rows(items, held, by, "Other").collect()] == ["salt"]


def test_vectors_and_pages(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0], "Meat"), (2, [0.6, 0.8], "Meat")], "k long, v array<double>, c string")
    b = spark.createDataFrame([(7, [1.0, 0.1], "Meat"), (8, [0.0, 1.0], "Dairy")], "id long, v array<double>, c string")
    assert [(r["k"], r["id"]) for r in search.nearest_vector(a, b, "k", "id", "v", "c").collect()] == [(1, 7)]
    rows, total, pages = search.page(spark.range(25), ["id"], 3, 10)
    assert ([r["id"] for r in rows.collect()], total, pages) == ([20, 21, 22, 23, 24], 25, 3)
    # more questions than one block holds: the same answers
    few, many = search.against(b, spark.range(10).withColumnRenamed("id", "n"), "n"), search.against(b, spark.range(10).withColumnRenamed("id", "n"), "n", 3)
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect())) and many.count() == 20
    assert [r["k"] for r in search.nearest_vector(a, a.withColumnRenamed("k", "id"), "k", "id", "v", "c", lambda _: F.lit(0.5), others_only=True).orderBy("k").collect()] == [1, 2]


def test_data_quality_report(spark):
    items = spark.createDataFrame([("Wortel", "kg", "kg"), ("tea", "K", "1000"), ("tea", "ribu", "1000"), ("salt", "g", "kg"), (None, "kg", None)], "standardized_name string, unit string, standardized_unit string")
    held = spark.createDataFrame([(0.0, 1.0), (500.0, None), (2e7, 0.0)], "amount double, unit_price double")
    got = {r["issue"]: (r["n"], r["percent"]) for r in quality.data_quality_report(items, held).collect()}
    assert got == {k: (n, 80.0) for k, n in {"indonesian_names": 1, "invalid_units": 2, "duplicate_products": 1, "null_prices": 1, "missing_unit_prices": 2, "out_of_range_prices": 2}.items()}
    assert {(r["n"], r["percent"]) for r in quality.data_quality_report(items.limit(0), held.limit(0)).collect()} == {(0, 0.0)}


def test_trigram_matches_by_rarest_find_what_all_pairs_do(spark):
    rng = random.Random(8)
    names = [" ".join("".join(rng.choice("abcd") for _ in range(rng.randint(2, 5))) for _ in range(rng.randint(1, 3))) for _ in range(80)] + ["", "Supplier common a", "Supplier common b"]
    a = spark.createDataFrame(list(enumerate(names[::3])), "k long, q string")
    b = spark.createDataFrame(list(enumerate(names)), "id long, n string")

    def grams(text):
        return {f"  {w} "[i : i + 3] for w in text.lower().split() for i in range(len(w) + 1)}

    for least in (0.3, 0.5, 0.8):
        want = {(i, j) for i, x in enumerate(names[::3]) for j, y in enumerate(names) if grams(x) and grams(y) and len(grams(x) & grams(y)) / len(grams(x) | grams(y)) > least}
        got = search.trigram_matches(a, b, "k", "q", "id", "n", least).collect()
        assert {(r["k"], r["id"]) for r in got} == want and len(got) == len(want)


def planned(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_candidates_never_broadcast_the_catalogue(spark):
    # files of repeated names look small enough for a broadcast, however many products they hold
    products = spark.range(300).select(F.format_string("p%03d", "id").alias("id"), F.concat(F.lit("ring "), (F.col("id") % 3).cast("string")).alias("name"), F.lit(None).cast("string").alias("standardized_name"), F.lit("").alias("raw_name"))
    asked = spark.createDataFrame([(1, "Ring 1"), (1, "ring"), (2, "Ring 1"), (3, "ring"), (4, None)], "item_id long, product_name string")
    aliases = spark.createDataFrame([("p005", "ring")], "product_id string, alias string")
    found = search.candidates(asked, products, aliases)
    assert "Broadcast" not in planned(found)
    got = {}
    for r in found.collect():
        got.setdefault((r["item_id"], r["tier"]), {})[r["position"]] = r["product_id"]
    # an item with two names takes the first tier that either finds
    assert got == {(1, 1): {1: "p005"}, (2, 2): {i + 1: f"p{3 * i + 1:03}" for i in range(20)}, (3, 1): {1: "p005"}}


def broadcasts(df):
    return planned(df).count("BroadcastHashJoin") + planned(df).count("BroadcastNestedLoopJoin")


def test_a_comparison_broadcasts_suppliers_only(items, products, prices, suppliers):
    assert broadcasts(compare.compare_prices(items, products, prices, suppliers, F.lit(day(10)).cast("timestamp_ntz"))) <= 1


def test_a_summary_broadcasts_suppliers_only(items, products, prices, suppliers):
    assert broadcasts(compare.summarize(compare.compare_prices(items, products, prices, suppliers, F.lit(day(10)).cast("timestamp_ntz")))) <= 1


def test_unmatched_names_broadcast_suppliers_only(items, products, prices, suppliers):
    found = compare.not_found(compare.compare_prices(items, products, prices, suppliers, F.lit(day(10)).cast("timestamp_ntz")))
    assert broadcasts(found) <= 1 and {r["raw_name"] for r in found.collect()} == {"Mozarella", "unicorn"}


def test_unmatched_names_need_no_prices_and_broadcast_nothing(items, products, prices, suppliers):
    found = compare.unmatched(items, products)
    assert broadcasts(found) == 0
    assert sorted(found.collect()) == sorted(compare.not_found(compare.compare_prices(items, products, prices, suppliers, F.lit(day(10)).cast("timestamp_ntz"))).collect())


def test_a_summary_without_names_broadcasts_nothing_and_is_the_same(items, products, prices, suppliers):
    at = F.lit(day(10)).cast("timestamp_ntz")
    bare = compare.summarize(compare.compare_prices(items, products, prices, None, at))
    assert broadcasts(bare) == 0
    assert bare.first() == compare.summarize(compare.compare_prices(items, products, prices, suppliers, at)).first()


def test_listing_works_out_the_offers_of_a_name_once(spark, products, prices, suppliers):
    # one name and unit, one without a unit, one without a name
    rows = spark.createDataFrame([("p1", "tea", "kg"), ("p2", "tea", "kg"), ("p3", "tea", None), ("p4", None, "kg"), ("p5", "tea", None)], "id string, standardized_name string, standardized_unit string")
    got = catalogue.listing(rows, prices, suppliers)
    assert "for_id" not in planned(got)
    assert {(r["id"], r["best_price"], r["best_supplier"], r["highest_price"], r["supplier_count"]) for r in got.collect()} == {("p1", 9000.0, "Boga Jaya", 9600.0, 3), ("p2", 9000.0, "Boga Jaya", 9600.0, 3), ("p3", 90000.0, "Island Organics", 90000.0, 1), ("p4", None, None, None, 0), ("p5", 90000.0, "Island Organics", 90000.0, 1)}


def test_standard_names_are_worked_out_once_for_each_name(spark):
    names = ["Wortel,  RED bolt 500 gr", " susu Indomie", "", None, "Wortel,  RED bolt 500 gr"]
    rows = spark.createDataFrame([(i, n, u) for i, (n, u) in enumerate((n, u) for n in names for u in ("kg", "", None))], "id long, name string, unit string")
    got = catalogue.standard_names(rows, "name", "unit")
    # one aggregate, below the join that gives each row its name's
    assert "Broadcast" not in planned(got) and planned(got).index("SortMergeJoin") < planned(got).index("HashAggregate")
    want = {r["id"]: r["s"] for r in rows.select("id", standardize.standardize(F.col("name"), F.col("unit")).alias("s")).collect()}
    assert {r["id"]: r["standard"] for r in got.collect()} == want and got.count() == 15 and got.columns == [*rows.columns, "standard"]


def test_related_prices_write_no_pairs_of_products(spark, prices):
    rows = spark.createDataFrame([("p1", "tea", None), ("p2", "tea", None), ("p3", None, "kg"), ("p4", "tea", "kg")], "id string, standardized_name string, standardized_unit string")
    got = catalogue.related_prices(rows, prices)
    # the last join, first in the plan, is the one by name
    assert "standardized_name" in next(line for line in planned(got).splitlines() if "Join" in line)
    assert {(r["for_id"], r["product_id"], r["amount"]) for r in got.collect()} == {(a, b, x) for a in ("p1", "p2") for b, x in (("p1", 9600.0), ("p1", 9500.0), ("p1", 9000.0), ("p2", 20000.0))} | {("p4", "p4", 9700.0)}


def test_related_prices_are_dealt_out_and_meet_blocks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "SAME_ROWS", 3)
    rows = spark.createDataFrame([(i, "tea", "kg" if i and i % 2 else None) for i in [*range(40), None, 7]] + [(50, None, "kg")], "id long, standardized_name string, standardized_unit string")
    costs = spark.createDataFrame([(i, i, s, float(i), None, None) for i in [1, 2, 50] for s in range(30)] + [(1, 1, None, 5.0, 2.0, None), (1, 1, 3, 5.0, 2.0, 9)], "id long, product_id long, supplier_id long, amount double, unit_price double, valid_to long")
    got = catalogue.related_prices(rows, costs)
    join = next(line for line in planned(got).splitlines() if "Join" in line)
    assert "part" in join and "for_id" not in join
    of = {1: [i for i in range(40) if i % 2] + [7], 2: [None, *range(0, 40, 2)]}
    held = {p: [(p, s, float(p), None) for s in range(30)] for p in of}
    held[1].append((1, None, 5.0, 2.0))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, *x)) for p in of for i in of[p] for x in held[p])


def test_related_prices_are_shuffled_in_arrays(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "SAME_PRICES", 4)
    rows = spark.createDataFrame([(1, "tea", "kg"), (2, "tea", "kg"), (3, "tea", None), (None, "tea", None), (4, None, "kg")], "id long, standardized_name string, standardized_unit string")
    costs = spark.createDataFrame([(1, 1, s % 5 if s else None, float(s), None if s % 2 else 1.0, None) for s in range(11)] + [(3, 3, 7, None, None, None), (1, 1, 8, 1.0, None, 9), (4, 4, 1, 1.0, None, None)], "id long, product_id long, supplier_id long, amount double, unit_price double, valid_to long")
    got = catalogue.related_prices(rows, costs)
    above = planned(got).split("SortMergeJoin")[1]  # from the last join to the one of products and prices
    assert above.index("Exchange") < above.index("collect_list(struct(supplier_id") and above.count("Exchange") == 1
    held = [(1, s % 5 if s else None, float(s), None if s % 2 else 1.0) for s in range(11)]
    want = [(i, *x) for i in (1, 2) for x in held] + [(i, 3, 7, None, None) for i in (3, None)]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_suppliers_of_a_text_are_looked_up_once(spark):
    suppliers = spark.createDataFrame([(f"s{i:02}", n) for i, n in enumerate(["Boga"] * 7 + ["boga", "Bali Boga", "Tea & Co", None])], "id string, name string")
    asked = spark.createDataFrame([(1, " boga"), (2, "BOGA "), (3, "bali"), (4, "co tea"), (5, "x  y"), (6, " "), (7, None), (1, "tea")], "item_id long, name string")
    found = search.match_supplier(asked, suppliers)
    assert "NestedLoop" not in planned(found) and "Cartesian" not in planned(found)
    got = sorted((r["item_id"], r["supplier_id"], r["tier"]) for r in found.collect())
    assert got == [(i, f"s0{j}", 1) for i in (1, 2) for j in range(5)] + [(3, "s08", 2), (4, "s09", 3)]


def test_trigram_pairs_are_made_once_and_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(search, "GRAM_ROWS", 3)
    monkeypatch.setattr(search, "SAME_ROWS", 2)
    names = spark.createDataFrame([(i, f"shop 00{i % 3}") for i in range(15)] + [(20, None), (21, "")], "id long, n string")
    asked = spark.createDataFrame([(1, "shop 001"), (2, "Shop 001"), (3, "")], "k long, q string")
    found = search.trigram_matches(asked, names, "k", "q", "id", "n", 0.9)
    assert "Broadcast" not in planned(found)
    assert sorted((r["k"], r["id"], r["similarity"]) for r in found.collect()) == [(k, i, 1.0) for k in (1, 2) for i in (1, 4, 7, 10, 13)]


def test_trigrams_of_a_text_are_worked_out_once_and_its_questions_asked_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "SAME_QUESTIONS", 4)
    monkeypatch.setattr(search, "GRAM_ROWS", 3)
    names = spark.createDataFrame([(i, ("shop 00%d", "SHOP-00%d!")[i % 2] % (i % 3)) for i in range(30)] + [(40, "?!"), (41, None)], "id long, n string")
    asked = spark.createDataFrame([(i, "Shop 001") for i in range(10)] + [(20, "shop"), (21, "xyz"), (22, "?!"), (23, None)], "k long, q string")
    found = search.trigram_matches(asked, names, "k", "q", "id", "n", 0.3)
    lines = planned(found).splitlines()
    assert not any("regexp_replace" in line for line, below in zip(lines, lines[1:]) if "Scan" in below)
    assert "/ 4.0" in planned(found)
    got = sorted((r["k"], r["id"], round(r["similarity"], 9)) for r in found.collect())
    whole = {i: 1.0 if i % 3 == 1 else round(7 / 11, 9) for i in range(30)}
    assert got == [(k, i, whole[i]) for k in range(10) for i in range(30)] + [(20, i, round(5 / 9, 9)) for i in range(30)]


def test_a_question_asks_no_further_than_a_trigram_of_all_names(spark):
    names = spark.createDataFrame([(i, f"supplier {i:03}") for i in range(40)], "id long, n string")
    asked = names.where("id % 20 = 0").withColumnsRenamed({"id": "k", "n": "q"})
    rows = search.trigram_matches(asked, names, "k", "q", "id", "n", 0.3)
    assert rows.count() == 80
    assert "ubquery" in planned(rows) and "Broadcast" not in planned(rows)


def test_nearest_vector_in_blocks_of_products(spark, monkeypatch):
    monkeypatch.setattr(vectors, "RING_ROWS", 4)
    monkeypatch.setattr(vectors, "ASKED_ROWS", 3)
    rows = [(i, [math.cos(i % 7), math.sin(i % 7)], "x" if i % 2 else "y") for i in range(20)] + [(30, None, "x"), (31, [0.0, 0.0], "x"), (32, [None, 1.0], "y"), (33, [1.0], "x"), (34, [1e200, 1e200], "y"), (35, [1.0, 0.0], None)]
    df = spark.createDataFrame(rows, "id long, v array<double>, c string")
    found = search.nearest_vector(df.withColumnRenamed("id", "k"), df, "k", "id", "v", "c", lambda _: F.lit(0.2), others_only=True)
    assert "CoGroups" in planned(found)
    pairs = df.selectExpr("id AS k", "v AS a", "c").join(df.selectExpr("id", "v AS b", "c"), "c").where("k <> id").select("k", "id", similarity.cosine(F.col("a"), F.col("b")).alias("s")).collect()
    want = {k: max((r["s"], -r["id"]) for r in pairs if r["k"] == k) for k in {r["k"] for r in pairs}}
    got = {r["k"]: (r["similarity"], -r["id"]) for r in found.collect()}
    assert got == {k: x for k, x in want.items() if x[0] >= 0.2} and len(got) > 15
