"""The store of an upload against the same done row by row."""

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from pricequarry.operators import ingest

ROWS = "supplier_id string, position long, name string, raw_name string, standardized_name string, category string, unit string, description string, amount double, products string"
PRODUCTS = "id string, raw_name string, name string, standardized_name string, category string, unit string, standardized_unit string, description string, created_at timestamp_ntz"
PRICES = "id string, amount double, unit string, unit_price double, supplier_id string, product_id string, upload_id string, valid_from timestamp_ntz, valid_to timestamp_ntz, created_at timestamp_ntz"
NOW, THEN = datetime(2030, 1, 1), datetime(2020, 1, 1)
UNITS = {"Boxes": "box", "kg": "kg", " Kilo": "kg"}


def by_rows(rows, products, prices):
    """Suppliers in order; of each the best row of every name and unit, one after the other."""
    products = {(p[3], p[6]): dict(zip(("id", "raw_name", "name", "standardized_name", "category", "unit", "standardized_unit", "description"), p)) for p in products}
    prices = [dict(zip(("amount", "unit", "supplier_id", "product_id", "valid_to"), (p[1], p[2], p[4], p[5], p[8]))) for p in prices]
    log, rejected = [], []
    groups = {}
    for s, pos, name, raw, std, cat, unit, desc, amount, _ in rows:
        if amount and amount > 0:
            key = (s, std or " ".join(name.lower().split()), UNITS.get(unit))
            best = groups.get(key)
            if best is None or (amount, pos) < best[:2]:
                groups[key] = (amount, pos, name, raw, cat, unit, desc)
    for (s, std, u), (amount, _, name, raw, cat, unit, desc) in sorted(groups.items(), key=lambda g: str(g[0])):
        if not name.strip() or not std or not u or amount <= 0.01 or not s:
            rejected.append((s, std, u))
            continue
        p = products.setdefault((std, u), {"id": None, "category": None, "description": None, "standardized_name": std, "standardized_unit": u})
        p.update(name=name.strip(), raw_name=(raw or name).strip(), unit=unit.strip())
        p.update({k: v for k, v in (("category", cat), ("description", desc)) if v is not None})
        pid = p["id"] or f"{std}|{u}"
        current = [x for x in prices if x["product_id"] == pid and x["supplier_id"] == s and x["valid_to"] is None]
        if any(x["amount"] == amount and x["unit"] == unit for x in current):
            continue
        for x in current:
            x["valid_to"] = NOW
            log.append((pid, s, amount, x["amount"], "api"))
        if not current:
            log.append((pid, s, amount, None, "initial"))
        prices.append({"amount": amount, "unit": unit, "supplier_id": s, "product_id": pid, "valid_to": None})
    return products, prices, log, rejected


def ordered(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("seed", (1, 2))
def test_as_row_by_row(spark, seed):
    rng = random.Random(seed)
    pick = rng.choice
    rows = [(pick(["s1", "s1", "s1", "s2", None]), i, pick(["Red  Tea", "salt", "OIL", " "]), pick(["raw", None]), pick([None, None, "green tea"]), pick(["C", None]), pick(["Boxes", "kg", " Kilo", None]), pick(["d", None]), pick([5.0, 7.0, 7.5, 0.005, 0.0, -1.0, None]), "clash") for i in range(60)]
    rows += rows[:10]
    products = [("p1", "x", "x", "salt", "Old", "kg", "kg", "kept", THEN), ("p2", "x", "x", "red tea", "Old", "box", "box", None, THEN), ("p9", "x", "x", None, "Old", "kg", None, None, THEN)]
    prices = [(f"h{i}", pick([5.0, 7.0]), pick(["kg", "Boxes", " Kilo"]), None, pick(["s1", "s2"]), pick(["p1", "p2"]), None, THEN, pick([None, THEN]), THEN) for i in range(6)]
    p_df, h_df, r_df = spark.createDataFrame(products, PRODUCTS), spark.createDataFrame(prices, PRICES), spark.createDataFrame(rows, ROWS)
    got = ingest.stored(r_df, p_df, h_df, F.lit("2030-01-01").cast("timestamp_ntz"), "u")
    want_products, want_prices, want_log, want_rejected = by_rows(rows, products, prices)
    names = {r["id"]: f"{r['standardized_name']}|{r['standardized_unit']}" for r in got.products.collect() if r["id"] not in ("p1", "p2", "p9")}
    fields = ("name", "raw_name", "category", "unit", "description")
    assert ordered((names.get(r["id"], r["id"]), *[r[f] for f in fields]) for r in got.products.collect()) == ordered((p["id"] or f"{p['standardized_name']}|{p['standardized_unit']}", *[p[f] for f in fields]) for p in want_products.values())
    assert ordered((r["amount"], r["unit"], r["supplier_id"], names.get(r["product_id"], r["product_id"]), r["valid_to"]) for r in got.prices.collect()) == ordered(tuple(p.values()) for p in want_prices)
    assert ordered((names.get(r["product_id"], r["product_id"]), r["supplier_id"], r["price"], r["changed_from"], r["change_reason"]) for r in got.history.collect()) == ordered(want_log)
    assert ordered((r["supplier_id"], r["standardized_name"], r["standardized_unit"]) for r in got.rejected.collect()) == ordered(want_rejected)
    # the same upload again
    again = ingest.stored(r_df, got.products, got.prices, F.lit("2031-01-01").cast("timestamp_ntz"), "v")
    assert again.history.count() == 0
    assert ordered(again.prices.collect()) == ordered(got.prices.collect())
    assert ordered(again.products.collect()) == ordered(got.products.collect())


def test_an_empty_upload_changes_nothing(spark):
    products = spark.createDataFrame([("p1", "x", "x", "salt", "Old", "kg", "kg", None, THEN)], PRODUCTS)
    prices = spark.createDataFrame([("h", 5.0, "kg", None, "s1", "p1", None, THEN, None, THEN)], PRICES)
    got = ingest.stored(spark.createDataFrame([], ROWS), products, prices, F.lit("2030-01-01").cast("timestamp_ntz"))
    assert got.products.collect() == products.collect() and got.prices.collect() == prices.collect()
    assert got.history.count() == got.rejected.count() == 0
