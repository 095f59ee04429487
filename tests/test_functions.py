"""Golden values of the domain's pure functions."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricequarry.functions import names, prices, similarity, units
from pricequarry.functions.expressions import half_up


def evaluate(spark, expression, rows, schema):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + schema)
    out = [r["x"] for r in df.select("i", expression.alias("x")).orderBy("i").collect()]
    return [x.asDict() if isinstance(x, T.Row) else x for x in out]


def check(spark, expression, table, schema="a string"):
    got = evaluate(spark, expression, [k if isinstance(k, tuple) else (k,) for k, _ in table], schema)
    assert got == [pytest.approx(v) if isinstance(v, float) else v for _, v in table]


def test_normalize_price(spark):
    check(spark, prices.normalize_price(F.col("a")), [("50K", 5e4), ("1.5K", 1500.0), ("2.5M", 2.5e6), ("50rb", 5e4), ("100 ribu", 1e5), ("Rp. 25k", 25e3), ("1.500.000", 1.5e6), ("99", None), ("10000001", None), ("K50", None), ("-100", None), ("IDR 15,000", 15e3), ("", None), (None, None), ("about 250 each", 250.0)])


def test_other_price_readings(spark):
    check(spark, prices.sheet_price(F.col("a")), [("Rp 12.500", 12500.0), ("1,234.50", 123450.0), ("x", None), ("0", None), (None, None)])
    check(spark, prices.suffix_price(F.col("a")), [("1.5k", 15e3), ("2jt", 2e6), ("Rp 25 rb", 25e3), ("abc", None)])
    check(spark, prices.local_number(F.col("a")), [("12.500", 12500.0), ("12,5", 12.5), ("1.234,5", 1234.5), ("7.25", 7.25), ("", None)])
    check(spark, prices.trailing_price(F.col("a")), [("Tomato cherry 25.000", 25e3), ("Basil 12K ", 12e3), ("no price", None)])
    check(spark, prices.signed_price(F.col("a")), [("1,234.5", 1234.5), ("-20", -20.0), ("x", None)])
    check(spark, prices.extract_currency(F.col("a")), [("Rp 5", "IDR"), ("$5", "USD"), ("5 EUR", "EUR"), ("£5", "GBP"), ("5", "IDR"), (None, "IDR")])


def test_price_grammar(spark):
    got = evaluate(spark, prices.parse_price_text(F.col("a")), [("10k - 12k",), ("3 for 50k",), ("15.000/kg",), ("20k -> 15k",), ("Rp 25.000",), ("call us",)], "a string")
    assert [(g["kind"], g["low"], g["high"], g["quantity"], g["unit"]) for g in got] == [("range", 1e4, 1.2e4, None, None), ("bulk", 5e4, None, 3.0, None), ("unit_price", 1.5e4, None, None, "kg"), ("discount", 1.5e4, 2e4, None, None), ("single", 2.5e4, None, None, None), ("unknown", None, None, None, None)]


def test_misread_prices(spark):
    check(spark, prices.looks_misread(F.col("a")), [(316.35, True), (316.5, True), (316.0, False), (25000.0, False), (1200.05, False)], "a double")
    check(spark, prices.suggest_price(F.col("a")), [(316.35, 316350.0), (25000.0, None), (1.5, 1500.0)], "a double")
    got = evaluate(spark, prices.repair_invoice(F.col("u"), F.col("q"), F.col("t")), [(15.0, 2.0, 30.0), (20000.0, 2.0, 30000.0), (500.0, 1.0, 0.0)], "u double, q double, t double")
    assert got == [{"unit": 15000.0, "total": 30000.0}, {"unit": 15000.0, "total": 30000.0}, {"unit": 500000.0, "total": 0.0}]
    check(spark, prices.short_price(F.col("a")), [(1.5e6, "1.5M"), (25e3, "25K"), (999.0, "999")], "a double")
    check(spark, prices.long_price(F.col("a")), [(1.5e6, "Rp 1.500.000")], "a double")
    check(spark, half_up(F.col("a")), [(-2.5, -2.0), (2.5, 3.0), (None, None)], "a double")
    check(spark, half_up(F.col("a"), 2), [(1.005, 1.0), (1.00499999, 1.0), (2.675, 2.68), (1.015, 1.01)], "a double")


def test_unit_prices(spark):
    rows = "p double, q double, u string"
    p, q, u = F.col("p"), F.col("q"), F.col("u")
    check(spark, units.unit_price(p, q, u), [((50000.0, 5.0, "kg"), 10000.0), ((2000.0, 500.0, "g"), 4000.0), ((24000.0, 1.0, "dozen"), 2000.0), ((1.0, 1.0, "parsec"), None), ((0.0, 1.0, "kg"), None), ((5.0, 0.0, "kg"), None)], rows)
    check(spark, units.old_unit_price(p, q, u), [((50000.0, 5.0, "kg"), 10000.0), ((2000.0, 500.0, "g"), 4000.0), ((5000.0, None, "kg"), 5000.0), ((10000.0, 5.0, "unknown"), 2000.0), ((24000.0, 1.0, "dozen"), 24000.0), ((5.0, 0.0, "kg"), None)], rows)
    check(spark, units.simple_unit_price(p, q, u), [((25000.0, 0.2, "kg"), 125000.0), ((10000.0, 500.0, "ml"), 20000.0), ((24000.0, 1.0, "dozen"), 2000.0), ((1.0, None, "kg"), None)], rows)


def test_units(spark):
    check(spark, units.canonical_unit(F.col("a")), [("K.G.", "kg"), (" Litre ", "ltr"), ("lusin", "pcs"), ("ikat", "bunch"), ("x", None), (None, None)])
    check(spark, units.standard_unit(F.col("a")), [("", "pcs"), (None, "pcs"), ("liter", "L"), ("500ml", "mL"), ("gram", "g"), ("foo", "foo"), ("Dozen", "pcs")])
    check(spark, units.convert_quantity(F.lit(500.0), F.col("a"), F.lit("kg")), [("g", 0.5), ("l", None)])
    check(spark, units.convert_quantity(F.lit(0.0), F.col("a"), F.lit("kg")), [("g", None)])
    check(spark, units.ingested_unit(F.col("a")), [("Box", "box"), (" packet ", "pack"), ("DOZEN", "dozen"), ("lbs", "lb"), ("Litres", "l"), ("ikat", "bunch"), (None, None)])
    check(spark, units.formatted_unit(F.col("a")), [("kotak", "box"), ("ml", "L"), ("paket", "pack"), ("lb", "lb")])
    check(spark, units.units_of_kind(F.col("a")), [("volume", ["l", "ltr", "liter", "litre", "ml", "milliliter"]), ("x", [])])
    got = evaluate(spark, units.normalize_weight(F.col("a")), [("500 gr",), ("1,5 kg",), ("2 lb",), ("3",), ("per kilo",), ("x",), (None,)], "a string")
    assert [(g["value"], g["unit"]) for g in got] == [(500.0, "g"), (1500.0, "kg"), (907.184, "lb"), (3.0, "pcs"), (1000.0, "kg"), (None, "pcs"), (None, "pcs")]


def test_names(spark):
    check(spark, names.matching_name(F.col("a")), [("Champiñón  (fresh)!", "champi n fresh"), (" a_b ", "a_b"), ("", "")])
    check(spark, names.translated_name(F.col("a")), [("Wortel Lokal!", "carrot lokal"), ("Champiñón champiñones", "mushroom"), ("kangkung", "water spinach"), ("red red wine", "red wine")])
    check(spark, names.core_noun(F.col("a")), [("local fresh carrot", "carrot"), ("chicken", ""), ("ayam", ""), ("sweet potato", "potato")])
    check(spark, names.data_name(F.col("a")), [("  “Baby” –  corn. ", 'Baby" - corn'), (None, "")])
    check(spark, names.name_fault(F.col("a")), [("125", "number"), ("12.5", None), ("500 gr", "weight"), ("2 LB", "weight"), ("3 pcs", None), ("IDR", "currency"), ("sgd", "currency"), ("ab", "short"), ("OK", None), ("kg", None), ("", None), (None, None), ("Tomato", None)])
    check(spark, names.is_category_heading(F.col("a"), F.lit(False)), [("VEGETABLES", True), ("Red onion", False), ("ab", False), ("Box 12", False)])
    check(spark, names.bound_category(F.col("a")), [("Cheddar cheese", "cheese"), ("Kopi Bali", "beverages"), ("thing", None)])
    check(spark, names.supplier_from_file(F.col("a")), [("PT. Sayur Bali 12_05 x.pdf", "Sayur Bali"), ("widi WIGUNA 3.xlsx", "Widi Wiguna"), ("Bali Seafood.csv", "Bali_seafood"), ("island+organics.jpg", "Island Organics Bali"), (".pdf", "Temporary Processing"), ("", "Temporary Processing")])
    check(spark, names.title_of_file(F.col("a")), [("Bali Boga_price-list 2024-01-05 (1) (2).xlsx", "Bali Boga (2)"), ("catalog final.pdf", "catalog final"), ("Sai v2 updated.csv", "Sai"), ("", None)])
    check(spark, names.first_word_of_file(F.col("a")), [("milk.up-2024.xls", "milk up"), ("Bali_x.pdf", "Bali")])
    check(spark, names.safe_file_name(F.col("a")), [("My  Liste é (1)__x.XLSX", "my_liste_1_x.xlsx")])
    check(spark, names.needs_translation(F.col("a"), F.lit("Red carrot")), [("Wortel MERAH", True), ("red CARROT", False), ("merahan", False), (None, False)])
    check(spark, names.supplier_from_text(F.col("a")), [("Prices\nSupplier: Bali Boga\nx", "Bali Boga"), ("from PT. Maju Jaya, Denpasar", "PT. Maju Jaya"), ("none", None)])
    check(spark, names.is_email(F.col("a")), [("a@b.co", True), ("a b@c", False)])
    check(spark, names.shortened(F.lit("abcdefghij"), 8), [("x", "abcde...")])


PAIRS = [(("carrot", "Carrot!"), 100.0), (("english spinach", "Spinach English"), 0.0), (("fresh carrot big", "Big fresh carrot"), 95.0), (("potato", "sweet potato"), 0.0), (("sweet potato", "potato"), 0.0), (("carrot", "tomato"), 0.0), (("almond", "roasted almond"), (0.5 + 0.3 + 0.1 - 0.05) * 80), (("red onion", "white onion"), 0.0), (("tomato", "cherry tomato"), (0.5 + 0.3 - 0.05) * 80)]


def test_name_similarity(spark):
    check(spark, similarity.name_similarity(F.col("a"), F.col("b")), PAIRS, "a string, b string")


def test_product_names(spark):
    check(spark, names.is_product_name(F.col("a")), [("10 x 5 kg", False), ("3 box", False), ("12", False), ("1A", False), ("250gr", False), ("5x6 pcs", False), ("Tomato", True), (" Tea ", True), ("to", False), ("%%%", False), ("Tomato 5 kg", True), ("", False), (None, False), ("2.5 x 3 abc", False), ("Ä!b", True)])


def test_categories(spark):
    from pricequarry.functions import lexicon as W

    check(spark, names.categorize(F.col("a")), [("Baby Corn", "Vegetables"), ("Peanut", "Vegetables"), ("Smoked bacon", "Meat"), ("Oat milk", "Grains"), ("Whipping CREAM", "Dairy"), ("Soap", "Other")])
    check(spark, names.categorize(F.col("a"), W.SHARED_CATEGORIES, whole_words=True), [("Susu segar", "Dairy"), ("Eggplant", "Other"), ("2 eggs", "Eggs"), ("ice cream", "Dairy"), ("es krim", "Dairy"), ("Frozen peas", "Frozen"), ("teh botol", "Beverages")])
    check(spark, names.categorize(F.col("a"), W.REPAIR_CATEGORIES, "OTHER"), [("Plantain", "FRUIT"), ("Meat pepper", "VEGETABLE"), ("tuna", "SEAFOOD"), ("x", "OTHER")])
    check(spark, names.categorize(F.col("a"), W.DAIRY_CATEGORIES, "OTHER"), [("Kefir", "DAIRY"), ("dumpling", "MEAT"), ("cheese cake", "DAIRY"), ("cookie", "OTHER")])


def test_more_price_readers(spark):
    check(spark, prices.appended_price(F.col("a")), [("39rb", 39000.0), ("1.5jt", 15e6), ("Rp 25.000", 25000.0), ("2 juta", 2.0), ("10ribu", 10000.0), ("39K", 39000.0), ("abc", 0.0), ("", 0.0), (None, 0.0)])
    check(spark, prices.pdf_price(F.col("a")), [("1000ML IDR 104,000", 104000.0), ("104,000 IDR", 104000.0), ("Beef 316.350", 316350.0), ("2 pcs 15000", 15000.0), ("Rp 250", 250.0), ("12.5", 12.5), ("1.2.3", 0.0), ("none", 0.0), ("", 0.0), (None, 0.0)])
    check(spark, prices.table_price(F.col("a")), [("Rp. 50.000", 50000.0), ("IDR 12,50", 12.5), ("$ 7.255", 7255.0), ("12.3456", 12.34), ("x", None), ("", None), (None, None)])


def test_costs(spark):
    cost = prices.token_cost(F.col("m"), F.lit(1000.0), F.lit(2000.0))
    check(spark, cost, [("gpt-4o-mini-x", 0.00135), ("gpt-4o", 0.0225), ("gpt-o3-mini", 0.00135), ("gpt-o3", 0.0225), ("gpt-4", 0.0225), ("gpt-3.5-turbo", 0.0035), ("other", 0.00135)], "m string")
    check(spark, prices.service_cost(F.col("m"), F.lit(1000.0), F.lit(1000.0)), [("gemini-1.5-pro", 0.00625), ("gemini-2.0-flash-exp", 0.0), ("gemini-9", 0.00009375)], "m string")
    check(spark, prices.shown_cost(F.col("c")), [(0.0001234, "$0.000123"), (0.00512, "$0.00512"), (1.5, "$1.5000")], "c double")


def test_other_similarities(spark):
    two = "a string, b string"
    check(spark, similarity.edit_similarity(F.col("a"), F.col("b")), [(("kitten", "Sitting"), 1 - 3 / 7), (("", ""), 1.0)], two)
    check(spark, similarity.token_jaccard(F.col("a"), F.col("b")), [(("red onion", "Onion"), 0.5), (("", ""), 0.0)], two)
    check(spark, similarity.trigram_similarity(similarity.trigrams(F.col("a")), similarity.trigrams(F.col("b"))), [(("word", "two words"), 4 / 11), (("cat", "cat"), 1.0), (("", "x"), 0.0)], two)
    check(spark, similarity.cosine(F.col("a"), F.col("b")), [(([1.0, 0.0], [1.0, 1.0]), 2**-0.5), (([0.0, 0.0], [1.0, 1.0]), 0.0)], "a array<float>, b array<float>")
    check(spark, similarity.misreadings(F.col("a")), [("mozarella", ["mozzarella", "mozarella"]), ("mayonaise", ["mayonaise", "mayonnaise"])])


def test_standard_names(spark):
    from pricequarry.functions import standardize as S

    cases = [
        (("Wortel Segar 500 gr", "gram"), ("carrot fresh 500 gr", "g", None, "500 gr", "id", 0.8)),
        (("poteto", None), ("potato", "pcs", None, None, "en", 0.5)),
        (("Indomie Mie Instan 5 pcs", None), ("instant-noodle indomie 5 pcs", "pcs", "indomie", "5 pcs", "en", 0.8)),
        (("Fresh chiken  breast & wing 1kg", "Dus"), ("chicken breast fresh wing 1kg", "box", None, "1kg", "en", 0.7)),
        (("Kecap manis ABC 600ml", ""), ("sweet-soy-sauce abc 600ml", "mL", "abc", "600ml", "mixed", 0.6)),
        (("Susu UHT", "ltr."), ("milk uht", "L", None, None, "mixed", 0.6)),
        (("bananas bananas the", None), ("bananas", "pcs", None, None, "en", 0.7)),
        (("", "330ml"), ("", "mL", None, None, "en", 0.5)),
        ((None, "crate/"), ("", "crate", None, None, "en", 0.5)),
    ]
    got = evaluate(spark, S.standardize(F.col("a"), F.col("u")), [k for k, _ in cases], "a string, u string")
    for g, ((_, _), want) in zip(got, cases, strict=True):
        assert tuple(g[f] for f in ("name", "unit", "brand", "size", "language")) == want[:5]
        assert g["confidence"] == pytest.approx(want[5])
    check(spark, units.service_unit(F.col("a")), [("Kg.", "kg"), ("ons", "oz"), ("ijs", "pcs"), ("5 kg", "kg"), ("rb", "1000"), ("lusin", "dozen"), ("kodi", "score"), ("x9", "x9"), ("", "pcs"), (None, "pcs")])
    check(spark, S.upper_unit(F.col("a")), [("500g", "500GRAM"), ("pcs", "PIECE"), ("crate", "CRATE"), (None, "PIECE"), (" 1.5 kg ", "1.5KG")])
    critical, wrong = {"kangkung": "water spinach"}, {"kangkung": ["kale"]}
    check(spark, S.translation_quality(F.col("a"), F.col("b"), critical, wrong), [(("Kangkung", "water spinach"), 100), (("kangkung", "kale"), 50), (("x", "kale"), 100)], "a string, b string")
    check(spark, S.fixed_translation(F.col("a"), F.col("b"), critical, wrong), [(("kangkung", "Kale fresh"), "water spinach fresh"), (("x", "kale"), "kale")], "a string, b string")


def test_rich_price_grammar(spark):
    """What the price grammar is to give for each of its forms."""
    cases = {
        "15000": ("single", 15000.0), "15.000": ("single", 15000.0), "15,000": ("single", 15000.0), "15k": ("single", 15000.0), "15rb": ("single", 15000.0), "2jt": ("single", 2e6), "Rp 15.000": ("single", 15000.0), "IDR 25000": ("single", 25000.0),
        "15.000,50": ("single", 15000.5), "15,000.50": ("single", 15000.5), "500 rb": ("single", 5e5), "1b": ("single", 1e9), "  Harga: Rp 15.000  ": ("single", 15000.0), "Cost = 25000": ("single", 25000.0),
        "15000-20000": ("range", 17500.0), "15.000-20.000": ("range", 17500.0), "15-20k": ("range", 17500.0), "15rb-25rb": ("range", 20000.0),
        "17/15": ("fraction", 17.0), "17000/15000": ("fraction", 17000.0), "25/22k": ("fraction", 25000.0),
        "250@10pcs": ("bulk", 250.0), "15k@5kg": ("bulk", 15000.0), "250 per 10pcs": ("bulk", 250.0), "250/10pcs": ("bulk", 250.0),
        "15000/kg": ("unit_price", 15000.0), "15k/kg": ("unit_price", 15000.0), "100/piece": ("unit_price", 100.0),
        "20000 (disc 10%)": ("discount", 20000.0), "20k (disc 15%)": ("discount", 20000.0), "15000 - 10%": ("discount", 15000.0), "25000 diskon 20%": ("discount", 25000.0),
        "min 5pcs = 15k": ("conditional", 15000.0), "minimum 10kg = 25000": ("conditional", 25000.0), "max 20 piece = 100": ("conditional", 100.0),
        "abc": ("unknown", None), "": ("unknown", None), "---": ("unknown", None), "99999999999": ("unknown", None),
    }
    rows = evaluate(spark, prices.parse_price_text(F.col("a")), [(x,) for x in cases], "a string")
    assert {x: (r["kind"], r["primary"]) for x, r in zip(cases, rows, strict=True)} == cases
    by = dict(zip(cases, rows, strict=True))
    assert by["15-20k"]["low"] == 15000.0 and by["15-20k"]["high"] == 20000.0
    assert by["25/22k"]["secondary"] == 22000.0 and by["17/15"]["secondary"] == 15.0
    assert (by["15k@5kg"]["quantity"], by["15k@5kg"]["unit"]) == (5.0, "kg") and by["15k/kg"]["unit"] == "kg"
    assert by["20k (disc 15%)"]["discount"] == 15.0 and by["20k (disc 15%)"]["secondary"] > 20000.0
    assert (by["max 20 piece = 100"]["quantity"], by["max 20 piece = 100"]["unit"]) == (20.0, "piece")
    marks = {"$100": "USD", "€50": "EUR", "S$75": "SGD", "Rp 15000": "IDR", "15000 IDR": "IDR", "RM 100": "MYR"}
    rows = evaluate(spark, prices.parse_price_text(F.col("a")), [(x,) for x in marks], "a string")
    assert [(r["kind"], r["currency"]) for r in rows] == [("single", c) for c in marks.values()]
