import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pricequarry.llm import language_id as L

EN = "the quick brown fox jumps over the lazy dog and then it walks home through the green hills with all the other animals"
DE = "der schnelle braune fuchs springt über den faulen hund und dann geht er nach hause durch die grünen hügel mit den tieren"
ES = "el rápido zorro marrón salta sobre el perro perezoso y luego camina a casa por las verdes colinas con los otros animales"


@pytest.fixture(scope="module")
def labelled(spark):
    rows, rng = [], np.random.default_rng(2)
    for lang, text in (("en", EN), ("de", DE), ("es", ES)):
        words = text.split(" ")
        rows += [(lang, " ".join(rng.choice(words, 40))) for _ in range(60)]
    rows = [(i, t, lang) for i, (lang, t) in enumerate(rows)] + [(900, None, "en"), (901, "x", None), (902, "", "fr")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.fixture(scope="module")
def model(labelled):
    return L.learn(labelled)


def logs_of(model, codes):
    """(languages, characters after the third) log-probabilities."""
    logs, number = model.char_logs(np.array(codes, np.uint32), list(range(len(model.langs))))
    return logs[:, number]


def test_probabilities_add_up(model):
    """Over all characters of the alphabet, known to the language or not, and one for all others, after any context."""
    alphabet = sorted({int(k) for t in model.tables() for k in t.keys[1]})
    assert len(alphabet) + 1 == model.alphabet
    for context in ("", " ", "th", "und", "xq", "ñ"):
        before = [0, 0, *([ord(c) for c in context] or [32])][-3:]
        logs = np.array([logs_of(model, [*before, c])[:, -1] for c in [*alphabet, 0x4E00]])
        assert np.exp2(logs.astype(np.float64)).sum(axis=0) == pytest.approx(1, abs=2e-3)


class Plain:
    """Interpolated Kneser-Ney by its definition, over dictionaries of strings."""

    def __init__(self, texts, order, alphabet):
        self.alphabet = alphabet
        words = [" " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " " for t in texts]
        grams = {n: Counter(w[i : i + n] for w in words for i in range(len(w) - n + 1)) for n in range(1, order + 1)}
        self.c = {n: grams[n] if n == order else Counter(g[1:] for g in grams[n + 1]) for n in grams}
        for n in grams:
            for g in grams[n]:
                self.c[n].setdefault(g, 0)
        self.d = {}
        for n, c in self.c.items():
            one, two = sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values())
            self.d[n] = min(0.95, max(0.1, one / max(1, one + 2 * two)))

    def p(self, context, char):
        n = len(context) + 1
        lower = self.p(context[1:], char) if context else 1 / self.alphabet
        follow = {g: v for g, v in self.c[n].items() if g[:-1] == context}
        total = sum(follow.values())
        if not total:
            return lower
        d = self.d[n]
        return max(0.0, follow.get(context + char, 0) - d) / total + d * sum(v > 0 for v in follow.values()) / total * lower


def test_probabilities_are_kneser_ney(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (EN[:60], "en"), (DE[30:], "de"), ("abababa", "en")])]
    model = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))  # few rows: all are learned from
    for k, lang in enumerate(model.langs):
        plain = Plain([t for _, t, x in rows if x == lang], 4, model.alphabet)
        for text in (EN[:70], DE[:70], "zzz abab ñandú"):
            codes = L.letters(text)
            got = logs_of(model, [0, 0, *codes])[k]
            s = "".join(map(chr, codes))
            want = [math.log2(plain.p(s[max(0, i - 3) : i], s[i])) for i in range(1, len(s))]
            assert got == pytest.approx(want, abs=1e-4)


def test_short_texts_of_a_language_that_was_not_learned_are_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id % 4 = 0")
    model = L.learn(docs.where("lang IN ('en', 'es')"))
    # whole words, 40 to 60 letters of them
    short = docs.where("lang IN ('en', 'de')").select("lang", F.regexp_extract("text", r"^(?:\S+\s+){2}((?:\S+\s+)*?\S{1,}.{40,60})\s", 1).alias("text")).where("length(text) BETWEEN 40 AND 70")
    rate = {r["lang"]: r["rate"] for r in L.identify(short, model).groupBy("lang").agg(F.avg(F.col("rejected").cast("int")).alias("rate")).collect()}
    assert rate["de"] > 0.8 and rate["en"] < 0.01


def test_repeated_rows_and_many_languages(spark, labelled, model):
    twice = labelled.where("text <> ''").limit(20)
    got = L.identify(twice.unionByName(twice), model).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lang_pred", "score", "bits", "rejected").alias("d")).collect()
    assert {(r["n"], r["d"]) for r in got} == {(2, 1)}
    rng = np.random.default_rng(4)
    rows = [(k, "".join(rng.choice(list("abcdefghij "), 60)), f"l{k % 90:02d}") for k in range(180)]
    many = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(many.langs) == 90


def test_scores_do_not_depend_on_the_batch(model):
    texts = [EN, "", DE[:3], "a", ES * 200, "日本", DE]
    together, n = model.entropies(texts)
    for i, t in enumerate(texts):
        alone, m = model.entropies([t])
        assert m[0] == n[i]
        assert together[i] == pytest.approx(alone[0], rel=1e-4)


def test_long_texts_in_pieces(model, monkeypatch):
    want = model.entropies([ES * 20])[0]
    monkeypatch.setattr(L, "_CHUNK", 100)
    assert model.entropies([ES * 20])[0] == pytest.approx(want, rel=1e-5)


def test_edge_rows(spark, model):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? \n"), (4, "THE LAZY DOG."), (5, "über den hügel"), (6, "zzqx " * 400), (None, EN * 500)], "doc_id long, text string").withColumns({"score": F.lit("mine"), "Bits": F.lit(1)})
    got = {r["doc_id"]: r for r in L.identify(df, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, None)] == ["und"] * 3 + ["en", "de", "en"]
    assert [got[i]["rejected"] for i in (1, 2, 3, 4, 5, None)] == [True] * 3 + [False] * 3
    assert got[6]["rejected"]
    assert all(0 <= r["_score"] <= 1 for r in got.values())
    assert got[1]["_score"] == 0 and got[4]["score"] == "mine"


def test_without_labels(docs, empty):
    assert L.learn(docs.where("lang IS NULL")) is None
    assert {r["lang_pred"] for r in L.identify(docs, None).collect()} == {"und"}
    assert L.identify(empty, L.learn(empty)).count() == 0


def test_held_out_accuracy(spark):
    got = L.op4_language_id(spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    rate = got.where("held_out").join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.avg(F.col("rejected").cast("int"))).first()
    assert rate[0] > 0.98 and rate[1] < 0.01


def test_a_language_of_few_rows_sets_no_limit_by_what_it_is_learned_from(spark):
    rows = [(i, "the cat sat on the mat and the dog ran after it " * 3, "en") for i in range(40)] + [(100 + i, "abcd efgh", "xx") for i in range(3)]
    model = L.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    at = model.langs.index("xx")
    # eight letters and the space
    assert set(model.limits[at]) == {np.log2(1 + 9)}
