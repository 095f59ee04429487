"""Predicates, pages, and the search for catalogue entries that a free-text name means."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import all_of, any_of
from ..functions.names import tokens, translated_name
from ..functions.similarity import cosine_limit, misreadings, name_parts, parts_similarity, trigram_similarity, trigrams
from ..functions.units import canonical_unit

#: Questions that are broadcast at once; more are dealt out in blocks.
MOST_QUESTIONS = 10_000
#: Candidates of a question that are scored.
CANDIDATES = 20
#: Names of one trigram that a task compares with the questions that have it; those of more are dealt out.
GRAM_ROWS = 512
#: Rows of the same text that are compared as one.
SAME_ROWS = 1_000
#: Questions of the same text that are compared as one: a task holds what these and a text's rows make until it is passed on.
SAME_QUESTIONS = 16


def contains_text(columns: Sequence[str | Column], text: str | Column) -> Column:
    """Whether any column contains the text, whatever its case; ``%`` and ``_`` stand for themselves."""
    needle = F.lower(F.lit(text) if isinstance(text, str) else text)
    return any_of(F.coalesce(F.contains(F.lower(F.col(c) if isinstance(c, str) else c), needle), F.lit(False)) for c in columns)


def optional(**conditions: tuple[object, Column]) -> Column:
    """The conditions whose value is given, joined by AND."""
    return all_of(c for value, c in conditions.values() if value is not None)


def page(df: DataFrame, order: Sequence[Column | str], number: int = 1, size: int = 50) -> tuple[DataFrame, int, int]:
    """A page (1 up; 1 to 100 rows) by a total order, the number of rows and of pages."""
    size, number = min(100, max(1, size)), max(1, number)
    total = df.count()
    return df.orderBy(*order).offset((number - 1) * size).limit(size), total, -(-total // size)


def _blocks(questions: DataFrame, key: str, most: int = MOST_QUESTIONS) -> list[DataFrame]:
    """The questions in blocks of about ``most`` rows by a hash of the key, each for broadcast; one block if they are few."""
    n = -(-questions.count() // most)
    return [F.broadcast(questions if n <= 1 else questions.where(F.pmod(F.xxhash64(key), F.lit(n)) == i)) for i in range(max(1, n))]


def against(rows: DataFrame, questions: DataFrame, key: str, most: int = MOST_QUESTIONS) -> DataFrame:
    """Every row beside every question: a stated query set against all rows, a block of questions at a time."""
    return reduce(DataFrame.unionByName, [rows.crossJoin(b) for b in _blocks(questions, key, most)])


#: The longest run of letters by which names are looked up.
GRAM = 3


def grams(text: Column) -> Column:
    """The distinct runs of one to GRAM characters of a text."""

    def runs(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))

    return F.filter(F.array_distinct(F.flatten(F.array(*map(runs, range(1, GRAM + 1))))), lambda g: g != "")


def names_with(needles: DataFrame, names: DataFrame) -> DataFrame:
    """(texts, names): for each array of texts, each once in ``needles``, the arrays of ``names``, each once there too, in one of whose names each text is.

    An index of runs of letters: each needle asks for the names with the rarest run that its texts have, and
    only those are looked through. A run of the needle that no name has ends its search. Equi-joins
    throughout; a run that many names have is split by the skew join. The index is never broadcast, however
    small the files that it comes from.
    """
    index = names.select("names", F.explode(F.array_distinct(F.flatten(F.transform("names", grams)))).alias("gram"))
    held = index.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    # of a text only its longest runs: they are the rarest
    longest = F.flatten(F.transform("texts", lambda t: F.filter(grams(t), lambda g: F.length(g) == F.least(F.length(t), F.lit(GRAM)))))
    asked = needles.select("texts", F.explode(F.array_distinct(longest)).alias("gram")).hint("merge").join(held.hint("merge"), "gram", "left")
    rarest = asked.groupBy("texts").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    pairs = rarest.hint("merge").join(index.hint("merge"), "gram")
    return pairs.where(F.forall("texts", lambda t: F.exists("names", lambda n: F.contains(n, t)))).select("texts", "names")


def first_of(rows: DataFrame, by: str, order: Sequence[str | Column], most: int) -> DataFrame:
    """The first ``most`` rows of each key."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("r") <= most).drop("r")


def products_with(needles: DataFrame, products: DataFrame, most: int = CANDIDATES) -> DataFrame:
    """(texts, product_id): for each array of texts, each once in ``needles``, the first ``most`` products by id of which each text is within a name.

    Products of the same names are found alike, so each set of names is looked through once (:func:`names_with`) and
    stands for the first ``most`` products that have it.
    """
    names = F.transform(F.array("name", "standardized_name", "raw_name"), lambda n: F.lower(F.coalesce(n, F.lit(""))))
    named = first_of(products.select(names.alias("names"), F.col("id").alias("product_id")), "names", ["product_id"], most)
    entries = named.groupBy("names").agg(F.collect_set("product_id").alias("ids"))
    found = names_with(needles, entries.select("names")).hint("merge").join(entries.hint("merge"), "names")
    return first_of(found.select("texts", F.explode("ids").alias("product_id")).distinct(), "texts", ["product_id"], most)


def candidates(questions: DataFrame, products: DataFrame, aliases: DataFrame | None = None, name: str = "product_name", key: str = "item_id", most: int = CANDIDATES) -> DataFrame:
    """(key, product id, tier, position): the catalogue entries of the first tier that finds any for a question.

    Tiers: 1 an alias of the translated name, 2 the translated name within a product's names, 3 the
    name as it is, as an alias and then within, 4 all of several words, 5 any word of more than two letters, 7 a misreading
    undone, the first that finds any. (A sixth, a name of at least four letters as a whole, can find
    nothing that the third has not.) What is searched for is looked up once, however many questions
    ask for it (:func:`products_with`); of a tier's products the first ``most`` by id are kept.
    """
    lower, words = F.lower("q"), tokens(F.col("q"))
    undone = F.transform(misreadings(F.col("q")), lambda x, i: F.struct((F.lit(70) + i).alias("order"), F.array(x).alias("texts")))

    def ask(order: int, texts: Column) -> Column:
        return F.array(F.struct(F.lit(order).alias("order"), texts.alias("texts")))

    long_words = F.filter(F.split(lower, r"\s+"), lambda w: F.length(w) > 2)
    asks = F.concat(
        ask(20, F.array(translated_name(F.col("q")))),
        ask(31, F.array(lower)),
        F.when(F.size(words) > 1, ask(40, F.array_sort(F.array_distinct(words)))).otherwise(F.array().cast("array<struct<order:int,texts:array<string>>>")),
        F.transform(long_words, lambda w: F.struct(F.lit(50).alias("order"), F.array(w).alias("texts"))),
        F.filter(undone, lambda x: x["texts"][0] != lower),
    )
    # questions of one name have the same answers: each name is asked once
    named = questions.select(F.col(key), F.col(name).alias("q")).where("q IS NOT NULL")
    once = named.select("q").distinct()
    asked = once.select("q", F.explode(asks).alias("a")).select("q", "a.order", "a.texts").where(F.forall("texts", lambda t: t != ""))
    hits = asked.hint("merge").join(products_with(asked.select("texts").distinct(), products, most).hint("merge"), "texts").select("q", "product_id", "order")
    if aliases is not None:
        known = aliases.select(F.lower(F.trim("alias")).alias("alias"), "product_id")
        alias = once.select("q", F.explode(F.array(F.struct(F.lit(10).alias("order"), translated_name(F.col("q")).alias("alias")), F.struct(F.lit(30).alias("order"), F.trim(lower).alias("alias")))).alias("a"))
        hits = hits.unionByName(alias.select("q", "a.*").hint("merge").join(known.hint("merge"), "alias").select("q", "product_id", "order"))

    def best(rows: DataFrame, by: str) -> DataFrame:
        """Of the first order that finds any, the first products by id."""
        least = F.rank().over(Window.partitionBy(by).orderBy("order"))
        of_least = rows.withColumn("r", least).where("r = 1").groupBy(by, "product_id").agg(F.min("order").alias("order"))
        return of_least.withColumn("position", F.row_number().over(Window.partitionBy(by).orderBy("product_id"))).where(F.col("position") <= most)

    found = named.hint("merge").join(best(hits, "q").drop("position").hint("merge"), "q").select(key, "product_id", "order")
    return best(found, key).select(key, "product_id", F.floor(F.col("order") / 10).cast("int").alias("tier"), "position")


def candidates_by_token(questions: DataFrame, products: DataFrame, name: str = "product_name", key: str = "item_id") -> DataFrame:
    """(key, product_id, shared): pairs that share a token of more than two letters, by an equi-join of tokens: for question sets of any size."""

    def index(df: DataFrame, column: Column, id_column: str, out: str) -> DataFrame:
        return df.select(F.col(id_column).alias(out), F.explode(F.array_distinct(tokens(column))).alias("token")).where(F.length("token") > 2)

    return index(questions, F.col(name), key, key).join(index(products, F.col("name"), "id", "product_id"), "token").groupBy(key, "product_id").agg(F.count(F.lit(1)).alias("shared"))


def scored(questions: DataFrame, products: DataFrame, found: DataFrame, name: str = "product_name", key: str = "item_id") -> DataFrame:
    """The candidates ``found`` with ``score``, ``same_unit``, the product's name and unit, and ``better``, by which the best match has the largest: a similarity at all, of the same canonical unit where the question has a unit (two unknown units are the same), the similarity, the earliest position."""
    pairs = found.join(products.select(F.col("id").alias("product_id"), F.col("name").alias("p_name"), name_parts(F.col("name")).alias("p"), F.col("standardized_unit").alias("p_unit")).hint("merge"), "product_id")
    pairs = pairs.join(questions.select(key, name_parts(F.col(name)).alias("q"), F.col("unit").alias("q_unit")).hint("merge"), key)
    pairs = pairs.withColumns({"score": parts_similarity(F.col("q"), F.col("p")), "same_unit": canonical_unit(F.col("p_unit")).eqNullSafe(canonical_unit(F.col("q_unit")))})
    unit_first = F.col("same_unit") & F.col("q_unit").isNotNull()
    better = F.struct((F.col("score") > 0).alias("any"), unit_first.alias("unit"), "score", (-F.col("position")).alias("position"))
    return pairs.select(key, "product_id", "position", "p_name", "p_unit", "score", "same_unit", better.alias("better"))


def best_match(questions: DataFrame, products: DataFrame, found: DataFrame, name: str = "product_name", key: str = "item_id") -> DataFrame:
    """One row for each question: the best of its candidates by :func:`scored`; null product and score 0 without one."""
    top = scored(questions, products, found, name, key).where("score > 0").groupBy(key).agg(F.max_by(F.struct("product_id", "score", "same_unit"), "better").alias("m")).select(key, "m.*")
    return questions.select(key).join(top, key, "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def match_supplier(questions: DataFrame, suppliers: DataFrame, name: str = "name", key: str = "item_id") -> DataFrame:
    """(key, supplier_id, tier): suppliers by equal name (1), name contained (2), first or last word (3), of the best tier that finds any, the first five by name."""
    asked = questions.select(key, F.lower(F.trim(name)).alias("q")).where("q <> ''")
    # each distinct text is looked up once among the distinct names, which stand for the first five suppliers that have them
    words = F.split("q", " ")
    tiers = F.array(*[F.struct(F.lit(t).alias("tier"), F.array(x).alias("texts")) for t, x in ((2, F.col("q")), (3, F.element_at(words, 1)), (3, F.element_at(words, -1)))])
    asks = asked.select("q").distinct().select("q", F.explode(tiers).alias("a")).select("q", "a.tier", "a.texts")
    named = first_of(suppliers.select(F.array(F.lower("name")).alias("names"), F.col("id").alias("supplier_id"), F.col("name").alias("s_name")).where("s_name IS NOT NULL"), "names", ["s_name", "supplier_id"], 5)
    hits = asks.hint("merge").join(names_with(asks.select("texts").distinct(), named.select("names").distinct()).hint("merge"), "texts")
    tier = F.min(F.when(F.col("names")[0] == F.col("q"), 1).otherwise(F.col("tier"))).alias("tier")
    held = first_of(hits.groupBy("q", "names").agg(tier).hint("merge").join(named.hint("merge"), "names"), "q", ["tier", "s_name", "supplier_id"], 5)
    w = Window.partitionBy(key)
    first = F.row_number().over(w.orderBy("tier", "s_name", "supplier_id"))
    found = asked.hint("merge").join(held.hint("merge"), "q")
    return found.withColumns({"least": F.min("tier").over(w), "r": first}).where("tier = least AND r <= 5").select(key, "supplier_id", "tier")


def trigram_matches(questions: DataFrame, names: DataFrame, key: str, text: str, id_column: str, name: str, least: float = 0.3) -> DataFrame:
    """(key, id, similarity): pairs of a trigram similarity over ``least``.

    Of each text's trigrams, the rarest first, only so many make candidates that similar texts must share
    one of them; a trigram that most names hold makes none. Candidates are then compared whole. A trigram
    that all names hold ends a question's list: there it has met every name.
    """
    a, b = _texts(questions, key, text, SAME_QUESTIONS), _texts(names, id_column, name, SAME_ROWS)
    held = b.select("ids", F.explode("grams").alias("g")).groupBy("g").agg(F.sum(F.size("ids")).alias("n"))
    held = held.withColumn("all", F.col("n") == b.agg(F.sum(F.size("ids"))).scalar())

    def rarest(df: DataFrame, until_all: bool = False) -> DataFrame:
        """The trigrams, the rarest first, and a row for each that makes candidates, with how many names hold it."""
        counted = df.select("ids", "block", "grams", F.explode("grams").alias("g")).hint("merge").join(held.hint("merge"), "g", "left")
        ranked = counted.groupBy("ids", "block", "grams").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g", F.coalesce("all", F.lit(False)).alias("all")))).alias("r"))
        size = F.size("r")
        most = (size - F.ceil(size * least - 1e-9) + 1).cast("int")
        if until_all:
            end = F.array_position(F.transform("r", lambda x: x["all"]), F.lit(True)).cast("int")
            most = F.least(most, F.when(end > 0, end))
        first = F.slice("r", 1, most)
        return ranked.select("ids", "grams", F.transform(first, lambda x: x["g"]).alias("first"), F.explode(first).alias("x")).select("ids", "grams", "first", "x.n", "x.g")

    # names of a trigram that many hold are dealt out, and the questions that have it with them
    parts = F.ceil(F.greatest("n", F.lit(1)) / GRAM_ROWS).cast("int")
    asked = rarest(a, until_all=True).select(F.col("ids").alias("qs"), F.col("grams").alias("ga"), F.col("first").alias("fa"), "g", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    found = rarest(b).select(F.col("ids").alias("ns"), F.col("grams").alias("gb"), F.col("first").alias("fb"), "g", F.pmod(F.xxhash64("ids"), parts).cast("int").alias("part"))
    # small tables make many pairs: as many tasks as there are partitions, whatever their sizes
    n = int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = asked.repartition(n, "g", "part").hint("merge").join(found.repartition(n, "g", "part").hint("merge"), ["g", "part"])
    # the rarest common trigram makes the pair, the others do not make it again
    once = pairs.where(F.element_at(F.array_intersect("fa", "fb"), 1) == F.col("g"))
    shared = F.size(F.array_intersect("ga", "gb"))
    both = once.select("qs", "ns", (shared.cast("double") / (F.size("ga") + F.size("gb") - shared)).alias("similarity")).where(F.col("similarity") > least)
    return both.select(F.explode("qs").alias(key), "ns", "similarity").select(key, F.explode("ns").alias(id_column), "similarity")


def _texts(rows: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """(grams, block, ids): the distinct texts, whatever their case, each with its trigrams, which are worked out once, and the rows that have it, at most ``most`` in an entry."""
    given = rows.select(F.col(key).alias("id"), F.lower(text).alias("text")).where(F.rlike("text", F.lit(r"[\p{L}\p{N}]")))
    numbered = given.withColumn("i", F.row_number().over(Window.partitionBy("text").orderBy("id")))
    entries = numbered.groupBy("text", F.floor((F.col("i") - 1) / most).alias("block")).agg(F.min("text").alias("of"), F.array_sort(F.collect_list("id")).alias("ids"))
    # of an aggregate, not of the key: else the trigrams are worked out for each row to leave out texts without any
    return entries.select(F.array_sort(trigrams(F.col("of"))).alias("grams"), "block", "ids")


def best_trigram_match(questions: DataFrame, names: DataFrame, key: str, text: str, id_column: str, name: str, least: float = 0.3) -> DataFrame:
    found = trigram_matches(questions, names, key, text, id_column, name, least)
    order = Window.partitionBy(key).orderBy(F.col("similarity").desc(), id_column)
    return found.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def greatest_trigram(query: str, *columns: str) -> Column:
    """The larger similarity of several columns to a fixed text."""
    return F.greatest(*[trigram_similarity(trigrams(F.lit(query)), trigrams(F.col(c))) for c in columns])


def sounds_like(column: str, query: Column) -> Column:
    return F.soundex(column) == F.soundex(query)


def nearest_vector(questions: DataFrame, references: DataFrame, key: str, id_column: str, vector: str, category: str | None = None, limit: Callable[[Column], Column] = cosine_limit, others_only: bool = False) -> DataFrame:
    """(key, id, similarity): the reference of the largest cosine, if it passes the category's limit; ties by id. Blocks of questions are held against blocks of references in tasks of their own (``vectors.nearest_of_groups``). ``others_only``: both are of one table, and no row is its own neighbour."""
    from .vectors import nearest_of_groups

    c = F.col(category) if category else F.lit(None).cast("string")
    asked = questions.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("q"), c.alias("c"))
    held = references.select(F.col(id_column).alias("id"), F.col(vector).cast("array<double>").alias("w"), c.alias("c"))
    if category:
        asked, held = asked.where("c IS NOT NULL"), held.where("c IS NOT NULL")
    near = nearest_of_groups(asked.where("key IS NOT NULL"), held.where("id IS NOT NULL"), ["c"], others_only=others_only)
    best = near.groupBy("key").agg(F.max_by(F.struct("id", "c", "similarity"), F.struct("similarity", -F.col("id"))).alias("b")).select("key", "b.*")
    return best.where(F.col("similarity") >= limit(F.col("c"))).select(F.col("key").alias(key), F.col("id").alias(id_column), "similarity")
