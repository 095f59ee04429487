"""What the operators share, against plain Python."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from pricequarry.llm import language_id, tokens
from pricequarry.llm._common import MOST_RANGES, id_bounds, keep_only, ranges_of


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 8, 1000])
def test_ranges_by_halving(spark, n):
    bounds = sorted(random.Random(n).sample(range(10_000), n))
    rows = spark.range(0, 10_000, 7).select("id", ranges_of(F.col("id"), [float(b) for b in bounds]).alias("r")).collect()
    assert all(r["r"] == bisect.bisect_right(bounds, r["id"]) for r in rows)


def test_null_is_in_the_first_range(spark):
    none = spark.sql("SELECT CAST(NULL AS BIGINT) AS id")
    assert none.select(ranges_of(F.col("id"), [1.0, 2.0]).alias("r")).first()["r"] == 0
    assert id_bounds(none, "id", 8) == []


def test_bounds_are_fewer_than_asked_for_beyond_the_most(spark):
    assert len(id_bounds(spark.range(100), "id", 10 * MOST_RANGES)) <= 100


def test_ranges_of_strings(spark):
    rng = random.Random(3)
    ids = ["".join(rng.choice("aäß\u4e2d0'\"") for _ in range(rng.randint(0, 6))) for _ in range(3000)]
    df = spark.createDataFrame([(i,) for i in [*ids, None]], "id string")
    bounds = id_bounds(df, "id", 9)
    assert 4 <= len(bounds) <= 8
    rows = df.select("id", ranges_of(F.col("id"), bounds).alias("r")).collect()
    assert all(r["r"] == (0 if r["id"] is None else bisect.bisect_right(bounds, r["id"])) for r in rows)
    assert id_bounds(df.where("id IS NULL"), "id", 9) == []


def test_ids_of_other_types_are_refused(spark):
    with pytest.raises(TypeError, match="numbers or strings"):
        id_bounds(spark.sql("SELECT DATE '2024-01-01' AS id"), "id", 4)


def test_a_stage_lets_go_of_what_others_left_in_its_worker():
    encoder = tokens.Encoder.of(tokens.tokenizer_path("word_bpe_49k.json"))
    language_id.letters("abc")
    keep_only("tokens")
    assert not language_id._CODES and tokens.Encoder.of(tokens.tokenizer_path("word_bpe_49k.json")) is encoder
    keep_only()
    assert not tokens._ENCODERS
    # what is let go of is made again when it is needed
    assert language_id.letters("Ab").tolist() == [32, 97, 98, 32]
    assert tokens.Encoder.of(tokens.tokenizer_path("word_bpe_49k.json")).encode(["ab"]) == encoder.encode(["ab"])
