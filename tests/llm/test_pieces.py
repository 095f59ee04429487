import random
import zlib

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from pricequarry.llm import pieces as Q
from pricequarry.llm.tokens import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abthezonén ß日😀\n\t.1▁\u0301"), max_size=40), max_size=5))
def test_ids_are_the_librarys(batch):
    library = sentencepiece.SentencePieceProcessor(model_file=PATH)
    model = Q.PieceModel.of(PATH)
    for text, ids in zip(batch, model.encode(batch), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text)
        assert model.decode(ids) == library.decode(library.encode(text)) == text.replace("▁", " ")


def best_sum(model, word):
    """The best score of all segmentations."""
    if not word:
        return 0.0
    out = -float("inf")
    for i in range(1, len(word) + 1):
        k = model.ids.get(word[:i])
        if k is not None or i == 1:
            out = max(out, (model.scores[k] if k is not None else model.lone) + best_sum(model, word[i:]))
    return out


def test_unigram_states_give_the_best_sum():
    model = Q.PieceModel(PATH)
    model.kind = Q.UNIGRAM
    rng = random.Random(1)
    words = sorted({"▁" + "".join(rng.choice("thenoiq日") for _ in range(rng.randint(1, 9))) for _ in range(60)})
    for word, parts in zip(words, model.walk(words), strict=True):
        assert "".join(parts) == word
        got = sum(model.scores[model.ids[p]] if p in model.ids else model.lone for p in parts)
        assert got == pytest.approx(best_sum(model, word))


def test_tables(spark, docs, edge_rows, empty, library):
    coded = Q.code_pieces(docs.withColumnRenamed("source", "ids"), PATH, decoded=True)
    assert coded.columns[-2:] == ["_ids", "decoded"]
    got = Q.decode_pieces(coded, PATH, "_ids").collect()
    assert sorted(r["decoded"] for r in got) == sorted(r["_decoded"] for r in got) == sorted(r[1] or "" for r in edge_rows)
    want = sorted(zlib.crc32(np.array(library.encode(r[1] or ""), "<u4").tobytes()) for r in edge_rows)
    assert sorted(zlib.crc32(bytes(r["_ids"])) for r in got) == want
    assert Q.decode_pieces(Q.code_pieces(empty, PATH), PATH).count() == 0
