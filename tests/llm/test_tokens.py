import gc
import json
import random
import struct
import sys
import zlib
from array import array

import numpy as np
import pytest
from tokenizers import Tokenizer
from hypothesis import given, settings
from hypothesis import strategies as st

from pricequarry.llm import tokens as T

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
ODD = ["", " ", "a  b", "a   b", " a", "a ", "a \nb", "a\n b", "\n\n x", "a\n\n\nb c", "it's  'x", "x\tb c", "a b́ c", "<|endoftext|> a", "\x1c a\x1cb", "ΑΣ. b", "ﬁ ²x", "日本 語 テ", "a.\nB c", "e\u0301, x", "x1. y2", "end%%% ***", "a\u00a0b c", "\x01 a \x01b"]


@pytest.fixture(scope="module")
def library():
    """The library by itself, as a caller without this module would use it."""
    own = {name: Tokenizer.from_file(T.tokenizer_path(name)) for name in (BYTE, WORD)}
    return lambda name, batch: [array("I", e.ids).tobytes() for e in own[name].encode_batch(batch, add_special_tokens=False)]


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_stretches_give_the_librarys_ids(name, library):
    e = T.Encoder(T.tokenizer_path(name))
    assert e.splits and e.keeps_blanks == (name == BYTE)
    for _ in range(2):  # the second time from what it remembers
        assert e.encode(ODD) == library(name, ODD)


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_special_tokens_strings_are_those_tokens(name, library):
    texts = ["end <|endoftext|> next", "<|endoftext|>", "a<|endoftext|>b", "a<|startoftext|>. b", "x\n<|endoftext|>\ny <|endoftext|>", " <|endoftext|>  z", "<|endoftext|>, a <|endoftext", "|><|endoftext|><|startoftext|>"]
    assert T.Encoder(T.tokenizer_path(name)).encode(texts) == library(name, texts)


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_marks_after_any_letter(name, library):
    letters = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalpha() and not c.isascii()]
    # of the long runs of ideographs and syllables some; of all other letters each one
    letters = [c for i, c in enumerate(letters) if not (0x3400 <= ord(c) < 0xA000 or 0xAC00 <= ord(c) < 0xD7A4 or ord(c) >= 0x17000) or i % 97 == 0]
    assert {"\u0130", "\u0958", "\ufb1d", "\u0f43"} <= set(letters)
    texts = [t for c in letters for t in (f"{c}, a{c}.", f"ab{c}) {c}")]
    assert T.Encoder(T.tokenizer_path(name)).encode(texts) == library(name, texts)


@pytest.mark.parametrize("name", [BYTE, WORD])
def test_words_that_stand_once_are_found_alike(name, library):
    letters = "".join(map(chr, range(0xC0, 0x100))).replace("\u00d7", "").replace("\u00f7", "")
    texts = [f"Stone Café {letters} stone. ŁÓDŹ word{i} {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]} . x" for i in range(100)] + [c + "b" for c in letters]
    e = T.Encoder(T.tokenizer_path(name))
    assert e.encode(texts) == library(name, texts) == e.encode(texts)
    assert e.known["Café"] == library(name, [" Café" if e.keeps_blanks else "Café"])[0]
    # packing, which shares its workers, remembers only words that texts looked up together repeat
    assert ("word7" in e.known) == e.keeps_blanks


@settings(max_examples=150, deadline=None)
@given(batch=st.lists(st.text(alphabet=st.sampled_from("abÉzß .,\x02\x01'\n\t19*\u0301\u00a0Σ\u0130\u0958") | st.characters(categories=["Lu", "Ll", "Lo", "Mn", "Nd", "Po", "Zs"]), max_size=40), max_size=4))
def test_any_text_gives_the_librarys_ids(batch, library):
    for name in (BYTE, WORD):
        assert T.Encoder.of(T.tokenizer_path(name)).encode(batch) == library(name, batch)


@pytest.mark.parametrize("change", [{"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"normalizer": {"type": "Lowercase"}}, {"added_tokens": [{"id": 50256, "content": "a b", "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}]}])
def test_other_tokenizers_get_whole_texts(change, tmp_path):
    with open(T.tokenizer_path(BYTE), encoding="utf-8") as f:
        made = json.load(f) | change
    path = str(tmp_path / "other.json")
    with open(path, "w", encoding="utf-8") as f:
        json.dump(made, f)
    rng = random.Random(5)
    batch = ["".join(rng.choice("aB .,\n") for _ in range(30)) for _ in range(50)] + ["x a b c"]
    e = T.Encoder(path)
    assert not e.splits
    assert e.encode(batch) == [array("I", x.ids).tobytes() for x in Tokenizer.from_file(path).encode_batch(batch, add_special_tokens=False)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 3) | st.integers(0, 50_000), max_size=900))
def test_blocks_round_trip(ids):
    ids = np.array(ids, np.uint32)
    words, starts = T.encode_blocks(ids)
    assert (T.decode_words(words) == ids).all()
    for b in range(len(starts) - 1):
        assert (T.decode_words(words[starts[b] : starts[b + 1]]) == ids[b * T.BLOCK_IDS : (b + 1) * T.BLOCK_IDS]).all()


def test_small_ids_pack_tightly():
    assert len(T.encode_blocks(np.zeros(240, np.uint32))[0]) == 1
    assert len(T.encode_blocks(np.ones(240, np.uint32))[0]) == 4
    assert len(T.encode_blocks(np.full(3, 2**31, np.uint32))[0]) == 6  # escapes


def test_files_hold_every_document(docs, edge_rows, tmp_path, library):
    manifest = T.write_token_files(docs, f"file://{tmp_path}", T.tokenizer_path(BYTE))
    got = T.read_token_files(manifest).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted((r[0] for r in edge_rows), key=lambda x: (x is not None, x))
    at = 0
    for r in got:
        assert r["start"] == at
        at += r["n_tokens"]
    end = struct.pack("<I", 0)
    want = sorted(((r[0], zlib.crc32(x + end), len(x) // 4 + 1) for r, x in zip(edge_rows, library(BYTE, [r[1] or "" for r in edge_rows]), strict=True)), key=str)
    assert sorted(((r["doc_id"], r["ids_crc32"], r["n_tokens"]) for r in got), key=str) == want
    for f in manifest.collect():
        whole = np.concatenate([ids for _, ids in T.read_documents(f["uri"])])
        assert len(whole) == f["ids"]
        assert (T.read_span(f["uri"], 5, min(700, len(whole))) == whole[5:700]).all()


def test_empty_table(empty, tmp_path):
    assert T.read_token_files(T.write_token_files(empty, f"file://{tmp_path}", T.tokenizer_path(BYTE))).count() == 0


def test_string_ids(spark, tmp_path, library):
    rows = [(x, f"text of {x}") for x in ("b", "a", "ä", "", "aa", "B")]
    manifest = T.write_token_files(spark.createDataFrame(rows, "doc_id string, text string"), f"file://{tmp_path}", T.tokenizer_path(BYTE), rows_per_file=1)
    got = T.read_token_files(manifest, "string").orderBy("start").collect()
    assert [r["doc_id"] for r in got] == sorted(x for x, _ in rows)
    want = dict(zip([x for x, _ in rows], library(BYTE, [t for _, t in rows]), strict=True))
    assert all(r["ids_crc32"] == zlib.crc32(want[r["doc_id"]] + struct.pack("<I", 0)) for r in got)


def test_the_collector_rests_while_texts_are_encoded(library):
    e, seen = T.Encoder(T.tokenizer_path(BYTE)), []
    learn = e.learn
    e.learn = lambda *x: seen.append(gc.isenabled()) or learn(*x)
    assert e.encode(["some text"]) == library(BYTE, ["some text"])
    assert seen == [False] and gc.isenabled()
