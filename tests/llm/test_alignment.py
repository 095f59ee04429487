import hashlib
import random
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pricequarry.llm.alignment import NOTHING, Aligner, Apart, Transducer, align_corpus, align_documents, op12_alignment
from pricequarry.llm.tokens import tokenizer_path

BPE, PIECES = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
ODD = [
    "<|endoftext|> in a text<s></s><unk>",
    "a ▁ b",
    "▁",
    " ",
    "  two  blanks \n\n and\tlines\r\n",
    " led by a blank",
    "\nled by a line's end",
    "Ünïcödé наука 漢字仮名 한국어 עברית",
    "emoji 👩‍👩‍👧 \U0001f9ff\x00 control \x02\x01",
    "é combining é, İstanbul ß",
    "x" * 3000,
    "antidisestablishmentarianism, unbelievably!!! ... --- ''' 12345678901234567890",
    "https://example.com/a?b=c&d=%20#e",
    "﻿bom ​ zero nbsp",
]


def spelled(text):
    """(A ids, B ids, byte ends of both) straight from the libraries; None without tokens."""
    if not text:
        return None
    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a = t.encode(" " + text, add_special_tokens=False).ids
    b = sp.encode(text)
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(x): x for x in own} | {chr(256 + n): x for n, x in enumerate(x for x in range(256) if x not in own)}
    left = [bytes(table[c] for c in t.id_to_token(i)) for i in a]
    right = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in b]
    whole = (" " + text).encode()
    if b"".join(left) != whole or b"".join(right) != whole:
        return None

    def ends(parts):
        at, out = 0, []
        for x in parts:
            at += len(x)
            out.append(at)
        return out

    return a, b, ends(left), ends(right)


def brute(rows):
    """The contract by byte offsets, one row for each of (id, text), in order."""
    found, held = [], Counter()
    for _, text in rows:
        s = spelled(text)
        groups = []
        if s:
            a, b, ea, eb = s
            i = j = 0
            for cut in sorted(set(ea) & set(eb)):
                xs = [a[k] for k in range(i, len(a)) if ea[k] <= cut]
                ys = [b[k] for k in range(j, len(b)) if eb[k] <= cut]
                i, j = i + len(xs), j + len(ys)
                groups.append((xs, ys))
        links = Counter((x, y) for xs, ys in groups for x in xs for y in ys)
        held.update(set(links))
        found.append((s, groups, links))
    most = defaultdict(int)
    for (x, _), n in held.items():
        most[x] = max(most[x], n)
    out = []
    for (i, _), (s, groups, links) in zip(rows, found, strict=True):
        text = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        out.append(
            (
                i,
                len(s[0]) if s else 0,
                len(s[1]) if s else 0,
                len(groups),
                sum(links.values()),
                sum(n for (x, y), n in links.items() if held[x, y] == most[x]),
                sum(n * held[p] for p, n in links.items()),
                hashlib.sha256(text.encode()).hexdigest() if s else "",
            )
        )
    return out


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def texts(edge_rows):
    rng = random.Random(5)
    alphabet = "aáb cß漢\n\t .,é👍01 the ing"
    rows = [(r[0], r[1]) for r in edge_rows if r[1] is None or len(r[1]) < 50_000]
    return rows + list(enumerate(ODD, 100)) + [(200 + i, "".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 120)))) for i in range(150)]


@pytest.mark.parametrize("most_pairs", [1 << 19, 40, 0])
def test_against_byte_offsets(spark, texts, most_pairs):
    docs = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in texts], "doc_id long, text string, pair int, row int, links string").repartition(3)
    assert rows_of(align_corpus(docs, BPE, PIECES, most_pairs=most_pairs)) == sorted(brute(texts), key=repr)


def test_query_empty_table_and_very_long_texts(spark, stored, empty, edge_rows):
    got = {(r["doc_id"], r["groups_sha256"]): r for r in op12_alignment(spark, stored).collect()}
    long = next(r for r in got.values() if r["doc_id"] == 9)
    assert long["n_a"] > 10_000 and long["n_links"] >= long["n_groups"] > 0
    assert sum(1 for r in edge_rows if not r[1]) == sum(r["n_a"] == 0 for r in got.values())
    assert align_corpus(empty, BPE, PIECES).collect() == []


def test_string_ids(spark):
    docs = spark.createDataFrame([("a", "one text"), ("a", "one text"), (None, None)], "doc_id string, text string")
    assert rows_of(align_corpus(docs, BPE, PIECES)) == sorted(brute([("a", "one text")] * 2 + [(None, None)]), key=repr)


def test_forgetting_changes_nothing(spark):
    some = [t for t in ODD if "▁" not in t]
    once = Aligner(BPE, PIECES)
    often = Aligner(BPE, PIECES)

    def seen(aligner, text):
        return [x.tolist() if hasattr(x, "tolist") else x for x in aligner.align(pa.array([text, "", text[:5]]))]

    for t in some * 2:
        expected = seen(once, t)
        often.transducer.clear_steps()
        often.transducer.clear_kinds()
        often.known, often.older = {"": NOTHING}, {}
        assert seen(often, t) == expected


def test_residuals_are_the_bytes_one_side_leads_by():
    t = Transducer([b" ab", b"c", b"abcd"], [b" a", b"bc", b"abc", b"d", b"x"])
    assert [t.written[g] for g in t.groups([0, 1, 2], [0, 1, 2, 3])] == ["0,1|0,1", "2|2,3"]
    assert t.residuals == [b"", b"b", b"c", b"d"]
    for xs, ys in (([0], [0]), ([0], [4]), ([2], [2, 3, 3]), ([1, 1], [])):
        with pytest.raises(Apart):
            t.groups(xs, ys)


def test_links_are_counted_not_written_out(spark):
    docs = spark.createDataFrame([(1, "x" * 3000)], "doc_id long, text string")
    r = align_documents(docs, BPE, PIECES).first()
    assert len(r["links"]) < 20 and r["n_links"] == sum(x["times"] for x in r["links"])
