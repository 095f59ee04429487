"""Whole texts to token ids by the tokenizers library, and a Simple-8b file format for the ids.

Encoding: a space before a character that is not blank always starts a new
pre-token, so the stretches between such spaces are encoded on their own, each
distinct one once, and a text's ids are those of its stretches joined. So does a line's
end between other characters. A stretch that is new is cut further where letters meet
marks, for its parts may be known. Texts where a blank has another beside it go to the
library whole, and so do all texts of a tokenizer whose normalizer, pre-tokenizer or added
tokens are not of the two kinds that this is known to hold for.

Files: the ids of a partition's documents in ascending doc_id order, in blocks of
BLOCK_IDS ids. A block is a run of 64-bit words: four bits select how many ids of
how many bits the other sixty hold; selector 15 is an escape, and the whole next word
is one id. The offsets of all blocks stand after the words, then the table of the
documents, then a footer; any block can be read and decoded without the others.
"""

from __future__ import annotations

import gc
import itertools
import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fitting, id_bounds, kept_by, new_path, opened, put_whole, ranges_of, read, texts, written

#: Distinct stretches, and parts of them, that a Python worker remembers across the tasks it runs: so many of the latest, and as many stretches from before them (about 200 bytes each).
MOST_STRETCHES, MOST_PARTS = 360_000, 100_000
_ENCODERS: dict[str, Encoder] = kept_by("tokens")
#: Texts that are split and looked up together.
TEXTS = 2_000
#: What stands before a text's first stretch while it is looked up; a text that holds it goes whole.
HEAD = "\x02"
BLANKS = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = rf"^[{BLANKS}]|[ \n](?:[{BLANKS}]|$)|\x02"
#: The same for texts that all begin with a space, which is then a border like others.
_ODD_LED = rf"[ \n](?:[{BLANKS}]|$)|\x02"
#: The normalizer and pre-tokenizer of a tokenizer that drops white space. Fixed values.
_WORDS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)
_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _structure(tokenizer: dict) -> str | None:
    """"bytes" for a byte-level tokenizer that keeps white space, "words" for one that drops it and lower-cases; None where stretches are not known to be independent."""
    shapes = tokenizer.get("normalizer"), tokenizer.get("pre_tokenizer") or {}
    plain = tokenizer["model"].get("type") == "BPE" and not tokenizer["model"].get("dropout")
    for t in tokenizer.get("added_tokens") or ():
        # found in a text before all else, and nothing beside them changes
        plain &= not (t.get("single_word") or t.get("lstrip") or t.get("rstrip") or t.get("normalized")) and not re.search(r"[\s\x00-\x1f]", t["content"])
    if plain and shapes[0] is None and shapes[1].get("type") == "ByteLevel" and shapes[1].get("use_regex") and not shapes[1].get("add_prefix_space"):
        return "bytes"
    if plain and shapes == _WORDS:
        return "words"
    return None


#: Whether a word has only letters of Latin-1, which are the same in every normal form.
_LATIN = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+").fullmatch


def _between(flat: bytes, mark: int) -> list[bytes]:
    """The ids before, between and after those equal to ``mark``."""
    cuts = 4 * np.flatnonzero(np.frombuffer(flat, "<u4") == mark)
    return [flat[i:j] for i, j in zip([0, *(cuts + 4).tolist()], [*cuts.tolist(), len(flat)], strict=True)]


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit integers: those that the tokenizers library gives with ``add_special_tokens=False``.

    A special token's string in a text is that token, as the library has it, unless ``plain``: then it is ordinary text,
    and all texts begin with a space. Whether white
    space makes ids (``keeps_blanks``) is read from the file. Without them (a tokenizer that drops white
    space) every space is a border.
    """

    def __init__(self, path: str, plain: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.odd = _ODD_LED if plain else _ODD
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        kind = _structure(read)
        self.special = re.compile("|".join(re.escape(t["content"]) for t in (not plain and read.get("added_tokens")) or ()) or r"(?!)")
        self.keeps_blanks = kind == "bytes"
        self.letters: dict[str, bool] = {}
        # packing shares its workers' memory with other stages: it remembers fewer, and only those that stand twice or more among texts looked up together
        self.most, self.often = (MOST_STRETCHES, 1) if self.keeps_blanks else (MOST_STRETCHES // 4, 2)
        self.known: dict[str, bytes] = self.nothing()
        self.older: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        # a line's end between other characters, or a control character between spaces that are dropped, is one pre-token and one id
        mark = "\n" if self.keeps_blanks else " \x01 "
        ids = self.tokenizer.encode(mark, add_special_tokens=False).ids
        self.splits = kind is not None and len(ids) == 1
        # words of plain letters need no normalizer but lower case, and are one pre-token each: the same model without the rest
        self.plain = self.plain_mark = None
        if self.splits and not self.keeps_blanks:
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            marks = self.plain.encode(".", add_special_tokens=False).ids
            self.plain_mark = marks[0] if len(marks) == 1 else None
        if self.splits:
            self.mark = mark, ids[0]
            if self.keeps_blanks:
                self.parts["\n"] = self.whole(["\n"])[0]

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def whole(self, batch: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(batch, add_special_tokens=False)]

    def nothing(self) -> dict[str, bytes]:
        """What is known at first: that empty stretches have no ids."""
        return {"": b"", HEAD: b""} if self.keeps_blanks else {"": b""}

    def many(self, parts: list[str]) -> list[bytes]:
        """The ids of parts that borders stand around: encoded together between marks that are always one id, and cut there."""
        mark, mark_id = self.mark
        out: list[bytes] = []
        for at in range(0, len(parts), 2000):
            some = parts[at : at + 2000]
            text = mark.join(some)
            # a part that is blank, or holds the mark, would run into the marks beside it; a special token would end what is before it
            if not any(map(str.isspace, some)) and text.count(mark.strip(" ")) == len(some) - 1 and not self.special.search(text):
                ids = self.whole([text])[0]
                cut = _between(ids, mark_id)
                if len(cut) == len(some):
                    out += cut
                    continue
            out += self.whole(some)
        return out

    def words(self, words: list[str], lead: str) -> dict[str, bytes]:
        """The ids of distinct words of letters, each after ``lead``."""
        if self.plain_mark is None:
            return dict(zip(words, self.many([lead + w for w in words]), strict=True))
        plain = [w for w in words if w.isascii() or _LATIN(w)]
        others = [w for w in words if not (w.isascii() or _LATIN(w))]
        found = dict(zip(others, self.many(others), strict=True))
        for at in range(0, len(plain), 2000):
            some = plain[at : at + 2000]
            ids = array("I", self.plain.encode_batch_fast([" . ".join(some).lower()], add_special_tokens=False)[0].ids)
            # no id of a word of letters is that of the mark
            found.update(zip(some, _between(ids.tobytes(), self.plain_mark), strict=True))
        return found

    def ends(self, word: str) -> bool:
        """Whether marks after a word are a pre-token of their own: all its characters are letters to the library too, once normalized (some letters come apart into a letter and a mark)."""
        if word.isascii():
            return word.isalpha()
        if not word.isalpha():
            return False
        for c in word:
            sure = self.letters.get(c)
            if sure is None:
                text = self.tokenizer.normalizer.normalize_str(f"{c}.") if self.tokenizer.normalizer else f"{c}."
                sure = self.letters[c] = [t for t, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)][1:] == ["."]
            if not sure:
                return False
        return True

    def cut(self, stretch: str, lead: str) -> list[str]:
        """Parts of a stretch that can be encoded on their own, the first with the space before it: a line's end before all, and a word and the marks after it."""
        start = stretch[0] if self.keeps_blanks and stretch[0] in ("\n", HEAD) else ""
        text = stretch[len(start) :]
        word = text.rstrip(_MARKS)
        parts = [word, text[len(word) :]] if word != text and self.ends(word) else [text]
        return [*(["\n"] if start == "\n" else []), *parts] if start else [lead + parts[0], *parts[1:]]

    def learn(self, stretches: list[str], lead: str) -> dict[str, bytes]:
        """The ids of distinct stretches that are not known."""
        if len(self.parts) > MOST_PARTS:
            self.parts = {"\n": self.parts["\n"]} if self.keeps_blanks else {}
        known, older, parts = self.known, self.older, self.parts
        fresh, others = set(), set()  # words and other parts that nothing is known of
        ended, cut = [], []
        for s in stretches:
            if s.isalpha():
                fresh.add(s)
                continue
            word = s.rstrip(_MARKS)
            if self.ends(word):
                ids, marks = known.get(word) or older.get(word), s[len(word) :]
                if ids is None:
                    fresh.add(word)
                ended.append((s, word, marks, ids))
                if marks not in parts:
                    others.add(marks)
                continue
            xs = self.cut(s, lead)
            cut.append((s, xs))
            for x in xs:
                if x not in parts:
                    ids = known.get(x[1:]) if lead and x[0] == lead else None
                    if ids:
                        parts[x] = ids
                    else:
                        others.add(x)
        found, new = self.words(list(fresh), lead), list(others)
        parts.update(zip(new, self.many(new), strict=True))
        for s, word, marks, ids in ended:
            found[s] = (ids or found[word]) + parts[marks]
        for s, xs in cut:
            found[s] = b"".join([parts[x] for x in xs])
        return found

    def encode(self, batch: list[str]) -> list[bytes]:
        return self.encode_column(pa.array(batch, pa.string()))

    def encode_column(self, column: pa.Array) -> list[bytes]:
        """The ids of each text of a column without nulls."""
        out: list[bytes] = []
        collects = gc.isenabled()
        gc.disable()  # nothing here refers to itself, and walking over what is remembered costs a sixth of the time
        try:
            for at in range(0, len(column), TEXTS):
                out += self._encode(column.slice(at, TEXTS))
        finally:
            if collects:
                gc.enable()
        pa.default_memory_pool().release_unused()
        return out

    def _encode(self, column: pa.Array) -> list[bytes]:
        if not self.splits:
            return self.whole(column.to_pylist())
        whole: dict[int, bytes] = {}
        if self.keeps_blanks:
            # a line's end between other characters is a border too; a stretch after one begins with it, a text's first one with HEAD, in place of the space
            odd = pc.match_substring_regex(column, self.odd)
            rows = np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist()
            if rows:
                whole = dict(zip(rows, self.whole([column[i].as_py() for i in rows]), strict=True))
                column = pc.if_else(odd, "", column)
            column = pc.replace_substring(pc.binary_join_element_wise(HEAD, column, ""), "\n", " \n")
        else:
            column = pc.replace_substring(column, "\n", " ")
        lists = pc.split_pattern(column, " ")
        words = lists.flatten().dictionary_encode()
        if len(self.known) > self.most:
            self.known, self.older = self.nothing(), self.known
        known, older = self.known, self.older
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist
        ids = list(map(known.get, distinct))
        gaps = [i for i, x in enumerate(ids) if x is None]
        before = [older.get(distinct[i]) for i in gaps]
        found = self.learn([distinct[i] for i, x in zip(gaps, before, strict=True) if x is None], " " if self.keeps_blanks else "")
        times = np.bincount(words.indices.to_numpy(), minlength=len(distinct))[gaps].tolist() if gaps else []
        for i, x, n in zip(gaps, before, times, strict=True):
            stretch = distinct[i]
            ids[i] = x = found[stretch] if x is None else x
            if n >= self.often:
                known[stretch] = x
        joined = pa.array(ids, pa.large_binary()).take(words.indices)
        starts = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset :] if len(joined) else np.zeros(1, np.int64)
        data = joined.buffers()[2] or b""
        ends = starts[np.asarray(lists.offsets)].tolist()
        data = memoryview(data)
        return [whole[i] if i in whole else bytes(data[ends[i] : ends[i + 1]]) for i in range(len(column))]


# ---------------------------------------------------------------- Simple-8b

#: Ids in a word, and bits of each, by selector. Fixed values.
COUNTS = np.array([240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2], np.int64)
WIDTHS = np.array([0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30], np.int64)
ESCAPE = 15
BLOCK_IDS = 256
MAGIC, VERSION = b"PQS8", 1
#: Documents that are read back together.
READ_DOCS = 500


_LENGTHS = np.array([n.bit_length() for n in range(1 << 16)], np.int8)


def _bit_lengths(ids: np.ndarray) -> np.ndarray:
    high = ids >> np.uint32(16)
    if high.any():
        return np.where(high > 0, _LENGTHS[high] + np.int8(16), _LENGTHS[ids & np.uint32(0xFFFF)])
    return _LENGTHS[ids]


def encode_blocks(ids: np.ndarray, block: int = BLOCK_IDS) -> tuple[np.ndarray, np.ndarray]:
    """Words (uint64) of the ids (uint32), and each block's first word with the end. Every block starts a new word."""
    n = len(ids)
    blocks = -(-n // block)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    width = np.zeros(n + int(COUNTS[0]), np.int8)
    width[:n] = _bit_lengths(ids)
    # ids of the block from here on; a word never holds more, so that counts add up
    left = np.tile(np.arange(block, 0, -1, dtype=np.int16), blocks)[:n]
    left[(blocks - 1) * block :] -= blocks * block - n
    # the widest of the next c ids, for growing c, against what a selector of c ids holds; the largest c that fits wins
    best, widest, c = np.full(n, ESCAPE, np.int8), width[:n].copy(), 1
    for s in range(len(COUNTS) - 1, -1, -1):
        while c < COUNTS[s]:
            np.maximum(widest, width[c : n + c], out=widest)
            c += 1
        # what fits a selector fits all that hold fewer ids, so the best one's number is found by counting, and where none fits the rest are not tried
        fits = (widest <= WIDTHS[s]) & (left >= c)
        if not fits.any():
            break
        best -= fits.view(np.int8)
    # walk all blocks in step, a word of each at a time
    steps = np.r_[COUNTS, 1]
    live = np.arange(blocks)
    at, ends = live * block, np.minimum((live + 1) * block, n)
    walk, each = [], np.zeros(blocks, np.int64)
    while len(live):
        walk.append((live, at))
        each[live] += 1
        at = at + steps[best[at]]
        more = at < ends[live]
        live, at = live[more], at[more]
    place = np.empty(int(each.sum()), np.int64)
    heads = np.cumsum(each) - each
    for k, (live, at) in enumerate(walk):
        place[heads[live] + k] = at
    owner = np.repeat(np.arange(blocks), each)
    chosen = best[place]
    escape = chosen == ESCAPE
    first = np.arange(len(place)) + np.cumsum(escape) - escape  # an escape takes two words
    words = np.zeros(len(place) + int(escape.sum()), np.uint64)
    words[first] = chosen.astype(np.uint64) << np.uint64(60)
    words[first[escape] + 1] = ids[place[escape]]
    for s in np.unique(chosen[~escape]):
        if WIDTHS[s]:
            own = np.flatnonzero(chosen == s)
            at, held = place[own], np.full(len(own), int(s) << 60, np.uint64)
            for k in range(int(COUNTS[s])):
                held |= ids[at + k].astype(np.uint64) << np.uint64(k * int(WIDTHS[s]))
            words[first[own]] = held
    sizes = np.bincount(owner, weights=1 + escape, minlength=blocks).astype(np.int64)
    return words, np.r_[0, np.cumsum(sizes)]


def decode_words(words: np.ndarray) -> np.ndarray:
    """The ids of whole blocks' words: all words of a selector are unpacked at once."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    # the word after an escape is an id, whatever its upper bits say; a raw word may itself look like an escape
    for i in np.flatnonzero(selectors == ESCAPE):
        if not raw[i] and i + 1 < len(words):
            raw[i + 1] = True
    counts = np.where(raw, 1, np.where(selectors == ESCAPE, 0, np.r_[COUNTS, 0][np.minimum(selectors, ESCAPE)]))
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), np.uint32)
    out[starts[raw]] = words[raw].astype(np.uint32)
    for k in np.unique(selectors[~raw]):
        if k < ESCAPE and WIDTHS[k]:
            own = np.flatnonzero((selectors == k) & ~raw)
            at, held, mask = starts[own], words[own], np.uint64((1 << int(WIDTHS[k])) - 1)
            for i in range(int(COUNTS[k])):
                out[at + i] = held & mask
                held >>= np.uint64(WIDTHS[k])
    return out


# ---------------------------------------------------------------- files


def _write(root: str, path: str, end_id: int):
    """From rows sorted by doc_id to one file, and one row about it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        encoder = Encoder.of(path)
        doc_ids: list = []
        lengths: list[np.ndarray] = []
        offsets: list[np.ndarray] = [np.zeros(1, np.int64)]
        state = {"words": 0, "ids": 0}

        def chunks() -> Iterator[bytes]:
            yield MAGIC + struct.pack("<II", VERSION, BLOCK_IDS) + b"\0" * 4
            rest = np.zeros(0, np.uint32)
            end = np.array([end_id], "<u4").tobytes()
            pieces: list[bytes] = []
            held = 0

            def pack(ids: np.ndarray) -> bytes:
                words, starts = encode_blocks(ids)
                offsets.append(starts[1:] + state["words"])
                state["words"] += len(words)
                state["ids"] += len(ids)
                return words.astype("<u8").tobytes()

            for b in batches:
                doc_ids.append(b.column(0))
                column = texts(b, "text")
                for at in range(0, b.num_rows, TEXTS):
                    encoded = encoder.encode_column(column.slice(at, TEXTS))
                    lengths.append(np.array([len(e) // 4 + 1 for e in encoded], np.int64))
                    for e in encoded:
                        pieces += (e, end)
                        held += len(e) + 4
                    if held >= 1 << 22:
                        ids = np.concatenate([rest, np.frombuffer(b"".join(pieces), "<u4")])
                        pieces, held = [], 0
                        whole = len(ids) // BLOCK_IDS * BLOCK_IDS
                        rest = ids[whole:]
                        yield pack(ids[:whole])
            ids = np.concatenate([rest, np.frombuffer(b"".join(pieces), "<u4")])
            if len(ids):
                yield pack(ids)
            at = 16 + 8 * state["words"]
            table = np.concatenate(lengths) if lengths else np.zeros(0, np.int64)
            starts = np.concatenate(offsets).astype("<u8").tobytes()
            docs = table.astype("<u8").tobytes()
            names = pa.chunked_array(doc_ids).combine_chunks() if doc_ids else pa.array([], pa.int64())
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("doc_id", names.type)])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([names], names=["doc_id"]))
            known = sink.getvalue().to_pybytes()
            yield starts
            yield docs
            yield known
            foot = json.dumps({"offsets": at, "blocks": len(starts) // 8 - 1, "lengths": at + len(starts), "docs": len(table), "doc_ids": at + len(starts) + len(docs), "doc_id_bytes": len(known), "ids": state["ids"]}).encode()
            yield foot
            yield struct.pack("<I", len(foot)) + MAGIC

        head = next(batches, None)
        if head is None:
            return
        whole = batches

        def again() -> Iterator[pa.RecordBatch]:
            yield head
            yield from whole

        batches = again()
        uri = f"{root}/tokens-{part:06d}-{TaskContext.get().taskAttemptId()}.s8b"
        size = put_whole(uri, chunks())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([uri]), pa.array([sum(map(len, lengths))], pa.int64()), pa.array([state["ids"]], pa.int64()), pa.array([size], pa.int64())], names=["part", "uri", "docs", "ids", "bytes"])

    return run


def write_token_files(df: DataFrame, root: str, tokenizer: str, end_id: int = 0, id_column: str = "doc_id", text_column: str = "text", rows_per_file: int = 20_000) -> DataFrame:
    """Writes the ids of all texts, each followed by ``end_id``, to files under ``root`` whose names sort as the doc_ids do, and returns one row a file: part, uri, docs, ids, bytes.

    Null texts are empty (the end id alone). Ids are numbers or strings (by code points). Null ids come first; rows that repeat an
    id are documents of their own, side by side. Rows are dealt out by ranges of the id, so no
    key is hot. A task that runs twice writes a file of its own name, and the returned table
    (written once) names the one to read. An empty table makes no file.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    bounds = id_bounds(rows, "doc_id", fitting(spark, df.count(), rows_per_file))
    part = ranges_of(F.col("doc_id"), bounds)
    ordered = rows.repartitionById(len(bounds) + 1, part).sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(_write(root, tokenizer, end_id), "part int, uri string, docs long, ids long, bytes long"), "manifest")


def _parts_of(uri: str):
    fs, path = opened(uri)
    f = fs.open_input_file(path)
    size = f.size()
    f.seek(size - 8)
    (n,) = struct.unpack("<I", f.read(8)[:4])
    f.seek(size - 8 - n)
    return f, json.loads(f.read(n))


def _array(f, at: int, n: int) -> np.ndarray:
    f.seek(at)
    return np.frombuffer(f.read(8 * n), "<u8")


def read_documents(uri: str, blocks_at_once: int = 2048) -> Iterator[tuple[object, np.ndarray]]:
    """(doc_id, ids) of a file's documents in order, with a bounded run of blocks in memory besides the document at hand."""
    f, foot = _parts_of(uri)
    with f:
        offsets = _array(f, foot["offsets"], foot["blocks"] + 1).astype(np.int64)
        lengths = _array(f, foot["lengths"], foot["docs"]).astype(np.int64)
        f.seek(foot["doc_ids"])
        names = pa.ipc.open_stream(f.read(foot["doc_id_bytes"])).read_all().column(0).to_pylist()
        held, block = np.zeros(0, np.uint32), 0
        for doc_id, n in zip(names, lengths.tolist(), strict=True):
            got = [held]
            have = len(held)
            while have < n:
                end = min(block + blocks_at_once, foot["blocks"])
                f.seek(16 + 8 * int(offsets[block]))
                got.append(decode_words(np.frombuffer(f.read(8 * int(offsets[end] - offsets[block])), "<u8")))
                have += len(got[-1])
                block = end
            held = np.concatenate(got) if len(got) > 1 else held
            yield doc_id, held[:n]
            held = held[n:]


def read_span(uri: str, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a file, from the blocks that hold them only."""
    f, foot = _parts_of(uri)
    with f:
        first, last = start // BLOCK_IDS, min(-(-stop // BLOCK_IDS), foot["blocks"])
        offsets = _array(f, foot["offsets"] + 8 * first, last - first + 1).astype(np.int64)
        f.seek(16 + 8 * int(offsets[0]))
        ids = decode_words(np.frombuffer(f.read(8 * int(offsets[-1] - offsets[0])), "<u8"))
        return ids[start - first * BLOCK_IDS : stop - first * BLOCK_IDS]


def read_token_files(manifest: DataFrame, id_type: str = "bigint") -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, file.

    Where each file starts is a running sum over the manifest, which has one row for each file.
    """
    spark = manifest.sparkSession
    at, starts = 0, []
    for r in manifest.orderBy("part").toLocalIterator():
        starts.append((r["uri"], at))
        at += r["ids"]
    if not starts:
        return spark.createDataFrame([], f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, file string")

    kind = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[id_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                documents = read_documents(uri)
                while some := list(itertools.islice(documents, READ_DOCS)):
                    counts = np.array([len(ids) for _, ids in some], np.int64)
                    sums = [zlib.crc32(ids.data) for _, ids in some]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name for name, _ in some], kind), pa.array(start + np.cumsum(counts) - counts), pa.array(counts), pa.array(sums, pa.int64()), pa.array([uri] * len(some), pa.string())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32", "file"],
                    )
                    start += int(counts.sum())

    dealt = spark.createDataFrame(starts, "uri string, start long").repartition(len(starts))
    return dealt.mapInArrow(run, f"doc_id {id_type}, start long, n_tokens long, ids_crc32 long, file string")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    manifest = write_token_files(docs, new_path(spark, "token-files"), tokenizer_path("byte_bpe_50k.json"))
    return read_token_files(manifest, docs.schema["doc_id"].dataType.simpleString()).select("doc_id", "start", "n_tokens", "ids_crc32")


QUERIES = {"op8_token_files": op8_token_files}
#: Byte-pair encoding has no SQL; tests/llm holds the files against the library's ids.
ORACLE_SQL: dict[str, str] = {}
