"""SentencePiece encoding and decoding by forward states shared over prefixes.

Spaces become marks, and a text falls into marked words that no piece crosses. The
distinct words of a batch are sorted, which is a depth-first walk of their trie: each
word keeps the forward states of the prefix that it shares with the one before and
adds those of its other characters. A state is the best last piece of a prefix.

For a unigram model that is Viterbi: the piece that gives the best sum of scores. A
model of merges (BPE) is not the best sum of anything, and Viterbi over its scores gives
other ids than the model's own; there the state is the one piece whose merges agree with those of
the prefix before it, by which the ids are exactly the model's. Characters without a piece become bytes.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import extended, free_name, read, text_of, texts
from .tokens import tokenizer_path

MARK = "▁"
UNIGRAM, BPE = 1, 2
#: Distinct marked words that a Python worker remembers: so many of the latest, and as many from before.
MOST_WORDS = 250_000
#: Pairs of pieces that it remembers to agree or not.
MOST_PAIRS = 500_000
LONE = -2
_WORDS = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
_MODELS: dict[str, PieceModel] = {}


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            n = varint()
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield tag >> 3, value


class PieceModel:
    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        trainer = dict(_fields(next(v for k, v in top if k == 2)))
        normalizer = dict(_fields(next(v for k, v in top if k == 3)))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE) or normalizer.get(2) or normalizer.get(4, 1):
            raise ValueError("only unigram and BPE models that keep all characters and white space are known")
        self.prefix = bool(normalizer.get(3, 1))
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(names) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.scores = [sp.get_score(i) for i in range(n)]
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = all(sp.is_byte(i) for i in self.bytes)
        self.unknown = sp.unk_id()
        self.by_id = [bytes([self.bytes.index(i)]) if self.fallback and sp.is_byte(i) else b"" if sp.is_control(i) else names[i].encode() for i in range(n)]
        used = [self.scores[i] for i in self.ids.values()]
        self.lone = min(used) - 10  # the score of a character without a piece
        self.names = names
        # every ending of a piece: the id if it is a piece itself, else -1
        self.endings = {p[i:]: -1 for p in self.ids for i in range(1, len(p))} | self.ids
        self.agree: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> PieceModel:
        if path not in _MODELS:
            _MODELS[path] = cls(path)
        return _MODELS[path]

    def marked(self, text: str) -> str:
        return (MARK if text and self.prefix else "") + text.replace(" ", MARK)

    # ------------------------------------------------ one word

    def merged(self, word: str) -> list[str]:
        """The pieces of a word by merging: the neighbours whose join has the best score, the leftmost first, until none has a piece. Joins wait in a heap, so that a long word takes n log n steps."""
        n = len(word)
        ends = list(range(1, n + 1))  # where the piece that starts here ends; 0 once it is part of another
        before = list(range(-1, n - 1))
        waiting: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = ends[i]
            if j < n:
                k = self.ids.get(word[i : ends[j]])
                if k is not None:
                    heapq.heappush(waiting, (-self.scores[k], i, j, ends[j]))

        for i in range(n - 1):
            offer(i)
        while waiting:
            _, i, j, end = heapq.heappop(waiting)
            # an offer counts only while both pieces are as they were
            if ends[i] != j or ends[j] != end:
                continue
            ends[i], ends[j] = end, 0
            if end < n:
                before[end] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(word[i : ends[i]])
            i = ends[i]
        return out

    def agrees(self, left: int, right: int) -> bool:
        """Whether merging the two pieces' characters gives the two pieces again; before the first piece (-1) whether merging gives the piece."""
        pair = (left << 20) + right
        out = self.agree.get(pair)
        if out is None:
            if len(self.agree) > MOST_PAIRS:
                self.agree.clear()
            two = [self.names[left], self.names[right]] if left >= 0 else [self.names[right]]
            out = self.agree[pair] = self.merged("".join(two)) == two
        return out

    def walk(self, words: list[str]) -> Iterator[list[str]]:
        """The pieces of each of the sorted ``words``; forward states of a shared prefix are made once."""
        endings, scores, kind = self.endings, self.scores, self.kind
        before = ""
        # of the first i characters: the best last piece, its id (LONE for a character without one), the sum of scores
        last, number, score = [""], [-1], [0.0]
        for word in words:
            n = 0
            for a, b in zip(before, word, strict=False):
                if a != b:
                    break
                n += 1
            del last[n + 1 :], number[n + 1 :], score[n + 1 :]
            for i in range(len(last), len(word) + 1):
                best, pick, k = -float("inf"), "", LONE
                for j in range(i - 1, -1, -1):
                    piece = word[j:i]
                    found = endings.get(piece)
                    if found is None:  # no piece ends so
                        if j == i - 1:
                            best, pick, k = score[j] + self.lone, piece, LONE
                        break
                    if kind == BPE:
                        # a character without a piece merges with nothing, so all agrees with it
                        if found >= 0 and (number[j] == LONE or self.agrees(number[j], found)):
                            best, pick, k = 0.0, piece, found
                            break
                        if found < 0 and j == i - 1:
                            best, pick, k = 0.0, piece, LONE
                    else:
                        s = score[j] + (scores[found] if found >= 0 else self.lone if j == i - 1 else -float("inf"))
                        if s > best:
                            best, pick, k = s, piece, found if found >= 0 else LONE
                last.append(pick)
                number.append(k)
                score.append(best)
            out, i = [], len(word)
            while i:
                out.append(last[i])
                i -= len(last[i])
            yield out[::-1]
            before = word

    def numbers(self, pieces: list[str]) -> bytes:
        """Ids as little-endian 32-bit integers; a piece that is not one becomes its bytes, or the unknown id."""
        out = array("I")
        for p in pieces:
            k = self.ids.get(p)
            if k is not None:
                out.append(k)
            elif self.fallback:
                out.extend(self.bytes[b] for b in p.encode())
            else:
                out.append(self.unknown)
        return out.tobytes()

    # ------------------------------------------------ texts

    def encode(self, batch: list[str]) -> list[bytes]:
        split = [_WORDS.findall(self.marked(t)) for t in batch]
        if len(self.known) > MOST_WORDS:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = set().union(*split).difference(known)
        known.update({w: older[w] for w in new if w in older})
        # words that begin with several marks hold pieces of equal scores, whose order the states don't tell
        odd = [w for w in new if w not in known and self.kind == BPE and w.startswith(MARK * 2)]
        known.update((w, self.numbers(self.merged(w))) for w in odd)
        rest = sorted(w for w in new if w not in known)
        known.update(zip(rest, map(self.numbers, self.walk(rest)), strict=True))
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        out = b"".join(map(self.by_id.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return out[1:] if self.prefix and out.startswith(" ") else out


def code_pieces(df: DataFrame, path: str, text_column: str = "text", decoded: bool = False) -> DataFrame:
    """``df`` with ``ids`` (binary: little-endian unsigned 32-bit integers) of every whole text, and with ``decoded``, if asked for, the text that those ids give.

    A null text, like an empty one, has no ids. A text that holds the mark itself comes back with a space
    in its place; all others as they were. New columns whose names are taken get underscores in front.
    """
    names = [free_name(df.columns, n) for n in ("ids", "decoded")[: 1 + decoded]]
    schema = extended(df, *zip(names, ("binary", "string"), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.of(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = model.encode(texts(part, text_column).to_pylist())
                more = [pa.array([model.decode(x) for x in ids], pa.string())] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()), *more], names=schema.names)

    return df.mapInArrow(run, schema)


def decode_pieces(df: DataFrame, path: str, ids_column: str = "ids") -> DataFrame:
    """``df`` with ``decoded``: the text of the ids, whoever made them. Null ids are none."""
    name = free_name(df.columns, "decoded")
    schema = extended(df, (name, "string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = PieceModel.of(path)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = part.column(part.schema.get_field_index(ids_column)).to_pylist()
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([model.decode(x or b"") for x in ids], pa.string())], names=schema.names)

    return df.mapInArrow(run, schema)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = code_pieces(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("piece_bpe_32k.model"), decoded=True)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == text_of("text")).alias("round_trip"),
    )


QUERIES = {"op5_sentencepiece": op5_sentencepiece}
#: Merging pieces has no SQL; tests/llm compares with the library and with all segmentations.
ORACLE_SQL: dict[str, str] = {}
