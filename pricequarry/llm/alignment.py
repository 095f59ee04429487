"""Alignment of two tokenizers' ids of the same texts by a dangling-suffix transducer.

Both id sequences of a text spell the same bytes. The transducer takes ids in turn and
holds which side leads and by which bytes that the other has not spelled yet; the side behind gives the
next id. Where nothing is left over, both end at the same byte and a group of ids closes.
The leading bytes are always the end of one id's bytes, so there are few states, and
what a state and a next id lead to is worked out once and remembered. Groups that come
again are remembered too, with their links: all pairs of an id of one side and an id
of the other. A space before a character that is not blank begins an id on either side,
so nothing is left over there: a stretch between such spaces always falls into the same groups, and the
transducer runs once over each distinct one that a worker remembers.

How many documents link a pair is counted in Spark. The pairs that most documents
hold are then joined by a broadcast of bounded size, all others by shuffling.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import dropped, read, texts, written
from .pieces import MARK, PieceModel
from .tokens import BLANKS, Encoder, tokenizer_path

#: An A id and a B id as one number, and the id that a state is joined with.
SHIFT = 20
#: What a worker remembers: distinct stretches with their groups (so many of the latest, and as many from before), transitions, and ids in the groups.
MOST_STRETCHES, MOST_STEPS, MOST_IDS = 250_000, 500_000, 1_000_000
#: Texts whose spaces are not all borders, or that the mark of the piece model spells otherwise, are taken whole.
_WHOLE = rf"^ | (?:[{BLANKS}]|$)|{MARK}"
#: Pairs that are broadcast, at most (about 40 bytes each).
MOST_PAIRS = 1 << 19
#: Documents aligned together.
DOCS = 1000
#: A text of a batch and a pair or a group as one number.
ROW, MASK = 40, (1 << 40) - 1
#: Ids of either side, and the numbers of the groups.
Aligned = tuple[int, int, tuple]
NOTHING: Aligned = (0, 0, ())
_ALIGNERS: dict[tuple[str, str], "Aligner"] = {}


class Apart(Exception):
    """The two sides do not spell the same bytes."""


class Transducer:
    """Closes groups of ids whose bytes end together. ``a`` and ``b`` are the bytes of each id of the two sides."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.a, self.b = a, b
        #: Residuals by number; a state is twice the residual's number, and one more where side B leads. The empty one is state 0.
        self.residuals: list[bytes] = [b""]
        self.numbers: dict[bytes, int] = {b"": 0}
        self.clear_steps()
        self.clear_kinds()

    def clear_steps(self) -> None:
        #: From the empty residual an id of each side is taken at once: the number of the group that closes, or ~state.
        self.opened: dict[int, int] = {}
        self.steps: dict[int, int] = {}

    def clear_kinds(self) -> None:
        self.opened = {k: v for k, v in self.opened.items() if v < 0}
        self.kinds: dict[tuple, int] = {}
        #: Of each kind of group: how it is written, its links as (pair, times), their number.
        self.written: list[str] = []
        self.links: list[list[tuple[int, int]]] = []
        self.ids = 0

    def rest(self, lead: bytes, token: bytes, b_leads: int) -> int:
        """The state after the side behind spells ``token`` against the leading bytes."""
        if lead.startswith(token):
            left = lead[len(token) :]
        elif token.startswith(lead):
            left, b_leads = token[len(lead) :], 1 - b_leads
        else:
            raise Apart
        if not left:
            return 0
        number = self.numbers.get(left)
        if number is None:
            number = self.numbers[left] = len(self.residuals)
            self.residuals.append(left)
        return 2 * number + b_leads

    def open(self, x: int, y: int) -> int:
        state = self.rest(self.a[x], self.b[y], 0)
        out = self.opened[x << SHIFT | y] = ~state if state else self.kind((x,), (y,))
        return out

    def step(self, state: int, token: int) -> int:
        b_leads = state & 1
        out = self.steps[state << SHIFT | token] = self.rest(self.residuals[state >> 1], (self.a if b_leads else self.b)[token], b_leads)
        return out

    def kind(self, xs: tuple, ys: tuple) -> int:
        """The number of a group of these ids."""
        out = self.kinds.get((xs, ys))
        if out is None:
            out = self.kinds[xs, ys] = len(self.written)
            self.written.append(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)))
            right = Counter(ys).items()
            self.links.append([(x << SHIFT | y, n * m) for x, n in Counter(xs).items() for y, m in right])
            self.ids += len(xs) + len(ys) + len(self.links[-1])
        return out

    def groups(self, xs: list[int], ys: list[int]) -> list[int]:
        """The numbers of the groups that the ids fall into, in order; :class:`Apart` if the sides spell other bytes."""
        opened, steps, out = self.opened, self.steps, []
        i, j, n = 0, 0, len(xs)
        try:
            while i < n:
                x, y = xs[i], ys[j]
                found = opened.get(x << SHIFT | y)
                if found is None:
                    found = self.open(x, y)
                i += 1
                j += 1
                if found < 0:
                    first, other, state = i - 1, j - 1, ~found
                    while state:
                        if state & 1:
                            token = xs[i]
                            i += 1
                        else:
                            token = ys[j]
                            j += 1
                        after = steps.get(state << SHIFT | token)
                        state = self.step(state, token) if after is None else after
                    found = self.kind(tuple(xs[first:i]), tuple(ys[other:j]))
                out.append(found)
        except IndexError:
            raise Apart from None
        if j != len(ys):
            raise Apart
        return out


def byte_level(token: str) -> bytes:
    """The bytes of a token of a byte-level vocabulary, where printable Latin-1 characters are themselves and the n-th other byte is character 256 + n."""
    return bytes(map(_BYTES.__getitem__, token))


_SELF = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace()]
_BYTES = {chr(b): b for b in _SELF} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in _SELF)}


class Aligner:
    """Both tokenizers, by their libraries, and the transducer over their ids."""

    def __init__(self, bpe_path: str, piece_path: str):
        self.encoder = Encoder(bpe_path, plain=True)
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        vocabulary = self.encoder.tokenizer
        added = vocabulary.get_added_tokens_decoder()
        a = [added[i].content.encode() if i in added else byte_level(vocabulary.id_to_token(i)) for i in range(vocabulary.get_vocab_size())]
        self.transducer = Transducer(a, [x.replace(MARK.encode(), b" ") for x in PieceModel(piece_path).by_id])
        self.sizes = np.array(list(map(len, a)), np.int64)
        self.known: dict[str, Aligned | None] = {"": NOTHING}
        self.older: dict[str, Aligned | None] = {}

    @classmethod
    def of(cls, bpe_path: str, piece_path: str) -> Aligner:
        if (bpe_path, piece_path) not in _ALIGNERS:
            _ALIGNERS[bpe_path, piece_path] = cls(bpe_path, piece_path)
        return _ALIGNERS[bpe_path, piece_path]

    def tidy(self) -> None:
        """Forgets, between texts, what is too much to remember."""
        machine = self.transducer
        if len(machine.steps) + len(machine.opened) > MOST_STEPS:
            machine.clear_steps()
        if machine.ids > MOST_IDS:
            machine.clear_kinds()
            self.known, self.older = {"": NOTHING}, {}
        if len(self.known) > MOST_STRETCHES:
            self.known, self.older = {"": NOTHING}, self.known

    def run(self, parts: list[str]) -> dict[str, Aligned | None]:
        """Of each part with a space before it: (A ids, B ids, groups), or None if a side spells other bytes."""
        machine, out = self.transducer, {}
        # those without a line's end are encoded together, with ends of lines between them
        parts = sorted(parts, key=lambda t: "\n" in t)
        lines = sum("\n" not in t for t in parts)
        led = [f" {t}" for t in parts]
        a = self.encoder.many(led[:lines]) + self.encoder.whole(led[lines:])
        ends = np.cumsum([len(x) // 4 for x in a]).tolist()
        ids = np.frombuffer(b"".join(a), "<u4")
        spelled = self.sizes[ids]
        wanted = np.array([len(t.encode()) for t in led], np.int64)
        ids = ids.tolist()
        # side A is held against the texts, all at once if it can be, and side B against side A
        sure = (np.diff(np.r_[0, np.cumsum(spelled)][np.r_[0, ends].astype(int)]) == wanted).all() and b"".join(map(machine.a.__getitem__, ids)) == "".join(led).encode()
        start = 0
        for text, end, ys in zip(parts, ends, self.pieces.encode(parts, num_threads=1), strict=True):
            xs, start = ids[start:end], end
            try:
                if not sure and b"".join(map(machine.a.__getitem__, xs)) != b" " + text.encode():
                    raise Apart
                out[text] = len(xs), len(ys), tuple(machine.groups(xs, ys))
            except Apart:
                out[text] = None
        return out

    def stretches(self, column: pa.Array, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[Aligned | None], np.ndarray]:
        """The texts as runs of stretches: where each text's begin (with the end), their numbers, and what each number stands for; and the texts with a stretch that is apart."""
        odd = np.flatnonzero(whole)
        lists = pc.split_pattern(pc.if_else(pa.array(whole), "", column), " ")
        coded = lists.flatten().dictionary_encode()
        words, flat, starts = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), np.asarray(lists.offsets).astype(np.int64)
        known, older = self.known, self.older
        new = [w for w in words if w not in known]
        known.update({w: older[w] for w in new if w in older})
        known.update(self.run([w for w in new if w not in known]))
        found = list(map(known.__getitem__, words))
        # a text that is taken whole is one stretch, which is not remembered
        flat[starts[odd]] = len(found) + np.arange(len(odd))
        texts_ = column.take(pa.array(odd)).to_pylist()
        results = self.run(list(set(texts_)))
        found += [results[t] or NOTHING for t in texts_]
        apart = np.array([x is None for x in found], bool)
        return starts, flat, found, np.unique(np.repeat(np.arange(len(column)), np.diff(starts))[apart[flat]])

    def align(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray]:
        """Of the texts of a column without nulls: A ids, B ids, groups, the groups as they are written; where each text's links begin (with the end), their pairs and times. Nothing where there are no tokens."""
        machine = self.transducer
        whole = pc.match_substring_regex(column, _WHOLE).to_numpy(zero_copy_only=False)
        starts, flat, found, apart = self.stretches(column, whole)
        if len(apart):
            whole[apart] = True
            starts, flat, found, _ = self.stretches(column, whole)

        def sums(values: np.ndarray) -> np.ndarray:
            return np.diff(np.r_[0, np.cumsum(values[flat])][starts])

        n_a, n_b = (sums(np.array([x[k] for x in found], np.int64)) for k in (0, 1))
        sizes = np.array([len(x[2]) for x in found], np.int64)
        n_groups = sums(sizes)
        said = pa.array([";".join(map(machine.written.__getitem__, x[2])) for x in found], pa.string())
        written = pc.binary_join(pa.ListArray.from_arrays(pa.array(starts, pa.int32()), said.take(pa.array(flat))), ";").to_pylist()

        kinds = np.fromiter(itertools.chain.from_iterable(x[2] for x in found), np.int64, int(sizes.sum()))
        rows = np.repeat(np.arange(len(column)), n_groups)
        held, times = np.unique(rows << ROW | kinds[ragged(np.cumsum(sizes) - sizes, sizes, flat)], return_counts=True)
        distinct, at = np.unique(held & MASK, return_inverse=True)
        links = [machine.links[k] for k in distinct.tolist()]
        many = np.array(list(map(len, links)), np.int64)
        pairs = np.fromiter((v for x in links for v in x), np.dtype((np.int64, 2)), int(many.sum()))
        of = ragged(np.cumsum(many) - many, many, at)
        each = np.repeat(times, many[at]) * pairs[of, 1]
        keys, back = np.unique(np.repeat(held >> ROW, many[at]) << ROW | pairs[of, 0], return_inverse=True)
        total = np.zeros(len(keys), np.int64)
        np.add.at(total, back, each)
        ends = np.searchsorted(keys >> ROW, np.arange(len(column) + 1))
        return n_a, n_b, n_groups, written, ends, keys & MASK, total


def ragged(starts: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The places of the items of these rows, one row's after another's."""
    n = sizes[rows]
    return np.repeat(starts[rows] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


def _aligned(bpe_path: str, piece_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.of(bpe_path, piece_path)
        gc.disable()  # what is remembered holds no cycles, and looking for some takes a tenth of the time
        try:
            yield from work(aligner, batches)
        finally:
            gc.enable()

    def work(aligner: Aligner, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, DOCS):
                part = b.slice(at, DOCS)
                aligner.tidy()
                n_a, n_b, n_groups, written, ends, pairs, times = aligner.align(texts(part, "text"))
                n_links = np.diff(np.r_[0, np.cumsum(times)][ends])
                digests = [hashlib.sha256(w.encode()).hexdigest() if n else "" for w, n in zip(written, n_groups.tolist(), strict=True)]
                links = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(pairs), pa.array(times)], names=["pair", "times"]))
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (n_a, n_b, n_groups, n_links)), pa.array(digests, pa.string()), links], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    return run


def align_documents(df: DataFrame, bpe_path: str, piece_path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of ``df``: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, and ``links``, an array of (pair, times): each pair of an A id and a B id (A id times 2 ** SHIFT plus B id) that a group holds together, and how often.

    A is the byte-level tokenizer's ids of a space and the whole text, where special tokens'
    strings are plain text; B is the piece model's. Texts that are null or empty, or
    that either side spells otherwise (such as those that hold the mark of the piece model), have no tokens: zeros, an empty
    ``groups_sha256`` and no links. Rows that repeat an id, or have none, are rows like any other. A
    text of any length is aligned whole. An empty table gives an empty result.
    """
    kind = df.schema[id_column].dataType.simpleString()
    out = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<pair: long, times: long>>"
    return df.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(_aligned(bpe_path, piece_path), out)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how many rows of ``aligned`` hold each pair linked, and whether none of its A id's pairs has more. Counts are combined in the tasks before they shuffle."""
    counts = aligned.select(F.explode("links.pair").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    counts = written(counts, "pair-counts")
    a = F.shiftright("pair", SHIFT)
    most = counts.groupBy(a.alias("a")).agg(F.max("n").alias("most"))
    out = written(counts.join(most, a == F.col("a")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")
    dropped(counts)
    return out


def align_corpus(df: DataFrame, bpe_path: str, piece_path: str, id_column: str = "doc_id", text_column: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """:func:`align_documents` with what the whole corpus says of each row's links, in place of the links themselves: n_best, how many have the highest count of their A id's pairs (ties included), and count_sum, the sum of their counts.

    Pairs are looked up in a broadcast of the ``most_pairs`` that most documents hold
    (whole powers of two of the count, as many as fit); the rest, of which each
    is in few documents, are joined by shuffling. Rows without tokens have zeros.
    """
    row = "row"
    aligned = written(align_documents(df, bpe_path, piece_path, id_column, text_column).withColumn(row, F.monotonically_increasing_id()), "aligned")
    pairs = pair_counts(aligned)
    # how many pairs there are of each power of two of the count: at most 64 rows
    steps = pairs.groupBy((F.length(F.bin("n")) - 1).alias("k")).count().orderBy(F.desc("k")).collect()
    least, held = 1 << 62, 0
    for r in steps:
        held += r["count"]
        if held > most_pairs:
            break
        least = 1 << r["k"]
    links = aligned.select(row, F.explode("links").alias("l")).select(row, "l.pair", "l.times")
    common = pairs.where(F.col("n") >= least) if held else pairs
    found = links.join(F.broadcast(common), "pair")
    if held > most_pairs:
        rare = pairs.where(F.col("n") < least)
        found = found.unionByName(links.join(F.broadcast(common.select("pair")), "pair", "left_anti").hint("shuffle_merge").join(rare.hint("shuffle_merge"), "pair"))
    sums = found.groupBy(row).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("times")).alias("count_sum"))
    whole = aligned.drop("links").join(sums, row, "left").drop(row)
    return whole.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_best", "count_sum")})


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = align_corpus(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {"op12_alignment": op12_alignment}
#: Byte-pair encoding has no SQL; tests/llm compares with the libraries' ids and byte offsets by brute force.
ORACLE_SQL: dict[str, str] = {}
