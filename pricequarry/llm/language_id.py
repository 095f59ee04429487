"""Language identification by interpolated Kneser-Ney character models.

For each language a model of the letters of words (lower case; whatever is not a
letter is one space) gives each character's probability after the ORDER - 1 before it.
Spark counts the n-grams; a task for each language works out all its probabilities: sorted
arrays of n-gram hashes hold every n-gram's logarithm, and for every context
the weight of backing off. The arrays are a written table, which the tasks that score
read, so nothing of the models passes through the driver. A text's score in a language is its
cross-entropy in bits a character; the least wins. A text whose least cross-entropy is beyond
what labelled texts of that language and length show is rejected.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import dropped, extended, free_name, keep_only, kept_by, opened, read, texts, written

ORDER = 4
#: Labelled characters of each language that its model learns from, about: the bound of the sample. Its rows are chosen by a hash of the id.
LEARN_CHARS = 1_500_000
#: Labelled rows of each language, about, that set its limits for rejection; none of them is learned from.
CALIBRATE_ROWS = 4_000
#: Limits are set for lengths of 2 ** 0 up to 2 ** (BANDS - 1) letters.
BANDS = 15
UNKNOWN = "und"
#: Texts whose letters are held at once, and letters that are scored at once.
_TEXTS, _CHUNK = 256, 1 << 17
#: The code points' letters, once they are needed.
_CODES: dict[str, np.ndarray] = kept_by("letters")
#: Tables that a Python worker has read, by path; those of the model used last.
_READ: dict[str, list[Tables]] = kept_by("languages")


def _codes() -> np.ndarray:
    """For each code point, that of its lower case if it is a letter, else a space."""
    if "all" not in _CODES:
        out = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if chr(c).isalpha():
                low = chr(c).lower()
                out[c] = ord(low) if len(low) == 1 else c
        _CODES["all"] = out
    return _CODES["all"]


def letters(text: str) -> np.ndarray:
    """Lower-cased letters with single spaces between words, and one before and after; empty if there is no letter."""
    if not text:
        return np.zeros(0, np.uint32)
    codes = _codes()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    padded = np.empty(len(codes) + 2, np.uint32)
    padded[0] = padded[-1] = 32
    padded[1:-1] = codes
    keep = np.ones(len(padded), bool)
    keep[1:] = (padded[1:] != 32) | (padded[:-1] != 32)
    out = padded[keep]
    return out if len(out) > 2 else out[:0]


def _fold(columns: list[np.ndarray]) -> np.ndarray:
    """Hashes of n-grams whose characters stand in ``columns``. Up to three characters they are the characters themselves; longer ones are mixed, in 64 bits."""
    out = columns[0].astype(np.uint64)
    for c in columns[1:]:
        out = (out << np.uint64(21) | c) if len(columns) <= 3 else (out * np.uint64(0x9E3779B97F4A7C15) + c + np.uint64(1)) ^ (out >> np.uint64(29))
    return out


def ngram_keys(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams that end at positions n - 1 and on."""
    return _fold([codes[k : len(codes) - n + 1 + k] for k in range(n)])


# ---------------------------------------------------------------- learning


def _count(order: int):
    """From (lang, text) rows to (lang, n, key, context, suffix, count), summed over a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, n), parts in held.items():
                key, context, suffix, count = (np.concatenate(x) for x in zip(*parts, strict=True))
                key, first, inverse = np.unique(key, return_index=True, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(key)), pa.array(np.full(len(key), n, np.int32)), pa.array(key.view(np.int64)), pa.array(context[first].view(np.int64)), pa.array(suffix[first].view(np.int64)), pa.array(np.bincount(inverse, weights=count).astype(np.int64))],
                    names=["lang", "n", "key", "context", "suffix", "count"],
                )
            held.clear()

        for b in batches:
            langs = b.column(0).to_pylist()
            by: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(langs, texts(b, "text").to_pylist(), strict=True):
                by.setdefault(lang, []).append(letters(text))
            for lang, parts in by.items():
                for codes in parts:
                    for n in range(1, order + 1):
                        if len(codes) < n:
                            continue
                        key = ngram_keys(codes, n)
                        m = len(key)
                        context = ngram_keys(codes[:-1], n - 1)[:m] if n > 1 else np.zeros(m, np.uint64)
                        suffix = ngram_keys(codes[1:], n - 1)[:m] if n > 1 else np.zeros(m, np.uint64)
                        held.setdefault((lang, n), []).append((key, context, suffix, np.ones(m)))
                        size += m
                        if size > 1 << 20:
                            yield from flush()
                            size = 0
        yield from flush()

    return run


def _kneser_ney(order: int, alphabet: int):
    """From the counts of one language to a row for each n: sorted n-gram hashes with their logarithms, and sorted context hashes with the weights of backing off.

    Interpolated Kneser-Ney: discounted counts at the highest order, and below it the number
    of different characters that an n-gram follows.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out, logs_below, keys_below = [], None, None
        by = {n: rows for n, rows in pdf.groupby("n")}
        for n in range(1, order + 1):
            rows = by.get(n)
            if rows is None:
                break
            keys, context, suffix = (rows[c].to_numpy(np.int64).view(np.uint64) for c in ("key", "context", "suffix"))
            at = np.argsort(keys)
            keys, context, suffix = keys[at], context[at], suffix[at]
            if n == order or n + 1 not in by:
                table = rows["count"].to_numpy(np.float64)[at]
            else:
                table = np.bincount(np.searchsorted(keys, by[n + 1]["suffix"].to_numpy(np.int64).view(np.uint64)), minlength=len(keys)).astype(np.float64)
            ones, twos = (table == 1).sum(), (table == 2).sum()
            discount = min(0.95, max(0.1, ones / max(1, ones + 2 * twos)))
            contexts, group = np.unique(context, return_inverse=True)
            total = np.bincount(group, weights=table, minlength=len(contexts))
            kinds = np.bincount(group, weights=table > 0, minlength=len(contexts))
            weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            lower = 1 / alphabet if n == 1 else np.exp2(logs_below[np.searchsorted(keys_below, suffix)])
            logs_below = np.log2(np.maximum(table - discount, 0) / np.maximum(total[group], 1) + weight[group] * lower)
            keys_below = keys
            out.append((key[0], n, keys.tobytes(), logs_below.astype("<f4").tobytes(), contexts.tobytes(), np.log2(weight).astype("<f4").tobytes()))
        return pd.DataFrame(out, columns=["lang", "n", "keys", "logs", "contexts", "backoffs"])

    return run


class Tables:
    """One language's arrays: for n of 1 up to the order, sorted ``keys[n]`` with ``logs[n]``, and sorted ``contexts[n]`` with ``backoffs[n]``."""

    def __init__(self, alphabet: int):
        self.keys: dict[int, np.ndarray] = {}
        self.logs: dict[int, np.ndarray] = {}
        self.contexts: dict[int, np.ndarray] = {}
        self.backoffs: dict[int, np.ndarray] = {}
        self.floor = np.float32(-math.log2(alphabet))

    def window_logs(self, keys: dict[int, np.ndarray], contexts: dict[int, np.ndarray]) -> np.ndarray:
        """The log-probability of the last character of windows whose last n characters have the hashes ``keys[n]``, and those before the last ``contexts[n]``."""
        m = len(keys[1])
        out, open_ = np.zeros(m, np.float32), np.arange(m)  # windows whose longest known n-gram is still sought
        for n in sorted(self.keys, reverse=True):
            mine = keys[n][open_]
            i = np.minimum(np.searchsorted(self.keys[n], mine), len(self.keys[n]) - 1)
            known = self.keys[n][i] == mine
            out[open_[known]] += self.logs[n][i[known]]
            open_ = open_[~known]
            if not len(open_):
                return out
            before = contexts[n][open_]
            j = np.minimum(np.searchsorted(self.contexts[n], before), len(self.contexts[n]) - 1)
            seen = self.contexts[n][j] == before
            out[open_[seen]] += self.backoffs[n][j[seen]]
        out[open_] += self.floor  # a character that the language lacks
        return out


class Model:
    """Where the tables of all languages are (a written table), and the limits of each language and length. Small: it travels with the tasks."""

    def __init__(self, path: str, langs: list[str], order: int, alphabet: int):
        self.path, self.langs, self.order, self.alphabet = path, langs, order, alphabet
        self.limits = np.full((len(langs), BANDS), math.log2(alphabet))

    def tables(self) -> list[Tables]:
        """The tables in the order of ``langs``, read once by each worker."""
        if self.path not in _READ:
            fs, path = opened(self.path)
            found = {lang: Tables(self.alphabet) for lang in self.langs}
            with_rows = pq.read_table(path, filesystem=fs)
            for batch in with_rows.to_batches(max_chunksize=1):
                for r in batch.to_pylist():
                    t, n = found[r["lang"]], r["n"]
                    t.keys[n], t.contexts[n] = np.frombuffer(r["keys"], "<u8"), np.frombuffer(r["contexts"], "<u8")
                    t.logs[n], t.backoffs[n] = np.frombuffer(r["logs"], "<f4"), np.frombuffer(r["backoffs"], "<f4")
            _READ.clear()
            _READ[self.path] = [found[lang] for lang in self.langs]
        return _READ[self.path]

    def char_logs(self, codes: np.ndarray, langs: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(languages, distinct windows) log-probabilities, and for each character from position order - 1 on the number of its window. Each distinct window is looked up once."""
        order = self.order
        number, _ = pd.factorize(ngram_keys(codes, order))
        first = np.empty(int(number.max()) + 1 if len(number) else 0, np.int64)
        first[number[::-1]] = np.arange(len(number))[::-1]
        columns = [codes[first + k] for k in range(order)]
        keys = {n: _fold(columns[order - n :]) for n in range(1, order + 1)}
        contexts = {n: _fold(columns[order - n : -1]) if n > 1 else np.zeros(len(first), np.uint64) for n in range(1, order + 1)}
        tables = self.tables()
        return np.stack([tables[i].window_logs(keys, contexts) for i in langs]), number

    def entropies(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) bits a character, and each text's number of characters; texts are scored whole, _TEXTS of them together."""
        parts = [self._entropies(batch[at : at + _TEXTS]) for at in range(0, max(1, len(batch)), _TEXTS)]
        return np.concatenate([b for b, _ in parts]), np.concatenate([n for _, n in parts])

    def _entropies(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = [letters(t) for t in batch]
        lengths = np.array([max(0, len(c) - 1) for c in codes], np.int64)
        sums = np.zeros((len(batch), len(self.langs)))
        # zeros between texts are in no n-gram, so no character is scored after those of another text
        gap, everyone = np.zeros(self.order - 2, np.uint32), list(range(len(self.langs)))
        at = 0
        while at < len(batch):
            end, n = at, 0
            while end < len(batch) and (end == at or n + len(codes[end]) <= _CHUNK):
                n += len(codes[end])
                end += 1
            some = [i for i in range(at, end) if lengths[i]]
            if some:
                flat = np.concatenate([x for i in some for x in (gap, codes[i])])
                # whose character it is; nobody's for a gap and a text's first space
                owner = np.concatenate([np.repeat([len(batch), i], [len(gap) + 1, lengths[i]]) for i in some])
                for i in range(self.order - 1, len(flat), _CHUNK):
                    logs, number = self.char_logs(flat[i - self.order + 1 : i + _CHUNK], everyone)
                    whose = owner[i : i + _CHUNK]
                    for k in everyone:
                        sums[:, k] += np.bincount(whose, weights=logs[k][number], minlength=len(batch) + 1)[: len(batch)]
            at = end
        return -sums / np.maximum(lengths, 1)[:, None], lengths

    def excerpts(self, text: str, lang: int) -> list[tuple[int, float]]:
        """(band, bits a character) of the text as a whole, and of an excerpt of 2 ** band letters from a word's beginning on for each band that it has room for."""
        codes = letters(text)
        m = len(codes) - 1
        if m < 1:
            return []
        flat = np.concatenate([np.zeros(self.order - 2, np.uint32), codes])
        bits = np.zeros(m + 1)
        for i in range(0, m, _CHUNK):
            logs, number = self.char_logs(flat[i : i + _CHUNK + self.order - 1], [lang])
            bits[i + 1 : i + 1 + len(number)] = -logs[0][number]
        bits = np.cumsum(bits)
        out = [(min(BANDS - 1, m.bit_length() - 1), float(bits[m]) / m)]
        spaces = np.flatnonzero(codes == 32)
        chance = zlib.crc32(codes.tobytes())
        for band in range(BANDS):
            starts = spaces[: np.searchsorted(spaces, m - (1 << band), side="right")]
            if len(starts):
                s = int(starts[chance * (band + 1) % len(starts)])
                out.append((band, float(bits[s + (1 << band)] - bits[s]) / (1 << band)))
        return out

    def limit(self, lang: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The cross-entropy beyond which a text of that length is none of the language."""
        band = np.minimum(BANDS - 1, np.frexp(np.maximum(lengths, 1).astype(np.float64))[1] - 1)
        return self.limits[lang, band]


def learn(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", order: int = ORDER, learn_chars: int = LEARN_CHARS, calibrate_rows: int = CALIBRATE_ROWS) -> Model | None:
    """A model of the languages in ``df``'s non-null labels, or None without any.

    Counts of rows and characters take in all labelled rows; the n-grams are those of
    a sample of about ``learn_chars`` characters of each language, chosen by a hash of
    the id from three quarters of the rows, and the limits come from about ``calibrate_rows`` rows of
    each language in the last quarter. A language of fewer than 8 rows is learned from all of
    them, and its limit is what a letter drawn at random from its alphabet costs. Rows without a text or label count for nothing, rows
    with a null id are one for the hash, and repeated rows count as often as they stand.
    """
    spark = df.sparkSession
    rows = df.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"), F.col(lang_column).cast("string").alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: (r["n"], r["c"]) for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("c")).where("c > 0").collect()}
    if not sizes:
        return None
    langs = sorted(sizes)
    drawn = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(1)), F.lit(1 << 30)) / float(1 << 30)

    def chosen(shares: dict[str, float], start: float, width: float) -> DataFrame:
        """Rows whose hash falls into that share of their language's part of [start, start + width)."""
        rate = F.element_at(F.create_map(*[F.lit(x) for lang, share in shares.items() for x in (lang, share * width)]), F.col("lang"))
        return rows.where((drawn >= start) & (drawn < F.lit(start) + rate)).select("lang", "text")

    # of a language with few rows all are learned from, so that none goes unknown; its limits come from its alphabet then
    few = [lang for lang in langs if sizes[lang][0] < 8]
    sample = chosen({lang: min(1.0, learn_chars / max(1, sizes[lang][1]) / 0.75) for lang in langs if lang not in few}, 0.0, 0.75) if len(few) < len(langs) else None
    if few:
        whole = rows.where(F.col("lang").isin(few)).select("lang", "text")
        sample = whole if sample is None else sample.unionByName(whole)
    counts = written(sample.mapInArrow(_count(order), "lang string, n int, key long, context long, suffix long, count long").groupBy("lang", "n", "key", "context", "suffix").agg(F.sum("count").alias("count")), "ngrams")
    alphabet = 1 + max(1, counts.where("n = 1").select("key").distinct().count())
    # a language's group holds at most order * learn_chars n-grams
    tables = written(counts.groupBy("lang").applyInPandas(_kneser_ney(order, alphabet), "lang string, n int, keys binary, logs binary, contexts binary, backoffs binary"), "language-tables")
    dropped(counts)
    letters_of = {r["lang"]: r["n"] for r in tables.where("n = 1").select("lang", (F.octet_length("keys") / 8).alias("n")).collect()}
    langs = [lang for lang in langs if lang in letters_of]
    if not langs:
        return None
    model = Model(tables._pq_path, langs, order, alphabet)
    at = {lang: i for i, lang in enumerate(langs)}

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("languages", "letters")
        for b in batches:
            found = [(lang, band, bits) for lang, text in zip(b.column(0).to_pylist(), texts(b, "text").to_pylist(), strict=True) if lang in at for band, bits in model.excerpts(text, at[lang])]
            own, band, bits = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(band, pa.int32()), pa.array(bits, pa.float64())], names=["lang", "band", "bits"])

    # a share of 0 for languages without rows to spare: what is learned from sets no limits
    rest = chosen({lang: 0.0 if lang in few else min(1.0, calibrate_rows / sizes[lang][0] / 0.25) for lang in langs}, 0.75, 0.25)
    seen = rest.mapInArrow(measure, "lang string, band int, bits double").groupBy("lang", "band").agg(F.percentile("bits", F.array(F.lit(0.5), F.lit(0.9))).alias("q"))
    found = {(r["lang"], r["band"]): r["q"] for r in seen.collect()}  # a row for each language and band
    for lang, i in at.items():
        chance = math.log2(1 + letters_of[lang])  # what a letter drawn at random from the language's own costs
        limit = math.inf
        for band in range(BANDS):
            if (lang, band) in found:
                half, most = found[lang, band]
                # half way from the usual to chance, and as much more as labelled texts of that length stray; quantiles within nine tenths, so that mixed and mislabelled texts do not count. A longer text keeps to the limit of shorter ones
                limit = min(limit, (half + max(chance, half)) / 2 + 2 * (most - half))
            model.limits[i, band] = limit if math.isfinite(limit) else chance
    return model


# ---------------------------------------------------------------- prediction


def identify(df: DataFrame, model: Model | None, text_column: str = "text") -> DataFrame:
    """``df`` with lang_pred, score, bits (a character) and rejected.

    ``lang_pred`` is the language of least cross-entropy (ties: the first by name), or
    ``und`` for a null text, one without a letter, or without a model. ``score`` is the share of
    the winner when languages are weighed by two to the power of minus ten times their bits a
    character; 0 for ``und``. ``rejected`` is true for ``und``, and where the bits exceed the limit that
    labelled texts of that language and length set. Every text is read whole, repeated rows each by
    themselves and alike; an empty table gives an empty result. New columns whose names are taken
    get underscores in front.
    """
    names = [free_name(df.columns, n) for n in ("lang_pred", "score", "bits", "rejected")]
    schema = extended(df, *zip(names, ("string", "double", "double", "boolean"), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_only("languages", "letters")
        for b in batches:
            n = b.num_rows
            if model is None:
                columns = [pa.array([UNKNOWN] * n, pa.string()), pa.array(np.zeros(n)), pa.nulls(n, pa.float64()), pa.array(np.ones(n, bool))]
            else:
                bits, lengths = model.entropies(texts(b, text_column).to_pylist())
                best = bits.argmin(axis=1) if n else np.zeros(0, np.int64)
                least = bits[np.arange(n), best]
                score = 1 / np.exp2(np.maximum(-1000, -10 * (bits - least[:, None]))).sum(axis=1)
                none = lengths == 0
                columns = [
                    pa.array([UNKNOWN if x else model.langs[i] for i, x in zip(best, none, strict=True)], pa.string()),
                    pa.array(np.where(none, 0.0, score)),
                    pa.array(least, mask=none),
                    pa.array(none | (least > model.limit(best, lengths))),
                ]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=schema.names)

    return df.mapInArrow(run, schema)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1
    model = learn(docs.where(~held_out))
    found = identify(docs.select("doc_id", "text", F.coalesce(held_out, F.lit(False)).alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "bits", "rejected")


QUERIES = {"op4_language_id": op4_language_id}
#: A trained model has no SQL; tests/llm measures its accuracy on held-out rows and checks its probabilities.
ORACLE_SQL: dict[str, str] = {}
