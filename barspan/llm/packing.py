"""Pattern packing: repeat counts of few-document length patterns by non-negative least squares, residuals by best fit."""

from __future__ import annotations

import math
import os
import re
import string
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barspan.llm.common import materialize

#: Words of one generation of a Python worker's memory; it holds two, and words that are met again move to the younger.
_WORDS_KEPT = 400_000
_CONTROLS = bytes(range(0x1C, 0x20))
_LETTERS = re.compile("[A-Za-zªµºÀ-ÖØ-öø-ÿ]+")


class WordIds(dict):
    """Token ids (as bytes) of words, and of texts whose vocabulary never crosses white space; words are remembered.

    Texts with the separators U+001C to U+001F, which Python and the vocabulary take differently, are encoded whole.
    Words of Latin letters with ASCII marks behind them are put together from marks and letters, these in lower case and
    by the library's model without the steps before it; where a vocabulary does not agree with that, this is left out.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.older: dict[str, bytes] = {}
        self.tokenize = self.tokenizer.model.tokenize
        to_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        letters = [c for c in map(chr, range(256)) if _LETTERS.fullmatch(c)]
        self.byte_level = str.maketrans({c: to_bytes(c)[0][0] for c in letters if not c.isascii()})
        probes = ["The", "Übermäßig", "ÉTÉ", *letters]
        self.split_marks = all(self._letters(w.lower()) == self.whole(w) and self.whole(w + "!,'") == self.whole(w) + self.whole("!,'") for w in probes)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _letters(self, word: str) -> bytes:
        tokens = self.tokenize(word if word.isascii() else word.translate(self.byte_level))
        return b"".join([t.id.to_bytes(4, "little") for t in tokens])

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            core = word.rstrip(string.punctuation)
            if self.split_marks and _LETTERS.fullmatch(core):
                small = core.lower()
                ids = self._letters(core) if small == word else self[small] + self[word[len(core) :]] if len(core) < len(word) else self[small]
            else:
                ids = self.whole(word)
        if len(self) >= _WORDS_KEPT:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        raw = text.encode()
        return self.whole(text) if len(raw) != len(raw.translate(None, _CONTROLS)) else b"".join(map(self.__getitem__, text.split()))


_WORD_IDS: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _WORD_IDS:
        _WORD_IDS[path] = WordIds(path)
    return _WORD_IDS[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = word_ids(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = coder.ids(text.as_py()) + end
                for k, i in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[i : i + 4 * capacity]
                    rows.append((doc, k, i // 4, len(part) // 4, zlib.crc32(part)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pieces of at most `capacity` tokens of every document's ids followed by end_id; a null text is empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_pieces(tokenizer_path, capacity, end_id), PIECES)


def patterns(bins: np.ndarray, total: int, most: int = 3) -> list[tuple[int, ...]]:
    """Every multiset of at most `most` (1 to 3) of these bins whose sum is `total`, in falling order."""
    there = set(int(b) for b in bins)
    out = [(total,)] if total in there else []
    if most >= 2:
        out += [(total - b, b) for b in sorted(there) if b <= total - b and total - b in there]
    if most >= 3:
        out += [(a, b, total - a - b) for a in sorted(there) for b in sorted(there) if total - a - b in there and a >= b >= total - a - b]
    return out


def nonnegative_least_squares(index: np.ndarray, target: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """x >= 0 that minimises |A x - target|, where column j of A counts the bins in index[j] (-1: none).

    Accelerated projected gradient: only the index is held, never A.
    """
    n = len(target)
    idx = np.where(index < 0, n, index)

    def times(x):
        return np.bincount(idx.ravel(), np.repeat(x, idx.shape[1]), n + 1)[:n]

    def back(r):
        return np.r_[r, 0.0][idx].sum(1)

    v = np.ones(len(idx))
    for _ in range(30):
        v = back(times(v))
        norm = np.linalg.norm(v)
        v /= norm
    scale = max(target.max(), 1.0)
    goal, x, y, t = target / scale, np.zeros(len(idx)), np.zeros(len(idx)), 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - back(times(y) - goal) / (1.01 * norm))
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x * scale


def plan_packing(histogram: dict[int, int], capacity: int, units: int = 256, most: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence, how many such sequences) for pieces of which histogram has the count of each length.

    Lengths are put in `units` bins, rounded up; patterns of at most `most` bins fill a sequence; their repeat counts are
    fitted to the histogram, rounded down, and filled with the longest pieces of their bins first. What remains goes, longest
    first, into the tightest gap that holds it, be it in such a sequence or a new one. All of that works on groups of
    alike sequences, so time and space depend on the capacity and not on the number of pieces.
    """
    left = {n: c for n, c in histogram.items() if c > 0}
    width = -(-capacity // units)
    full = -(-capacity // width)
    made: list[tuple[tuple[int, ...], int]] = []
    if capacity in left:
        made.append(((capacity,), left.pop(capacity)))
    bins: dict[int, list[list[int]]] = defaultdict(list)
    for n in sorted(left, reverse=True):
        if capacity % width == 0 or -(-n // width) * width <= capacity:
            bins[-(-n // width)].append([n, left[n]])
    room = {b: sum(c for _, c in runs) for b, runs in bins.items()}
    order = np.array(sorted(bins), dtype=np.int64)
    found = patterns(order, full, most) if len(order) and capacity % width == 0 else []
    if found:
        at = {int(b): i for i, b in enumerate(order)}
        index = np.array([[at[b] for b in p] + [-1] * (most - len(p)) for p in found])
        fitted = np.floor(nonnegative_least_squares(index, np.array([room[int(b)] for b in order], float)) + 1e-6)
        for j in np.argsort(-fitted, kind="stable"):
            times = {b: found[j].count(b) for b in found[j]}
            c = int(min(fitted[j], *(room[b] // k for b, k in times.items())))
            if c <= 0:
                continue
            for b, k in times.items():
                room[b] -= c * k
            while c:  # cut into groups whose members have the same exact lengths
                heads = []
                for b in found[j]:
                    run = next(r for r in bins[b] if r[1] > sum(1 for h in heads if h is r))
                    heads.append(run)
                m = min(c, *(r[1] // sum(1 for h in heads if h is r) for r in heads))
                for r in heads:
                    r[1] -= m
                made.append((tuple(r[0] for r in heads), m))
                c -= m
                for b in set(found[j]):
                    bins[b] = [r for r in bins[b] if r[1]]
    rest = sorted(((r[0], r[1]) for runs in bins.values() for r in runs if r[1]), reverse=True)
    rest = sorted(rest + [(n, c) for n, c in left.items() if -(-n // width) not in bins], reverse=True)
    return _best_fit(made, rest, capacity)


def _best_fit(made: list[tuple[tuple[int, ...], int]], rest: list[tuple[int, int]], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    open_at: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    gaps: list[int] = []

    def put(lengths: tuple[int, ...], count: int, gap: int) -> None:
        if count:
            if not open_at[gap]:
                insort(gaps, gap)
            open_at[gap].append((lengths, count))

    for lengths, count in made:
        put(lengths, count, capacity - sum(lengths))
    for n, c in rest:
        while c:
            i = bisect_left(gaps, n)
            if i == len(gaps):
                k = capacity // n
                lengths, count, gap = (), -(-c // k), capacity
            else:
                gap = gaps[i]
                lengths, count = open_at[gap].pop()
                if not open_at[gap]:
                    gaps.pop(i)
                k = gap // n
            used, odd = min(count, c // k), 0
            put(lengths + (n,) * k, used, gap - k * n)
            c -= used * k
            if c and used < count:
                odd = c
                put(lengths + (n,) * odd, 1, gap - odd * n)
                used, c = used + 1, 0
            if lengths:
                put(lengths, count - used, gap)
    return [g for groups in open_at.values() for g in groups]


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Give each piece its sequence_id and its offset there; see best_fit_packing."""
    spark = pieces.sparkSession
    # At most `capacity` rows, one for each length.
    histogram = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    ranks, first_id, slots = defaultdict(int), 0, []
    for lengths, count in plan_packing(histogram, capacity):
        offset = 0
        for n in lengths:
            slots.append((n, ranks[n], ranks[n] + count, first_id, offset))
            ranks[n] += count
            offset += n
        first_id += count
    # Dense ranks within a length: numbers within hashed buckets of it, after the counts of the buckets before. As many
    # buckets as the root of the number of pieces keep both small: the pieces of a bucket and the buckets of a length.
    n_buckets = max(1, math.isqrt(sum(histogram.values())))
    salted = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n_buckets)))
    counts = salted.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("length", "_bucket", before.alias("_before"))
    number = F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = salted.withColumn("_number", number).join(offsets, ["length", "_bucket"]).withColumn("_rank", F.col("_number") + F.col("_before"))
    # Slots are bounded by the plan, which knows lengths and no documents.
    plan = spark.createDataFrame(slots, "_length long, _from long, _to long, _first long, offset long")
    placed = ranked.join(F.broadcast(plan), (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    return placed.select(*pieces.columns, (F.col("_first") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def best_fit_packing(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Pack all documents into few sequences of at most `capacity` tokens.

    A document is its token ids and end_id. Only longer ones are cut, into pieces of `capacity` tokens and a rest.
    Null and empty texts are end_id alone. Repeated rows are packed each, null ids are carried, ties in length are
    placed by hash of doc_id and piece, and an empty table gives an empty table. Only doc_id and text are read.
    The driver sees the histogram of lengths, at most `capacity` numbers, and plans groups of alike sequences.
    Result: doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    """
    return pack(materialize(token_pieces(docs, tokenizer_path, capacity, end_id), "pieces"), capacity)
