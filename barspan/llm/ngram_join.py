"""N-gram Jaccard join: candidates by rare prefix shingles, T-occurrence search by DivideSkip, links and their components."""

from __future__ import annotations

import hashlib
import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspan.llm.common import materialize
from barspan.llm.components import connected_components

_MASK = np.uint64((1 << 48) - 1)


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text, A-Z lower-cased; fewer words make one n-gram."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(size, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def least_overlap(n: int) -> int:
    """Shingles that a set of n must share with any set of Jaccard similarity 0.8 or more: 4n/5, rounded up."""
    return (4 * n + 4) // 5


def _frequent(size: int, chunk: int = 1 << 22):
    """Shingles that at least three documents of a chunk of rows hold, with their numbers there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush():
            found, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            often = counts >= 3
            return pa.RecordBatch.from_arrays([pa.array(found[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["token", "n"])

        for batch in batches:
            for text in batch.column(0):
                s = shingles(text.as_py(), size)
                held.append(s)
                n += len(s)
                if n >= chunk:
                    yield flush()
                    held, n = [], 0
        yield flush()

    return run


def parity(s: np.ndarray) -> bytes:
    """One bit for each residue: whether an odd number of shingles has it. Sets differ in at least as many shingles as bits."""
    bits = 1 << max(9, min(16, math.ceil(math.log2(max(1, len(s))))))
    at = ((s >> np.uint64(20)) % np.uint64(bits)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8)).tobytes()


def may_match(n: int, p: bytes, m: int, q: bytes) -> bool:
    """False only where sizes or parities rule out a similarity of 0.8: the difference is at most (n + m) / 9."""
    if 5 * min(n, m) < 4 * max(n, m):
        return False
    if len(p) > len(q):
        p, q = q, p
    a, b = np.frombuffer(p, np.uint8), np.frombuffer(q, np.uint8)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return 9 * int(np.bitwise_count(a ^ b).sum()) <= n + m


_SETS = "doc_id long, text_key long, n_shingles long, digest binary, light array<long>, heavy array<long>, parity binary"


def _sets(size: int, heavy: np.ndarray, rank: np.ndarray):
    """Sizes, digests and prefixes; frequent shingles come last in the order that prefixes follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, digests, light, late, parities = [], [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), size)
                n = len(s)
                ns.append(n)
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if n else None)
                parities.append(parity(s))
                k = n - least_overlap(n) + 1 if n else 0
                at = np.minimum(np.searchsorted(heavy, s), max(0, len(heavy) - 1))
                often = heavy[at] == s if len(heavy) else np.zeros(n, bool)
                rare = s[~often][:k]
                common = s[often][np.argsort(rank[at[often]], kind="stable")][: k - len(rare)] if often.any() else s[:0]
                light.append((rare & _MASK).view(np.int64).tolist())
                late.append((common & _MASK).view(np.int64).tolist())
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(ns, pa.int64()), pa.array(digests, pa.binary()), pa.array(light, longs), pa.array(late, longs), pa.array(parities, pa.binary())],
                names=["doc_id", "text_key", "n_shingles", "digest", "light", "heavy", "parity"],
            )

    return run


def _likely_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column(0).to_pylist(), batch.column(3).to_pylist()
        rest = [batch.column(i).to_pylist() for i in (1, 2, 4, 5)]
        keep = [i for i, (n, p, m, q) in enumerate(zip(*rest, strict=True)) if may_match(n, p, m, q)]
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], names=["a", "b"])


def _cross_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of unlike components within each group (token, lo, hi), which come together and may go over several batches."""

    def pairs(rows: list[tuple]) -> list[tuple[int, int]]:
        _, lo, hi = rows[0][:3]
        rows = sorted(rows, key=lambda r: r[5])  # by size
        sizes = np.array([r[5] for r in rows])
        component = np.array([r[6] for r in rows])
        block = np.array([r[3] for r in rows])
        bits = [np.frombuffer(r[7], np.uint8) for r in rows]
        out = []
        for i, r in enumerate(rows):
            last = np.searchsorted(sizes, r[5] * 5 // 4, "right")
            js = np.arange(i + 1, last)
            js = js[component[i + 1 : last] != component[i]]
            if lo != hi:
                js = js[block[js] != block[i]]
            by_width: dict[int, list[int]] = {}
            for j in js:
                by_width.setdefault(len(bits[j]), []).append(j)
            for width, same in by_width.items():
                q, p = np.stack([bits[j] for j in same]), bits[i]
                while q.shape[1] > len(p):
                    q = q[:, : q.shape[1] // 2] ^ q[:, q.shape[1] // 2 :]
                near = np.bitwise_count(q ^ p).sum(1, dtype=np.int64) * 9 <= r[5] + sizes[same]
                out += [(r[4], rows[j][4]) for j, ok in zip(same, near, strict=True) if ok]
        return out

    held: list[tuple] = []
    for batch in batches:
        found = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][:3] != row[:3]:
                found += pairs(held) if len({r[6] for r in held}) > 1 else []
                held = []
            held.append(row)
        yield pa.RecordBatch.from_pylist([{"a": max(p), "b": min(p)} for p in found], pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    found = pairs(held) if held else []
    yield pa.RecordBatch.from_pylist([{"a": max(p), "b": min(p)} for p in found], pa.schema([("a", pa.int64()), ("b", pa.int64())]))


class InvertedLists:
    """Sorted lists of the documents that hold each shingle, searched by DivideSkip."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = [len(s) for s in sets]
        tokens = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]

    def lists(self, query: np.ndarray) -> list[list[int]]:
        lo, hi = np.searchsorted(self.tokens, query, "left"), np.searchsorted(self.tokens, query, "right")
        return [self.owner[a:b].tolist() for a, b in zip(lo, hi, strict=True) if b > a]

    def search(self, query: np.ndarray, least: int) -> list[tuple[int, int]]:
        """(document, overlap) of every document that shares at least `least` of the query's shingles.

        Fewer than `least` of the longest lists are set aside. A document that reaches `least` must occur in the others
        often enough; those are merged by a heap, and each document that does is looked up in the long ones.
        """
        lists = sorted(self.lists(query), key=len)
        if len(lists) < least:
            return []
        longest = len(lists[-1])
        aside = min(least - 1, len(lists) - 1, int(least / (0.01 * math.log2(longest + 1) + 1)))
        short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
        out = []
        for doc, same in groupby(heapq.merge(*short)):
            n = sum(1 for _ in same)
            if n >= least - aside:
                for k, at in enumerate(long):
                    if n + len(long) - k < least:
                        break
                    i = bisect_left(at, doc)
                    n += i < len(at) and at[i] == doc
                if n >= least:
                    out.append((doc, n))
        return out


def _t_occurrence(size: int):
    """Links among the documents of one bucket: those marked as queries are searched in the lists of the others.

    Of the links found, those are returned that join components which earlier links of the bucket, or earlier rounds,
    have left apart; they connect what all of them do.
    """

    def run(key, t):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        ids = t["doc_id"].to_pylist()
        sets = [shingles(unpack(b), size) for b in t["packed"].to_pylist()]
        index = [i for i, x in enumerate(t["indexed"].to_pylist()) if x]
        held = InvertedLists([sets[i] for i in index])
        src, dst, top = [], [], {}

        def find(c):
            while (up := top.get(c, c)) != c:
                top[c] = top.get(up, up)
                c = up
            return c

        part = t["component"].to_pylist()
        for i, asks in enumerate(t["asks"].to_pylist()):
            if asks:
                n = len(sets[i])
                for k, both in held.search(sets[i], least_overlap(n)):
                    j = index[k]
                    a, b = find(part[i]), find(part[j])
                    if a != b and 100 * both >= 80 * (n + len(sets[j]) - both):
                        top[max(a, b)] = min(a, b)
                        src.append(ids[i])
                        dst.append(ids[j])
        return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pack(x.as_py()) for x in batch.column(1)], pa.binary()), batch.column(2)], names=["doc_id", "packed", "text_key"])


def _verified(pairs: DataFrame, texts: DataFrame, size: int, pairs_a_task: int, components: DataFrame | None = None) -> DataFrame:
    """Links that join components (or documents), among candidate pairs (a asks, b is indexed), in buckets of about pairs_a_task.

    What a document asks goes to one bucket, so that its lists are searched once; one that asks for more than pairs_a_task
    others goes to as many buckets as these take.
    """
    buckets = max(1, -(-pairs.count() // pairs_a_task))
    many = pairs.groupBy(F.col("a").alias("asking")).agg(F.ceil(F.count("*") / pairs_a_task).alias("slices")).filter("slices > 1")
    sliced = pairs.join(many, F.col("a") == F.col("asking"), "left")
    slice_of = F.coalesce(F.pmod(F.xxhash64("b"), F.col("slices")), F.lit(0).cast("long"))
    placed = sliced.select("a", "b", F.pmod(F.xxhash64("a", slice_of), F.lit(buckets)).alias("bucket"))
    asks = placed.select("bucket", F.col("a").alias("doc_id"), F.lit(True).alias("asks"), F.lit(False).alias("indexed"))
    indexed = placed.select("bucket", F.col("b").alias("doc_id"), F.lit(False).alias("asks"), F.lit(True).alias("indexed"))
    dealt = asks.unionByName(indexed).groupBy("bucket", "doc_id").agg(F.max("asks").alias("asks"), F.max("indexed").alias("indexed"))
    if components is not None:
        named = components.withColumnRenamed("rep", "doc_id")
        dealt = dealt.join(named, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    else:
        dealt = dealt.withColumn("component", F.col("doc_id"))
    return dealt.join(texts, "doc_id").groupBy("bucket").applyInArrow(_t_occurrence(size), "src long, dst long")


def ngram_join(docs: DataFrame, size: int = 5, heavy_tokens: int = 100_000, block_rows: int = 1000, pairs_a_task: int = 1000) -> DataFrame:
    """Classes of documents whose word n-gram sets have a Jaccard similarity of 0.8 or more: (doc_id, n_shingles, component_id).

    A set holds the distinct n-grams of the text's words after A-Z are lower-cased (one n-gram if there are fewer words).
    Null and empty texts, and those without words, hold none and link with nothing. Equal sets are one class; only its
    smallest doc_id takes part in the search. Rows that repeat are a row each in the result; where rows share a doc_id but
    not a text, the set with the least digest is the one that is searched in that doc_id's name. Rows without doc_id link
    with nothing and have no component. An empty table gives an empty table, and columns other than doc_id and text are
    ignored.

    Two similar sets share a shingle among the first fifth of each in any common order. Here frequent shingles come last;
    which ones count as frequent (at most heavy_tokens, found over all documents) changes the work and not the result.
    1. Each group of documents with a prefix shingle in common is searched against its smallest member, a star; groups
       that hold several components after that, against one more member, which each shingle picks by hash.
    2. Groups that still hold several components are gone through pair by pair across components, in blocks of
       block_rows, inside the task: sizes and parity bits rule out most pairs, and what may match is searched too.
    So no link between unlike components is missed, and no group is expanded into all its pairs. Searches go in buckets:
    inverted lists over the bucket's indexed documents, DivideSkip for each asking one, then the exact condition.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("text_key"))
    counts = rows.select("text").filter("text is not null").mapInArrow(_frequent(size), "token long, n long")
    top = counts.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(heavy_tokens).collect()
    tokens = np.array([r["token"] for r in top], np.int64).view(np.uint64)
    order = np.argsort(tokens)
    heavy, rank = tokens[order], (len(tokens) - order).astype(np.int64)

    sets = materialize(rows.mapInArrow(_sets(size, heavy, rank), _SETS), "shingle-sets")
    classes = materialize(sets.filter("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep")), "set-classes")
    searched = classes.groupBy("rep").agg(F.min("digest").alias("of"))
    reps = sets.join(searched.hint("shuffle_hash"), (F.col("doc_id") == F.col("rep")) & (F.col("digest") == F.col("of")), "left_semi")
    chosen = materialize(reps.drop("digest"), "set-reps")
    info = chosen.select(F.col("doc_id").alias("rep"), "n_shingles", "parity").dropDuplicates(["rep"])

    def groups(column: str, dealt: bool) -> DataFrame:
        at = chosen.select(F.col("doc_id").alias("rep"), F.explode(column).alias("token"))
        at = at.repartition("token") if dealt else at
        shared = at.groupBy("token").agg(F.count("*").alias("n"), F.min("rep").alias("pivot")).filter("n > 1")
        return at.join(shared, "token")

    # Rare shingles are dealt out once, for the aggregate and the join; frequent ones leave the skew to adaptive execution.
    members = materialize(groups("light", True).unionByName(groups("heavy", False)), "prefix-groups")
    active = chosen.select("doc_id", "text_key").join(members.select(F.col("rep").alias("doc_id")).distinct(), "doc_id", "left_semi")
    packed = rows.filter("text is not null and doc_id is not null").mapInArrow(_pack, "doc_id long, packed binary, text_key long")
    texts = materialize(packed.join(active.hint("shuffle_hash"), ["doc_id", "text_key"], "left_semi").drop("text_key"), "active-texts").dropDuplicates(["doc_id"])

    def likely(pairs: DataFrame, label: str) -> DataFrame:
        of_a = info.select(F.col("rep").alias("a"), F.col("n_shingles").alias("n_a"), F.col("parity").alias("p_a"))
        of_b = info.select(F.col("rep").alias("b"), F.col("n_shingles").alias("n_b"), F.col("parity").alias("p_b"))
        sized = pairs.join(of_a, "a").join(of_b, "b").filter("5 * least(n_a, n_b) >= 4 * greatest(n_a, n_b)")
        return materialize(sized.select("a", "n_a", "p_a", "b", "n_b", "p_b").mapInArrow(_likely_pairs, "a long, b long"), label)

    star = members.filter("rep <> pivot").select(F.col("rep").alias("a"), F.col("pivot").alias("b")).distinct()
    links = materialize(_verified(likely(star, "star-pairs"), texts, size, pairs_a_task), "star-links")
    wide = members.filter("n > 2").select("token", "rep", "n")
    labelled = lambda c: wide.join(c, "rep", "left").withColumn("component", F.coalesce("component", "rep"))

    def mixed(rows: DataFrame) -> DataFrame:
        of_token = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min_by("rep", F.xxhash64("rep", "token")).alias("other_pivot"))
        return of_token.filter("low <> high").select("token", "other_pivot")

    first = connected_components(links).withColumnRenamed("id", "rep")
    apart = labelled(first)
    again = apart.join(mixed(apart), "token").filter("rep <> other_pivot").select(F.col("rep").alias("a"), F.col("other_pivot").alias("b"), F.col("component").alias("c_a")).distinct()
    again = again.join(first.select(F.col("rep").alias("b"), F.col("component").alias("c_b")), "b", "left").filter(F.col("c_a") != F.coalesce("c_b", "b")).select("a", "b")
    links = links.unionByName(materialize(_verified(likely(again, "other-star-pairs"), texts, size, pairs_a_task, first), "other-star-links"))
    components = connected_components(links).withColumnRenamed("id", "rep")
    apart = labelled(components).join(info, "rep")
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    block = F.pmod(F.xxhash64("rep"), blocks).cast("int")
    dealt = apart.join(mixed(apart).select("token"), "token").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    keyed = dealt.select("token", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "rep", "n_shingles", "component", "parity")
    across = keyed.repartition("token", "lo", "hi").sortWithinPartitions("token", "lo", "hi").mapInArrow(_cross_pairs, "a long, b long").distinct()
    second = materialize(_verified(materialize(across, "cross-pairs"), texts, size, pairs_a_task, components), "cross-links")
    whole = connected_components(links.unionByName(second)).select(F.col("id").alias("rep"), "component")
    named = classes.join(whole, "rep", "left").select("digest", F.coalesce("component", "rep").alias("component"))
    joined = sets.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))
