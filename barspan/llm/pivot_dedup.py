"""Embedding near-dedup: pivot permutations in inverted lists, shared-pivot counts, then exact cosines."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspan.llm.common import materialize
from barspan.llm.components import connected_components

_PREPARED = "vec_id long, label long, dim int, digest binary, vector binary"


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors (float64) and the digest of the given ones; vectors that can't be compared get nulls."""
    for batch in batches:
        dims, digests, vectors = [], [], []
        for i, given in enumerate(batch.column(2)):
            v = np.array(given.as_py(), dtype=np.float64) if given.is_valid and batch.column(1)[i].is_valid and batch.column(0)[i].is_valid else np.empty(0)
            norm = np.linalg.norm(v) if len(v) and np.isfinite(v).all() else 0.0
            if norm > 0 and not math.isfinite(norm) or norm == 0 and len(v) and np.isfinite(v).all() and v.any():
                v = v / np.abs(v).max()  # squares of very large or very small components leave the range
                norm = np.linalg.norm(v)
            ok = norm > 0
            dims.append(len(v) if ok else None)
            digests.append(hashlib.blake2b((v + 0.0).tobytes(), digest_size=16).digest() if ok else None)
            vectors.append((v / norm).tobytes() if ok else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(dims, pa.int32()), pa.array(digests, pa.binary()), pa.array(vectors, pa.binary())],
            names=["vec_id", "label", "dim", "digest", "vector"],
        )


def _nearest(pivots: np.ndarray, k: int):
    """The k pivots nearest to each vector, nearest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            width = pivots.shape[1]
            x = np.zeros((batch.num_rows, width))
            for i, raw in enumerate(batch.column(batch.schema.get_field_index("vector")).to_pylist()):
                v = np.frombuffer(raw)[:width]
                x[i, : len(v)] = v
            near = x @ pivots.T
            top = np.argsort(-near, axis=1, kind="stable")[:, :k].astype(np.int32)
            perm = pa.ListArray.from_arrays(pa.array(np.arange(0, top.size + 1, top.shape[1], dtype=np.int32)), pa.array(top.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, perm], names=[*batch.schema.names, "pivots"])

    return run


def _link(threshold: float, shared_least: int):
    """Links among the vectors of one list (or between two blocks of it), each counted at its first shared pivot or pivots."""

    def run(key, t):
        pivot, second, lo, hi = (k.as_py() for k in key[2:6])
        ids, block = t["vec_id"].to_numpy(), t["block"].to_numpy()
        sizes = t["size"].to_numpy()
        perm = np.array(t["pivots"].to_pylist())
        x = np.stack([np.frombuffer(v) for v in t["vector"].to_pylist()])
        n = len(ids)
        there = np.unique(perm)
        has = np.zeros((n, len(there)), np.float32)
        has[np.arange(n)[:, None], np.searchsorted(there, perm)] = 1
        # What a pair must not share, else it is counted elsewhere.
        before = has[:, there < pivot] if second < 0 else has[:, (there < second) & (there != pivot)]
        close = (has @ has.T >= shared_least) & (before @ before.T == 0)
        close &= x @ x.T >= threshold
        np.fill_diagonal(close, False)
        if lo != hi:
            close &= block[:, None] != block[None, :]
        counts = close @ sizes
        label = np.arange(n)
        while n:
            low = np.minimum(label, np.where(close, label[None, :], n).min(1))
            low = low[low]
            if (low == label).all():
                break
            label = low
        linked = np.flatnonzero(counts)
        joined = np.flatnonzero(label != np.arange(n))
        return pa.table(
            {
                "src": np.r_[ids[linked], ids[joined]].astype(np.int64),
                "dst": pa.array([None] * len(linked) + ids[label[joined]].tolist(), pa.int64()),
                "n": np.r_[counts[linked], np.zeros(len(joined), np.int64)].astype(np.int64),
            }
        )

    return run


def pivot_dedup(vectors: DataFrame, threshold: float = 0.93, max_pivots: int = 4096, prefix: int = 8, shared_least: int = 2, block_rows: int = 1000) -> DataFrame:
    """Near-duplicate vectors with equal labels: (vec_id, n_links, component_id, kept).

    Pivots are a bounded sample: the 4 * sqrt(n) distinct vectors with the least hash of their id, max_pivots of them at
    most (max_pivots * dimension doubles are broadcast). Each vector is described by its `prefix` nearest pivots in order,
    and indexed in the inverted list of each of these, by label. Vectors of a list that share at least `shared_least`
    pivots are compared by cosine in double precision, so every link reported is exact and links may only be missed
    where two vectors share fewer pivots. A list of more than block_rows vectors is split by the second pivot that two of
    its vectors share; what is still larger, such as a group of near copies, is worked off in pairs of blocks: no list is
    collected whole, and none is capped. Pairs stay within their task: counts and spanning links leave it.
    Exact copies are one class: they are compared once, count as links of each other and share a component.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows with null label or vec_id, link
    with nothing; vectors of unlike dimension never link. Repeated rows are vectors of their own, an empty table gives
    an empty table, and other columns are ignored.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    prepared = materialize(rows.mapInArrow(_prepare, _PREPARED), "vectors")
    valid = prepared.filter("digest is not null")
    classes = materialize(valid.groupBy("label", "dim", "digest").agg(F.min("vec_id").alias("rep"), F.count("*").alias("size")), "vector-classes")
    chosen = valid.join(classes.withColumnRenamed("rep", "vec_id"), ["label", "dim", "digest", "vec_id"]).dropDuplicates(["label", "dim", "digest"])
    reps = materialize(chosen.select("vec_id", "label", "dim", "size", "vector"), "vector-reps")
    n = reps.count()
    wanted = min(max_pivots, max(prefix, math.ceil(4 * math.sqrt(n))))
    sample = [np.frombuffer(r["vector"]) for r in reps.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("vector").collect()]
    out_schema = "vec_id long, n_links long, component_id long, kept boolean"
    if not sample:
        return prepared.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept")).to(spark.createDataFrame([], out_schema).schema)
    pivots = np.zeros((len(sample), max(map(len, sample))))
    for i, v in enumerate(sample):
        pivots[i, : len(v)] = v
    described = materialize(reps.mapInArrow(_nearest(pivots, prefix), "vec_id long, label long, dim int, size long, vector binary, pivots array<int>"), "permutations")
    of_list, of_pair = ["label", "dim", "pivot"], ["label", "dim", "pivot", "second"]
    listed = described.select("label", "dim", "pivots", F.explode("pivots").alias("pivot"))
    lists = materialize(listed.groupBy(of_list).agg(F.count("*").alias("n")).filter("n > 1"), "posting-lists")
    # A list of more than block_rows vectors is dealt out by the second pivot that a pair shares.
    split = (F.col("n") > block_rows) if shared_least >= 2 else F.lit(False)
    later = F.explode(F.filter("pivots", lambda q: q > F.col("pivot"))).alias("second")
    pairs = listed.join(lists.filter(split), of_list).select("label", "dim", "pivot", later).groupBy(of_pair).agg(F.count("*").alias("n")).filter("n > 1")
    postings = described.withColumn("pivot", F.explode("pivots"))
    whole = postings.join(lists.filter(~split), of_list).withColumn("second", F.lit(-1))
    dealt_out = postings.join(lists.filter(split).drop("n"), of_list).select("*", later).join(materialize(pairs, "pair-lists"), of_pair)
    blocks = F.ceil(F.col("n") / block_rows).cast("int")
    keyed = whole.unionByName(dealt_out).withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    dealt = keyed.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
    lists_of = dealt.select("label", "dim", "pivot", "second", "lo", "hi", "block", "vec_id", "size", "pivots", "vector").groupBy("label", "dim", "pivot", "second", "lo", "hi")
    found = materialize(lists_of.applyInArrow(_link(threshold, shared_least), "src long, dst long, n long"), "vector-links")
    links = found.filter("dst is null").groupBy(F.col("src").alias("rep")).agg(F.sum("n").alias("linked"))
    components = connected_components(found.filter("dst is not null")).select(F.col("id").alias("rep"), "component")
    by_class = classes.join(links, "rep", "left").join(components, "rep", "left").select(
        "label", "dim", "digest", (F.coalesce("linked", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component")
    )
    all_rows = prepared.select("vec_id", "label", "dim", "digest").join(by_class, ["label", "dim", "digest"], "left")
    component = F.coalesce("component", "vec_id")
    return all_rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
