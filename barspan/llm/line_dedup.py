"""Line dedup: range-partitioned line hashes, streamed in order, become compressed keep bitmaps by document."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barspan.llm.common import free_names, materialize

_WS = b" \t\n\x0b\x0c\r"
_KEYS = "h1 long, h2 long, doc_id long, row_key long, pos int, n_lines int"


def _keys(least_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, docs, rows, at, of = [], [], [], [], []
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                lines = text.as_py().split(b"\n")
                for i, line in enumerate(lines):
                    if len(line) >= least_chars:
                        key = line.strip(_WS).lower()  # of bytes: A-Z alone change
                        if len(key) >= least_chars and len(key.decode()) >= least_chars:
                            hashes.append(hashlib.blake2b(key, digest_size=16).digest())
                            docs.append(doc)
                            rows.append(row)
                            at.append(i)
                            of.append(len(lines))
            h = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(docs, pa.int64()), pa.array(rows, pa.int64()), pa.array(at, pa.int32()), pa.array(of, pa.int32())],
                names=["h1", "h2", "doc_id", "row_key", "pos", "n_lines"],
            )

    return run


_STREAMED = _KEYS + ", kind int, n_docs long, last_doc long, part int"
DROP, EDGE, SUMMARY = 0, 1, 2


#: Entries of one group that are held; a group that goes on is passed on as if it lay at an edge.
_OPEN = 1 << 16
_NAMES = ["h1", "h2", "doc_id", "row_key", "pos", "n_lines", "kind", "n_docs", "last_doc", "part"]


def _passed(cols: list[np.ndarray], kind: int, n_docs: int = 0, last_doc: int = 0) -> pa.RecordBatch:
    n = len(cols[0])
    out = [*cols[:6], np.full(n, kind, np.int32), np.full(n, n_docs, np.int64), np.full(n, last_doc, np.int64), cols[6].astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=_NAMES)


def _stream(least_docs: int):
    """Entries come sorted by hash, document (largest first) and position; the first document of a group keeps its lines.

    Groups that a partition holds whole are decided here. Its first and last group may go on in its neighbours:
    their entries are passed on, with a summary of each. So is a group of very many entries, as they come, of which only
    the first entry, the last document and the number of documents are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        top, n_docs, last_doc = None, 0, None  # of the group that is passed on
        first = True
        for batch in batches:
            if not batch.num_rows:
                continue
            now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if top is not None:
                other = np.flatnonzero((now[0] != top[0][0]) | (now[1] != top[1][0]))
                k = int(other[0]) if len(other) else len(now[0])
                if k:
                    docs = now[2][:k]
                    n_docs += int(docs[0] != last_doc) + int((docs[1:] != docs[:-1]).sum())
                    last_doc = docs[-1]
                    yield _passed([x[:k] for x in now], EDGE)
                if k == len(now[0]):
                    continue
                yield _passed(top, SUMMARY, n_docs, last_doc)
                top, first, now = None, False, [x[k:] for x in now]
            held = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            h1, h2 = held[0], held[1]
            starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
            if len(starts) > 1:  # the last group stays open
                yield _decide([x[: starts[-1]] for x in held], first, False, least_docs)
                held, first = [x[starts[-1] :] for x in held], False
            if len(held[0]) > _OPEN:
                docs = held[2]
                top, n_docs, last_doc = [x[:1] for x in held], 1 + int((docs[1:] != docs[:-1]).sum()), docs[-1]
                yield _passed(held, EDGE)
                held = None
        if top is not None:
            yield _passed(top, SUMMARY, n_docs, last_doc)
        elif held is not None:
            yield _decide(held, True, True, least_docs)

    return run


def _decide(cols: list[np.ndarray], first_edge: bool, last_edge: bool, least_docs: int) -> pa.RecordBatch:
    h1, h2, doc, _, _, _, part = cols
    n = len(h1)
    starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    sizes = np.diff(np.r_[starts, n])
    new_doc = np.r_[True, doc[1:] != doc[:-1]]
    new_doc[starts] = True
    n_docs = np.add.reduceat(new_doc.astype(np.int64), starts)
    group = np.repeat(np.arange(len(starts)), sizes)
    edge = np.zeros(len(starts), bool)
    edge[0] |= first_edge
    edge[-1] |= last_edge
    drop = (n_docs[group] >= least_docs) & (doc != doc[starts][group]) & ~edge[group]
    keep = np.flatnonzero(drop | edge[group])
    kind = np.where(drop[keep], DROP, EDGE)
    ends = starts + sizes - 1
    tops = starts[edge]
    row = np.r_[keep, tops]
    zeros = np.zeros(len(keep), np.int64)
    out = [x[row] for x in cols[:6]]
    out += [np.r_[kind, np.full(len(tops), SUMMARY)].astype(np.int32), np.r_[zeros, n_docs[edge]], np.r_[zeros, doc[ends][edge]], part[row].astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=_NAMES)


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps, dropped = [], []
        for n, at in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            keep = np.ones(n, np.uint8)
            keep[at] = 0
            maps.append(zlib.compress(np.packbits(keep).tobytes()))
            dropped.append(int(n - keep.sum()))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(dropped, pa.int32()), pa.array(maps, pa.binary())],
            names=["doc_id", "row_key", "n_lines", "n_dropped", "keep_bitmap"],
        )


def line_bitmaps(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """Keep bitmaps of the documents that lose lines: (doc_id, row_key, n_lines, n_dropped, keep_bitmap).

    A line's key is the line stripped of white space at both ends with A-Z lower-cased. Keys of at least `least_chars`
    code points found in at least `least_docs` documents stay only in the largest doc_id that holds them.
    keep_bitmap is zlib over one bit a line, most significant first, 1 for kept. row_key is xxhash64 of the text, so rows
    that share a doc_id keep bitmaps of their own; such rows are one document when documents are counted.
    Null and empty texts hold one empty line and lose nothing, as do rows without doc_id, which don't count as documents.
    An empty table gives an empty result. Only doc_id and text are read, so other columns can't clash.
    A line that very many documents share is spread over range partitions by document; nothing is grouped by line alone.
    """
    rows = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row_key"), F.col("text").cast("binary").alias("text"))
    keys = materialize(rows.mapInArrow(_keys(least_chars), _KEYS), "line-keys")
    order = [F.col("h1"), F.col("h2"), F.col("doc_id").desc(), F.col("pos"), F.col("row_key")]
    ordered = keys.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    streamed = materialize(ordered.mapInArrow(_stream(least_docs), _STREAMED), "line-stream")
    # Groups at the edges of partitions: at most two summaries from each partition.
    sums = streamed.filter(f"kind = {SUMMARY}").groupBy("h1", "h2").agg(F.sort_array(F.collect_list(F.struct("part", "doc_id", "last_doc", "n_docs"))).alias("s"))
    shared = F.aggregate("s", F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("last")), lambda a, x: F.struct((a["n"] + x["n_docs"] - F.when(a["last"] == x["doc_id"], 1).otherwise(0)).alias("n"), x["last_doc"].alias("last")), lambda a: a["n"])
    edges = sums.select("h1", "h2", shared.alias("all_docs"), F.array_max(F.transform("s", lambda x: x["doc_id"])).alias("top_doc")).filter(F.col("all_docs") >= least_docs)
    at_edges = streamed.filter(f"kind = {EDGE}").join(F.broadcast(edges), ["h1", "h2"]).filter("doc_id <> top_doc")
    cols = ["doc_id", "row_key", "n_lines", "pos"]
    dropped = streamed.filter(f"kind = {DROP}").select(*cols).unionByName(at_edges.select(*cols))
    by_doc = dropped.groupBy("doc_id", "row_key").agg(F.first("n_lines").alias("n_lines"), F.collect_set("pos").alias("pos"))
    return by_doc.select("doc_id", "row_key", "n_lines", "pos").mapInArrow(_bitmaps, "doc_id long, row_key long, n_lines int, n_dropped int, keep_bitmap binary")


def _apply(text: str, bitmap: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, maps = batch.schema.get_field_index(text), batch.schema.get_field_index(bitmap)
            column = batch.column(at)
            marked = batch.column(maps)
            if marked.null_count < len(marked):
                texts = column.to_pylist()
                for i, packed in enumerate(marked.to_pylist()):
                    if packed is not None:
                        lines = texts[i].split("\n")
                        bits = np.unpackbits(np.frombuffer(zlib.decompress(packed), np.uint8))
                        texts[i] = "\n".join(x for x, keep in zip(lines, bits, strict=False) if keep)
                column = pa.array(texts, column.type)
            cols = [column if i == at else c for i, c in enumerate(batch.columns) if i != maps]
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema.remove(maps))

    return run


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """The documents with their kept lines as text, and the numbers of lines and of dropped lines (long) as two last columns.

    These are named _n_lines and _n_dropped, with more underscores before where docs has such columns. Every row and
    column of docs is returned; a null text stays null and counts as one line. Rows without doc_id, or whose text is null,
    have no bitmap and stay out of the join.
    """
    n_lines, n_dropped, bitmap = free_names(docs, "_n_lines", "_n_dropped", "_keep_bitmap")
    marks = bitmaps.select("doc_id", "row_key", F.col("n_dropped").cast("long").alias(n_dropped), F.col("keep_bitmap").alias(bitmap))
    may_match = docs["doc_id"].isNotNull() & docs["text"].isNotNull()
    same = (docs["doc_id"] == marks["doc_id"]) & (F.xxhash64(docs["text"]) == marks["row_key"])
    named = [docs[f"`{c}`"] for c in docs.columns]
    joined = docs.filter(may_match).join(marks.hint("shuffle_hash"), same, "left").select(*named, F.coalesce(marks[n_dropped], F.lit(0).cast("long")).alias(n_dropped), marks[bitmap])
    rest = docs.filter(~may_match).select(*named, F.lit(0).cast("long").alias(n_dropped), F.lit(None).cast("binary").alias(bitmap))
    count = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    every = joined.unionAll(rest).select(*[f"`{c}`" for c in docs.columns], F.coalesce(count.cast("long"), F.lit(1).cast("long")).alias(n_lines), n_dropped, bitmap)
    fields = [f for f in every.schema.fields if f.name != bitmap]
    text = next(c for c in docs.columns if c.lower() == "text")
    return every.mapInArrow(_apply(text, bitmap), type(every.schema)(fields))


def line_dedup(docs: DataFrame, least_chars: int = 40, least_docs: int = 5) -> DataFrame:
    """line_bitmaps and apply_bitmaps in one: docs with kept lines and the two counts."""
    return apply_bitmaps(docs, line_bitmaps(docs, least_chars, least_docs))
