"""Cycles in reply trees, caches appended twice, damaged files and pages, hot lines, planted vectors."""

import gzip
import random
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from barspan.llm import line_dedup as lines
from barspan.llm.chat import reply_trees, tree_paths
from barspan.llm.pivot_dedup import pivot_dedup
from barspan.llm.queries import SQL, vocabulary
from barspan.llm.token_cache import read_cache, token_counts
from barspan.llm.warc import parse_warc, read_page, read_warc, unpacked

MESSAGES = "tree_id long, node_id long, parent_id long, role string, text string, score double"


def test_paths_below_cycles_are_none(spark):
    """Two messages that answer each other, one that answers one of them, a self-answer; and a chain and a fork beside them."""
    rows = [(1, 1, 2), (1, 2, 1), (1, 3, 1), (2, 5, 5), (2, 6, 5), (3, 1, None), (3, 2, 1), (3, 3, 2), (3, 4, 2), (3, 9, 8), (4, 1, None), (4, 2, 3), (4, 3, 2), (4, 4, 3), (4, 5, 1)]
    df = spark.createDataFrame([(t, n, p, "user", f"{n}", 1.0) for t, n, p in rows], MESSAGES)
    got = sorted(tuple(r) for r in tree_paths(df).select("tree_id", "leaf_id", "up", "node_id").collect())
    assert got == [(3, 3, 0, 3), (3, 3, 1, 2), (3, 3, 2, 1), (3, 4, 0, 4), (3, 4, 1, 2), (3, 4, 2, 1), (3, 9, 0, 9), (4, 5, 0, 5), (4, 5, 1, 1)]
    assert sorted((r["tree_id"], r["leaf_id"]) for r in reply_trees(df, branches=9).collect()) == [(3, 3), (3, 4), (3, 9), (4, 5)]


def test_long_tails_below_a_cycle_stay_small(spark):
    tail = [(1, n, n - 1) for n in range(3, 60)]
    df = spark.createDataFrame([(t, n, p, "user", "", 0.0) for t, n, p in [(1, 1, 2), (1, 2, 1), *tail]], MESSAGES)
    assert tree_paths(df).count() == 0


def test_a_cache_appended_twice_gives_one_row_a_document(spark, tmp_path):
    docs, path, at = spark.createDataFrame([(1, "some words"), (2, "other words here")], "doc_id long, text string"), vocabulary("byte_bpe_50k.json"), str(tmp_path / "cache")
    first = sorted(map(tuple, token_counts(docs, path, at).collect()))
    read_cache(spark, at).write.mode("append").parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("append").parquet(at)
    assert read_cache(spark, at).count() == 4
    assert sorted(map(tuple, token_counts(docs, path, at).collect())) == first and len(first) == 2


def made_record(i):
    block = b"block %d " % i * 50
    return b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:%d>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i, len(block), block)


def test_padding_and_damaged_members_do_not_stop_a_file(spark, tmp_path):
    members = [gzip.compress(made_record(i)) for i in range(6)]
    names = lambda raw: [h.get("WARC-Record-ID", h["WARC-Type"]) for h, _ in parse_warc(raw)]
    whole = [f"<urn:{i}>" for i in range(6)]
    assert names(b"".join(members)) == whole
    assert names(b"".join(members) + bytes(5000)) == whole
    assert names(members[0] + bytes(99) + b"".join(members[1:])) == whole
    hurt = bytearray(members[2])
    hurt[40:60] = b"\xff" * 20
    cut = members[3][: len(members[3]) // 2]
    for bad in (bytes(hurt), cut, members[2][:10] + bytes(30)):
        got = names(members[0] + members[1] + bad + members[4] + members[5])
        assert [x for x in got if x != "damage"] == [whole[0], whole[1], whole[4], whole[5]] and "damage" in got
    (tmp_path / "warc").mkdir()
    (tmp_path / "warc" / "a.warc.gz").write_bytes(members[0] + bytes(hurt) + members[1] + bytes(64))
    (tmp_path / "warc" / "empty.warc.gz").write_bytes(b"")
    at = f"file://{tmp_path}/warc"
    assert sorted(r["record_id"] for r in read_warc(spark, at).collect()) == whole[:2]
    lost = read_warc(spark, at, "damage").collect()
    assert [r["headers"]["X-Offset"] for r in lost] == [str(len(members[0]))]


def test_bodies_of_several_members_and_bombs():
    assert unpacked(gzip.compress(b"first ") + gzip.compress(b"second"), "gzip") == b"first second"
    assert unpacked(gzip.compress(b"one") + b"\0\0 no member", "gzip") == b"one"
    assert len(unpacked(gzip.compress(bytes(1 << 20)), "gzip", 1000)) == 1000
    assert unpacked(zlib.compress(b"x"), "deflate") == b"x" and unpacked(b"plain", "br, zstd") == b"plain"


def test_heads_take_steps_in_proportion():
    def took(n):
        page = "<head>" * n + "in" + "</head>out"
        began = time.process_time()
        assert read_page(page)[0] == "out"
        return time.process_time() - began

    took(1000)
    assert took(32_000) < 12 * max(took(8_000), 1e-3)  # four times the work; 16 times where each head looks for the end
    assert read_page("<head>a<head>b</head>c<head>d</head>e</head>f")[0] == "cef"


def entries(groups):
    """Sorted entries as the stream gets them, from {hash: [(doc, pos), ...]}."""
    rows = [(h, h, doc, 0, pos, 9, 0) for h, found in sorted(groups.items()) for doc, pos in sorted(found, key=lambda x: (-x[0], x[1]))]
    return [np.array(c, np.int64) for c in zip(*rows, strict=True)]


@pytest.mark.parametrize("batch", [7, 1000, 10_000])
def test_hot_lines_are_passed_on_as_they_come(monkeypatch, batch):
    """Every group's dropped entries, whatever is held: those decided at once, and those that summaries decide."""
    rnd = random.Random(3)
    groups = {h: [(rnd.randrange(900 if h % 4 == 1 else 7), p) for p in range(3000 if h % 4 == 1 else rnd.randrange(1, 12))] for h in range(1, 10)}
    groups = {h: sorted(set(v)) for h, v in groups.items()}
    monkeypatch.setattr(lines, "_OPEN", 50)
    cols = entries(groups)
    names = ["h1", "h2", "doc_id", "row_key", "pos", "n_lines", "part"]
    given = [pa.RecordBatch.from_arrays([pa.array(c[i : i + batch]) for c in cols], names=names) for i in range(0, len(cols[0]), batch)]
    out = [r for b in lines._stream(5)(iter(given)) for r in b.to_pylist()]
    tops = {r["h1"]: r for r in out if r["kind"] == lines.SUMMARY}
    assert len(tops) == sum(r["kind"] == lines.SUMMARY for r in out)
    dropped = {(r["h1"], r["doc_id"], r["pos"]) for r in out if r["kind"] == lines.DROP}
    dropped |= {(r["h1"], r["doc_id"], r["pos"]) for r in out if r["kind"] == lines.EDGE and tops[r["h1"]]["n_docs"] >= 5 and r["doc_id"] != tops[r["h1"]]["doc_id"]}
    want = set()
    for h, found in groups.items():
        docs = {d for d, _ in found}
        want |= {(h, d, p) for d, p in found if len(docs) >= 5 and d != max(docs)}
    assert dropped == want


def test_pivot_sql_with_planted_links(spark):
    """The registered SQL and the operator on vectors of which many link, as the given tables hold no pair above the threshold."""
    duckdb = pytest.importorskip("duckdb")
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(60, 16))
    rows = [(i, (centres[i % 60] + rng.normal(size=16) * (0.05 if i % 3 else 0.4)).astype(np.float32).tolist(), int(i % 60) % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    con = duckdb.connect()
    con.register("given", pa.table({"vec_id": pa.array([r[0] for r in rows], pa.int64()), "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float32())), "label": pa.array([r[2] for r in rows], pa.int32())}))
    con.execute("create view embeddings as select * from given")
    want = {r[0]: r[1:] for r in con.execute(SQL["op10_pivot_dedup"]).fetchall()}
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pivot_dedup(df).select("vec_id", "n_links", "component_id", "kept").collect()}
    links = sum(n for n, _, _ in want.values())
    assert links > 500 and sum(n for n, _, _ in got.values()) >= 0.9 * links
    assert all(got[k][0] <= want[k][0] for k in want)
    assert sum(got[k][1:] == want[k][1:] for k in want) >= 0.95 * len(want)
