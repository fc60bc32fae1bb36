"""Each corpus operator on small tables: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from barspan.llm.chat import chains, escape, format_turns, parse_turns, reply_trees, unescape
from barspan.llm.components import connected_components
from barspan.llm.line_dedup import line_bitmaps, line_dedup
from barspan.llm.mixing import mix, mixing_rates, mixing_sample, rake
from barspan.llm.ngram_join import InvertedLists, may_match, ngram_join, parity, shingles
from barspan.llm.packing import best_fit_packing, nonnegative_least_squares, plan_packing, token_pieces
from barspan.llm.pivot_dedup import pivot_dedup
from barspan.llm.pu_quality import N_FEATURES, estimate_prior, expand, fit, quality_scores
from barspan.llm.quality_rules import quality_rules
from barspan.llm.queries import QUERIES, SQL, vocabulary
from barspan.llm.token_cache import counter, token_counts
from barspan.llm.warc import derive, parse_warc, plain_text, read_page, read_warc, responses_of_pages, sha1_digest, warc_derivatives, write_warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{i}" for i in range(60)]


def some_docs(seed=0, n=60):
    """Texts with copies, near copies, shared lines, odd spaces, nulls, an empty and a very long one."""
    rnd = random.Random(seed)
    texts = [" ".join(rnd.choices(WORDS, k=rnd.randint(1, 60))) for _ in range(n)]
    long = " ".join(rnd.choices(WORDS, k=20_000))
    line = "This line is shared by many documents and long enough to count."
    texts += [texts[0]] * 7 + [None, "", " \n\t ", long, long + " end", "a", "a b c d", "A B c D"]
    for i in range(12):
        w = texts[1].split() + rnd.choices(WORDS, k=40)
        w[i % len(w)] = "edited"
        texts.append(" ".join(w))
    texts += [f"start {i}\n  {line.upper() if i % 2 else line} \t\nend" for i in range(8)]
    return [(i, t, "en" if i % 3 else None, f"s{i % 4}", len(t) if t else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(some_docs(), DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(df):
    """The same rows with further columns whose names operators use inside."""
    names = ["token", "rep", "component", "digest", "h1", "pos", "n", "topic", "tokens", "weight", "rate", "score", "length", "x", "kind"]
    names += ["_text", "_tokens", "_kept", "_n_lines", "_n_dropped", "_keep_bitmap", "_m_doc", "_m_row", "held_out", "predicted", "n_lines", "n_dropped", "component_id", "kept"]
    return df.select("*", *[F.lit(1).alias(c) for c in names])


def rows(df, *keys):
    return sorted((tuple(r) for r in df.collect()), key=str)


def brute_components(links, ids):
    top = {i: i for i in ids}

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for a, b in links:
        a, b = find(a), find(b)
        top[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


# quality rules


def test_quality_rules_count_as_by_hand(spark):
    text = ("one two three four five six seven eight " * 3).strip() + "\n* the of\n\nsame line\nsame line"
    r = quality_rules(spark.createDataFrame([(1, text), (2, None), (2, ""), (None, "x")], "doc_id long, text string")).collect()
    a = r[0]
    words = text.split()
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    assert (a.n_words, a.word_chars, a.n_symbols, a.n_dup_lines, a.n_repeat_words) == (len(words), sum(map(len, words)), 1, 1, len(covered))
    assert a.base_failed and not a.kept
    assert [(x.n_words, x.kept) for x in r[1:]] == [(0, False), (0, False), (1, False)]


def test_quality_rules_on_odd_tables(spark, docs):
    assert quality_rules(empty(spark)).count() == 0
    assert rows(quality_rules(clashing(docs))) == rows(quality_rules(docs))


# token counts


def test_token_counts_equal_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = vocabulary("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = {i: (len((x or "").encode()), len(t.encode(x or "", add_special_tokens=False).ids)) for i, x, *_ in some_docs()}
    got = token_counts(clashing(docs), path).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in got} == want
    assert all(r.over_limit == (r.n_tokens > 1024) for r in got)
    assert token_counts(empty(spark), path).count() == 0


def test_counts_of_words_add_up():
    c = counter(vocabulary("byte_bpe_50k.json"))
    rnd = random.Random(1)
    parts = ["a", " ", "\n", "\t", "'s", "12", "é", "日本", "  ", "<|endoftext|>", "\x1c", "\x85", " ", "!?", "x.", "don't", "　"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 9))) for _ in range(4000)]
    assert c.counts(texts) == [c.whole(t) if t else 0 for t in texts]


def test_token_cache_is_used_again(spark, docs, tmp_path):
    path, cache = vocabulary("byte_bpe_50k.json"), f"file://{tmp_path}/cache"
    first = rows(token_counts(docs, path, cache))
    n = spark.read.parquet(cache).count()
    assert rows(token_counts(docs, path, cache)) == first
    assert spark.read.parquet(cache).count() == n == len({(t or "") for _, t, *_ in some_docs()})
    repeated = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, "new", None, None, None)], DOCS))
    assert token_counts(repeated, path, cache).count() == docs.count() + 4


# packing


def test_packing_is_exact_and_tight(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {i: t.encode(x or "", add_special_tokens=False).ids + [1] for i, x, *_ in some_docs()}
    got = best_fit_packing(clashing(docs), vocabulary("word_bpe_49k.json"), 512).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert by_doc.keys() == ids.keys()
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r.piece)
        assert [r.start for r in parts] == list(range(0, len(ids[i]), 512))
        for r in parts:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[i][r.start : r.start + 512], "<u4").tobytes()) and r.length == len(ids[i][r.start : r.start + 512])
    for parts in by_seq.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 512
    bound = -(-sum(r.length for r in got) // 512)
    assert len(by_seq) <= bound * 1.03 + 1
    assert best_fit_packing(empty(spark), vocabulary("word_bpe_49k.json")).count() == 0
    twice = best_fit_packing(docs.filter("doc_id < 3").unionByName(docs.filter("doc_id < 3")), vocabulary("word_bpe_49k.json"))
    assert twice.count() == 6


@pytest.mark.parametrize("capacity", [64, 100, 4096])
def test_plan_packs_every_piece_once(capacity):
    rnd = random.Random(capacity)
    h = Counter(min(capacity, 1 + int(rnd.expovariate(4 / capacity))) for _ in range(5000))
    plan = plan_packing(dict(h), capacity)
    used = Counter()
    for lengths, count in plan:
        assert count > 0 and sum(lengths) <= capacity
        for n in lengths:
            used[n] += count
    assert used == h
    assert sum(c for _, c in plan) <= -(-sum(n * c for n, c in h.items()) // capacity) * 1.02 + 1
    assert plan_packing({}, capacity) == []


def test_least_squares_finds_a_nonnegative_fit():
    index = np.array([[0, 1, -1], [1, 1, -1], [2, -1, -1]])
    x = nonnegative_least_squares(index, np.array([3.0, 7.0, 4.0]))
    assert np.allclose(x, [3, 2, 4], atol=1e-3)


def test_word_ids_equal_the_library(spark):
    from barspan.llm.packing import word_ids

    w = word_ids(vocabulary("word_bpe_49k.json"))
    rnd = random.Random(2)
    parts = ["Ab", " ", "\n", "'s", "12", "É", "é", "日本", "<|endoftext|>", "\x1c", "\x85", "!?", "x.", "ΑΣ", "　", "'T", "İ"]
    texts = ["".join(rnd.choices(parts, k=rnd.randint(0, 9))) for _ in range(4000)]
    assert [w.ids(t) for t in texts] == [w.whole(t) for t in texts]


# line dedup


def brute_lines(data, least=40, k=5):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip("\t\n\x0b\x0c\r ").translate(table)
    held = defaultdict(set)
    for i, t in data:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= least:
                    held[key(x)].add(i)
    out = []
    for i, t in data:
        keep = [x for x in (t or "").split("\n") if i is None or len(held.get(key(x), ())) < k or max(held[key(x)]) == i]
        out.append((i, len((t or "").split("\n")), len((t or "").split("\n")) - len(keep), "\n".join(keep)))
    return sorted(out, key=str)


def test_line_dedup_matches_brute_force(spark):
    rnd = random.Random(3)
    lines = [f"line number {i} that is shared {'x' * 30}" for i in range(12)] + ["short", "", "  ", "É" * 40, "É" * 39]
    data = [(i, "\n".join(rnd.choices(lines, k=rnd.randint(1, 6)))) for i in range(300)] + [(7, lines[0]), (7, lines[0]), (None, lines[1]), (400, None), (401, "")]
    data += [(i, lines[2].upper() + "\n" + lines[2]) for i in range(500, 900)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    for parts in ("4", "37"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = line_dedup(clashing(df))
        assert got.columns[-2:] == ["__n_lines", "__n_dropped"]
        got = got.select("doc_id", *got.columns[-2:], F.coalesce("text", F.lit("")))
        assert rows(got) == brute_lines(data)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_line_dedup_on_odd_tables(spark, docs):
    assert line_dedup(empty(spark)).count() == 0
    assert line_bitmaps(docs.filter("doc_id < 5")).count() == 0
    assert set(line_dedup(docs).columns) == {*docs.columns, "_n_lines", "_n_dropped"}


# n-gram join


def word_sets(data):
    out = {}
    for i, t in data:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_join(data):
    sets = word_sets(data)
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    c = brute_components(links, ids)
    return sorted(((i, len(sets[i]), c[i]) for i in ids), key=str)


def test_ngram_join_matches_brute_force(spark, docs):
    assert rows(ngram_join(clashing(docs))) == brute_join([(i, t) for i, t, *_ in some_docs()])
    assert ngram_join(empty(spark)).count() == 0


@pytest.mark.parametrize("block_rows", [4, 1000])
def test_ngram_join_of_a_family(spark, block_rows):
    """Copies with one to many edits: a chain of links around one base, with isolated members and blocks of a few rows."""
    rnd = random.Random(5)
    base = rnd.choices(WORDS, k=150)
    data = []
    for i in range(90):
        w = list(base)
        for _ in range(rnd.randint(0, 7)):
            w[rnd.randrange(len(w))] = f"new{rnd.randrange(999)}"
        data.append((i, " ".join(w)))
    data += [(100 + i, " ".join(rnd.choices(WORDS, k=80) + base[:30])) for i in range(30)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(4)
    assert rows(ngram_join(df, heavy_tokens=50, block_rows=block_rows, pairs_a_task=20)) == brute_join(data)


def test_divide_skip_equals_counting():
    rnd = random.Random(6)
    sets = [np.array(sorted(rnd.sample(range(60), rnd.randint(1, 40))), np.uint64) for _ in range(50)]
    lists = InvertedLists(sets)
    for q in sets:
        for least in (1, 5, len(q)):
            want = sorted((i, n) for i, s in enumerate(sets) if (n := len(np.intersect1d(q, s))) >= least)
            assert sorted(lists.search(q, least)) == want


def test_parity_never_rules_out_a_match():
    rnd = random.Random(7)
    for _ in range(300):
        a = {rnd.getrandbits(64) for _ in range(rnd.randint(5, 1500))}
        b = set(a)
        for x in rnd.sample(sorted(a), rnd.randint(0, len(a) // 9)):
            b.discard(x)
            if rnd.random() < 0.5:
                b.add(rnd.getrandbits(64))
        x, y = (np.array(sorted(s), np.uint64) for s in (a, b))
        if 10 * len(a & b) >= 8 * len(a | b):
            assert may_match(len(x), parity(x), len(y), parity(y))


def test_shingles_of_short_texts():
    assert len(shingles(None)) == len(shingles(b" \n")) == 0
    assert len(shingles(b"a b")) == 1 and (shingles(b"A b") == shingles(b"a  B")).all()
    assert len(shingles(b"a b c d e f")) == 2


def test_ngram_join_rows_that_share_an_id(spark):
    t = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    data = [(1, t[0]), (1, t[0]), (2, t[0]), (2, t[1]), (3, t[1]), (None, t[0])]
    got = ngram_join(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert len(got) == 6 and {r.component_id for r in got if r.doc_id is None} == {None}


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5), (None, 3)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {**dict.fromkeys(range(61), 0), **dict.fromkeys(range(100, 130), 100)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


# embeddings


def brute_vectors(data, threshold=0.93):
    ids = [i for i, *_ in data]
    v = {i: (np.array(e, float), lab) for i, e, lab in data if e is not None and lab is not None and i is not None and None not in e and np.isfinite(e).all() and np.any(e)}
    links = [(a, b) for a in v for b in v if a != b and v[a][1] == v[b][1] and len(v[a][0]) == len(v[b][0]) and v[a][0] @ v[b][0] / (np.linalg.norm(v[a][0]) * np.linalg.norm(v[b][0])) >= threshold]
    n = Counter(a for a, _ in links)
    c = brute_components(links, ids)
    return sorted(((i, n[i], c[i], c[i] == i) for i in ids), key=str)


@pytest.mark.parametrize("block_rows", [6, 1000])
def test_pivot_dedup_matches_brute_force(spark, block_rows):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(25, 16))
    data = []
    for i in range(140):
        e = base[i % 25 if i < 100 else 0] + rng.normal(size=16) * (0.05 if i % 4 else 0.6)
        data.append((i, [float(x) for x in e], i % 2))
    data += [(200, data[0][1], 0), (201, data[0][1], 0), (202, None, 0), (203, [0.0] * 16, 0), (204, [1.0, None], 1), (205, [float("nan")] * 16, 1), (206, [1.0, 2.0], None), (207, [1.0, 2.0], 0), (208, [], 0), (209, [1e-200] * 16, 0), (210, [1e-200] * 16, 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").repartition(3)
    got = rows(pivot_dedup(df.withColumn("dim", F.lit(3)), block_rows=block_rows))
    want = brute_vectors([x for x in data if x[0] not in (209, 210)])  # whose norms leave the range
    for i in ("209", "210"):
        pair = [g for g in got if str(g[0]) == i]
        assert pair[0][1] == 1 and pair[0][2] == 209
        got = [g for g in got if str(g[0]) != i]
    assert got == want
    assert pivot_dedup(df.limit(0)).count() == 0
    assert rows(pivot_dedup(df.filter("vec_id = 202"))) == [(202, 0, 202, True)]


def test_pivot_recall_on_noisy_vectors(spark):
    """Links just above the threshold, where permutations agree least: recall against brute force is 0.9 at least."""
    rng = np.random.default_rng(9)
    base = rng.normal(size=(150, 64))
    e = np.concatenate([base, base + rng.normal(size=base.shape) * 0.36])
    data = [(i, [float(x) for x in v], 0) for i, v in enumerate(e)]
    want = sum(n for _, n, *_ in brute_vectors(data))
    got = pivot_dedup(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")).agg(F.sum("n_links")).first()[0]
    assert want > 100 and 0.9 * want <= got <= want


@pytest.mark.parametrize("n", [200, 800, 2400])
def test_pivot_recall_as_vectors_grow(spark, n):
    """Vectors around few centres, so that lists are long and are split by pairs of pivots and by blocks."""
    rng = np.random.default_rng(n)
    base = rng.normal(size=(n // 20, 32))
    e = np.concatenate([base[rng.integers(0, len(base), n - n // 8)] + rng.normal(size=(n - n // 8, 32)) * rng.choice([0.1, 0.3, 0.6], (n - n // 8, 1)), base[0] + rng.normal(size=(n // 8, 32)) * 0.02])
    unit = e / np.linalg.norm(e, axis=1, keepdims=True)
    want = int((unit @ unit.T >= 0.93).sum()) - n
    df = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(e)], "vec_id long, embedding array<double>, label int")
    got = pivot_dedup(df, block_rows=40).agg(F.sum("n_links")).first()[0]
    assert want > n and 0.9 * want <= got <= want


# quality classifier


def test_quality_scores_tell_prose_from_junk(spark):
    rnd = random.Random(10)
    prose = [" ".join(rnd.choice(["the", "a", "sees", "runs"] + WORDS) for _ in range(rnd.randint(20, 90))) + "." for _ in range(300)]
    junk = [" ".join(rnd.choice(WORDS) + "$$$" for _ in range(rnd.randint(20, 90))) if i % 2 else "spam " * 50 for i in range(100)]
    data = list(enumerate(prose + junk)) + [(900, None), (901, ""), (None, "x y")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300, 2)] + [(i, 0, 0) for i in range(300, 400, 3)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_scores(clashing(df), labels).collect()}
    wide = quality_scores(clashing(df), labels, columns=clashing(df).columns)
    assert wide.columns[-3:] == ["_held_out", "_score", "_predicted"]
    assert {r[0]: r[-2] for r in wide.collect()} == {i: r.score for i, r in got.items()}
    for layout in (df.repartition(7), df.repartition(3, "text"), df.unionByName(df.filter("doc_id < 50"))):
        assert {r.doc_id: r.score for r in quality_scores(layout, labels).collect()} == {i: r.score for i, r in got.items()}
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert np.mean([got[i].predicted for i in range(300)]) > 0.95 and np.mean([got[i].predicted for i in range(300, 400)]) < 0.05
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(400))
    assert {r.score for r in quality_scores(df, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(empty(spark), labels).count() == 0


def test_prior_and_risk():
    rng = np.random.default_rng(11)
    p = rng.normal(size=(2000, 3)) + 3
    u = np.concatenate([rng.normal(size=(1400, 3)) + 3, rng.normal(size=(600, 3)) - 3])
    assert abs(estimate_prior(p.sum(1), u.sum(1)) - 0.7) < 0.05
    m = fit(p, u)
    assert abs(m["prior"] - 0.7) < 0.06


# mixing


CELLS = [("a", "x", "p", 100), ("a", "y", "p", 50), ("b", "x", "q", 30), ("b", "y", "p", 70), ("c", "y", "q", 0)]


def test_raking_reaches_its_marginals(spark):
    cells = spark.createDataFrame(CELLS, "source string, lang string, topic string, tokens long")
    share = lambda d: spark.createDataFrame(list(d.items()), "value string, share double")
    targets = {"source": share({"a": 0.5, "b": 0.5}), "lang": share({"x": 0.3, "y": 0.7}), "topic": share({"p": 0.9, "q": 0.1, "absent": 0.0})}
    w = rake(cells, targets).toPandas()
    assert np.allclose(w.groupby("lang")["weight"].sum(), [0.3, 0.7], atol=1e-5) and np.allclose(w.groupby("topic")["weight"].sum(), [0.9, 0.1], atol=1e-5)
    assert np.allclose(w.groupby("source")["weight"].sum(), [0.5, 0.5, 0], atol=1e-5)


def test_raking_within_what_a_sample_can_hold(spark):
    cells = spark.createDataFrame([("a", "x", 800), ("a", "y", 100), ("b", "x", 60), ("b", "y", 40)], "source string, lang string, tokens long")
    share = lambda d: spark.createDataFrame(list(d.items()), "value string, share double")
    targets = {"source": share({"a": 0.5, "b": 0.5}), "lang": share({"x": 0.8, "y": 0.2})}
    w = {(r.source, r.lang): r.weight for r in rake(cells, targets, keep=0.5).collect()}
    assert w["b", "x"] == pytest.approx(0.12, rel=1e-3) and w["b", "y"] == pytest.approx(0.08, rel=1e-3)  # all that there is of b
    assert w["a", "x"] == pytest.approx(0.68, rel=1e-3) and w["a", "y"] == pytest.approx(0.12, rel=1e-3)
    with pytest.warns(UserWarning, match="sweeps"):  # the driver's form and Spark's, sweep by sweep
        short, wide = ({(r.source, r.lang): r.weight for r in rake(cells, targets, keep=0.5, driver_cells=n, max_sweeps=2).collect()} for n in (10, 1))
    assert short == pytest.approx(wide)


def mixed_docs():
    rnd = random.Random(13)
    data = []
    for i in range(3000):
        source = rnd.choices(["s0", "s1", "s2", None], [70, 25, 4, 1])[0]
        body = " ".join(rnd.choices(WORDS, k=rnd.randint(1, 60)))
        data.append((i, body + (" | cell" if rnd.random() < 0.1 else ""), rnd.choice(["en", "en", "de"]), source, 1))
    return data + [(3000, "lonely @ text", "xx", "rare", 1), (3001, None, "en", "s0", 0), (3002, "", "en", "s0", 0), (None, "a b", "en", "s0", 3), (5, data[5][1], data[5][2], data[5][3], 1)]


def test_rates_agree_with_a_loop(spark):
    """Cells, tempered and attainable targets, sweeps and rates, each by plain loops over rows."""
    data, power, keep = mixed_docs(), 0.9, 0.7
    rows = [(i, (s or "", g or "", "table" if " | " in (t or "") else "contact" if "@" in (t or "") else "prose"), len((t or "").split())) for i, t, g, s, _ in data]
    cells = Counter()
    for _, c, n in rows:
        cells[c] += n
    total = sum(cells.values())
    weight = {c: n / total for c, n in cells.items()}
    aims = []
    for k in range(3):
        sums = Counter()
        for c, n in cells.items():
            sums[c[k]] += n
        want = {v: n**power for v, n in sums.items() if n}
        want = {v: x / sum(want.values()) for v, x in want.items()}
        full = set()
        while True:
            left = 1 - sum(sums[v] / total / keep for v in full)
            scale = left / sum(x for v, x in want.items() if v not in full)
            more = {v for v, x in want.items() if v not in full and x * scale >= sums[v] / total / keep}
            if not more:
                break
            full |= more
        aims.append({v: sums[v] / total / keep if v in full else want[v] * scale for v in want})
    for _ in range(300):
        for k, aim in enumerate(aims):
            sums = Counter()
            for c, w in weight.items():
                sums[c[k]] += w
            weight = {c: min(w * aim.get(c[k], 0) / sums[c[k]] if sums[c[k]] else 0, cells[c] / total / keep) for c, w in weight.items()}
    docs = spark.createDataFrame(data, DOCS).repartition(3)
    got = mixing_sample(*mixing_rates(docs, power=power, keep=keep)).collect()
    assert len(got) == len(data)
    for r in got:
        c = (r.source, r.lang, r.topic)
        assert r.rate == pytest.approx(weight[c] * keep * total / cells[c], abs=1e-4) and 0 <= r.rate <= 1
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == sorted((str(i), n) for i, _, n in rows)
    sample = Counter()
    for r in got:
        if r.kept:
            sample[r.source] += r.n_tokens
    held = sum(sample.values())
    assert held / total == pytest.approx(keep, abs=0.03)
    for v, aim in aims[0].items():
        assert sample[v] / held == pytest.approx(aim, abs=0.03)
    kept = mix(docs).collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(r.doc_id) for r in got if r.kept)


def test_mix_of_odd_tables(spark, docs):
    assert mix(docs).columns == docs.columns
    assert rows(mix(docs.repartition(7))) == rows(mix(docs))
    assert mix(empty(spark)).count() == 0
    assert mix(docs.filter("text is null")).count() == 0
    assert rows(mix(clashing(docs)).select(*docs.columns)) == rows(mix(docs))
    assert mixing_sample(*mixing_rates(docs)).count() == docs.count()


# chat


def test_escapes_are_reversible():
    rnd = random.Random(12)
    parts = ["<|turn|>", "<|text|>", "<|end|>", "\\", "<", "[", "[INST]", "[/INST]", "</s>", "<<SYS>>", "|>", "a", "\n", "é"]
    for _ in range(5000):
        turns = [(rnd.choice(["user", "assistant", "x<|text|>"]), "".join(rnd.choices(parts, k=rnd.randint(0, 6)))) for _ in range(rnd.randint(0, 3))]
        text, spans = format_turns(turns)
        assert parse_turns(text) == turns
        assert [unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
        assert all(unescape(escape(t)) == t for _, t in turns)


def test_parsing_takes_time_in_proportion():
    turns = [("user", "\\" * 200_000 + "<" * 200_000), ("assistant", "<|end|>" * 50_000)]
    text, _ = format_turns(turns)
    assert parse_turns(text) == turns
    assert parse_turns(text[:-1]) == turns[:1] and parse_turns("<|turn|>" * 100_000 + "a" * 100_000) == []


def test_reply_trees_rank_branches(spark):
    tree = [(1, 1, None, "user", "hi", 0.0), (1, 2, 1, "assistant", "low", 0.1), (1, 3, 1, "assistant", "high", 0.9), (1, 4, 3, "user", "more", None), (1, 5, 4, "assistant", "done", 0.8)]
    tree += [(2, 1, 99, "user", None, 1.0), (3, 1, 2, "user", "cycle", 1.0), (3, 2, 1, "user", "cycle", 1.0), (None, 1, None, "user", "x", 1.0), (1, 1, None, "user", "hi", 0.0)]
    df = spark.createDataFrame(tree, "tree_id long, node_id long, parent_id long, role string, text string, score double").withColumn("up", F.lit(0))
    got = {(r.tree_id, r.branch_rank): parse_turns(r.formatted) for r in reply_trees(df, branches=2).collect()}
    assert got == {(1, 1): [("user", "hi"), ("assistant", "high"), ("user", "more"), ("assistant", "done")], (1, 2): [("user", "hi"), ("assistant", "low")], (2, 1): [("user", "")]}
    assert reply_trees(df.limit(0)).count() == 0


def test_chains_of_conversations(spark):
    data = [(1, t, "user" if t % 2 == 0 else "assistant", f"t{t}") for t in range(21)] + [(2, 0, "user", None), (2, 0, "assistant", "tie"), (None, 0, "user", "x")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").repartition(3)
    got = {r.tree_id: parse_turns(r.formatted) for r in reply_trees(chains(df)).collect()}
    assert got == {1: [(r, t) for _, _, r, t in data[:21]], 2: [("assistant", "tie"), ("user", "")]}


# WARC


def test_warc_round_trip(spark, tmp_path):
    page = "<html lang='en'><head><title>A &amp; B</title><style>x</style></head><body><script>no</script><p>Hello <b>there</b></p><!-- c --><a href='/x'>link</a></body></html>"
    data = [(1, "http://a.example/", page), (2, None, None), (2, None, None), (None, "u", "plain & text"), (3, "v", "<p>" * 5000 + "deep")]
    pages = spark.createDataFrame(data, "page_id long, url string, html string").withColumn("block", F.lit("clash"))
    derived = warc_derivatives(responses_of_pages(pages))
    got = derived.collect()
    assert len(got) == 10
    one = {r.warc_type: r for r in got if r.headers.get("WARC-Target-URI") == "http://a.example/"}
    assert one["conversion"].block == "Hello there\nlink" and "title: A & B\r\n" in one["metadata"].block and "outlink: /x\r\n" in one["metadata"].block
    assert one["conversion"].headers["WARC-Refers-To"] == one["metadata"].headers["WARC-Refers-To"] == one["metadata"].source_id
    assert f"source-payload-digest: {sha1_digest(page.encode())}" in one["metadata"].block
    write_warc(derived, f"{tmp_path}/w")
    back = read_warc(spark, f"{tmp_path}/w/*.gz", None).collect()
    assert sorted((r.record_id, bytes(r.block).decode()) for r in back) == sorted((r.record_id, r.block) for r in got)
    assert all(sha1_digest(bytes(r.block)) == r.headers["WARC-Block-Digest"] and int(r.headers["Content-Length"]) == len(r.block) for r in back)
    assert warc_derivatives(responses_of_pages(pages.limit(0))).count() == 0
    assert derive("<x>", {}, b"")[1]["block"] == "" and list(parse_warc(b"")) == []


def test_pages_left_open_take_time_in_proportion():
    import time

    began = time.time()
    for part in ("<a ", "<head ", "<title>", "<script>", "<!--", "<a href='", "<head>", "<p", "<a href="):
        read_page(part * 200_000)
        read_page(part * 200_000 + ">")
    assert time.time() - began < 20


def test_bodies_are_decoded():
    import gzip

    page = "<html lang='de'><head><title>Gr\u00fc\u00dfe</title></head><p>\u00c4pfel</p>"
    packed = gzip.compress(page.encode("latin-1"))
    chunked = b"".join(b"%x\r\n%s\r\n" % (len(packed[i : i + 9]), packed[i : i + 9]) for i in range(0, len(packed), 9)) + b"0\r\n\r\n"
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nContent-Encoding: gzip\r\nTransfer-Encoding: chunked\r\n\r\n"
    metadata, conversion = derive("<x>", {}, head + chunked)
    assert conversion["block"] == "\u00c4pfel" and "title: Gr\u00fc\u00dfe\r\n" in metadata["block"]
    assert f"source-payload-digest: {sha1_digest(packed)}" in metadata["block"]
    plain = b"HTTP/1.1 200 OK\r\n\r\n"
    assert derive("<x>", {}, plain + b"<meta charset=iso-8859-1>\xe4")[1]["block"] == "\u00e4"
    assert derive("<x>", {}, plain + "\ufeff\u00e4".encode())[1]["block"] == "\u00e4"
    assert derive("<x>", {}, b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\nContent-Type: text/html; charset=none\r\n\r\nplain")[1]["block"] == "plain"


def test_warc_files_are_read_record_by_record():
    import gzip

    records = [(f"<urn:{i}>", b"WARC/1.0 inside\r\n\r\n" * i) for i in range(40)]
    made = [b"WARC/1.1\r\nWARC-Record-ID: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (i.encode(), len(b), b) for i, b in records]
    for raw in (b"".join(made), b"".join(map(gzip.compress, made)), b"junk\r\n" + gzip.decompress(gzip.compress(b"".join(made)))):
        assert [(h["WARC-Record-ID"], b) for h, b in parse_warc(raw)] == records
    assert [b for _, b in parse_warc(made[3][:-30])] == [records[3][1][: -30 + 4]]  # a file cut short


def test_warc_query_against_a_loop(spark):
    """Every record of the query from the pages alone, by a parser and plain statements."""
    import base64
    import hashlib

    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    got = {(r.target_uri, r.warc_type, r.source_id): r for r in QUERIES["op3_warc_derivatives"](spark, sf).collect()}
    pages = pq.read_table(f"{sf}/pages.parquet").to_pylist()
    assert len(got) == 2 * len(pages)
    by_uri = defaultdict(list)
    for (uri, kind, _), r in got.items():
        by_uri[uri, kind].append(r)
    sha1 = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    for p in pages:
        body = (p["html"] or "").encode()
        text = next(r for r in by_uri[p["url"], "conversion"] if plain_text(p["html"] or "") == r.block)
        said = next(r for r in by_uri[p["url"], "metadata"] if f"source-payload-digest: {sha1(body)}" in r.block)
        for r in (text, said):
            assert r.refers_to == r.source_id and r.block_digest == sha1(r.block.encode()) and r.content_length == len(r.block.encode())
            assert r.warc_date and r.source_content_type == "application/http; msgtype=response"
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        assert f"source-block-digest: {sha1(head + body)}" in said.block and said.block.startswith("http-status: HTTP/1.1 200 OK\r\n")


def test_plain_text_matches_a_parser():
    from html.parser import HTMLParser

    class Text(HTMLParser):
        def __init__(self):
            super().__init__()
            self.out, self.hidden = [], 0

        def handle_starttag(self, tag, attrs):
            self.hidden += tag in ("script", "style", "head")
            self.out += ["\n"] * (tag in ("p", "li", "div", "br", "h1", "ul"))

        def handle_endtag(self, tag):
            self.hidden -= tag in ("script", "style", "head")
            self.out += ["\n"] * (tag in ("p", "li", "div", "h1", "ul"))

        def handle_data(self, data):
            if not self.hidden:
                self.out.append(data)

    import pyarrow.parquet as pq

    for page in pq.read_table("/root/testdata/sf0.001/pages.parquet").column("html").to_pylist():
        p = Text()
        p.feed(page)
        want = [" ".join(x.split()) for x in "".join(p.out).split("\n")]
        assert " ".join(plain_text(page).split()) == " ".join(x for x in want if x)


def test_stages_on_odd_tables(spark):
    """Nulls, empty and long texts, repeated rows, further columns and empty tables go through every stage."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    data = some_docs()
    data += data[:3] + [(None, "no id " * 30, None, None, None), (None, None, "en", "s", 0)]
    docs = clashing(spark.createDataFrame(data, DOCS)).repartition(3)
    sizes = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, sf)
        assert kept.columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
        sizes[name] = kept.count()
        given, left = Counter(r.doc_id for r in docs.collect()), Counter(r.doc_id for r in kept.collect())
        assert all(left[i] in (0, n) for i, n in given.items() if i is not None), name  # rows that repeat go or stay together
    assert sizes["line dedup"] == len(data)
    packed = corpus_pipeline.packing(spark, docs, sf).collect()
    assert Counter(r.doc_id for r in packed if r.piece == 0) == Counter(i for i, *_ in data)
    assert corpus_pipeline.packing(spark, docs.limit(0), sf).count() == 0


def hashed(doc_id: int, seed: int) -> int:
    """Spark's xxhash64 of a long and an int."""
    import struct

    import xxhash

    first = xxhash.xxh64(struct.pack("<q", doc_id), seed=42).intdigest()
    return xxhash.xxh64(struct.pack("<i", seed), seed=first).intdigest()


def verdicts_by_loop(texts: dict, labels: list) -> set:
    """Documents that the classifier accepts: samples, order and scores by plain statements, features and descent by their functions."""
    from barspan.llm.pu_quality import features

    signed = lambda h: h - (1 << 64) if h >> 63 else h
    learned = [i for i in texts if zlib.crc32(str(i).encode()) % 4 != 2]
    good = {i for i, q in labels if q == 1 and i in set(learned)}
    order = lambda ids: sorted(ids, key=lambda i: (signed(hashed(i, 3)), i))
    x = {i: features(t) for i, t in texts.items()}
    model = fit(np.array([x[i] for i in order(good)]), np.array([x[i] for i in order(learned)]), None)
    out = set()
    for i, v in x.items():
        z = float((expand(v[None], model["mean"], model["sd"]) * model["weights"]).sum())
        out |= {i} if 1 / (1 + math.exp(-z)) >= 0.7 else set()
    return out


def kept_by_loop(texts: dict, where: dict, keep: float = 0.7, power: float = 0.9) -> set:
    """Ids that mixing keeps: cells, tempered targets, raking with limits and rates, one value after the other."""
    marks = [("table", (" | ",)), ("legal", ("Licensed under", "SPDX-License-Identifier", "All rights reserved", "Permission is hereby granted")), ("code", ("```", "#include", "def ", "function ", "();")), ("contact", ("@",))]
    cell, tokens = {}, Counter()
    for i, text in texts.items():
        topic = next((name for name, held in marks if any(m in (text or "") for m in held)), "prose")
        cell[i] = (where[i][1] or "", where[i][0] or "", topic)
        tokens[cell[i]] += len([w for w in re.split("[ \t\n\x0b\x0c\r]", text or "") if w])
    total = sum(tokens.values())
    weight = {c: n / total for c, n in tokens.items()}
    most = {c: n / total / keep for c, n in tokens.items()}
    aims = []
    for d in range(3):
        sums = Counter()
        for c, n in tokens.items():
            sums[c[d]] += n
        tempered = {v: n**power for v, n in sums.items() if n > 0}
        target = {v: p / sum(tempered.values()) for v, p in tempered.items()}
        limit = {v: sum(m for c, m in most.items() if c[d] == v) for v in target}
        aim, free = {}, set(target)
        while free:
            scale = (1 - sum(aim.values())) / sum(target[v] for v in free)
            over = {v for v in free if target[v] * scale >= limit[v]}
            if not over:
                aim |= {v: target[v] * scale for v in free}
                break
            aim |= {v: limit[v] for v in over}
            free -= over
        aims.append(aim)
    for _ in range(500):
        for d, aim in enumerate(aims):
            sums = Counter()
            for c, w in weight.items():
                sums[c[d]] += w
            weight = {c: min(w * (aim.get(c[d], 0.0) / sums[c[d]] if sums[c[d]] > 0 else 0.0), most[c]) for c, w in weight.items()}
        worst = max(abs(sum(w for c, w in weight.items() if c[d] == v) - a) / a for d, aim in enumerate(aims) for v, a in aim.items())
        if worst <= 1e-6:
            break
    rate = {c: round(min(w * keep * total / tokens[c], 1.0), 9) if tokens[c] else 0.0 for c, w in weight.items()}
    return {i for i in texts if hashed(i, 7) % (1 << 52) / (1 << 52) < rate[cell[i]]}


def test_pipeline_against_brute_force(spark):
    """Every stage on what the stage before kept: verdicts, lines, classes, rates and packing by plain loops."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    assert len(texts) == documents.count()
    accepted = verdicts_by_loop(texts, [(r.doc_id, r.quality) for r in spark.read.parquet(f"{sf}/labels.parquet").collect()])
    assert 0 < len(accepted) < len(texts)
    texts = {i: t for i, t in texts.items() if i in accepted}
    texts = {i: t if texts[i] is not None else None for i, _, _, t in brute_lines(list(texts.items()))}
    texts = {i: texts[i] for i, _, c in brute_join(list(texts.items())) if i == c}
    kept = kept_by_loop(texts, {r.doc_id: (r.lang, r.source) for r in documents.select("doc_id", "lang", "source").collect()})
    assert 0 < len(kept) < len(texts)
    final = corpus_pipeline.run(spark, sf).collect()
    t = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    ids = {i: t.encode(texts[i] or "", add_special_tokens=False).ids + [1] for i in kept}
    want = Counter((i, k, len(x[at : at + 4096]), zlib.crc32(np.array(x[at : at + 4096], "<u4").tobytes())) for i, x in ids.items() for k, at in enumerate(range(0, len(x), 4096)))
    assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in final) == want
    by_sequence = defaultdict(list)
    for r in final:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        ends = [0, *(a + n for a, n in sorted(places))]
        assert [a for a, _ in sorted(places)] == ends[:-1] and ends[-1] <= 4096


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_its_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    want = con.execute(SQL[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(columns) == sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(*columns).collect()), key=str) == sorted(want.fetchall(), key=str)


def test_training_equals_plain_steps():
    """The non-negative risk by hand, example by example, with the same steps of the optimiser."""
    rng = np.random.default_rng(14)
    p, u = rng.normal(size=(30, N_FEATURES)) + 0.3, rng.normal(size=(40, N_FEATURES))
    model = fit(p.astype(np.float32), u.astype(np.float32), prior=0.5, steps=15)
    every = np.concatenate([p, u]).astype(np.float32).astype(float)
    mean, sd = every.mean(0), every.std(0) + 1e-6
    ep, eu = expand(p.astype(np.float32), mean, sd).astype(float), expand(u.astype(np.float32), mean, sd).astype(float)
    l2, w = 1e-3 + 1 / 30, np.zeros(ep.shape[1])
    m, v = w.copy(), w.copy()
    sigma = lambda z: 1 / (1 + np.exp(-z))
    for t in range(1, 16):
        plus, minus, risk = np.zeros_like(w), np.zeros_like(w), 0.0
        for x in ep:
            plus -= 0.5 * (1 - sigma(x @ w)) * x / len(ep)
            minus -= 0.5 * sigma(x @ w) * x / len(ep)
            risk -= 0.5 * np.log1p(np.exp(x @ w)) / len(ep)
        for x in eu:
            minus += sigma(x @ w) * x / len(eu)
            risk += np.log1p(np.exp(x @ w)) / len(eu)
        g = (plus + minus if risk >= 0 else -minus) + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.05 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(model["weights"], w, atol=2e-3)
