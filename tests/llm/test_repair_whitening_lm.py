"""Structure repair, whitening and language-model scores: loops and exact arithmetic, odd rows, hot groups."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barspan.llm import maxent_lm as lm
from barspan.llm import repair
from barspan.llm.whitening import LEVEL, centred, pair_squares, solve, whiten

CONVERSATIONS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, text string"


# Structure repair
def least_edits(symbols: str) -> tuple[int, str]:
    """Least (cost, audit) row by row, over whole strings."""
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    wanted = {0: "u", 1: "u", 2: "a", 3: "u"}

    def put_in(best):
        for _ in range(3):
            for q, (cost, audit) in list(best.items()):
                to, made = step[q, wanted[q]], (cost + 2, audit + "I")
                best[to] = min(best.get(to, made), made)
        return best

    best = put_in({0: (0, "")})
    for c in symbols:
        after = {}
        for q, (cost, audit) in best.items():
            ways = [(q, (cost + 3, audit + "D"))]
            if c != "x":
                more = int(c.isupper())
                ways += [(step[q, wanted[q]], (cost + 2 + more, audit + "R"))]
                ways += [(step[q, c.lower()], (cost + more, audit + "K"))] if (q, c.lower()) in step else []
            for to, made in ways:
                after[to] = min(after.get(to, made), made)
        best = put_in(after)
    return min(v for q, v in best.items() if q in (0, 3))


def test_search_finds_the_least_cost_and_audit():
    rnd = random.Random(1)
    for _ in range(4000):
        s = "".join(rnd.choice("suaoxSUAO") for _ in range(rnd.randint(0, 12)))
        assert repair.search(s) == least_edits(s), s


def test_segments_join_to_the_whole():
    rnd = random.Random(2)
    for _ in range(500):
        s = "".join(rnd.choice("suaoxSUAO") for _ in range(rnd.randint(3, 24)))
        parts, ways, audits = [s[i : i + 3] for i in range(0, len(s), 3)], [], {}
        for i, p in enumerate(parts):
            end = i == len(parts) - 1
            for e in (0,) if i == 0 else range(4):
                found = [(x[0], *r) for x in ([repair.ACCEPTED] if end else [(q,) for q in range(4)]) if (r := repair.search(p, e, x, end))]
                order = sorted(a for _, _, a in found)
                ways += [("k", i, e, x, c, order.index(a)) for x, c, a in found]
                audits.update({(i, e, x): a for x, _, a in found})
        joined = repair._join_segments(pd.DataFrame(ways, columns=["key", "segment", "entry", "exit", "cost", "place"]))
        assert (int(joined["total"][0]), "".join(audits[r.segment, r.entry, r.exit] for r in joined.itertuples())) == least_edits(s), s


def report_by_loop(rows):
    """Everything that the report says of one conversation, from its rows (turn, role, text) in order."""
    seen, symbols, faults = set(), "", Counter()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        faults[fault] += 1
        c = role[:1] if role[:1] in ("s", "u", "a") and role else "o"
        symbols += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
    cost, audit = least_edits(symbols)
    out, at, state = [], 0, "s?u"
    for e in audit:
        if e != "I":
            _, role, text = rows[at]
            at += 1
        if e == "D":
            continue
        role, text = (role, text) if e == "K" else ("assistant" if state == "a" else "user", "" if e == "I" else text)
        state = {"s": "u", "u": "a", "a": "u"}[role[0]]
        out.append(f"{role}:{text}")
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(), len(out)


def in_order(rows):
    blank = lambda v: " " if v is None else v
    by_id = {}
    for conv, turn, role, text in rows:
        by_id.setdefault(conv, []).append((turn, blank(role), blank(text)))
    digest = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return {k: sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, digest(r))) for k, v in by_id.items()}


def odd_conversations(seed=0):
    rnd = random.Random(seed)
    texts = ["Yes.", "No!", "Why? ", "cut off", "", " \n\t", None, "é.", "Long text. " * 3000, "a", "..."]
    roles = ["user", "assistant", "system", "tool", None, "", "unit", "Assistant"]
    rows = [(c, rnd.choice([None, 0, 1, 2, 3, 5, 9]), rnd.choice(roles[: 3 if c % 2 else 8]), rnd.choice(texts)) for c in range(60) for _ in range(rnd.randint(1, 9))]
    return rows + [(None, 1, "user", "Without an id."), (None, 2, "assistant", "Neither."), (61, -(2**63), "user", "Far."), (61, 2**63 - 1, "assistant", "Apart.")]


def test_reports_against_a_loop(spark):
    rows = odd_conversations()
    df = spark.createDataFrame(rows, CONVERSATIONS).repartition(5).withColumns({c: F.lit(1) for c in ("key", "place", "pos", "audit", "kind", "fault")})
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_report(df).collect()}
    want = {k: report_by_loop(v) for k, v in in_order(rows).items()}
    want[61] = (None, *want[61][1:])  # wider than a long
    assert got == want
    told = {}
    for r in repair.repaired_conversations(df).collect():
        told.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"], r["edit"]))
    for k, v in want.items():
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t, _ in sorted(told.get(k, []))).encode()).hexdigest() == v[7]
        initials = "".join(r[:1] for _, r, _, _ in sorted(told.get(k, [])))
        assert re.fullmatch("(s?(ua)+)?", initials)


def test_a_conversation_longer_than_a_segment(spark):
    rnd = random.Random(5)
    rows = [(7, t, rnd.choice(["user", "assistant", "assistant", "system"]), rnd.choice([f"Turn {t}.", f"cut {t}", "", "Same."])) for t in range(2 * repair.SEGMENT + 700)]
    df = spark.createDataFrame(rows + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Ho.")], CONVERSATIONS).repartition(4)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair_report(df).collect()}
    assert got == {k: report_by_loop(v) for k, v in in_order(rows + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Ho.")]).items()}


def damaged_by_loop(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda v: " " if v is None else str(v)
        role, text = said(role), said(text)
        code = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        made = (conv, turn, "user" if code == 4 else role, "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text)
        out += [] if code == 0 else [made, made] if code == 3 else [made]
    return out


def test_damage(spark):
    rows = odd_conversations(3)
    got = repair.damage(spark.createDataFrame(rows, CONVERSATIONS)).select("conv_id", "turn", "role", "text").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, damaged_by_loop(rows)))


def test_repair_of_an_empty_table(spark):
    none = spark.createDataFrame([], CONVERSATIONS)
    assert repair.repair_report(none).count() == 0 and repair.repaired_conversations(none).count() == 0


# Whitening
def whitened_by_loop(vectors):
    """Rows (n, deviation, |whitened|, explained) by vector, in integers and NumPy."""
    x = [[math.floor(64.0 * float(c)) + LEVEL for c in v] for v in vectors]
    u = [list(v) for v in {tuple(v) for v in x}]
    n, s = len(u), [sum(v) for v in zip(*u, strict=True)]
    d = np.array([[float(n * c - t) / n for c, t in zip(v, s, strict=True)] for v in u])
    e, w = np.linalg.eigh(d.T @ d / n)
    e, w = e[::-1], w[:, ::-1]
    of = np.array([[float(n * c - t) / n for c, t in zip(v, s, strict=True)] for v in x]) @ w / np.sqrt(np.where(e > 1e-9, e, np.nan))
    return n, [sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x], np.abs(of), e / e.sum()


def test_whitening_against_a_loop(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(400, 20)) * np.linspace(0.2, 3, 20)
    vectors = [v.astype(np.float32).tolist() for v in base]
    vectors += [vectors[0]] * 150 + vectors[1:4]
    bad = [None, [], [None] + [0.0] * 19, [float("nan")] + [0.0] * 19, [float("inf")] + [0.0] * 19, [1e30] + [0.0] * 19, [1.0, 2.0]]
    rows = [(i, v) for i, v in enumerate(vectors)] + [(10_000 + i, v) for i, v in enumerate(bad)] + [(None, vectors[5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(6).withColumns({c: F.lit(1) for c in ("x", "n", "component", "i", "label")})
    got = whiten(df).toPandas()
    n, deviations, values, explained = whitened_by_loop(vectors)
    assert set(got["n"]) == {n} and got["identity_error"].max() < 1e-9
    assert len(got) == 16 * (len(vectors) + 1) and sorted(got["component"].unique()) == list(range(1, 17))
    plain = got[got["vec_id"].notna()]
    table = plain.pivot(index="vec_id", columns="component", values="whitened").sort_index().to_numpy()
    assert np.allclose(np.abs(table), values[:, :16], atol=1e-9)
    assert plain.groupby("vec_id")["deviation"].first().sort_index().tolist() == deviations
    assert np.allclose(got.groupby("component")["explained"].first(), explained[:16], rtol=1e-9)


def test_whitening_of_what_has_no_space(spark):
    kind = "vec_id long, embedding array<double>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 0.5])], [(1, [0.5, 0.5]), (2, [0.5, 0.5])]):
        assert whiten(spark.createDataFrame(rows, kind)).count() == 0
    flat = [(i, [float(i % 7), 1.0, 2.0 * (i % 7)]) for i in range(40)]  # one dimension's worth of variance
    got = whiten(spark.createDataFrame(flat, kind)).toPandas()
    assert set(got["component"]) == {1} and len(got) == 40 and got["identity_error"].max() < 1e-9


def test_polarised_sums_are_exact():
    rng = np.random.default_rng(6)
    for scale in (1 << 5, 1 << 33, 1 << 45):
        x = rng.integers(-scale, scale, (50, 3)) + LEVEL
        n, sums = 50, [int(s) for s in x.astype(object).sum(axis=0)]
        d = centred(x, n, sums)
        exact = [[n * int(c) - s for c, s in zip(v, sums, strict=True)] for v in x]
        got = pair_squares(d)
        for i in range(3):
            for j in range(i, 3):
                assert got[i][j - i] == sum((v[i] + v[j] if i != j else v[i]) ** 2 for v in exact)
        fitted = solve(n, sums, {(i, j): got[i][j - i] for i in range(3) for j in range(i, 3)})
        centre = np.array([[c / n for c in v] for v in exact])
        assert np.allclose(fitted.eigenvalues, np.linalg.eigvalsh(centre.T @ centre / n)[::-1])


def test_deviation_beyond_a_long_is_null(spark):
    rows = [(i, [float(1 << 40) * i, float(i * i)]) for i in range(4)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    assert got["deviation"].isna().all() and got["identity_error"].max() < 1e-6


# Language-model scores
def some_texts(seed=0, n=300):
    rnd = random.Random(seed)
    one, two = [f"Alpha{i}" for i in range(40)], [f"beta{i}é" for i in range(40)]
    texts = []
    for i in range(n):
        words = one if i % 3 else two
        texts.append(" ".join(w for _ in range(rnd.randint(1, 60)) for w in ("the" if i % 3 else "der", rnd.choice(words), rnd.choice(words).upper())))
    return [*enumerate(texts), (n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "never seen once"), (n + 4, "the alpha1 " * 60_000), (n + 5, texts[0]), (5, texts[5]), (None, "the alpha2")]


def base_by_loop(rows):
    fold = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    words = [(i, [*re.findall(r"[^\x20\x09-\x0D]+", fold(t)), None]) for i, t in rows]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    counts = Counter(w for i, ws in words if not out(i) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    return sorted(((i, out(i), len(ws), sum(counts[w] > 0 for w in ws), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in ws), 4)) for i, ws in words), key=str)


@pytest.mark.parametrize("named", [lm.NAMED, 10])
def test_base_scores_against_a_loop(spark, named):
    rows = some_texts()
    df = spark.createDataFrame(rows, DOCS).repartition(4).withColumns({c: F.lit(1) for c in ("row", "raw", "tokens", "rare", "word", "n", "round", "base")})
    got = lm.lm_scores(df, rounds=2, named=named).collect()
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in got), key=str) == base_by_loop(rows)
    unseen = [r for r in got if r["held_out"] and r["n_tokens"] > 1]
    assert all(r["score"] < 0 for r in got) and sum(r["score"] for r in unseen) > sum(r["base_score"] for r in unseen)


def trained(texts, named, rounds=2):
    counts = Counter()
    words = [[w for piece in lm.word_lists(t.encode()) for w in piece] for t in texts]
    for ws in words:
        counts.update(ws)
        counts[lm.END] += 1
    order = sorted(counts, key=lambda w: (w != lm.END, -counts[w], w))
    rest = order[named:]
    totals, types = np.zeros(lm.GROUPS, np.int64), np.zeros(lm.GROUPS, np.int64)
    for w in rest:
        totals[lm.ending_group(w)] += counts[w]
        types[lm.ending_group(w)] += 1
    v = lm.Vocabulary(order[:named], np.array([counts[w] for w in order[:named]]), sum(counts.values()), len(counts), totals, types)
    number = lambda w: v.ids.get(w, len(v.words) + lm.ending_group(w))
    tokens = [np.array([*map(number, ws), 0], np.int32).tobytes() for ws in words]
    weights = lm.Weights.zero()
    for _ in range(rounds):
        g = lm.Gradient()
        for t, lead, _ in lm._token_batches(iter(tokens)):
            g.add(t, v, weights, lead)
        seen = [s.reshape(2, *w.shape) for s, w in zip(g.total(), (weights.classes, weights.members), strict=True)]
        weights = lm.Weights(*[(w + 0.4 * np.log((s[0] + 4.0) / (s[1] + 4.0))).astype(np.float32) for w, s in zip((weights.classes, weights.members), seen, strict=True)])
    return v, weights, counts, rest, tokens


def test_probabilities_sum_to_one():
    texts = [t for _, t in some_texts() if t and len(t) < 10_000]
    v, weights, counts, rest, _ = trained(texts, 40)
    for before in ([], [3], [3, 7], [5, 2, 9, 1]):
        total = 0.0
        for w in range(len(v.words)):
            total += math.exp(lm.forward(np.array([*before, w], np.int32), v, weights)[0][-1])
        for g in range(lm.GROUPS):
            share = math.exp(lm.forward(np.array([*before, len(v.words) + g], np.int32), v, weights)[0][-1])
            total += share * (sum(counts[w] + 1 for w in rest if lm.ending_group(w) == g) + 1)
        assert abs(total - 1) < 1e-4


def test_long_texts_in_pieces_score_as_whole():
    texts = [t for _, t in some_texts() if t]
    v, weights, _, _, tokens = trained(texts, 40, 1)
    scores = lm.text_scores(iter(tokens), v, weights)
    for raw, score in zip(tokens, scores, strict=True):
        whole = lm.forward(np.frombuffer(raw, np.int32), v, weights)[0].sum()
        assert abs(whole - score) < 1e-6 * max(1, abs(whole))


def test_draws_follow_the_powers():
    powers = np.tile(np.array([1, 0, 3, 0, 0, 2, 0, 0, 4, 0, 0, 0, 0, 0, 0, 6], np.float32), (20_000, 1))
    drawn = lm._drawn(powers, np.random.default_rng(0).random(20_000, np.float32))
    share = np.bincount(drawn, minlength=16) / 20_000
    assert np.abs(share - powers[0] / 16).max() < 0.02


def test_rounds_do_not_depend_on_partitions(spark):
    texts = [t for _, t in some_texts() if t]
    v, _, _, _, tokens = trained(texts, 40, 1)
    df = spark.createDataFrame([(t,) for t in tokens], "tokens binary").coalesce(1)
    once, again = (lm.train_round(df, v, lm.Weights.zero(), 1) for _ in range(2))
    assert (once.classes == again.classes).all() and (once.members == again.members).all() and np.abs(once.classes).max() > 0.1


def test_lm_without_anything_to_learn(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    got = lm.lm_scores(spark.createDataFrame([(i, "some words") for i in held], DOCS)).collect()
    assert sorted(tuple(r) for r in got) == [(i, True, 3, 0, 0, 0.0, 0.0) for i in held]
    assert lm.lm_scores(spark.createDataFrame([], DOCS)).count() == 0
