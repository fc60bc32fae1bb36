"""Conversation structure repair: least edits to well-formed turns by bidirectional Dijkstra over the edit lattice."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barspan.llm.common import BLANKS, materialize

# What edits cost, and the states of (s?(ua)+)?: nothing yet, after s, after u, after a.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTED = (START, ASSISTANT)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that an inserted or renamed turn takes in each state, and where it leads.
WANTED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
NEXT = {q: STEP[q, r[0]] for q, r in WANTED.items()}
#: Rows of one search. Longer conversations are cut into segments that are searched apart, from each state to each state.
SEGMENT = 1024


def symbol(initial: Column, fault: Column) -> Column:
    """One letter for what the lattice needs of a row: s, u, a or o for other initials, x where it must go, capital if truncated."""
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(fault.isin("blank", "duplicate"), "x").when(fault == "truncated", F.upper(known)).otherwise(known)


def _forward(symbols: str, i: int, q: int, end: bool) -> Iterator[tuple[int, int, int, str]]:
    """Edges (layer, state, cost, edit) out of state q before row i; turns are put in behind the last row only at a conversation's end."""
    n = len(symbols)
    if i < n or end:
        yield i, NEXT[q], INSERT, "I"
    if i < n:
        c = symbols[i]
        yield i + 1, q, DELETE, "D"
        if c != "x":
            extra = TRUNCATED if c.isupper() else 0
            if (q, c.lower()) in STEP:
                yield i + 1, STEP[q, c.lower()], KEEP + extra, "K"
            yield i + 1, NEXT[q], REROLE + extra, "R"


def _backward(symbols: str, i: int, q: int, end: bool) -> Iterator[tuple[int, int, int, str]]:
    """Edges into state q before row i, as (layer, state) that they come from."""
    if i < len(symbols) or end:
        yield from ((i, p, INSERT, "I") for p in NEXT if NEXT[p] == q)
    if i:
        c = symbols[i - 1]
        yield i - 1, q, DELETE, "D"
        if c != "x":
            extra = TRUNCATED if c.isupper() else 0
            yield from ((i - 1, p, KEEP + extra, "K") for p in NEXT if STEP.get((p, c.lower())) == q)
            yield from ((i - 1, p, REROLE + extra, "R") for p in NEXT if NEXT[p] == q)


class _Side:
    """One of the two searches: tentative and settled costs by node (4 * layer + state)."""

    def __init__(self, starts: list[int], edges):
        self.cost = dict.fromkeys(starts, 0)
        self.settled: set[int] = set()
        self.heap = [(0, s) for s in starts]
        self.edges = edges

    def top(self) -> int | None:
        while self.heap and self.heap[0][1] in self.settled:
            heappop(self.heap)
        return self.heap[0][0] if self.heap else None

    def settle(self, other: _Side, best: int | None) -> int | None:
        """Settle the nearest node; the length of the shortest way that is known through it or one of its edges."""
        cost, node = heappop(self.heap)
        self.settled.add(node)
        for i, q, step, _ in self.edges(node >> 2, node & 3):
            to, through = 4 * i + q, cost + step
            if through < self.cost.get(to, through + 1):
                self.cost[to] = through
                heappush(self.heap, (through, to))
            if to in other.cost and (best is None or through + other.cost[to] < best):
                best = through + other.cost[to]
        return best


def search(symbols: str, entry: int = START, exits: tuple[int, ...] = ACCEPTED, end: bool = True) -> tuple[int, str] | None:
    """The least cost of leading `entry` through all rows to one of `exits`, and the least audit (by ASCII) at that cost.

    A forward search from the entry and a reverse one from the exits settle nodes in turn, the nearer first. They go on
    while a way of the same cost as the best may be open, so that all crossings of that cost are found. From the crossings
    the tight edges of both sides are all ways of that cost. An audit names one way (each state has one wanted role), none
    is a prefix of another, and so the least letter at each node gives the least of the concatenated audits.
    """
    n = len(symbols)
    ahead = _Side([entry], lambda i, q: _forward(symbols, i, q, end))
    behind = _Side([4 * n + q for q in exits], lambda i, q: _backward(symbols, i, q, end))
    best = min((ahead.cost[x] + behind.cost[x] for x in ahead.cost.keys() & behind.cost.keys()), default=None)
    while (a := ahead.top()) is not None and (b := behind.top()) is not None and (best is None or a + b <= best):
        best = ahead.settle(behind, best) if a <= b else behind.settle(ahead, best)
    if best is None:
        return None
    # A node on a way of the best cost is settled by one side at least. Where the reverse cost of an edge's end makes up the
    # best, the edge is a crossing or lies behind one; else its end must be a forward node from which tight edges lead on.
    leads_on: set[int] = set()

    def open_edges(x: int, cost: int) -> list[tuple[str, int, int]]:
        out = []
        for i, q, step, edit in _forward(symbols, x >> 2, x & 3, end):
            to, through = 4 * i + q, cost + step
            if through + behind.cost.get(to, best + 1) == best or (to in leads_on and ahead.cost[to] == through):
                out.append((edit, to, through))
        return out

    # By cost and layer every tight edge comes after its start.
    for x in sorted(ahead.settled, key=lambda x: (ahead.cost[x], x >> 2), reverse=True):
        if ahead.cost[x] + behind.cost.get(x, best + 1) == best or open_edges(x, ahead.cost[x]):
            leads_on.add(x)
    audit, x, cost, goals = [], entry, 0, {4 * n + q for q in exits}
    while x not in goals or cost < best:
        edit, x, cost = min(open_edges(x, cost))
        audit.append(edit)
    return best, "".join(audit)


_SEARCHED = pa.schema([("key", pa.string()), ("segment", pa.int64()), ("last", pa.bool_()), ("entry", pa.int32()), ("exit", pa.int32()), ("cost", pa.int64()), ("place", pa.int32()), ("audit", pa.string())])


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs and audits of a segment for each entry and exit; `place` orders the audits of one entry."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            exits = [ACCEPTED] if r["last"] else [(q,) for q in range(4)]
            for entry in (START,) if r["segment"] == 0 else range(4):
                found = [(x[0], *s) for x in exits if (s := search(r["symbols"], entry, x, r["last"])) is not None]
                order = sorted(audit for _, _, audit in found)
                out += [dict(zip(_SEARCHED.names, (r["key"], r["segment"], r["last"], entry, x, cost, order.index(audit), audit), strict=True)) for x, cost, audit in found]
        yield pa.RecordBatch.from_pylist(out, schema=_SEARCHED)


def _join_segments(pdf: pd.DataFrame) -> pd.DataFrame:
    """Entry and exit of each segment on the least way through a conversation: costs from the end, then least audits from the start."""
    ways: dict[int, dict[int, list[tuple[int, int, int]]]] = {}
    for r in pdf.itertuples(index=False):
        ways.setdefault(r.segment, {}).setdefault(r.entry, []).append((r.place, r.exit, r.cost))
    last = max(ways)
    rest = {last + 1: dict.fromkeys(range(4), 0)}
    for s in range(last, -1, -1):
        totals = {e: [cost + rest[s + 1][x] for _, x, cost in w if x in rest[s + 1]] for e, w in ways[s].items()}
        rest[s] = {e: min(t) for e, t in totals.items() if t}
    out, at = [], START
    for s in range(last + 1):
        _, leads = min((place, x) for place, x, cost in ways[s][at] if x in rest[s + 1] and cost + rest[s + 1][x] == rest[s][at])
        out.append((pdf["key"].iloc[0], s, at, leads, rest[0][START]))
        at = leads
    return pd.DataFrame(out, columns=["key", "segment", "entry", "exit", "total"])


def _turns(conversations: DataFrame, place: str | None) -> DataFrame:
    """(key, turn, place, role, text): nulls of id, role and text are one space; place orders rows of one turn."""
    blank = F.lit(" ")
    role, text = F.coalesce(F.col("role"), blank), F.coalesce(F.col("text"), blank)
    tie = F.col(place) if place else _digest(role, text)
    return conversations.select(F.coalesce(F.col("conv_id").cast("string"), blank).alias("key"), F.col("turn").cast("long").alias("turn"), tie.alias("place"), role.alias("role"), text.alias("text"))


def _digest(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def row_faults(turns: DataFrame) -> DataFrame:
    """(key, pos, turn, initial, fault, is_new_turn, is_illegal, is_last): what is wrong with each row; texts stay behind as digests."""
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    cut = ~F.substring(bare, -1, 1).isin(".", "!", "?")
    slim = turns.select("key", "turn", "place", F.substring("role", 1, 1).alias("initial"), _digest(F.col("role"), F.col("text")).alias("digest"), (bare == "").alias("blank"), cut.alias("cut"))
    w = Window.partitionBy("key").orderBy("turn", "place")
    before, same = F.lag("turn").over(w), F.lag("initial").over(w)
    placed = slim.withColumns({
        "pos": F.row_number().over(w).cast("long") - 1,
        "is_new_turn": F.col("turn").isNotNull() & (before.isNull() | (before != F.col("turn"))),
        "is_illegal": F.coalesce(~F.concat(same, F.col("initial")).isin("su", "ua", "au"), F.lit(False)),
        "is_last": F.lead("initial").over(w).isNull(),
    })
    again = F.row_number().over(Window.partitionBy("key", "digest").orderBy("pos")) > 1
    fault = F.when(F.col("blank"), "blank").when(again, "duplicate").when(F.col("cut"), "truncated")
    return placed.withColumn("fault", fault).select("key", "pos", "turn", "initial", "fault", "is_new_turn", "is_illegal", "is_last")


def repair_plans(faults: DataFrame) -> DataFrame:
    """(key, cost, audit) of each conversation: one search where it fits in a segment, else its segments are joined by their costs."""
    cut = faults.select("key", "pos", F.floor(F.col("pos") / SEGMENT).alias("segment"), symbol(F.col("initial"), F.col("fault")).alias("c"), "is_last")
    letters = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "c"))), lambda x: x["c"]), "")
    # A fixed number of tasks: letters are few bytes, but each costs a search, so that sizes say little of the work.
    tasks = int(faults.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    segments = cut.repartition(tasks, "key", "segment").groupBy("key", "segment").agg(letters.alias("symbols"), F.max("is_last").alias("last"))
    found = materialize(segments.mapInArrow(_searched, "key string, segment long, last boolean, entry int, exit int, cost long, place int, audit string"), "repair-segments")
    whole = found.filter("segment = 0 and last").select("key", "cost", "audit")
    parts = found.filter("not (segment = 0 and last)")
    chosen = parts.select("key", "segment", "entry", "exit", "cost", "place").groupBy("key").applyInPandas(_join_segments, "key string, segment long, entry int, exit int, total long")
    pieces = parts.join(chosen, ["key", "segment", "entry", "exit"])
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("segment", "audit"))), lambda x: x["audit"]), "")
    return whole.unionByName(pieces.groupBy("key").agg(F.first("total").alias("cost"), joined.alias("audit")))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str, str]]]]:
    """Plans in turn, each with the turns (role, text, edit) that its audit makes of the rows behind it; only one row is held.

    Rows come by conversation, the plan first. Each plan's turns must be used up before the next plan is asked for.
    """
    rows = (r for batch in batches for at in range(0, batch.num_rows, 256) for r in batch.slice(at, 256).to_pylist())
    held = [next(rows, None)]

    def turns(key: str, audit: str) -> Iterator[tuple[str, str, str]]:
        q = START
        for edit in audit:
            if edit == "I":
                yield WANTED[q], "", edit
                q = NEXT[q]
                continue
            role, text = held[0]["role"], held[0]["text"]
            held[0] = next(rows, None)
            if edit == "D":
                continue
            role = role if edit == "K" else WANTED[q]
            q = STEP[q, role[0]]
            yield role, text, edit

    while held[0] is not None:
        plan = held[0]
        held[0] = next(rows, None)
        yield plan, turns(plan["key"], plan["audit"])


_REPORT = "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["key", *_COUNTS, "audit", "repaired_sha256", "repaired_turns"]
    kinds = [pa.string(), *[pa.int64()] * len(_COUNTS), pa.string(), pa.string(), pa.int64()]
    schema, out = pa.schema(list(zip(names, kinds, strict=True))), []
    for plan, turns in _edited(batches):
        sha, n = hashlib.sha256(), 0
        for role, text, _ in turns:
            sha.update((("\n" if n else "") + f"{role}:{text}").encode())
            n += 1
        out.append({**{k: plan[k] for k in ("key", *_COUNTS, "audit")}, "repaired_sha256": sha.hexdigest(), "repaired_turns": n})
        if len(out) == 1000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    yield pa.RecordBatch.from_pylist(out, schema=schema)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
    out = []
    for plan, turns in _edited(batches):
        for n, (role, text, edit) in enumerate(turns):
            out.append({"key": plan["key"], "turn": n, "role": role, "text": text, "edit": edit})
            if len(out) == 1000:
                yield pa.RecordBatch.from_pylist(out, schema=schema)
                out = []
    yield pa.RecordBatch.from_pylist(out, schema=schema)


def _reports(turns: DataFrame) -> DataFrame:
    """One row of counts, cost and audit for each conversation."""
    faults = row_faults(turns)
    of = lambda name: F.count(F.when(F.col("fault") == name, 1)).alias(name)
    span = F.try_subtract(F.max("turn"), F.min("turn"))
    gaps = F.coalesce(F.try_subtract(F.try_add(span, F.lit(1)), F.count(F.when(F.col("is_new_turn"), 1))), F.when(F.max("turn").isNull(), F.lit(0)))
    counts = faults.groupBy("key").agg(gaps.cast("long").alias("gaps"), of("blank"), of("duplicate"), of("truncated"), F.count(F.when(F.col("is_illegal"), 1)).alias("illegal"))
    return counts.join(repair_plans(faults), "key")


def _streamed(turns: DataFrame, reports: DataFrame) -> DataFrame:
    """Plans and texts by conversation, each plan before its rows, which are in order."""
    empty = lambda df, names: [F.lit(None).cast(df.schema[n].dataType).alias(n) for n in names]
    plans = reports.select("key", F.lit(0).alias("kind"), *empty(turns, ("turn", "place", "role", "text")), *_COUNTS, "audit")
    rows = turns.select("key", F.lit(1).alias("kind"), "turn", "place", "role", "text", *empty(reports, (*_COUNTS, "audit")))
    return rows.unionByName(plans).repartition("key").sortWithinPartitions("key", "kind", "turn", "place").select("key", "role", "text", *_COUNTS, "audit")


def _id(like: DataFrame) -> Column:
    return F.when(F.col("key") != " ", F.col("key")).cast(like.schema["conv_id"].dataType).alias("conv_id")


def repair_report(conversations: DataFrame, place: str | None = None) -> DataFrame:
    """What is wrong with the turns of each conversation, and the least edits that make them well-formed.

    conversations: conv_id, turn, role, text; further columns are ignored. Turns are in the order of `turn` (nulls first), ties
    by the column that `place` names, else by a digest of role and text. Well-formed are no turns, or roles with initials
    s?(ua)+. A row's first fault counts: blank (no character but blanks), duplicate (role and text of an earlier row),
    truncated (the last character that isn't blank is not one of .!?). Keep costs 0, Rerole to user or assistant 2, Delete 3
    (required for blank and duplicate rows), Insert of an empty user or assistant turn 2; truncated rows that stay add 1.
    Null ids, roles and texts are one space each, so rows without an id are one conversation, whose conv_id comes back as null;
    gaps beyond the range of a long are null. An empty table gives an empty one.
    Windows and sorts stream a conversation's rows; only letters for each row, never texts, come together, in segments of
    1024 rows that tasks search apart. A long conversation then needs its segments' costs in one place (at most 16 small
    rows a segment) and its audit, which is a part of the result.
    Result: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of the repaired role:text, joined
    by line ends), repaired_turns.
    """
    turns = _turns(conversations, place)
    made = _streamed(turns, _reports(turns)).mapInArrow(_reported, f"{_REPORT}, repaired_sha256 string, repaired_turns long")
    return made.select(_id(conversations), *[c for c in made.columns if c != "key"])


def repaired_conversations(conversations: DataFrame, place: str | None = None) -> DataFrame:
    """The repaired rows (conv_id, turn from 0, role, text, edit: K, R or I); rules and odd cases as for repair_report."""
    turns = _turns(conversations, place)
    made = _streamed(turns, _reports(turns)).mapInArrow(_told, "key string, turn long, role string, text string, edit string")
    return made.select(_id(conversations), "turn", "role", "text", "edit")


def damage(conversations: DataFrame) -> DataFrame:
    """Conversations with planted faults, as crc32 of "conv_id:turn" (a null: one space) modulo 20 says.

    0 drops a row, 1 empties its text, 2 takes its .!? away, 3 repeats it behind itself, 4 makes it the user's; other rows
    stay. `place` orders rows of one turn: by what they were, then copies.
    """
    blank = F.lit(" ")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"))
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    coded = rows.withColumn("code", F.crc32(key.cast("binary")) % 20).filter("code <> 0")
    was = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    copies = coded.withColumn("copy", F.explode(F.when(F.col("code") == 3, F.array(F.lit("0"), F.lit("1"))).otherwise(F.array(F.lit("0")))))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return copies.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.concat(was, F.col("copy")).alias("place"))
