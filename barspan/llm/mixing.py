"""Mixing to target weights: token weights raked to several marginals, then documents sampled by calibrated rates."""

from __future__ import annotations

import warnings
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barspan.llm.common import materialize, word_array

DIMENSIONS = ("source", "lang", "topic")

# The first topic of which a text holds a mark; others are prose.
TOPIC_MARKS = {
    "table": (" | ",),
    "legal": ("Licensed under", "SPDX-License-Identifier", "All rights reserved", "Permission is hereby granted"),
    "code": ("```", "#include", "def ", "function ", "();"),
    "contact": ("@",),
}


def word_count(text: Column) -> Column:
    """Words of the text, the token weight where no count by a tokenizer is at hand."""
    return F.size(word_array(text)).cast("long")


def topic_of(text: Column, marks: dict[str, tuple[str, ...]] = TOPIC_MARKS) -> Column:
    body = F.coalesce(text, F.lit(""))
    return F.coalesce(*[F.when(reduce(lambda a, b: a | b, [body.contains(m) for m in held]), topic) for topic, held in marks.items()], F.lit("prose"))


def tempered_targets(cells: DataFrame, dimension: str, power: float) -> DataFrame:
    """Target shares (value, share) in proportion to each value's tokens to a power: below 1 favours rare values."""
    sums = cells.groupBy(F.col(dimension).alias("value")).agg(F.sum("tokens").cast("double").alias("tokens")).filter("tokens > 0")
    powered = sums.select("value", F.pow("tokens", F.lit(power)).alias("p"))
    total = powered.agg(F.sum("p").alias("all"))
    # One row, the sum over one dimension's values.
    return powered.join(F.broadcast(total)).select("value", (F.col("p") / F.col("all")).alias("share"))


def attainable(target: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """Shares that sum to 1, in proportion to target but none above its limit; limits sum to 1 at least."""
    out, free = np.zeros(len(target)), target > 0
    if limit[free].sum() < 1:  # what the values with a target can't fill is left unfilled
        return np.where(free, limit, 0.0)
    while free.any():
        scaled = target * (1 - out[~free].sum()) / target[free].sum()
        over = free & (scaled >= limit)
        if not over.any():
            return np.where(free, scaled, out)
        out[over], free = limit[over], free & ~over
    return out


def _warn(sweeps: int, worst: float) -> None:
    warnings.warn(f"raking stopped after {sweeps} sweeps: a sum was off by {worst:.3g} of its share", stacklevel=3)


def rake_cells(tokens: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], keep: float, max_sweeps: int = 500, tolerance: float = 1e-6) -> np.ndarray:
    """Weights of cells whose sums match every target, none above its tokens' share over `keep`; see rake."""
    share = tokens / max(1.0, tokens.sum())
    most, weight = share / keep if keep else np.full(len(share), np.inf), share.copy()
    aims = [attainable(t, np.bincount(c, most, len(t)) if len(c) else t) for c, t in zip(codes, targets, strict=True)]
    worst = 0.0
    for _ in range(max_sweeps):
        for c, aim in zip(codes, aims, strict=True):
            sums = np.bincount(c, weight, len(aim))
            weight = np.minimum(weight * np.divide(aim, sums, out=np.zeros(len(aim)), where=sums > 0)[c], most)
        off = [np.abs(np.bincount(c, weight, len(a)) - a) / np.where(a > 0, a, 1.0) for c, a in zip(codes, aims, strict=True)]
        worst = max((float(x.max()) for x in off if len(x)), default=0.0)
        if worst <= tolerance:
            return weight
    _warn(max_sweeps, worst)
    return weight


def _rake_wide(cells: DataFrame, targets: dict[str, DataFrame], keep: float, max_sweeps: int, tolerance: float) -> DataFrame:
    """rake for more cells than the driver should hold: a join and an aggregate for each dimension and sweep."""
    total = cells.agg(F.sum("tokens")).first()[0] or 1
    fitted = cells.withColumn("weight", F.col("tokens") / F.lit(float(total))).withColumn("most", F.col("weight") / keep if keep else F.lit(float("inf")))
    aims = {}
    for d, target in targets.items():
        limits = cells.groupBy(F.col(d).alias("value")).agg((F.sum("tokens") / F.lit(float(total * keep)) if keep else F.max(F.lit(float("inf")))).alias("limit"))
        aim = materialize(limits.join(target, "value", "left").select("value", "limit", F.coalesce("share", F.lit(0.0)).alias("share"), F.lit(False).alias("full")), "aims")
        while True:  # the same filling as in attainable()
            full, free = (aim.filter(F.col("full") == x).agg(F.coalesce(F.sum("limit"), F.lit(0.0)), F.coalesce(F.sum("share"), F.lit(0.0))).first() for x in (True, False))
            scale = (1 - full[0]) / free[1] if free[1] > 0 else 0.0
            over = ~F.col("full") & (F.col("share") > 0) & (F.col("share") * scale >= F.col("limit"))
            if aim.filter(over).isEmpty():
                break
            aim = materialize(aim.withColumn("full", F.col("full") | over), "aims")
        aims[d] = materialize(aim.select(F.col("value").alias(d), F.when(F.col("full"), F.col("limit")).otherwise(F.col("share") * scale).alias("_aim")), "aims")
    worst = 0.0
    for _ in range(max_sweeps):
        for d, aim in aims.items():
            scale = fitted.groupBy(d).agg(F.sum("weight").alias("_sum")).join(aim, d).select(d, F.coalesce(F.try_divide("_aim", "_sum"), F.lit(0.0)).alias("_scale"))
            fitted = fitted.join(scale, d).withColumn("weight", F.least(F.col("weight") * F.col("_scale"), "most")).drop("_scale")
        fitted = materialize(fitted, "raked")
        off = [fitted.groupBy(d).agg(F.sum("weight").alias("_sum")).join(aim, d).agg(F.max(F.abs(F.col("_sum") - F.col("_aim")) / F.when(F.col("_aim") > 0, F.col("_aim")).otherwise(1.0))).first()[0] for d, aim in aims.items()]
        worst = max((x or 0.0 for x in off), default=0.0)
        if worst <= tolerance:
            return fitted.drop("most")
    _warn(max_sweeps, worst)
    return fitted.drop("most")


def rake(cells: DataFrame, targets: dict[str, DataFrame], keep: float = 0.0, max_sweeps: int = 500, tolerance: float = 1e-6, driver_cells: int = 100_000) -> DataFrame:
    """Iterative proportional fitting: cells with a column weight whose sums match every target.

    cells: one row for each combination of the dimensions, with its tokens. Each sweep scales the weights to one dimension
    after the other and cuts each at the cell's share of all tokens over `keep`, which is as much as a sample of that part of
    the tokens can hold of it (0: no cut). Targets are cut in the same way before, and what is cut goes to the other values in
    proportion. Sweeps end when no sum is off by more than tolerance times its share; a warning says when max_sweeps don't
    reach that. Values without a target get weight 0, as do cells without tokens.
    Up to driver_cells cells are fitted on the driver, more by joins and aggregates; both follow the same steps.
    """
    spark = cells.sparkSession
    rows = cells.limit(driver_cells + 1).collect()  # bounded
    if len(rows) > driver_cells:
        return _rake_wide(cells, targets, keep, max_sweeps, tolerance)
    codes, aims = [], []
    for d, target in targets.items():
        values = sorted({r[d] for r in rows})
        at = {v: i for i, v in enumerate(values)}
        # No more rows than values of cells.
        wanted = target.join(F.broadcast(spark.createDataFrame([(v,) for v in values], "value string")), "value", "left_semi").collect() if values else []
        aims.append(np.zeros(len(values)))
        for r in wanted:
            aims[-1][at[r["value"]]] += r["share"] or 0.0
        codes.append(np.array([at[r[d]] for r in rows], np.int64))
    weight = rake_cells(np.array([float(r["tokens"] or 0) for r in rows]), codes, aims, keep, max_sweeps, tolerance)
    schema = type(cells.schema)(list(cells.schema.fields)).add("weight", "double")
    return spark.createDataFrame([(*r, float(w)) for r, w in zip(rows, weight, strict=True)], schema)


def _keys(docs: DataFrame, topic: Column | None) -> dict[str, Column]:
    empty = F.lit("")
    return {
        "source": F.coalesce(docs["source"].cast("string"), empty),
        "lang": F.coalesce(docs["lang"].cast("string"), empty),
        "topic": F.coalesce(topic if topic is not None else topic_of(docs["text"]), empty),
    }


def _uniform(doc_id: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(seed)), F.lit(1 << 52)) / float(1 << 52)


def mixing_rates(docs: DataFrame, targets: dict[str, DataFrame] | None = None, power: float = 0.9, keep: float = 0.7, tokens: Column | None = None, topic: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, rates): doc_id, source, lang, topic and n_tokens of every row; the rate of every (source, lang, topic).

    See mix. Texts are read once; what is written are ids, counts and cells.
    """
    named = [c.alias(k) for k, c in _keys(docs, topic).items()]
    counted = docs.select(docs["doc_id"].cast("long").alias("doc_id"), *named, (tokens if tokens is not None else word_count(docs["text"])).cast("long").alias("n_tokens"))
    rows = materialize(counted, "weights")
    cells = materialize(rows.groupBy(*DIMENSIONS).agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")), "cells")
    raked = rake(cells, targets or {d: tempered_targets(cells, d, power) for d in DIMENSIONS}, keep)
    total = float(cells.agg(F.sum("tokens")).first()[0] or 1)
    rate = F.round(F.least(F.coalesce(F.try_divide(F.col("weight") * F.lit(keep * total), F.col("tokens").cast("double")), F.lit(0.0)), F.lit(1.0)), 9)
    return rows, materialize(raked.select(*DIMENSIONS, rate.alias("rate")), "rates")


def mixing_sample(rows: DataFrame, rates: DataFrame, seed: int = 7) -> DataFrame:
    """The rows of mixing_rates with their rate and whether the sample keeps them."""
    return rows.join(rates, list(DIMENSIONS)).select(*rows.columns, "rate", (_uniform(F.col("doc_id"), seed) < F.col("rate")).alias("kept"))


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, power: float = 0.9, keep: float = 0.7, seed: int = 7, tokens: Column | None = None, topic: Column | None = None) -> DataFrame:
    """A sample of the documents whose tokens follow target shares of source, lang and topic, with all columns of docs.

    targets: dimension -> (value, share); by default tempered_targets of the data with the given power. tokens: the weight
    of a row, such as a column with a tokenizer's counts; by default its words. Token weights of the cells (source, lang,
    topic) are raked to the targets. A cell's rate is such that the sample holds the part `keep` of all tokens, whatever
    their number; no rate is above 1, as rake sees to it. A row is kept if a uniform hash of its doc_id and the seed is
    below its cell's rate.
    Null source, lang and topic are values of their own ('' is taken for them); null and empty texts have no tokens and
    weigh nothing in their cell's rate, which decides on them all the same; a cell without tokens has rate 0.
    Rows that repeat a doc_id within a cell are kept or left together; rows without doc_id are decided by the hash of null.
    An empty table gives an empty table. Only doc_id, source, lang and text are read, and no column is added, so that no
    name can clash. Cells are aggregated with map-side combine; rates are joined by equality of cells, so a hot source is
    split by adaptive execution, or its cells are broadcast where Spark finds them small.
    """
    _, rates = mixing_rates(docs, targets, power, keep, tokens, topic)
    same = reduce(lambda a, b: a & b, [key == rates[d] for d, key in _keys(docs, topic).items()])
    return docs.join(rates, same & (_uniform(docs["doc_id"].cast("long"), seed) < rates["rate"]), "left_semi")
