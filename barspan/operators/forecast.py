"""Walk-forward folds, splits, standardisers, scoring and forecast metrics."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Predictor(Protocol):
    """What score_windows needs of a model: batches of windows (n, steps, features) to n predictions."""

    def predict(self, x: np.ndarray) -> np.ndarray: ...


def sigma_gate(forecasts: DataFrame, limit: float | None) -> DataFrame:
    """Forecasts whose sigma is within the limit or unknown; all of them without a limit."""
    return forecasts if limit is None else forecasts.filter(F.col("sigma").isNull() | (F.col("sigma") <= limit))


def walk_forward_folds(spark: SparkSession, start: str, end: str, retrain_days: int) -> DataFrame:
    """(fold, anchor, fold_end): anchors every retrain_days; a fold's test part is [anchor, fold_end)."""
    s = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz") - F.expr("INTERVAL 1 SECOND"), F.expr(f"INTERVAL {retrain_days} DAY"))).alias("anchor"))
    ends = F.least(F.col("anchor") + F.expr(f"INTERVAL {retrain_days} DAY"), F.lit(end).cast("timestamp_ntz"))
    return s.select((F.row_number().over(Window.orderBy("anchor")) - 1).alias("fold"), "anchor", ends.alias("fold_end"))


def assign_folds(rows: DataFrame, folds: DataFrame, ts: str = "target_ts", least_train: int = 1) -> DataFrame:
    """Rows with fold and part: train before the anchor, test from it on; folds with too few training rows go.

    Folds are a table of dates, one for each retraining, and are broadcast for the range join.
    """
    f = F.broadcast(folds)
    train = rows.join(f, F.col(ts) < F.col("anchor")).withColumn("part", F.lit("train"))
    test = rows.join(f, (F.col(ts) >= F.col("anchor")) & (F.col(ts) < F.col("fold_end"))).withColumn("part", F.lit("test"))
    enough = train.groupBy("symbol", "fold").agg(F.count("*").alias("_n")).filter(F.col("_n") >= least_train).select("symbol", "fold")
    return train.unionByName(test).join(enough, ["symbol", "fold"], "left_semi")


def validation_split(train: DataFrame, fraction: float = 0.2, ts: str = "target_ts") -> DataFrame:
    """The last fraction of each fold's training rows, one at least, as validation."""
    w = Window.partitionBy("symbol", "fold").orderBy(F.desc(ts))
    n = F.count("*").over(Window.partitionBy("symbol", "fold"))
    return train.withColumn("is_val", F.row_number().over(w) <= F.greatest(F.lit(1), F.floor(n * fraction)))


def fit_standardizer(sequences: DataFrame) -> DataFrame:
    """(symbol, fold, feature, mean, std) over samples and steps, with the target as feature -1; a deviation of 0 becomes 1."""
    steps = sequences.select("symbol", "fold", F.explode("x").alias("row")).select("symbol", "fold", F.posexplode("row").alias("feature", "v"))
    both = steps.unionByName(sequences.select("symbol", "fold", F.lit(-1).alias("feature"), F.col("y").alias("v")))
    s = both.groupBy("symbol", "fold", "feature").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    return s.withColumn("std", F.when(F.col("std") > 0, F.col("std")).otherwise(1.0))


def standardize(sequences: DataFrame, standardizer: DataFrame) -> DataFrame:
    """Windows and targets in units of their fold's standardizer; y_mean and y_std turn predictions back."""
    stats = standardizer.filter("feature >= 0").groupBy("symbol", "fold").agg(F.sort_array(F.collect_list(F.struct("feature", "mean", "std"))).alias("_s"))
    target = standardizer.filter("feature = -1").select("symbol", "fold", F.col("mean").alias("y_mean"), F.col("std").alias("y_std"))
    rows = sequences.join(stats, ["symbol", "fold"]).join(target, ["symbol", "fold"])
    x = F.transform("x", lambda row: F.zip_with(row, F.col("_s"), lambda v, s: (v - s["mean"]) / s["std"]))
    return rows.withColumn("x", x).withColumn("y", (F.col("y") - F.col("y_mean")) / F.col("y_std")).drop("_s")


def fit_linear(rows: DataFrame, features: list[str], target: str, folds: DataFrame, ts: str = "target_ts") -> DataFrame:
    """(symbol, fold, n, intercept, coefficients): least squares over all rows before each fold's anchor.

    Rows are read once: each adds to the sums of products (the Gram matrix of 1, features and target) of the first fold that
    trains on it, and sums are carried on from fold to fold. What is solved is one small system a symbol and fold, by
    pseudo-inverse of the centred matrix, so that features that don't vary get 0. Rows with a null in any column don't
    count; folds without rows have no model. Folds are a table of dates and are broadcast.
    """
    columns = [F.lit(1.0), *[F.col(c).cast("double") for c in [*features, target]]]
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    earlier = F.lag("anchor", 1, "0001-01-01").over(Window.orderBy("anchor"))  # one row a fold
    spans = F.broadcast(folds.select("fold", "anchor", earlier.alias("_after")))
    entered = rows.dropna(subset=[*features, target, ts]).join(spans, (F.col(ts) < F.col("anchor")) & (F.col(ts) >= F.col("_after")))
    parts = entered.groupBy("symbol", "fold").agg(*[F.sum(columns[i] * columns[j]).alias(f"_{i}_{j}") for i, j in pairs])
    # Every fold from a symbol's first on, also those that no row enters.
    every = parts.groupBy("symbol").agg(F.min("fold").alias("_from")).join(F.broadcast(folds.select("fold")), F.col("fold") >= F.col("_from")).select("symbol", "fold")
    so_far = Window.partitionBy("symbol").orderBy("fold").rowsBetween(Window.unboundedPreceding, 0)
    grams = every.join(parts, ["symbol", "fold"], "left").select("symbol", "fold", F.array(*[F.sum(f"_{i}_{j}").over(so_far) for i, j in pairs]).alias("gram"))

    k = len(columns)

    def solve(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            found = []
            for gram in pdf["gram"]:
                g = np.zeros((k, k))
                for (i, j), v in zip(pairs, gram, strict=True):
                    g[i, j] = g[j, i] = v
                n, mean = g[0, 0], g[0, 1:] / g[0, 0]
                s = g[1:, 1:] - n * np.outer(mean, mean)
                beta = np.linalg.pinv(s[:-1, :-1], hermitian=True) @ s[:-1, -1]
                found.append((int(n), float(mean[-1] - mean[:-1] @ beta), beta.tolist()))
            n, intercept, beta = zip(*found, strict=True) if found else ((), (), ())
            yield pdf[["symbol", "fold"]].assign(n=list(n), intercept=list(intercept), coefficients=list(beta))

    return grams.mapInPandas(solve, "symbol string, fold int, n long, intercept double, coefficients array<double>")


def predict_linear(rows: DataFrame, models: DataFrame, features: list[str]) -> DataFrame:
    """rows (symbol, fold and features) with y_pred by the model of their symbol and fold; null where there is none."""
    terms = [F.col("coefficients")[i] * F.col(c) for i, c in enumerate(features)]
    return rows.join(models.drop("n"), ["symbol", "fold"], "left").withColumn("y_pred", sum(terms, F.col("intercept"))).drop("intercept", "coefficients")


_STANDARDIZER = "struct<feature_mean: array<double>, feature_std: array<double>, target_mean: double, target_std: double>"


def standardizer_to_json(standardizer: DataFrame) -> DataFrame:
    """(symbol, fold, payload): one JSON object for each fold, features in order."""
    features = F.sort_array(F.collect_list(F.when(F.col("feature") >= 0, F.struct("feature", "mean", "std"))))
    target = lambda c: F.max(F.when(F.col("feature") == -1, F.col(c)))
    s = standardizer.groupBy("symbol", "fold").agg(features.alias("f"), target("mean").alias("target_mean"), target("std").alias("target_std"))
    return s.select("symbol", "fold", F.to_json(F.struct(F.col("f.mean").alias("feature_mean"), F.col("f.std").alias("feature_std"), "target_mean", "target_std")).alias("payload"))


def standardizer_from_json(payloads: DataFrame) -> DataFrame:
    """The standardizer (symbol, fold, feature, mean, std) that standardizer_to_json was given."""
    p = payloads.select("symbol", "fold", F.from_json("payload", _STANDARDIZER).alias("p"))
    features = p.select("symbol", "fold", F.posexplode(F.arrays_zip("p.feature_mean", "p.feature_std")).alias("feature", "v"))
    target = p.select("symbol", "fold", F.lit(-1).alias("feature"), F.col("p.target_mean").alias("mean"), F.col("p.target_std").alias("std"))
    return features.select("symbol", "fold", "feature", F.col("v.feature_mean").alias("mean"), F.col("v.feature_std").alias("std")).unionByName(target)


def prediction_table(scored: DataFrame, train: DataFrame, folds: DataFrame, model_root: str) -> DataFrame:
    """Scores with the lineage of their fold: the span it was trained on, the span it predicts, the folder of its model.

    Sorted by time. Folds are a table of dates and are broadcast; spans of training are one row for each symbol and fold.
    """
    spans = train.groupBy("symbol", "fold").agg(F.min("target_ts").alias("train_start"), F.max("target_ts").alias("train_end"))
    rows = scored.join(spans, ["symbol", "fold"]).join(F.broadcast(folds), "fold")
    folder = F.concat(F.lit(model_root + "/"), "symbol", F.format_string("/step_%03d", F.col("fold")))
    return rows.select(
        F.col("target_ts").alias("ts"), "symbol", "y_pred_logret", "y_pred_std", "y_true_logret", F.col("fold").alias("step"), "train_start", "train_end",
        F.col("anchor").alias("pred_start"), F.col("fold_end").alias("pred_end"), folder.alias("model_dir"),
    ).orderBy("ts", "symbol")


def score_windows(sequences: DataFrame, models: dict[str, Predictor]) -> DataFrame:
    """(symbol, fold, target_ts, y_pred_std, y_pred_logret, y_true_logret) of standardised windows, in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pdf[["symbol", "fold", "target_ts"]].copy()
            pred = np.full(len(pdf), np.nan)
            for symbol, at in pdf.groupby("symbol").indices.items():
                if symbol in models:
                    pred[at] = models[symbol].predict(np.stack([np.stack(x) for x in pdf["x"].iloc[at]]))
            out["y_pred_std"] = pred
            out["y_pred_logret"] = pred * pdf["y_std"].to_numpy() + pdf["y_mean"].to_numpy()
            out["y_true_logret"] = pdf["y"].to_numpy() * pdf["y_std"].to_numpy() + pdf["y_mean"].to_numpy()
            yield out

    scored = sequences.select("symbol", "fold", "target_ts", "x", "y", "y_mean", "y_std").mapInPandas(run, "symbol string, fold int, target_ts timestamp_ntz, y_pred_std double, y_pred_logret double, y_true_logret double")
    return scored.filter(~F.isnan("y_pred_std"))


class LastValue:
    """A predictor for checks: a fixed share of the last step's first feature."""

    def __init__(self, share: float = 0.1):
        self.share = share

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.share * x[:, -1, 0]


def forecast_metrics(predictions: DataFrame, *keys: str) -> DataFrame:
    """Count, errors, Pearson and Spearman (average ranks) correlation and sign accuracy by keys; null where degenerate."""
    w = Window.partitionBy(*keys)

    def average_rank(c: str):
        return F.rank().over(w.orderBy(c)) + (F.count("*").over(Window.partitionBy(*keys, c)) - 1) / 2

    rows = predictions.filter("y_pred_logret is not null and y_true_logret is not null")
    rows = rows.withColumns({"_rp": average_rank("y_pred_logret"), "_rt": average_rank("y_true_logret")})
    e = F.col("y_pred_logret") - F.col("y_true_logret")

    def ic(a: str, b: str):
        return F.when((F.count("*") > 1) & (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0), F.corr(a, b))

    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), ic("y_pred_logret", "y_true_logret").alias("ic_pearson"),
        ic("_rp", "_rt").alias("ic_spearman"), F.avg((F.signum("y_pred_logret") == F.signum("y_true_logret")).cast("double")).alias("sign_accuracy"),
    )


def fold_and_overall_errors(predictions: DataFrame) -> DataFrame:
    """Errors by fold and over all folds of a symbol (fold null), in one pass of grouping sets."""
    e = F.col("y_pred_logret") - F.col("y_true_logret")
    rows = predictions.withColumns({"e2": e * e, "ae": F.abs(e)})
    sets = rows.groupingSets([["symbol", "step"], ["symbol"]], "symbol", "step")
    return sets.agg(F.count("*").alias("n"), F.avg("e2").alias("mse"), F.avg("ae").alias("mae"))


def forecast_frame(predictions: DataFrame, requested: int) -> DataFrame:
    """(ts, n, coverage, mean_mu, max_mu, expected): expected simple returns of each time as a map, with coverage."""
    mu = F.exp("y_pred_logret") - 1
    one = predictions.groupBy("ts", "symbol").agg(F.max_by(mu, "step").alias("mu"))
    pairs = F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", "mu"))))
    return one.groupBy("ts").agg(F.count("*").alias("n"), (F.count("*") / requested).alias("coverage"), F.avg("mu").alias("mean_mu"), F.max("mu").alias("max_mu"), pairs.alias("expected"))


def read_at_bars(bars: DataFrame, predictions: DataFrame, forecast_lag: int = 0) -> DataFrame:
    """Predictions at bar time; with forecast_lag 1 a bar takes the prediction for the next bar, known at its close."""
    order = Window.partitionBy("symbol").orderBy("bar_ts")
    rows = bars.withColumn("_at", F.lead("bar_ts", forecast_lag).over(order) if forecast_lag else F.col("bar_ts"))
    p = predictions.select("symbol", F.col("ts").alias("_at"), (F.exp("y_pred_logret") - 1).alias("mu"))
    return rows.join(p, ["symbol", "_at"]).select("symbol", "bar_ts", "close", "mu")
