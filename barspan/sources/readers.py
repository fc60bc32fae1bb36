"""Readers and writers: bars, klines, funding, predictions, manifests, contract data, monitoring records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barspan.functions.scalars import finite, from_millis, normalize_symbol, unix_millis
from barspan.schema import BARS, MANIFEST, PREDICTIONS

PRICES = ("open", "high", "low", "close", "volume")


def read_bars(spark: SparkSession, path, fmt: str = "parquet") -> DataFrame:
    """Bars from parquet or CSV, with infinities and NaN as null; partition columns and filters reach the scan."""
    reader = spark.read.schema(BARS)
    rows = reader.csv(path, header=True) if fmt == "csv" else reader.format(fmt).load(path)
    return rows.withColumns({c: finite(F.col(c)) for c in PRICES})


def write_bars(bars: DataFrame, path: str, timeframe: str) -> None:
    bars.withColumn("timeframe", F.lit(timeframe)).write.mode("append").partitionBy("timeframe", "symbol").parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both; of rows with the same keys those of `new` stay, and one of them if it repeats."""
    both = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    rest = [F.desc(c) for c in old.columns if c not in keys]
    w = Window.partitionBy(*keys).orderBy(F.desc("_seq"), *rest)
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_seq")


def write_months(bars: DataFrame, path: str) -> None:
    """Bars by symbol and month, one file each: the layout that upsert_months keeps up."""
    rows = bars.withColumn("month", F.date_format("bar_ts", "yyyy-MM"))
    rows.repartition("symbol", "month").write.mode("append").partitionBy("symbol", "month").parquet(path)


def read_months(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BARS + ", month string").parquet(path)


def upsert_months(new: DataFrame, path: str, staging: str) -> None:
    """Merge new bars into a table of write_months: symbols and months that got rows are replaced whole, files of others stay.

    Old rows are read from those symbols and months alone. The merged rows are staged as a table of their own and then put in
    place by one commit, so that a write that dies while it reads or merges leaves the table as it was. New rows win over old
    ones; of new ones that repeat one stays.
    """
    spark = new.sparkSession
    rows = new.withColumn("month", F.date_format("bar_ts", "yyyy-MM"))
    touched = rows.select("symbol", "month").distinct()
    old = read_months(spark, path).join(touched, ["symbol", "month"], "left_semi")
    merged = upsert(old, rows.select(*old.columns), ["symbol", "bar_ts"])
    merged.repartition("symbol", "month").write.partitionBy("symbol", "month").parquet(staging)
    staged = read_months(spark, staging).repartition("symbol", "month")
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "month").parquet(path)


def decode_klines(raw: DataFrame, value: str = "raw") -> DataFrame:
    """Wire klines (symbol, timeframe, JSON array of strings) to typed bars with their close time; short arrays are dropped."""
    k = F.from_json(value, "array<string>")
    rows = raw.select("symbol", "timeframe", k.alias("k")).filter(F.size("k") >= 6)
    num = lambda i: finite(F.get("k", F.lit(i)).try_cast("double"))
    return rows.select(
        normalize_symbol(F.col("symbol")).alias("symbol"), "timeframe", from_millis(F.get("k", F.lit(0)).try_cast("long")).alias("bar_ts"),
        *[num(i + 1).alias(c) for i, c in enumerate(PRICES)], from_millis(F.get("k", F.lit(6)).try_cast("long")).alias("close_ts"),
    )


def encode_klines(bars: DataFrame, timeframe: str, tf_ms: int) -> DataFrame:
    """Bars as wire klines, for landing zones and checks."""
    ms = unix_millis(F.col("bar_ts"))
    fields = F.array(ms.cast("string"), *[F.format_string("%.12f", F.col(c)) for c in PRICES], (ms + tf_ms - 1).cast("string"))
    return bars.select("symbol", F.lit(timeframe).alias("timeframe"), fields.alias("k"))


def read_funding(spark: SparkSession, path) -> DataFrame:
    """Funding CSV (symbol, timestamp, rate) with mixed timestamps; rows without a readable time or rate are dropped."""
    rows = spark.read.csv(path, header=True, schema="symbol string, timestamp string, rate string")
    ms = F.col("timestamp").try_cast("long")
    ts = F.coalesce(F.try_to_timestamp("timestamp").cast("timestamp_ntz"), from_millis(ms))
    return rows.select("symbol", ts.alias("ts"), finite(F.col("rate").try_cast("double")).alias("rate")).dropna(subset=["ts", "rate"])


def read_predictions(spark: SparkSession, paths, start: str | None = None, end: str | None = None) -> DataFrame:
    """Prediction CSVs of many files, found by path or glob: symbol in upper case, milliseconds derived where absent."""
    rows = spark.read.csv(paths, header=True, schema=PREDICTIONS)
    ms = F.coalesce("timestamp_ms", unix_millis(F.try_to_timestamp("timestamp")))
    out = rows.select(F.upper("symbol").alias("symbol"), ms.alias("timestamp_ms"), "y_pred_logret", "y_true_logret").dropna(subset=["symbol", "timestamp_ms", "y_pred_logret"])
    for bound, keep in ((start, F.col("timestamp_ms").__ge__), (end, F.col("timestamp_ms").__le__)):
        if bound is not None:
            out = out.filter(keep(unix_millis(F.lit(bound).cast("timestamp_ntz"))))
    return out


def prediction_index(predictions: DataFrame) -> DataFrame:
    """(timestamp_ms, values): symbol to prediction by time; of several for one symbol the greatest stands."""
    one = predictions.groupBy("timestamp_ms", "symbol").agg(F.max("y_pred_logret").alias("v"))
    return one.groupBy("timestamp_ms").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("symbol", "v")))).alias("values"))


def read_manifest(spark: SparkSession, path: str, timeframe: str = "8h", lookback: int = 64, retrain_days: int = 30) -> DataFrame:
    """Model manifest with defaults filled in; entries without symbol or folder are skipped."""
    rows = spark.read.schema(MANIFEST).json(path, multiLine=True, mode="PERMISSIVE")
    return rows.filter("symbol is not null and artifact_dir is not null").fillna({"timeframe": timeframe, "lookback": lookback, "retrain_days": retrain_days})


def latest_model_version(paths: DataFrame) -> DataFrame:
    """(symbol, path): the file in a symbol's root if there is one, else that of the highest step_NNN, of any number of digits;
    of equal steps the path that sorts last."""
    digits = F.regexp_extract("path", r"step_(\d+)", 1)
    number = F.ltrim(digits, F.lit("0"))
    s = paths.groupBy("symbol").agg(F.max(F.when(digits == "", F.col("path"))).alias("root"), F.max_by("path", F.struct(F.length(number), number, "path")).alias("latest"))
    return s.select("symbol", F.coalesce("root", "latest").alias("path"))


def eligible_caps(caps: DataFrame, listed: DataFrame, max_rank: int) -> DataFrame:
    """Caps (coin, cap) of coins with a listed contract, as its symbol, largest first, at most max_rank."""
    named = caps.withColumn("symbol", F.concat(F.upper("coin"), F.lit("USDT")))
    return named.join(listed.select("symbol"), "symbol", "left_semi").orderBy(F.desc("cap"), "symbol").limit(max_rank).select("symbol", "cap")


def perpetual_contracts(info: DataFrame) -> DataFrame:
    """Listed perpetuals from exchange information with nested symbols."""
    return info.select(F.explode("symbols").alias("s")).select("s.*").filter("contractType = 'PERPETUAL' and quoteAsset = 'USDT'")


def symbol_filters(info: DataFrame, least_notional: float = 0.0) -> DataFrame:
    """(symbol, step_size, min_qty, min_notional) from nested filters; 0 where a filter is missing."""
    f = info.select(F.explode("symbols").alias("s")).select("s.symbol", F.explode_outer("s.filters").alias("f"))
    pick = lambda kind, field: F.coalesce(F.max(F.when(F.col("f.filterType") == kind, F.col(f"f.{field}"))), F.lit(0.0))
    s = f.groupBy("symbol").agg(pick("LOT_SIZE", "stepSize").alias("step_size"), pick("LOT_SIZE", "minQty").alias("min_qty"), pick("MIN_NOTIONAL", "notional").alias("min_notional"))
    return s.withColumn("min_notional", F.greatest("min_notional", F.lit(least_notional)))


#: Least quantity and step of liquid contracts, for use where the exchange's own are not at hand.
DEFAULT_FILTERS = {
    "BTCUSDT": (0.001, 0.0001),
    "ETHUSDT": (0.01, 0.0001),
    "BNBUSDT": (0.1, 0.01),
    "XRPUSDT": (1.0, 1.0),
    "SOLUSDT": (0.1, 0.01),
}


def default_symbol_filters(symbols: DataFrame, least_notional: float = 5.0, table: dict[str, tuple[float, float]] = DEFAULT_FILTERS) -> DataFrame:
    """(symbol, step_size, min_qty, min_notional) by a small fixed table: no step or least quantity for symbols it lacks."""
    rows = symbols.sparkSession.createDataFrame([(k, q, step) for k, (q, step) in table.items()], "_key string, min_qty double, step_size double")
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return symbols.join(F.broadcast(rows), F.upper("symbol") == F.col("_key"), "left").select("symbol", zero("step_size"), zero("min_qty"), F.lit(float(least_notional)).alias("min_notional"))


def account_metrics(balances: DataFrame, positions: DataFrame) -> DataFrame:
    """(account, wallet, unrealized, margin, exposure_pct, open_positions) of each account."""
    b = balances.groupBy("account").agg(F.sum("wallet").alias("wallet"))
    p = positions.groupBy("account").agg(F.sum("unrealized").alias("unrealized"), F.sum("margin").alias("margin"), F.sum(F.abs("notional")).alias("_n"), F.count_if(F.abs("amount") > 0).alias("open_positions"))
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    j = b.join(p, "account", "left")
    return j.select("account", "wallet", z("unrealized").alias("unrealized"), z("margin").alias("margin"), F.coalesce(F.try_divide(z("_n"), F.col("wallet")) * 100, F.lit(0.0)).alias("exposure_pct"), F.coalesce("open_positions", F.lit(0)).alias("open_positions"))


def append_monitoring(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def write_metrics(long_metrics: DataFrame, path: str) -> None:
    long_metrics.write.mode("overwrite").csv(path, header=True)


def read_metrics(spark: SparkSession, path: str, keys: str = "strategy_id string") -> DataFrame:
    return spark.read.csv(path, header=True, schema=f"{keys}, metric string, value double")


def write_equity(equity: DataFrame, path: str) -> None:
    """The NAV by bar as CSV."""
    equity.select("strategy_id", "bar_ts", "nav").write.mode("overwrite").csv(path, header=True)


def read_equity(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="strategy_id string, bar_ts timestamp_ntz, nav double")


def write_predictions(predictions: DataFrame, path: str) -> None:
    """Predictions (symbol, ts, ...) as CSV in the form that read_predictions takes; further columns follow."""
    ms = unix_millis(F.col("ts"))
    first = [F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), ms.alias("timestamp_ms"), F.col("symbol"), F.col("y_pred_logret"), F.col("y_true_logret")]
    rest = [c for c in predictions.columns if c not in ("ts", "symbol", "y_pred_logret", "y_true_logret")]
    predictions.select(*first, *rest).write.mode("overwrite").csv(path, header=True)


def write_records(rows: DataFrame, path: str) -> None:
    """One JSON line for each row, such as metrics of each retraining step or one summary."""
    rows.write.mode("overwrite").json(path)
