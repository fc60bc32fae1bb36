"""Explicit schemas of the tables that operators exchange."""

BARS = "symbol string, bar_ts timestamp_ntz, open double, high double, low double, close double, volume double"
FUNDING = "symbol string, ts timestamp_ntz, rate double"
PREDICTIONS = "timestamp string, timestamp_ms long, symbol string, y_pred_logret double, y_true_logret double"
MANIFEST = "symbol string, timeframe string, lookback int, retrain_days int, artifact_dir string"
#: Order of the features in windows and sequences.
FEATURES = "log_return", "log_volume", "mom_3", "mom_15", "rsi_innov", "atr_innov", "obv_tilt", "funding"
