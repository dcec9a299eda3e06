"""Spark-native analytics over ranked word predictions and the texts behind them."""
