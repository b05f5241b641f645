"""Backtests: a fold over dates, one per run, many runs side by side."""
