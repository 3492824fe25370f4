"""Compositions of operators: panels from raw tables, the backtest, the catalog."""
