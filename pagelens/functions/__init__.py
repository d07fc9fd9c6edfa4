"""Column expressions and the fixed values behind them."""
