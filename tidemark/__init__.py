"""Panel forecasting, backtesting and monitoring as Spark DataFrame operators."""

from tidemark.config import Engine, Measure

__all__ = ["Engine", "Measure"]
