"""Factor research on Spark: formulas, panels, statistics, books and records as DataFrame plans."""

__version__ = "0.1.0"
