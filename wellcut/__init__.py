"""wellcut: refining graph communities on Spark."""

__version__ = "0.1.0"
