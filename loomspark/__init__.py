"""loomspark: a DataFrame-first engine for retrieval, knowledge tables and data preparation."""

__version__ = "0.1.0"
