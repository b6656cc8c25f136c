"""Spark-first engine for building text corpora and analysing model evaluations.

Every operator takes DataFrames and returns a DataFrame; nothing is computed
until the caller runs an action, except where a docstring says so.
"""

__version__ = "0.1.0"
