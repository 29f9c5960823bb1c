"""Spark-first analytics over scientific text, evidence, beliefs and causal graphs."""

__version__ = "0.1.0"
