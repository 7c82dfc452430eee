"""Threat-intelligence enrichment, scoring and alert analytics on Spark DataFrames."""

__version__ = "0.1.0"
