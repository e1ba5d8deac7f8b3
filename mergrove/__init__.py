"""SPARQL-style solution-sequence algebra on Spark DataFrames; see ``mergrove.api``."""
