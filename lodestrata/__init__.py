"""Lodestrata: a PySpark-native engine for versioned knowledge corpora.

Text nodes, typed edges, term postings and vectors are plain DataFrames; every
operator declares a Catalyst plan and drops to Arrow-batched Python only for
parser-like or greedy steps.
"""

__version__ = "0.1.0"
