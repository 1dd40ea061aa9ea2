"""Encrypted-tunnel traffic analytics as DataFrame operators.

Every operator takes and returns DataFrames and is keyed by ``capture_id``, so
one plan covers any number of captures.
"""

__version__ = "0.1.0"
