"""Claim analytics on Spark: pure ``DataFrame -> DataFrame`` operators, a versioned table store and streaming runners."""

__version__ = "0.1.0"
