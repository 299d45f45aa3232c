"""Document analytics on DataFrames: scans, projections, joins, layout and reports as Spark plans."""

__version__ = "0.1.0"
