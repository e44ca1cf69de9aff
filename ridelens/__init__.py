"""ridelens: funnel, segment and review-keyword analytics on Spark DataFrames.

Every operator takes DataFrames and returns a lazy DataFrame built from
built-in Spark SQL expressions, so Catalyst plans it and the work runs on
the executors.
"""

__version__ = "0.1.0"
