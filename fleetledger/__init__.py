"""Change-log and fleet analytics as Spark jobs.

Functions take DataFrames and return DataFrames.  ``now`` is always a parameter,
so one input snapshot always gives one result.
"""
