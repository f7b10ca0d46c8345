"""Operators: functions from DataFrames to DataFrames, lazy and without side effects.

Results are unordered unless a docstring says so; ``larder.plans.reports`` holds the
sort order of each report.
"""
