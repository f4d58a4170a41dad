"""Spark-native analytics for sky-survey and interferometry tables.

Everything is a plain DataFrame transformation: functions take DataFrames and
Columns and return DataFrames and Columns, so Catalyst plans the work.
"""
