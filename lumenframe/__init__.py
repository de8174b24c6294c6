"""Lumenframe: a Spark-native engine for single-molecule localisation tables.

Every operator takes and returns DataFrames and stays lazy; Catalyst plans
the work.  See README.md for the map of the package.
"""
