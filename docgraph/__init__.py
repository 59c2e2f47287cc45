"""Spark jobs over documentation symbol graphs: functions from DataFrames to DataFrames."""
