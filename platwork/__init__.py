"""Permit and personal-property import, matching and reporting on Spark DataFrames."""

__version__ = "0.1.0"
