"""Yearly property-assessment analytics as plain functions over Spark DataFrames."""
