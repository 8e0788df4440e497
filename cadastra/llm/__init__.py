"""Operators for training-data pipelines: one module per operator, none used by the rest of the library."""
