"""Instruction-adherence evaluation on Spark.

Response documents come in as DataFrames, every response is checked against the
instructions of its prompt by native column expressions, and the outcomes are
rolled up, compared and flattened with DataFrame aggregations.
"""
