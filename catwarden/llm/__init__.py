"""Operators for preparing large text corpora (training-data pipelines).

Self-contained: nothing else in the library imports this subpackage. Each
module holds one operator; ``queries`` registers them over the given tables.
"""
