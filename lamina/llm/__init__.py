"""Operators for preparing text corpora, vectors and conversations for training.

Every operator is a Spark job over DataFrames; nothing outside this subpackage imports it.
"""
