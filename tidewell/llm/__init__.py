"""Operators that prepare collections of documents as training text.

Nothing outside this folder imports it. Each module documents its operator's defined results for nulls,
blank and very long texts, ties, repeated rows, empty tables and extra columns.
"""
