"""Operators for large text, URL and media corpora that feed model training.

Nothing outside this subpackage imports it. Every operator is a function from DataFrame to
DataFrame; ``queries`` binds them to the driver's tables.
"""
