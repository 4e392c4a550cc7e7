"""Operators of a large-scale training-data pipeline, each over a ``documents``-like DataFrame.

Nothing else in the library imports this package. Every operator reads only the columns it is told
to read (``id_col``, ``text_col``), so extra columns of any name never clash with its own.
"""
