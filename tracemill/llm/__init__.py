"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface (real texts, spans and files); ``queries``
derives the thin digest queries from them.
"""
