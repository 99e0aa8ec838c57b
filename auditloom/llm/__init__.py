"""Operators of a training-data pipeline over documents, pages and labels.

Nothing outside this package imports it; its queries are registered by
:mod:`auditloom.llm.queries`.
"""
