"""Operators of a training-data pipeline over documents, pages and conversations.

Nothing else in the library imports this subpackage.  Each module holds one
operator with a general interface; ``registered`` derives the query results.
"""
