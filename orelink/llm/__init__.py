"""Training-data operators: Spark jobs over documents, pages and conversations.

Nothing else in the library imports this subpackage. ``queries.py`` holds the registered queries.
"""
