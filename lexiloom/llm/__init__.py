"""Training-data operators: ten independent DataFrame operators over a table of documents.

Nothing else in the library imports this subpackage.
"""
