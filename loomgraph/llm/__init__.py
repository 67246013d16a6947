"""Training-data operators: thirteen corpus-scale building blocks and the queries that run them.

Nothing else in the library imports this subpackage.
"""
