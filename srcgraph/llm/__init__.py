"""Training-data operators over the ``documents``-like tables.

Nothing else in the library imports this subpackage, so it can be removed
without touching the code-intelligence engine.
"""
