"""Training-data operators: ten distributed text, page and vector jobs.

Nothing else in the library imports this subpackage; it may be deleted whole.
"""
