"""Training-data operators: one module per operator, ``queries`` registers them.

Nothing else in the library imports this subpackage.
"""
