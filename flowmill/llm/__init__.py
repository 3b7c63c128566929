"""Training-data operators: one module per operator, all on DataFrames.

Nothing else in the package imports this subpackage.
"""
