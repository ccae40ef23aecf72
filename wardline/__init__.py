"""wardline - access-governance analytics as PySpark DataFrame operators.

Operators take and return DataFrames. ``as_of`` stands in for the current time
everywhere, so every result can be reproduced later from the same tables.
"""
