"""Training-data operators: language ID, deduplication, decontamination, mixing and their kin.

Nothing else in the library imports this subpackage; ``registry`` holds its queries and SQL.
"""
