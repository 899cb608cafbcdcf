"""Training-data operators: deduplication, decontamination, tokenizing, archives, filters.

Nothing else in the library imports this package.  Every operator takes and
returns DataFrames; ``queries.py`` binds them to the documents/pages tables.
"""
