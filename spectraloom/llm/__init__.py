"""Training-data operators: tokenising, quality, language, joins, scoring, mixing and search.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; see the module docstrings for nulls, ties and empty input.
"""
