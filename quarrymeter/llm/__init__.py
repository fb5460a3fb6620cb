"""Training-data pipeline operators.

Nothing outside this subpackage imports it. Every operator takes DataFrames,
works on whole texts and returns DataFrames; see ``queries.py`` for the
registered queries.
"""
