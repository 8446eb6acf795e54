"""Training-data pipeline operators: documents in, decided and encoded documents out.

One module per operator; ``queries`` registers one ``opN_<name>`` query for each
and ``sql`` holds the DuckDB twins of those that SQL can express. Nothing outside
this package imports it.
"""
