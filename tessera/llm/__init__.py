"""Training-data operators: one module per operator, one contract query per module.

Nothing outside this package imports it. Each module's operator takes and
returns DataFrames and has its own parameters; the ``op<N>_<name>`` functions in
``queries`` apply it to a whole table and derive the digest columns.
"""
