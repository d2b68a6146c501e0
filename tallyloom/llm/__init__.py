"""Training-data operators: nothing outside this subpackage imports it.

Every module holds one operator with a general interface (any id/text column
names) and returns real outputs: ids, texts, spans, files.  ``queries.py`` wires
them to the driver's tables.
"""
