"""Facts of source files: definitions, imports, exports, calls, data flow.

Source text has to be parsed, which no Catalyst expression can do, so files
go through one Arrow-batched Python function; everything after works on rows.
"""
