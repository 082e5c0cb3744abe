"""Training-data pipeline operators.

Nothing outside this subpackage imports it; `tessera.llm.catalog` lists its
queries for the entry module.
"""
