"""Training-data operators: deduplication, archives, language, quality, licences, mixing and sharding.

Nothing outside this folder imports it. Every operator takes and returns DataFrames; the
registered queries are in :mod:`parcelfusion.llm.queries`.
"""
