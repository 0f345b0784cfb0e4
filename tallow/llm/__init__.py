"""Operations of a large-scale training-data pipeline.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; the thin ``opN_<name>`` queries are in :mod:`tallow.llm.queries`.
"""
