"""Operators for large-scale training-data pipelines.

Nothing outside this subpackage imports it; its queries live in
:mod:`factorloom.llm.queries` and are added by ``__spark_entry__`` only when
the subpackage is present.
"""
