"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its own general interface; :mod:`arrayq.llm.queries` binds them
to the ``opN_*`` queries of the driver.
"""
