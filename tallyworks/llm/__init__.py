"""Training-data operators: one module an operator, all DataFrame in, DataFrame out.

Nothing else in the library imports this subpackage.  ``queries()`` and ``oracle_sql()`` are in
``tallyworks.llm.queries``.
"""
