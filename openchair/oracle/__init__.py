"""Independent SQL for the named queries, written for a single-node SQL engine.

The statements share no code with the operators and use other formulations: correlated
NOT EXISTS, row numbers, windowed means and a range self-join.
"""

from openchair.oracle.statements import ORACLE_SQL

__all__ = ["ORACLE_SQL"]
