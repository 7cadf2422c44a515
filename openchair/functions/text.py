from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_list(values: Column) -> Column:
    """An integer array as ``[0, 5, 10]``."""
    return F.concat(F.lit("["), F.array_join(values, ", "), F.lit("]"))


def string_list(values: Column) -> Column:
    """A string array as ``["a", "b"]``."""
    quoted = F.concat(F.lit('"'), F.array_join(values, '", "'), F.lit('"'))
    return F.concat(F.lit("["), F.when(F.size(values) > 0, quoted).otherwise(""), F.lit("]"))
