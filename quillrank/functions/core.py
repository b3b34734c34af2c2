"""Expression helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable.

    An expression that names the same costly sub-expression several times
    (``when(instr(s, '&') > 0, f(s)).otherwise(s)``) would otherwise evaluate
    it once per mention; binding it keeps regex chains linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
