"""Evaluate a sub-expression once."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value bound to a lambda variable. Inside higher-order functions Spark evaluates a captured
    expression again for every element; a bound one is evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))
