"""Arrow functions that are made when they are called, so that workers can import their modules without a session."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(kind: str):
    def wrap(f):
        @functools.wraps(f)
        def call(*args) -> Column:
            return F.pandas_udf(f, kind)(*args)

        call.plain = f
        return call

    return wrap


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
