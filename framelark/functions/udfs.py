"""Vectorised Python functions whose Spark type is parsed when they are first used, so that modules import without a session."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F


def vectorised(ddl: str):
    """Like ``pandas_udf(ddl)``, for module level."""

    def wrap(function):
        @functools.wraps(function)
        def call(*columns):
            return F.pandas_udf(function, ddl)(*columns)

        return call

    return wrap
