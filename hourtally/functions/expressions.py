"""Small helpers for composing Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters Unicode counts as white space.
WHITE_SPACE = (
    "\t\n\u000b\u000c\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
    "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``, inside one expression.

    A Column used twice in an expression may be computed twice. A lambda
    variable is not, so costly values go through a one-element ``transform``.
    """
    return F.transform(F.array(value), body).getItem(0)


def trim_space(text: Column) -> Column:
    """Strip Unicode white space from both ends; inner white space stays."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def first_not_null(items: Column) -> Column:
    """First element of an array that is not NULL, or NULL."""
    return F.get(F.filter(items, lambda item: item.isNotNull()), F.lit(0))


Stages = list[tuple[str, Column]]


def built_once(build: Callable[..., Stages]) -> Callable[..., Stages]:
    """Keep the columns that ``build`` returns for its arguments, per JVM.

    A large expression is sent to the JVM node by node, which can take longer
    than a micro-batch should. The columns refer to others by name only, so the
    same ones serve every DataFrame.
    """
    kept: dict[tuple, Stages] = {}

    @wraps(build)
    def lookup(*args) -> Stages:
        key = (id(SparkContext._gateway), *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return lookup


def with_stages(df: DataFrame, stages: Stages) -> DataFrame:
    """Add columns one after the other; each may use those before it."""
    for name, column in stages:
        df = df.withColumn(name, column)
    return df
