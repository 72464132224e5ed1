"""Evaluate a costly expression once per row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Inside a lambda nothing is shared, so an outer expression would be computed again for every
    element; a lambda variable is computed once.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def only_if(value: Column, keep: Callable[[Column], Column]) -> Column:
    """A generator that yields ``value`` where ``keep`` holds and drops the row elsewhere.

    A filter on a computed column is pushed below it and computes it twice; a generator computes once.
    """
    return F.explode(F.filter(F.array(value), keep))
