"""Names for columns that an operator adds and drops again, and expressions that are evaluated once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def temporary(stem: str, *frames: DataFrame) -> str:
    """A column name that none of the frames has."""
    taken = {c.lower() for d in frames for c in d.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name = f"_{name}"
    return name


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)
