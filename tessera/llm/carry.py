"""Extra columns through operators: in one struct under positional names, so that no name can clash on the way."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The column that holds them.
REST = "__rest"


def packed(columns: list[str]) -> Column:
    """The columns as one struct; null if there are none."""
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]
    return (F.struct(*fields) if fields else F.lit(None).cast("boolean")).alias(REST)


def names(columns: list[str], own: list[str]) -> list[str]:
    """What the columns are called beside an operator's own: `<name>_in` where they would clash, whatever their case."""
    taken, out = {c.lower() for c in own}, []
    for c in columns:
        while c.lower() in taken:
            c += "_in"
        taken.add(c.lower())
        out.append(c)
    return out


def unpacked(columns: list[str], own: list[str]) -> list[Column]:
    return [F.col(REST)[f"c{i}"].alias(n) for i, n in enumerate(names(columns, own))]
