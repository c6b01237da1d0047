"""Names of columns that are no column's yet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def private(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, each behind as many underscores as make it no column of df (whatever the case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)
