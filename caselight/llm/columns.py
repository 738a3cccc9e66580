"""Names for columns that an operator adds for its own use."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free(df: DataFrame, *wanted: str) -> list[str]:
    """The names, each with as many underscores in front as make it new to the table, whatever the case of its letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out
