"""Keep a costly column from being computed again by every filter above it."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_VALUE = "_computed_once"


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Set column ``name``.  Filters on it stay above, where they read the finished value.

    Catalyst moves filters below projections by repeating the projected expression, which
    for parsed fields means parsing once per condition.  It does not move them below a
    generator, and a generator over one element changes no row.  The value is finished below
    the generator: there its code is compiled even where it calls functions on elements.
    """
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, value.alias(_VALUE)).select(*rest, F.explode(F.array(_VALUE)).alias(name)).select(
        *(df.columns if name in df.columns else [*df.columns, name])
    )
