"""What fields records have: presence, fill rate, type; and which columns to show."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from recordlake.functions.kinds import column_type, with_kind_flags

# A table of all fields that would be wider than this is refused, never cut; named fields have no limit.
MAX_COLUMNS = 10_000


def column_profile(records: DataFrame, rate: bool = False) -> DataFrame:
    """One row per field: ``key, present, non_null, flags, column_type``.

    Counts and flags are combined in the map tasks, so a field that every record has shuffles no more than any other, and a field of any
    number of nested names costs one integer.  ``flags`` are the kinds of its values (``functions.kinds``), ``column_type`` the type
    of the widened column.  ``rate`` adds ``fill_rate``, at the price of a count over the records.
    """
    values = with_kind_flags(records.select(F.explode("fields").alias("key", "flags")), ["flags"])
    profile = values.groupBy("key").agg(
        F.count(F.lit(1)).alias("present"),
        F.count_if(F.col("flags") != 0).alias("non_null"),  # a null alone has no kind
        F.bit_or("flags").alias("flags"),
    ).withColumn("column_type", column_type(F.col("flags")))
    if rate:
        total = records.agg(F.count(F.lit(1)).alias("records")).scalar()
        profile = profile.withColumn("fill_rate", F.col("non_null") / total)
    return profile


def field_flags(records: DataFrame, fields: Sequence[str]) -> dict[str, int]:
    """Kinds of the named fields only: one integer each, whatever other fields there are.  Runs one job."""
    if not fields:
        return {}
    # Values one below the other: a column for each field would make code too long for the JVM to compile.
    values = records.select(F.explode("fields").alias("key", "flags")).filter(F.col("key").isin(*fields))
    rows = with_kind_flags(values, ["flags"]).groupBy("key").agg(F.bit_or("flags").alias("flags")).collect()
    return dict.fromkeys(fields, 0) | {r["key"]: r["flags"] for r in rows}


def field_keys(records: DataFrame) -> DataFrame:
    """Every field name that is no metadata, all-null ones too."""
    keys = records.select(F.explode(F.map_keys("fields")).alias("key")).distinct()
    return keys.filter(~F.col("key").startswith("_"))


def top_columns(profile: DataFrame, k: int) -> DataFrame:
    """The ``k`` best filled displayable fields with their ``rank``, ties by name."""
    best = displayable(profile).orderBy(F.desc("non_null"), "key").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("non_null"), "key")))


def displayable(profile: DataFrame) -> DataFrame:
    """Fields that can be a column: no metadata, and a value in at least one record."""
    return profile.filter(~F.col("key").startswith("_") & (F.col("non_null") > 0))


def fitting_columns(
    profile: DataFrame, budget: int, widths: Mapping[str, int] | None = None, default_width: int = 20, lead_width: int = 0
) -> DataFrame:
    """Best filled fields, in rank order, while their widths fit the budget; at least one stays."""
    left = budget - lead_width
    narrowest = max(1, min([default_width, *(widths or {}).values()]))
    # No more fields than this can fit, so the running sum needs no others.
    best = top_columns(profile, max(1, left // narrowest))
    best = best.withColumn("used", F.sum(_width_of(widths, default_width)).over(Window.orderBy("rank")))
    # Widths are positive: once the running sum has passed the budget it stays above it.
    return best.filter((F.col("used") <= left) | (F.col("rank") == 1))


def _width_of(widths: Mapping[str, int] | None, default_width: int) -> Column:
    width = F.lit(default_width)
    for key, value in (widths or {}).items():
        width = F.when(F.col("key") == key, value).otherwise(width)
    return width


def collect_profile(records_or_profile: DataFrame) -> list[Row]:
    """The profile on the driver; refuses more than ``MAX_COLUMNS`` fields."""
    df = records_or_profile
    profile = column_profile(df) if "fields" in df.columns else df
    rows = profile.limit(MAX_COLUMNS + 1).collect()
    if len(rows) > MAX_COLUMNS:
        raise ValueError(f"records have more than {MAX_COLUMNS} different fields; name the columns to use")
    return sorted(rows, key=lambda r: r["key"])


def shown_columns(
    profile: Sequence[Row],
    explicit: Sequence[str] = (),
    override: Sequence[str] = (),
    budget: int | None = None,
    widths: Mapping[str, int] | None = None,
    default_width: int = 20,
    lead_width: int = 0,
) -> tuple[list[str], int]:
    """Columns to show and the number hidden.

    An explicit order (or its override) wins and keeps its order; otherwise the best
    filled fields are taken and shown by name.  Only fields with a value count.
    """
    filled = {r["key"]: r["non_null"] for r in profile if not r["key"].startswith("_") and r["non_null"] > 0}
    given = list(override) or list(explicit)
    candidates = [k for k in given if k in filled] if given else sorted(filled, key=lambda k: (-filled[k], k))
    shown, left = [], None if budget is None else budget - lead_width
    for key in candidates:
        width = (widths or {}).get(key, default_width)
        if left is not None:
            if shown and width > left:
                break
            left -= width
        shown.append(key)
    return shown if given else sorted(shown), len(candidates) - len(shown)
