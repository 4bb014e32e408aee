"""Hot keys of a join, spread over several tasks.

A key is hot when it alone has at least ``min_rows`` rows and more than its share of a task.  It is dealt over as many salts as its rows fill
tasks.  The share bounds how many keys can be hot (``KEYS_A_TASK`` for each shuffle partition), so the hot keys are broadcast whole, without a limit; all
other keys join as usual.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS_A_TASK = 4
MIN_ROWS = 1_000_000


def hot_keys(counts: DataFrame, keys: Sequence[str], min_rows: int = MIN_ROWS) -> DataFrame:
    """Hot keys of a table ``(*keys, rows)`` that has one row per key, with their number of ``_salts``."""
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = counts.agg(F.sum("rows") / F.lit(KEYS_A_TASK * tasks)).scalar()
    target = F.greatest(F.lit(float(min_rows)), share)
    hot = counts.filter(F.col("rows") >= target)
    return hot.select(*keys, F.ceil(F.col("rows") / target).cast("long").alias("_salts"))


def spread_many(df: DataFrame, hot: DataFrame, keys: Sequence[str], row_id: Sequence[str]) -> DataFrame:
    """Add ``_salt`` to the side with many rows per key: rows of a hot key get one of its salts."""
    salt = F.coalesce(F.pmod(F.xxhash64(*row_id), F.col("_salts")), F.lit(0).cast("long"))
    return df.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", salt).drop("_salts")


def spread_one(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``_salt`` to the side with one row per key: rows of a hot key repeat for every salt."""
    salts = F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_salts"), F.lit(1).cast("long")) - 1)
    return df.join(F.broadcast(hot), list(keys), "left").withColumn("_salt", F.explode(salts)).drop("_salts")
