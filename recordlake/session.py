"""Session settings."""

from collections.abc import Mapping
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Helpful for corpora of many small files: they cost little to open, so pack more per task.
CORPUS_CONF = {
    "spark.sql.files.openCostInBytes": str(64 * 1024),
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}

_CLAUSE_DIALECT = {
    "spark.sql.ansi.enabled": "true",
    "spark.sql.ansi.doubleQuotedIdentifiers": "true",
}


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]):
    """While inside, these settings hold; the caller's are put back."""
    before = {name: spark.conf.get(name, None) for name in values}
    try:
        for name, value in values.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def clause_dialect(spark: SparkSession):
    """While inside, ``"x"`` is a column in the text of a clause."""
    return settings(spark, _CLAUSE_DIALECT)


def last_key_wins(spark: SparkSession) -> None:
    """Of equal keys of a JSON object the last counts, unless the session says otherwise.

    Spark reads the setting again whenever it copies a plan, so it is set for the session and not only around an expression.
    """
    name = "spark.sql.variant.allowDuplicateKeys"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, "true")
