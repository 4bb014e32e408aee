"""Records as a typed table, and conditions on its columns."""

import datetime
import re
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, NumericType, StringType, VariantType

from recordlake.functions.kinds import type_names
from recordlake.functions.text import like_pattern
from recordlake.functions.values import typed_value
from recordlake.operators.profile import collect_profile, field_flags
from recordlake.session import clause_dialect
from recordlake.sources.columns import stored_column, stored_flags

METADATA = ("_note_file", "_source_type", "_layer", "_pos")
# The operators of a condition.
OPERATORS = ("=", "!=", "LIKE", ">", "<", ">=", "<=", "IS NULL", "IS NOT NULL", "IN")
# Conditions of errors that values raise in a clause.
_DATA_ERRORS = ("CAST_", "CANNOT_PARSE", "DATETIME_", "DIVIDE_BY_ZERO", "ARITHMETIC_OVERFLOW", "NUMERIC_", "INVALID_")
_NUMBER = re.compile(r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?")


def column_types(records: DataFrame, infer_dates: bool = True, fields: Sequence[str] | None = None) -> dict[str, str]:
    """Inferred column type of every field that is no metadata, or of the named ``fields``.

    Stored records know the types of the whole store.  Others are read once: all of them for their fields, or
    only the named fields, which is cheaper.
    """
    known = stored_flags(records)
    if known is not None:
        types = type_names(known if fields is None else {f: known.get(f, 0) for f in fields})
    elif fields is not None:
        types = type_names(field_flags(records, fields))
    else:
        types = {r["key"]: r["column_type"] for r in collect_profile(records)}
    types = {k: t for k, t in types.items() if not k.startswith("_")}
    return types if infer_dates else {k: "string" if t == "date" else t for k, t in types.items()}


def widen(
    records: DataFrame,
    types: Mapping[str, str] | None = None,
    infer_dates: bool = True,
    keep: Sequence[str] = (),
    fields: Sequence[str] | None = None,
) -> DataFrame:
    """One typed column per field, next to the metadata columns.

    ``types`` names the columns and saves the job that infers them; ``fields`` names them and infers their types only;
    ``keep`` names other columns of the records to carry.  Names that differ
    only in case get a suffix ``_1``, ``_2``; every name is a column of its own.

    A field that the store holds as a column of that type is that column, so conditions on it reach the Parquet scan and
    the map of all fields is not read.
    """
    types = column_types(records, infer_dates, fields) if types is None else types
    taken = {m.lower() for m in (*METADATA, *keep)}
    columns = []
    for key, wanted in types.items():
        name, n = key, 0
        while name.lower() in taken:
            n += 1
            name = f"{key}_{n}"
        taken.add(name.lower())
        stored = stored_column(records, key, wanted)
        columns.append((typed_value(F.col("fields")[key], wanted) if stored is None else stored).alias(name))
    return records.select(*METADATA, *keep, *columns)


def sql_where(table: DataFrame, clause: str, on_error: str = "raise") -> DataFrame | tuple[DataFrame, str]:
    """Rows that meet a SQL condition; trailing SQL such as ``ORDER BY`` is allowed.

    ``"x"`` is a column, ``'x'`` a text in which backslashes stand for themselves; only a
    ``LIKE`` pattern still takes a backslash as its escape character.

    With ``on_error="passthrough"`` the result is ``(rows, message)``; a clause that does not analyse leaves the rows unfiltered, and
    so does one that compares text with a number, a date or a boolean where a text is none.  Only such a clause is tried on
    the data beforehand, by a job that reads the columns it names.
    """
    if on_error not in ("raise", "passthrough"):
        raise ValueError(f"on_error: {on_error!r}")
    message = ""
    result = table
    if clause.strip():
        try:
            result = _select_where(table, clause)
            if on_error == "passthrough" and _casts_text(result):
                result.agg(F.count(F.lit(1))).collect()
        except PySparkException as error:  # an error of the clause, not of the cluster
            if on_error == "raise" or not (isinstance(error, AnalysisException) or (error.getCondition() or "").startswith(_DATA_ERRORS)):
                raise
            result, message = table, "SQL: " + str(error).strip().splitlines()[0]
    return (result, message) if on_error == "passthrough" else result


def _casts_text(rows: DataFrame) -> bool:
    """Whether the analysed clause turns text columns into other types, which can fail on the data."""
    plan = rows._jdf.queryExecution().analyzed().toString()
    conditions = [line for line in plan.splitlines() if re.match(r"[\s:+-]*(Filter|Sort) ", line)]
    return any(re.search(r"cast\(.* as (tinyint|smallint|int|bigint|float|double|decimal\([0-9,]+\)|date|timestamp|timestamp_ntz|boolean)\)", c) for c in conditions)


def _select_where(table: DataFrame, clause: str) -> DataFrame:
    spark = table.sparkSession
    view = "records_" + uuid.uuid4().hex
    table.createOrReplaceTempView(view)
    try:
        with clause_dialect(spark):
            literal_backslashes = clause.replace("\\", "\\\\")
            return spark.sql(f"SELECT * FROM {view} WHERE {literal_backslashes}")
    finally:
        spark.catalog.dropTempView(view)


def where_field(table: DataFrame, field: str, op: str, value: str = "") -> Column:
    """Condition from a field, an operator and a text value, typed by the column.

    Raises ``ValueError`` when the combination is incomplete or does not fit the type.
    """
    field, op, value = field.strip(), re.sub(r"\s+", " ", op.strip().upper()), value.strip()
    if not field or op not in OPERATORS:
        raise ValueError(f"incomplete condition: {field!r} {op!r}")
    column, kind = _resolved(table, field)
    if op == "IS NULL":
        return column.isNull()
    if op == "IS NOT NULL":
        return column.isNotNull()
    if not value:
        raise ValueError(f"condition on {field!r} needs a value")
    if op == "LIKE":
        pattern = value.replace("\\", "\\\\")
        return column.cast("string").like(pattern if "%" in value else f"%{pattern}%")
    if op == "IN":
        items = [part.strip() for part in value.split(",") if part.strip()]
        if not items:
            raise ValueError(f"condition on {field!r} needs a value")
        return column.isin(*[_literal(kind, field, item) for item in items])
    literal = _literal(kind, field, value)
    comparisons = {"=": column == literal, "!=": column != literal, ">": column > literal,
                   "<": column < literal, ">=": column >= literal, "<=": column <= literal}
    return comparisons[op]


def where_form(table: DataFrame, conditions: Sequence[tuple[str, str, str]]) -> Column | None:
    """All conditions of a form at once; incomplete lines are left out.  None when no line is complete."""
    complete = [c for c in conditions if is_complete(*c)]
    return reduce(lambda a, b: a & b, [where_field(table, *c) for c in complete]) if complete else None


def is_complete(field: str, op: str, value: str = "") -> bool:
    """Whether a line of a form says enough to be a condition."""
    op = re.sub(r"\s+", " ", op.strip().upper())
    items = [part for part in value.split(",") if part.strip()] if op == "IN" else [value] if value.strip() else []
    return bool(field.strip()) and op in OPERATORS and (op in ("IS NULL", "IS NOT NULL") or bool(items))


def combine(*clauses: str) -> str:
    """SQL clauses joined by AND, each in its own parentheses; blank ones are left out."""
    given = [c.strip() for c in clauses if c.strip()]
    # a line end keeps a comment at the end of a clause from swallowing its parenthesis
    return given[0] if len(given) == 1 else " AND ".join(f"({c}\n)" for c in given)


def _resolved(table: DataFrame, field: str) -> tuple[Column, DataType]:
    """Column and type of a field; as in SQL, case counts only where names differ by nothing else."""
    found = [f for f in table.schema if f.name == field] or [f for f in table.schema if f.name.lower() == field.lower()]
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} field {field!r}")
    quoted = found[0].name.replace("`", "``")
    return table[f"`{quoted}`"], found[0].dataType


def _day(field: str, value: str) -> datetime.date:
    parts = re.fullmatch(r"(\d{4})(?:-(\d{1,2})(?:-(\d{1,2}))?)?", value)
    try:
        return datetime.date(*[int(x or 1) for x in parts.groups()])
    except (AttributeError, ValueError):
        raise ValueError(f"{field!r} is a date, {value!r} is not") from None


def _literal(kind, field: str, value: str) -> Column:
    if isinstance(kind, NumericType):
        if not _NUMBER.fullmatch(value):
            raise ValueError(f"{field!r} is a number, {value!r} is not")
        if not re.fullmatch(r"[-+]?\d{1,38}", value):
            return F.lit(float(value))
        return F.lit(int(value)) if -(1 << 63) <= int(value) < 1 << 63 else F.lit(value).cast("decimal(38,0)")
    if isinstance(kind, BooleanType):
        if value.lower() not in ("true", "false"):
            raise ValueError(f"{field!r} is a boolean, {value!r} is not")
        return F.lit(value.lower() == "true")
    if isinstance(kind, (StringType, DateType)):
        return F.lit(value) if isinstance(kind, StringType) else F.lit(_day(field, value))
    if isinstance(kind, (ArrayType, VariantType)):
        raise ValueError(f"{field!r} holds {kind.simpleString()}, which does not compare with text")
    return F.lit(value)


def filter_filename(table: DataFrame, term: str) -> DataFrame:
    """Rows whose source path contains the term; ``%`` and ``_`` in it are wildcards."""
    term = term.strip()
    return table.filter(F.col("_note_file").like(like_pattern(term))) if term else table
