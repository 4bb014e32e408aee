"""What kinds of value a field holds, as bit flags.

The flags of a value are one small integer; those of a field are the ``bit_or`` over its values, whatever their number or the size of
nested objects.  Flags of parts of a table combine to those of the whole.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions.values import text_form

# One bit for each kind, and one for each kind of list element.
BOOLEAN, INTEGER, FRACTION, TEXT, DAY, OBJECT, OTHER = 1, 2, 4, 8, 16, 32, 64
LIST, LIST_BOOLEAN, LIST_INTEGER, LIST_FRACTION, LIST_TEXT, LIST_NESTED = 128, 256, 512, 1024, 2048, 4096
ANY_LIST = LIST | LIST_BOOLEAN | LIST_INTEGER | LIST_FRACTION | LIST_TEXT | LIST_NESTED
_ISO_DATE = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"


def with_kind_flags(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Replace VARIANT columns by the flags of their values; 0 for null.

    Kinds and texts are columns of their own on the way: the flags ask for them again and again, and in one expression each
    question would read the value anew.
    """
    rest = [c for c in df.columns if c not in names]
    df = df.withColumns({f"{n}__kind": F.schema_of_variant(n) for n in names})
    df = df.withColumns({f"{n}__text": F.when(F.col(f"{n}__kind") == "STRING", text_form(F.col(n))) for n in names})
    return df.select(*rest, *[_flags(F.col(f"{n}__kind"), F.col(f"{n}__text")).alias(n) for n in names])


def _flags(kind: Column, text: Column) -> Column:
    # The length decides for most texts, before a pattern has to.
    day = F.when((F.length(text) == 10) & text.rlike(_ISO_DATE) & text.try_cast("date").isNotNull(), DAY).otherwise(TEXT)
    element = F.substring_index(F.substring(kind, 7, 9), "(", 1)
    of_list = (
        F.when(element.startswith("BIGINT"), LIST_INTEGER)
        .when(element.startswith("STRING"), LIST_TEXT)
        .when(element.startswith("BOOLEAN"), LIST_BOOLEAN)
        .when(element.startswith("DECIMAL") | element.startswith("DOUBLE") | element.startswith("FLOAT"), LIST_FRACTION)
        .when(element.startswith("VARIANT") | element.startswith("OBJECT") | element.startswith("ARRAY"), LIST_NESTED)
        .when(element.startswith("VOID"), 0)
        .otherwise(LIST_TEXT)
    )
    return (
        F.when(kind.isNull() | (kind == "VOID"), 0)
        .when(kind == "STRING", day)
        .when(kind == "BIGINT", INTEGER)
        .when(kind == "BOOLEAN", BOOLEAN)
        .when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), FRACTION)
        .when(kind.startswith("ARRAY"), of_list + LIST)
        .when(kind.startswith("OBJECT"), OBJECT)
        .otherwise(OTHER)
    )


def _is_fraction(flags, whole: int, part: int):
    return (flags == part) | (flags == whole + part)


def column_type(flags: Column) -> Column:
    """Type of the widened column: mixed kinds are text, whole and fractional numbers DOUBLE, all ISO dates DATE."""
    flags = F.coalesce(flags, F.lit(0))
    # Elements of one kind, numbers of any kind, or none at all can be a list of texts.
    simple = (LIST, LIST + LIST_BOOLEAN, LIST + LIST_INTEGER, LIST + LIST_FRACTION, LIST + LIST_INTEGER + LIST_FRACTION, LIST + LIST_TEXT)
    return (
        F.when(flags == INTEGER, "bigint")
        .when(flags == BOOLEAN, "boolean")
        .when(_is_fraction(flags, INTEGER, FRACTION), "double")
        .when(flags == DAY, "date")
        .when(flags == OBJECT, "variant")
        .when(flags.isin(*simple), "array<string>")
        .when((flags.bitwiseAND(ANY_LIST) == flags) & (flags != 0), "array<variant>")
        .otherwise("string")
    )


def type_name(flags: int) -> str:
    """The same for flags that are known, as those of a store are."""
    simple = {LIST, LIST + LIST_BOOLEAN, LIST + LIST_INTEGER, LIST + LIST_FRACTION, LIST + LIST_INTEGER + LIST_FRACTION, LIST + LIST_TEXT}
    single = {INTEGER: "bigint", BOOLEAN: "boolean", FRACTION: "double", INTEGER + FRACTION: "double", DAY: "date", OBJECT: "variant"}
    if flags in single:
        return single[flags]
    return "array<string>" if flags in simple else "array<variant>" if flags and not flags & ~ANY_LIST else "string"


def type_names(flags: Mapping[str, int]) -> dict[str, str]:
    return {key: type_name(f) for key, f in sorted(flags.items())}
