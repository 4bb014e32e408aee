"""YAML text to typed fields.

Blocks whose lines are all ``key: scalar`` are rewritten to JSON with built-in string
functions and never leave the JVM.  Only the other blocks reach Python, in Arrow batches.
Both ways follow the YAML 1.2 core schema and must give equal results.
"""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from recordlake.functions.yaml_text import (
    FALSE_WORDS,
    JSON_NUMBER,
    NULL_WORDS,
    OTHER_NUMBER,
    TRUE_WORDS,
    yaml_batch_errors,
    yaml_batch_to_json,
)

# While it is rewritten every line ends in this marker, with a comma unless it is the last.
# A replacement can only insert what the line holds, so the marker also supplies the word
# and the quotes that JSON needs.
_END = '\x01null"'
# Printable characters beyond ASCII.  A line that holds a control, a line separator or a
# byte order mark goes to the full parser, and so does one with a quote or backslash inside.
_WIDE = r"[\xa0-\u2027\u202a-\ufefe\uff00-\ufffd\x{10000}-\x{10ffff}]"


def _ascii(but: str) -> str:
    """A class of the printable ASCII characters but some.  Listed one by one they are one look-up, where each range is a call."""
    return "[" + "".join(rf"\x{c:02x}" for c in range(0x20, 0x7F) if chr(c) not in but) + "]"


def _run(but: str) -> str:
    return rf"{_ascii(but)}*+(?:{_WIDE}++{_ascii(but)}*+)*+"


_NO_LETTER = "".join(chr(c) for c in range(0x20, 0x7F) if not (chr(c).isalnum() or chr(c) == "_"))
_WORD = _ascii(_NO_LETTER)
_KEY = rf"{_ascii(_NO_LETTER + '0123456789')}{_ascii(re.sub('[ .-]', '', _NO_LETTER))}*+(?<={_WORD})"
_ANOTHER_WORD = rf"(?=[-+.0-9TFnN~])(?:{OTHER_NUMBER}|{TRUE_WORDS}|{FALSE_WORDS}|{NULL_WORDS})\r?+\x01"
_NO_COLON_OR_HASH = _run("\"#:\\")
_PLAIN = (
    rf"(?!{_ANOTHER_WORD})(?:{_ascii(re.sub('[.$()+/;^~]', '', _NO_LETTER))}|-(?=[0-9A-Za-z.])|{_WIDE}){_NO_COLON_OR_HASH}"
    rf"(?:(?::(?=[^\x00-\x20])|(?<=[^ ])#){_NO_COLON_OR_HASH})*+(?<! )"
)
_LINE = (
    rf"(?md)^({_KEY}):(?: ++(?:({JSON_NUMBER}|true|false|null)\r?+\x01null\"|({_PLAIN})\r?+\x01null(\")"
    rf"|\"({_run('\"\\')})\"\r?+\x01null(\")|'({_run("\"'\\")})'\r?+\x01null(\"))"
    r"|(?: ~)?\r?+\x01(null)\")(,?+)\n?+"
)
_MEMBER = '"$1":$2$4$6$8$3$5$7$4$6$8$9$10'


def flat_to_json(text: Column) -> Column:
    """JSON object text of a block whose lines are all ``key: scalar``.

    For any other block the result is no valid JSON.
    """
    return F.concat(F.lit("{"), _flat_members(text, _marked(text)), F.lit("}"))


def _marked(text: Column) -> Column:
    return F.concat(F.replace(text, F.lit("\n"), F.lit(_END + ",\n")), F.lit(_END))


def _flat_members(text: Column, marked: Column) -> Column:
    """Members of that object; a line that is no ``key: scalar`` keeps its marker."""
    return F.when(text == "", "").otherwise(F.regexp_replace(marked, _LINE, _MEMBER))


def header_to_json(text: Column) -> Column:
    """JSON object text for ``key: text`` lines, every value kept as text."""
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    out = F.regexp_replace(out, r"[\x00-\x09\x0b-\x1f]", " ")
    out = F.regexp_replace(out, r"(?md)^ *([^:\n]*?) *: *([^\n]*?) *$", '"$1":"$2"')
    return F.concat(F.lit("{"), F.regexp_replace(F.trim(out, F.lit(" \n")), r"\n+", ","), F.lit("}"))


def with_yaml_fields(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out MAP<STRING,VARIANT>``, parsed from the YAML column ``text``.

    Text that is not a valid YAML mapping gives NULL.
    """
    members, n = f"{out}__members", f"{out}__n"
    df = with_yaml_members(df, text, members, n)
    # Two steps, so that the text is parsed once for the test and the value.
    df = df.withColumn(out, json_fields(F.concat(F.lit("{"), members, F.lit("}"))))
    return df.withColumn(out, F.when(F.size(out) == F.col(n), F.col(out))).drop(members, n)


def with_yaml_members(df: DataFrame, text: str, out: str, n: str) -> DataFrame:
    """Add ``out``, the members of a JSON object without its braces, and ``n``, their number, from the YAML column ``text``.

    Text that is no YAML mapping gives NULL.  A text of flat lines that repeats a key has more members than fields.
    """
    marked, flat, rest = f"{out}__marked", f"{out}__flat", f"{out}__rest"
    df = df.withColumn(marked, _marked(F.col(text)))
    # Sizes tell the number of lines; counting line ends would read the text again.
    lines = F.when(F.col(text) == "", 0).otherwise(((F.octet_length(marked) - F.octet_length(text) - len(_END)) / (len(_END) + 1)).cast("int") + 1)
    df = df.withColumns({flat: _flat_members(F.col(text), F.col(marked)), n: lines}).drop(marked)
    # A line that is not rewritten keeps its marker, and only such texts are parsed in Python.
    df = df.withColumn(rest, yaml_to_json(F.when(F.contains(flat, F.lit(_END[0])), F.col(text))))
    df = df.withColumn(rest, F.when(F.contains(flat, F.lit(_END[0])), F.coalesce(rest, F.lit(""))))
    inner = F.when(F.col(rest) != "", F.substring(rest, F.lit(2), F.length(rest) - 2))
    return df.withColumns({
        out: F.when(F.col(rest).isNull(), F.col(flat)).otherwise(inner),
        n: F.when(F.col(rest).isNull(), F.col(n)).otherwise(F.size(F.json_object_keys(rest))),
    }).drop(flat, rest)


def _flat_fields(text: Column) -> Column:
    """Fields of a block whose lines are all ``key: scalar``, each with a key of its own; NULL for any other."""
    fields = _as_map(F.try_parse_json(flat_to_json(text)))
    return F.when(F.size(fields) == _lines(text), fields)


def _lines(text: Column) -> Column:
    """Fields that a block of flat lines must have: the session may let JSON objects repeat a key, a block may not."""
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(text == "", 0).otherwise(1)


def json_fields(text: Column) -> Column:
    """JSON object text to ``MAP<STRING,VARIANT>``; anything but an object gives NULL."""
    return _as_map(F.try_parse_json(text))


def yaml_error(text: Column) -> Column:
    """Why a YAML text gives no fields; NULL for a text that does, or that is NULL."""
    rest = F.when(_flat_fields(text).isNull(), text)
    too_large = F.when(rest.isNotNull() & _as_map(F.try_parse_json(yaml_to_json(rest))).isNull(), "nested too deep or too large")
    return F.coalesce(_yaml_errors(rest), too_large)


def _as_map(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


yaml_to_json = F.arrow_udf(yaml_batch_to_json, StringType())
_yaml_errors = F.arrow_udf(yaml_batch_errors, StringType())
