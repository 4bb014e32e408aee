"""Built-in expressions over paths and texts."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordlake.functions.patterns import TRAILING_SPACE

# Source types by lower-cased file extension.
MARKDOWN_EXTENSIONS = ("", ".md", ".markdown")
TYPST_EXTENSIONS = (".typ", ".typst")
JSONL_EXTENSIONS = (".jsonl",)
_NOTE_NAME = r"(?i)(?:^|/)[^/.]*\z|\.(?:md|markdown|typ|typst)\z"

# Invisible characters that sanitising removes.
_INVISIBLE = (
    r"[\x00-\x08\x0b-\x1a\x1c-\x1f\x7f-\x9f\x{ad}\x{feff}"
    r"\x{200b}-\x{200f}\x{2028}-\x{202e}\x{2060}-\x{2064}]"
)


def base_name(path: Column) -> Column:
    """Last segment of a path."""
    return F.element_at(F.split(path, "/"), -1)


def extension(path: Column) -> Column:
    """Last extension with its dot, as written; empty when there is none."""
    return F.regexp_extract(base_name(path), r"(\.[^.]*)$", 1)


def note_stem(path: Column) -> Column:
    """Base name without its last extension."""
    return F.regexp_replace(base_name(path), r"\.[^.]*$", "")


def source_type(path: Column) -> Column:
    """``markdown``, ``typst``, ``jsonl`` or ``other``; no extension means markdown."""
    ext = F.lower(extension(path))
    return (
        F.when(ext.isin(*MARKDOWN_EXTENSIONS), "markdown")
        .when(ext.isin(*TYPST_EXTENSIONS), "typst")
        .when(ext.isin(*JSONL_EXTENSIONS), "jsonl")
        .otherwise("other")
    )


def is_note(path: Column) -> Column:
    """Source type is markdown or typst."""
    return path.endswith(".md") | path.rlike(_NOTE_NAME)  # most notes need no pattern


def sanitize_text(text: Column) -> Column:
    """Tabs become spaces; control, zero-width and direction characters are dropped."""
    return F.regexp_replace(F.translate(text, "\t", " "), _INVISIBLE, "")


def right_trim(text: Column) -> Column:
    return F.rtrim(text, F.lit(TRAILING_SPACE))


def contains_ignoring_case(text: Column, term: str) -> Column:
    return F.contains(F.lower(text), F.lit(term.lower()))


def like_pattern(term: str) -> str:
    """``%term%``, with backslashes kept as ordinary characters."""
    return "%" + term.replace("\\", "\\\\") + "%"
