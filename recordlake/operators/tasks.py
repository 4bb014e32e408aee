"""Task lists of notes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions.text import contains_ignoring_case, note_stem
from recordlake.functions.values import is_null, number_text

# What marks a task as done or closed.
DONE_STATUS, DONE_TAG = "x", "done"
CLOSED_STATUSES = (">", "-")
CLOSED_TAGS = ("deferred", "cancelled")


def flatten_tasks(index: DataFrame) -> DataFrame:
    """One row per task, with the project and file of its note."""
    tasks = index.select("project", "file", F.explode("tasks").alias("t"))
    return tasks.select(
        F.col("t.line").alias("line"),
        F.coalesce("t.status", F.lit("")).alias("status"),
        F.col("t.tags").alias("tags"),
        F.col("t.task").alias("text"),
        "project",
        "file",
    )


def has_tag(tag: str) -> Column:
    """The tag is present, whatever its value."""
    return F.coalesce(F.map_contains_key("tags", tag), F.lit(False))


def is_done() -> Column:
    return (F.col("status") == DONE_STATUS) | has_tag(DONE_TAG)


def is_closed() -> Column:
    closed = is_done() | F.col("status").isin(*CLOSED_STATUSES)
    for tag in CLOSED_TAGS:
        closed = closed | has_tag(tag)
    return closed


def filter_tasks(tasks: DataFrame, search: str = "", tag: str = "", project: str = "", done: bool = False) -> DataFrame:
    """Open tasks, or done ones.  Deferred and cancelled tasks are in neither set."""
    tasks = tasks.filter(is_done() if done else ~is_closed())
    if tag:
        tasks = tasks.filter(has_tag(tag))
    if project:
        tasks = tasks.filter(contains_ignoring_case(F.col("project"), project))
    if search:
        tasks = tasks.filter(contains_ignoring_case(F.col("text"), search))
    return tasks


def tag_text(tags: Column) -> Column:
    """``@k`` for a tag that is true, else ``@k(value)``; sorted, two spaces apart."""

    def one(k: Column) -> Column:
        value = tags[k]
        is_true = F.coalesce(F.try_variant_get(value, "$", "string") == "true", F.lit(False)) & (
            F.schema_of_variant(value) == "BOOLEAN"
        )
        text = F.when(is_null(value), "").otherwise(number_text(value))
        return F.when(is_true, F.concat(F.lit("@"), k)).otherwise(F.concat(F.lit("@"), k, F.lit("("), text, F.lit(")")))

    return F.coalesce(F.array_join(F.transform(F.array_sort(F.map_keys(tags)), one), "  "), F.lit(""))


def format_tasks(tasks: DataFrame) -> DataFrame:
    """Display rows ``Task, Project, Tags, Note``."""
    marked = F.when(F.col("status") != "", F.concat(F.lit("["), "status", F.lit("] "), "text"))
    return tasks.select(
        marked.otherwise(F.col("text")).alias("Task"),
        F.col("project").alias("Project"),
        tag_text(F.col("tags")).alias("Tags"),
        note_stem(F.col("file")).alias("Note"),
    )


def task_location() -> Column:
    """``file:line``, or the file alone when the line is not known."""
    return F.when(F.col("line") > 0, F.concat_ws(":", "file", F.col("line").cast("string"))).otherwise(F.col("file"))
