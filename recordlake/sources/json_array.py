"""The elements of JSON files that each hold one array, read by many tasks.

Files are read as fragments that end with ``}``, which the text source can split anywhere.  What a fragment does depends on whether it
begins inside a string: so each fragment, and each split of a file, is summed up as three numbers: how it flips that state, and how it moves
the nesting depth from either state.  The flips before a split give its state, the depths before it its depth; from there every fragment
knows where it stands, and an element ends with a fragment that comes back to depth 1.  Only fragments of one element meet again.

No escape crosses a fragment's end: ``\\}`` is no JSON escape.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordlake.sources.notes import plain_path


def json_array_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``_note_file, _pos, element``: the objects of each array as JSON text, numbered within their file."""
    files = spark.read.format("text").option("lineSep", "}").load(path)
    rows = files.select(
        plain_path(F.col("_metadata.file_path")).alias("_note_file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("text"),
    )
    rows = rows.withColumns(_effects(F.col("text")))
    of_split = Window.partitionBy("_note_file", "split").orderBy("row")
    before = of_split.rowsBetween(Window.unboundedPreceding, -1)
    # The state in which a fragment begins, if its split begins outside any string.
    rows = rows.withColumn("state", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    rows = rows.withColumns({f"move{s}": F.when(F.col("state") == s, F.col("outside")).otherwise(F.col("inside")) for s in (0, 1)})
    rows = rows.withColumns({f"depth{s}": F.sum(f"move{s}").over(of_split.rowsBetween(Window.unboundedPreceding, 0)) for s in (0, 1)})
    starts = _split_starts(rows)
    placed = rows.join(starts, ["_note_file", "split"])
    begins = (F.col("state") + F.col("begin")) % 2
    depth = F.col("depth") + F.when(F.col("begin") == 0, F.col("depth0")).otherwise(F.col("depth1"))
    ends = ((begins + F.col("flips")) % 2 == 0) & (depth == 1)
    placed = placed.select("_note_file", "split", "row", "text", ends.cast("int").alias("ends"))
    return _assembled(placed)


def _effects(text: Column) -> dict[str, Column]:
    """Quotes of a fragment modulo 2, and the change of depth if it begins outside or inside a string, its closing brace included."""
    parts = F.split(F.regexp_replace(text, r"(?s)\\.", ""), '"')
    n = F.size(parts)

    def change(rest: int) -> Column:
        outside = F.array_join(F.filter(parts, lambda _, i: i % 2 == rest), "")
        opened = F.length(outside) - F.length(F.translate(outside, "{[", ""))
        closed = F.length(outside) - F.length(F.translate(outside, "}]", ""))
        return opened - closed - F.when((n - 1) % 2 == rest, 1).otherwise(0)

    return {"flips": (n - 1) % 2, "outside": change(0), "inside": change(1)}


def _split_starts(rows: DataFrame) -> DataFrame:
    """``_note_file, split, begin, depth``: state and depth with which each split begins.  One row per split."""
    splits = rows.groupBy("_note_file", "split").agg(F.sum("flips").alias("flips"), F.sum("move0").alias("move0"), F.sum("move1").alias("move1"))
    before = Window.partitionBy("_note_file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("begin", F.coalesce(F.sum("flips").over(before), F.lit(0)) % 2)
    moved = F.sum(F.when(F.col("begin") == 0, F.col("move0")).otherwise(F.col("move1"))).over(before)
    return splits.select("_note_file", "split", "begin", F.coalesce(moved, F.lit(0)).alias("depth"))


def _assembled(placed: DataFrame) -> DataFrame:
    """Fragments to elements, by the number of elements that ended before."""
    of_split = Window.partitionBy("_note_file", "split").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    inside = placed.withColumn("number", F.coalesce(F.sum("ends").over(of_split), F.lit(0)))
    counts = placed.groupBy("_note_file", "split").agg(F.sum("ends").alias("ended"))
    before = Window.partitionBy("_note_file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_note_file", "split", F.coalesce(F.sum("ended").over(before), F.lit(0)).alias("earlier"))
    numbered = inside.join(counts, ["_note_file", "split"]).withColumn("_pos", F.col("number") + F.col("earlier"))
    pieces = F.array_sort(F.collect_list(F.struct("split", "row", "text")))
    whole = numbered.groupBy("_note_file", "_pos").agg(pieces.alias("pieces"), F.max("ends").alias("ended"))
    text = F.concat(F.array_join(F.transform("pieces", lambda p: p["text"]), "}"), F.lit("}"))
    # What follows the last element is NULL, so that a condition moved below this filter meets no half element.
    element = F.when(F.col("ended") == 1, F.regexp_replace(text, r"\A[\s,\[\x{feff}]+", ""))
    return whole.filter("ended = 1").select("_note_file", "_pos", element.alias("element"))
