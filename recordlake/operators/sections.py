"""The text section around every YAML block of a note.

The text is cut into pieces at headings and fences inside the JVM.  Only the kinds of the
pieces, small integers, go to Python, where one pass finds where each section ends.
Sections are exploded before their blocks, so no row holds a section more than once.
"""

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from recordlake.functions.patterns import BEFORE_HEADING, FENCE, FENCE_OR_RUN, HEADING_MARKS, STARTS_WITH_FENCE
from recordlake.functions.text import right_trim

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FENCE_PIECE = -1
_SPAN_FIELDS = ("first", "end", "from_block", "blocks")
_SPANS = ArrayType(StructType([StructField(name, IntegerType()) for name in _SPAN_FIELDS]))


def explode_sections(df: DataFrame) -> DataFrame:
    """One row per block of ``_body``, with ``_pos``, ``_block`` and ``_section``.

    A section runs from the nearest heading above the block to the next heading of the
    same or a higher level, or over the whole text when there is no heading above.
    Notes without blocks keep one row with NULLs.
    """
    tokens = F.regexp_extract_all("_body", F.lit(FENCE_OR_RUN), F.lit(0))
    pieces = F.flatten(F.transform(tokens, lambda t: F.split(t, BEFORE_HEADING)))
    blocks = F.regexp_extract_all("_body", F.lit(FENCE), F.lit(1))
    rest = [c for c in df.columns if c not in ("content", "_body")]
    df = df.select(*rest, pieces.alias("_pieces"), blocks.alias("_blocks"))
    kinds = F.transform(
        "_pieces",
        lambda p: F.when(p.rlike(STARTS_WITH_FENCE), FENCE_PIECE).otherwise(
            F.length(F.regexp_extract(p, HEADING_MARKS, 1))
        ),
    )
    df = df.withColumn("_spans", section_spans(F.when(F.size("_blocks") > 0, kinds)))
    sections = F.transform(
        "_spans",
        lambda s: F.struct(
            right_trim(F.array_join(F.slice("_pieces", s["first"] + 1, s["end"] - s["first"]), "")).alias("text"),
            s["from_block"].alias("from_block"),
            F.slice("_blocks", s["from_block"] + 1, s["blocks"]).alias("blocks"),
        ),
    )
    df = df.select(*rest, F.explode_outer(sections).alias("_s"))
    df = df.select(
        *rest,
        F.col("_s.text").alias("_section"),
        F.col("_s.from_block").alias("_from"),
        F.posexplode_outer("_s.blocks").alias("_nth", "_block"),
    )
    return df.withColumn("_pos", F.col("_from") + F.col("_nth")).drop("_from", "_nth")


def spans_of(kinds: list[int]) -> list[dict]:
    """Section bounds, as piece numbers, for the runs of blocks under one heading.

    ``kinds`` holds -1 for a fence, the level for a heading, 0 for other text.
    """
    ends, open_headings = {}, []
    for i, level in enumerate(kinds):
        if level > 0:
            while open_headings and kinds[open_headings[-1]] >= level:
                ends[open_headings.pop()] = i
            open_headings.append(i)
    spans, heading, n_blocks = [], None, 0
    for i, kind in enumerate(kinds):
        if kind > 0:
            heading = i
        elif kind == FENCE_PIECE:
            if spans and spans[-1]["heading"] == heading:
                spans[-1]["blocks"] += 1
            else:
                end = len(kinds) if heading is None else ends.get(heading, len(kinds))
                spans.append({"heading": heading, "first": heading or 0, "end": end, "from_block": n_blocks, "blocks": 1})
            n_blocks += 1
    return [{name: span[name] for name in _SPAN_FIELDS} for span in spans]


def _spans_batch(kinds: pa.Array) -> pa.Array:
    ints = pa.list_(pa.struct([(name, pa.int32()) for name in _SPAN_FIELDS]))
    return pa.array([spans_of(k or []) for k in kinds.to_pylist()], ints)


section_spans = F.arrow_udf(_spans_batch, _SPANS)
