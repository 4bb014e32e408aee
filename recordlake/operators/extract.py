"""Records from note texts: frontmatter, header block, fenced YAML blocks."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions.barrier import computed_once
from recordlake.functions.patterns import BLANK_FIRST_LINE, FENCE, HEADER_BLOCK
from recordlake.functions.text import is_note, source_type
from recordlake.functions.values import is_null
from recordlake.functions.yaml_fields import header_to_json, json_fields, with_yaml_fields, with_yaml_members, yaml_error
from recordlake.operators.sections import explode_sections

ALL, FRONTMATTER, BLOCKS_ONLY = "all", "frontmatter", "blocks_only"
RECORD_COLUMNS = ("_note_file", "_source_type", "_layer", "_pos", "fields")
FRONTMATTER_POSITION = -1


def with_frontmatter(corpus: DataFrame, header_block: bool = False) -> DataFrame:
    """Add ``_frontmatter`` (empty when there is none) and ``_body``.

    Frontmatter ends at the next ``---`` anywhere after the opening one.  With
    ``header_block``, a text without frontmatter may open with ``key: value`` lines.
    """
    content = F.col("content")
    df = corpus.withColumn("_rest", F.when(content.startswith("---"), _from(content, F.lit(4))))
    df = df.withColumn("_front", F.substring_index("_rest", "---", 1))
    split = F.coalesce(F.col("_front") != F.col("_rest"), F.lit(False))
    frontmatter = F.when(split, F.trim(F.col("_front"), F.lit("\n"))).otherwise("")
    body = F.when(split, _from(F.col("_rest"), F.length("_front") + 4)).otherwise(content)
    if not header_block:
        return df.withColumns({"_frontmatter": frontmatter, "_body": body}).drop("_rest", "_front")
    header = F.when(split, "").otherwise(F.regexp_extract(content, HEADER_BLOCK, 1))
    df = df.withColumns({"_frontmatter": frontmatter, "_body": body, "_header": header})
    is_header = F.col("_header") != ""
    after = F.regexp_replace(_from(content, F.length("_header") + 1), BLANK_FIRST_LINE, "")
    return df.withColumns(
        {
            "_frontmatter": F.when(is_header, F.rtrim(F.col("_header"), F.lit("\n"))).otherwise(F.col("_frontmatter")),
            "_body": F.when(is_header, after).otherwise(F.col("_body")),
            "_is_header": is_header,
        }
    ).drop("_rest", "_front", "_header")


def _from(text: Column, position: Column) -> Column:
    return F.substring(text, position, F.lit((1 << 31) - 1))


def frontmatter_keys(corpus: DataFrame, header_block: bool = False) -> DataFrame:
    """``_note_file, keys``: the keys of every note's frontmatter or header block."""
    df = _with_frontmatter_fields(with_frontmatter(corpus, header_block), header_block)
    no_keys = F.array().cast("array<string>")
    return df.select("_note_file", F.coalesce(F.map_keys("_frontmatter_fields"), no_keys).alias("keys"))


def extract_records(
    corpus: DataFrame,
    mode: str = ALL,
    header_block: bool = False,
    sections: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One record per YAML block, combined with the frontmatter of its note.

    ``corpus`` has ``_note_file`` and ``content``.  A note without blocks gives one
    frontmatter record at ``_pos`` -1.  ``mode`` is ``all``, ``frontmatter`` or
    ``blocks_only``; anything else means ``all``.  ``sections`` adds ``_section``, the
    text around the block, and ``_frontmatter``.  ``keep`` names corpus columns to carry.

    A block key wins over the frontmatter key.  Invalid YAML contributes no field, and a
    record without any field is left out.
    """
    kept = [*keep, *(("_frontmatter", "_section") if sections else ())]
    df = with_frontmatter(corpus.filter(is_note(F.col("_note_file"))), header_block)
    if sections:
        df = df.withColumn("_frontmatter_text", F.col("_frontmatter"))
    if mode == FRONTMATTER:
        df = df.withColumns({"_pos": F.lit(FRONTMATTER_POSITION), "_section": F.lit("")})
        df = _with_frontmatter_fields(df, header_block)
        fields = F.col("_frontmatter_fields")
    else:
        together = mode != BLOCKS_ONLY and not header_block
        if together:
            df = with_yaml_members(df, "_frontmatter", "_frontmatter_members", "_frontmatter_n")
        elif mode != BLOCKS_ONLY:
            df = _with_frontmatter_fields(df, header_block)
        df = explode_sections(df) if sections else _explode_blocks(df)
        if together:
            df, fields = _with_fields_together(df)
        else:
            df = with_yaml_fields(df, "_block", "_block_fields")
            fields = F.col("_block_fields")
            if mode != BLOCKS_ONLY:
                fields = overlay(fields, F.col("_frontmatter_fields"))
    if sections:
        df = df.withColumns({"_frontmatter": F.col("_frontmatter_text"), "_section": F.coalesce("_section", F.lit(""))})
    df = computed_once(df, "fields", fields)
    return df.filter(F.size("fields") > 0).select(
        "_note_file",
        source_type(F.col("_note_file")).alias("_source_type"),
        F.lit("annotation").alias("_layer"),
        F.coalesce(F.col("_pos"), F.lit(FRONTMATTER_POSITION)).cast("long").alias("_pos"),
        "fields",
        *kept,
    )


def bad_blocks(corpus: DataFrame, header_block: bool = False) -> DataFrame:
    """``_note_file, _pos, error, text``: frontmatter (at -1) and blocks that ``extract_records`` gets no field from because they are no
    valid YAML mapping, repeat a key, or are nested too deep."""
    notes = with_frontmatter(corpus.filter(is_note(F.col("_note_file"))), header_block)
    front = F.col("_frontmatter")
    if header_block:  # a header block that is no YAML is read as lines of text
        front = F.when(F.col("_is_header"), "").otherwise(front)
    blocks = F.regexp_extract_all("_body", F.lit(FENCE), F.lit(1))
    parts = F.concat(F.array(front), blocks)
    each = notes.select("_note_file", F.posexplode(parts).alias("_at", "text"))
    each = each.withColumn("error", yaml_error(F.col("text")))
    each = each.select("_note_file", (F.col("_at") + FRONTMATTER_POSITION).cast("long").alias("_pos"), "error", "text")
    return each.filter(F.col("error").isNotNull())


def overlay(upper: Column, lower: Column, fill_nulls: bool = False) -> Column:
    """Both maps in one; keys of ``upper`` win (or only its non-null values do)."""

    def pick(_, u, low):
        return F.when(is_null(u), F.coalesce(low, u)).otherwise(u) if fill_nulls else F.coalesce(u, low)

    zipped = F.map_zip_with(upper, lower, pick)
    # Most maps share no key; those are put together without a function call for each of their keys.
    both = F.when(F.arrays_overlap(F.map_keys(upper), F.map_keys(lower)), zipped).otherwise(F.map_concat(upper, lower))
    return F.when(upper.isNull(), lower).when(lower.isNull(), upper).otherwise(both)


def _with_fields_together(df: DataFrame) -> tuple[DataFrame, Column]:
    """Fields of a block over those of its frontmatter.

    The members of both are parsed as one object.  Only where that has fewer fields than members, since a key is in both or is repeated,
    each is parsed on its own.
    """
    df = with_yaml_members(df, "_block", "_block_members", "_block_n")
    lower, upper = F.col("_frontmatter_members"), F.col("_block_members")
    empty = F.lit("")
    members = F.concat_ws(",", F.nullif(lower, empty), F.nullif(upper, empty))
    df = df.withColumn("_together", json_fields(F.concat(F.lit("{"), members, F.lit("}"))))
    n = F.coalesce("_frontmatter_n", F.lit(0)) + F.coalesce("_block_n", F.lit(0))
    apart = F.coalesce(F.size("_together") != n, F.lit(True))
    df = df.withColumns({
        "_together": F.when(~apart, F.col("_together")),
        "_lower": json_fields(F.when(apart, F.concat(F.lit("{"), lower, F.lit("}")))),
        "_upper": json_fields(F.when(apart, F.concat(F.lit("{"), upper, F.lit("}")))),
    })
    df = df.withColumns({
        "_lower": F.when(F.size("_lower") == F.col("_frontmatter_n"), F.col("_lower")),
        "_upper": F.when(F.size("_upper") == F.col("_block_n"), F.col("_upper")),
    })
    return df, F.coalesce(F.col("_together"), overlay(F.col("_upper"), F.col("_lower")))


def _with_frontmatter_fields(df: DataFrame, header_block: bool) -> DataFrame:
    df = with_yaml_fields(df, "_frontmatter", "_frontmatter_fields")
    if not header_block:
        return df
    as_text = F.when(F.col("_is_header"), json_fields(header_to_json(F.col("_frontmatter"))))
    return df.withColumn("_frontmatter_fields", F.coalesce("_frontmatter_fields", as_text))


def _explode_blocks(df: DataFrame) -> DataFrame:
    blocks = F.regexp_extract_all("_body", F.lit(FENCE), F.lit(1))
    rest = [c for c in df.columns if c not in ("content", "_body")]
    return df.select(*rest, F.posexplode_outer(blocks).alias("_pos", "_block"))
