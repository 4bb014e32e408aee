"""Text around records: sections, compact contexts, digests."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordlake.functions.barrier import computed_once
from recordlake.functions.patterns import HEADED_FENCE
from recordlake.functions.text import is_note, right_trim
from recordlake.functions.values import display_text
from recordlake.operators.display import record_form
from recordlake.operators.extract import (
    BLOCKS_ONLY,
    FRONTMATTER_POSITION,
    extract_records,
    frontmatter_keys,
    with_frontmatter,
)
from recordlake.operators.sections import explode_sections

EVERY_BLOCK = 0  # fixed value: stands for a value that every block has


def fenced(frontmatter: Column) -> Column:
    """Frontmatter between its markers; NULL when there is none."""
    return F.when(frontmatter != "", F.concat(F.lit("---\n"), frontmatter, F.lit("\n---")))


def compact_text(frontmatter: Column, section: Column) -> Column:
    """Frontmatter and section, apart by a blank line."""
    return F.concat_ws("\n\n", fenced(frontmatter), F.when(section != "", section))


def extract_with_context(corpus: DataFrame, header_block: bool = False) -> DataFrame:
    """Records with ``context``, straight from the corpus: no join."""
    records = extract_records(corpus, header_block=header_block, sections=True)
    text = F.nullif(compact_text(F.col("_frontmatter"), F.col("_section")), F.lit(""))
    context = F.coalesce(text, record_form(F.col("fields"), F.col("_note_file")))
    return records.withColumn("context", context).drop("_frontmatter", "_section")


def note_sections(corpus: DataFrame, header_block: bool = False) -> DataFrame:
    """``_note_file, _pos, _frontmatter, _section`` of every block, and of every note at -1."""
    notes = with_frontmatter(corpus.filter(is_note(F.col("_note_file"))), header_block)
    sections = explode_sections(notes.select("_note_file", "_frontmatter", "_body")).filter(F.col("_pos").isNotNull())
    sections = sections.select("_note_file", F.col("_pos").cast("long").alias("_pos"), "_frontmatter", F.coalesce("_section", F.lit("")).alias("_section"))
    whole = notes.select(
        "_note_file", F.lit(FRONTMATTER_POSITION).cast("long").alias("_pos"), "_frontmatter", F.lit("").alias("_section")
    )
    return sections.unionByName(whole)


def attach_context(records: DataFrame, corpus: DataFrame, header_block: bool = False) -> DataFrame:
    """Add ``context``: the frontmatter of the record's note and the section of its block.

    Without either, the record form.  Only notes that have records are cut into
    sections, so ``records`` is read twice: pass stored ones.  For records fresh from a
    corpus ``extract_with_context`` needs no join.
    """
    sections = note_sections(_notes_of(records, corpus), header_block)
    joined = records.join(sections, ["_note_file", "_pos"], "left")
    text = F.nullif(compact_text(F.col("_frontmatter"), F.col("_section")), F.lit(""))
    context = F.coalesce(text, record_form(F.col("fields"), F.col("_note_file")))
    return joined.select(*records.columns, context.alias("context"))


def _notes_of(records: DataFrame, corpus: DataFrame, *hints: str) -> DataFrame:
    """The notes that have records, one row per path.

    Copies of a path are reduced to one in the map tasks, so that records do not meet
    each of them.
    """
    wanted = records.select("_note_file").distinct()
    for hint in hints:
        wanted = wanted.hint(hint)
    notes = corpus.join(wanted, "_note_file", "left_semi")
    return notes.groupBy("_note_file").agg(F.min("content").alias("content"))


def locate_blocks(records: DataFrame, corpus: DataFrame, header_block: bool = False) -> DataFrame:
    """Set ``_pos`` of records that lost it: the first block of their note that matches.

    A block matches on ``id``, unless it is missing or comes from the frontmatter; then on
    every other field that is neither null, metadata nor from the frontmatter.  Values
    compare as text; a missing value counts as empty text.  Records that match no block get NULL.

    Records of a note that test the same values are asked once.  They meet its blocks on their rarest tested value, and the
    blocks that have it are verified, so a note with many blocks and many sets of fields costs about its size.
    No side of a join is broadcast: texts and fields are much larger than Spark guesses from the files they are made of.
    """
    notes = _notes_of(records, corpus, "merge")
    keys = frontmatter_keys(notes, header_block)
    shown = F.transform_values(F.map_filter("fields", lambda k, v: ~F.coalesce(F.is_variant_null(v), F.lit(True))),
                               lambda _, v: display_text(v))
    own = F.map_filter(shown, lambda k, _: ~k.startswith("_") & ~F.array_contains("keys", k))
    by_id = F.map_filter(own, lambda k, _: k == "id")
    tested = F.when(F.size(by_id) > 0, by_id).otherwise(own)
    wanted = records.join(keys.hint("merge"), "_note_file", "left").withColumn("keys", F.coalesce("keys", F.array().cast("array<string>")))
    wanted = computed_once(wanted, "_tested", F.array_sort(F.map_entries(tested)))
    wanted = wanted.withColumn("_print", F.when(F.size("_tested") > 0, F.sha2(F.to_json("_tested"), 256)))
    asked = wanted.filter(F.col("_print").isNotNull()).groupBy("_note_file", "_print").agg(F.first("_tested").alias("_tested"))
    blocks = extract_records(notes, BLOCKS_ONLY, header_block).select(
        "_note_file", F.col("_pos").alias("_found"), F.transform_values("fields", lambda _, v: display_text(v)).alias("_shown")
    )
    first = _first_matches(asked, blocks)
    located = wanted.join(first.hint("merge"), ["_note_file", "_print"], "left")
    return located.select(*[F.col("_found").alias("_pos") if c == "_pos" else c for c in records.columns],
                          *(() if "_pos" in records.columns else (F.col("_found").alias("_pos"),)))


def _first_matches(asked: DataFrame, blocks: DataFrame) -> DataFrame:
    """``_note_file, _print, _found``: the first block that holds every tested value.

    An empty value is met by a block without the field too, so blocks cannot be looked up by it: records that test nothing
    else meet every block of their note.
    """
    holds = F.forall("_tested", lambda t: F.coalesce(F.col("_shown")[t["key"]], F.lit("")) == t["value"])
    pair = lambda e: F.xxhash64(e["key"], e["value"])
    every = F.array(F.lit(EVERY_BLOCK))
    by_value = F.transform(F.filter("_tested", lambda t: t["value"] != ""), pair)
    pairs = asked.select("_note_file", "_print", "_tested", F.posexplode(F.when(F.size(by_value) > 0, by_value).otherwise(every)).alias("_at", "_pair"))
    pairs = pairs.select("_note_file", "_pair", "_print", F.when(F.col("_at") == 0, F.col("_tested")).alias("_tested"))
    held = blocks.select("_note_file", "_found", "_shown", F.explode(F.concat(every, F.transform(F.map_entries("_shown"), pair))).alias("_pair"))
    rarity = held.groupBy("_note_file", "_pair").agg(F.count(F.lit(1)).alias("_blocks"))
    rated = pairs.join(rarity.hint("merge"), ["_note_file", "_pair"], "left")
    rarest = rated.groupBy("_note_file", "_print").agg(
        F.min(F.struct(F.coalesce("_blocks", F.lit(0)).alias("n"), F.col("_pair").alias("pair"))).alias("_best"), F.first("_tested", ignorenulls=True).alias("_tested")
    )
    rarest = rarest.filter(F.col("_best.n") > 0).select("_note_file", "_print", "_tested", F.col("_best.pair").alias("_pair"))
    met = rarest.join(held.hint("merge"), ["_note_file", "_pair"]).filter(holds)
    return met.groupBy("_note_file", "_print").agg(F.min("_found").alias("_found"))


def compact_digest(corpus: DataFrame, tasks_heading: str = "Tasks", header_block: bool = False) -> DataFrame:
    """``_note_file, digest``: frontmatter, blocks with their headings, and the task section.

    A heading counts when only blank lines part it from the block.  The task section ends
    at the next second-level heading; the last one of several is used.
    """
    notes = with_frontmatter(corpus, header_block)
    heads = F.regexp_extract_all("_body", F.lit(HEADED_FENCE), F.lit(1))
    fences = F.regexp_extract_all("_body", F.lit(HEADED_FENCE), F.lit(2))
    blocks = F.zip_with(heads, fences, lambda h, f: F.when(h != "", F.concat(h, F.lit("\n"), f)).otherwise(f))
    digest = F.concat_ws("\n\n", fenced(F.col("_frontmatter")), blocks, _task_section(tasks_heading))
    return notes.select("_note_file", digest.alias("digest"))


def _task_section(heading: str) -> Column:
    word_end = r"(?![0-9A-Za-z_])" if re.search(r"[0-9A-Za-z_]$", heading) else r"(?=[0-9A-Za-z_])"
    pattern = rf"(?msd)^(## {re.escape(heading)}{word_end}.*?)(?=^## |\z)"
    sections = F.regexp_extract_all("_body", F.lit(pattern), F.lit(1))
    return F.when(F.size(sections) > 0, right_trim(F.element_at(sections, -1)))
