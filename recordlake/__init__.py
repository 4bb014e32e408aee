"""Structured records inside text files, as Spark DataFrames."""

from recordlake.functions.text import note_stem, sanitize_text, source_type
from recordlake.functions.values import cell_text, display_text
from recordlake.operators.context import attach_context, compact_digest, extract_with_context, locate_blocks
from recordlake.operators.display import record_form, select_columns, source_column
from recordlake.operators.extract import bad_blocks, extract_records, frontmatter_keys, with_frontmatter
from recordlake.operators.fulltext import filter_fulltext, mark_fulltext
from recordlake.operators.layers import explode_field, merge_layers, normalize_arrays, union_layers
from recordlake.operators.presets import active_expressions, apply_presets, preset_condition
from recordlake.operators.profile import column_profile, field_keys, fitting_columns, shown_columns, top_columns
from recordlake.operators.tasks import filter_tasks, flatten_tasks, format_tasks, task_location
from recordlake.operators.textindex import filter_fulltext_indexed, matching_notes_indexed, write_text_index
from recordlake.operators.where import column_types, combine, filter_filename, is_complete, sql_where, where_field, where_form, widen
from recordlake.plans.query import QueryResult, build_records, query, query_corpus
from recordlake.sources.jsonl import bad_lines, parse_jsonl, read_collections, read_jsonl, read_lines
from recordlake.sources.notes import read_corpus
from recordlake.sources.refresh import changed_notes, current_records, refresh
from recordlake.sources.store import read_records, snapshot, stored_profile, write_csv, write_json_lines, write_records
from recordlake.sources.task_index import read_task_index

__all__ = [name for name in dir() if not name.startswith("_")]
