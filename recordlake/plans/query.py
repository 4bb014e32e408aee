"""The whole query: presets, SQL and file name, full text, in this order."""

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from recordlake.operators.extract import extract_records
from recordlake.operators.fulltext import FULLTEXT_FLAG, filter_fulltext, mark_fulltext
from recordlake.operators.layers import explode_field, merge_layers, normalize_arrays
from recordlake.operators.presets import active_expressions, apply_presets
from recordlake.operators.where import filter_filename, sql_where, widen

BINDER_FIELD = "binder"


@dataclass
class QueryResult:
    """Rows of a query.  Counts are there once an action has run on ``rows``."""

    rows: DataFrame
    error: str = ""
    _structured: Observation = field(default_factory=Observation)
    _shown: Observation = field(default_factory=Observation)

    @property
    def structured_count(self) -> int:
        """Rows before the full-text filter."""
        return self._structured.get["rows"]

    @property
    def shown_count(self) -> int:
        return self._shown.get["rows"]


def build_records(
    corpus: DataFrame,
    collections: DataFrame | None = None,
    mode: str = "all",
    header_block: bool = False,
    keep: Sequence[str] = (),
    array_fields: Sequence[str] = (),
) -> DataFrame:
    """Records of a corpus, merged with its collection index when there is one.

    ``keep`` names corpus columns to carry, which index records lack; ``array_fields`` become lists in both layers.
    """
    records = normalize_arrays(extract_records(corpus, mode, header_block, keep=keep), array_fields)
    if collections is None:
        return records
    index = normalize_arrays(collections, array_fields)
    return merge_layers(explode_field(records, BINDER_FIELD), explode_field(index, BINDER_FIELD), keep=keep)


def query(
    records: DataFrame,
    presets: Mapping[str, Sequence[str]] | None = None,
    active: Iterable[str] | None = None,
    where: str = "",
    filename: str = "",
    fulltext: str = "",
    corpus: DataFrame | None = None,
    array_fields: Sequence[str] = (),
    types: Mapping[str, str] | None = None,
    fields: Sequence[str] | None = None,
    infer_dates: bool = True,
    order_by: Sequence = (),
    on_error: str = "raise",
) -> QueryResult:
    """Typed rows of the records that pass every channel.

    All presets count when ``active`` is None.  ``types`` saves the job that infers the
    columns; ``fields`` names the columns and infers only those.  Full text needs the ``corpus``, unless the records carry ``_fulltext`` for
    this term.
    """
    presets = presets or {}
    expressions = active_expressions(presets, presets if active is None else active)
    chosen = apply_presets(normalize_arrays(records, array_fields), expressions)
    flagged = FULLTEXT_FLAG in records.columns
    wide = widen(chosen, types, infer_dates, keep=[FULLTEXT_FLAG] if flagged else [], fields=fields)
    # Before the clause, so that a LIMIT in it counts rows of the files asked for.
    wide = filter_filename(wide, filename)
    # A trailing ORDER BY of the clause survives the filters below.
    rows, message = sql_where(wide, where, "passthrough") if on_error == "passthrough" else (sql_where(wide, where), "")
    result = QueryResult(rows, message)
    rows = rows.observe(result._structured, F.count(F.lit(1)).alias("rows"))
    if fulltext.strip():
        if flagged:
            rows = rows.filter(F.col(FULLTEXT_FLAG))
        elif corpus is not None:
            rows = filter_fulltext(rows, corpus, fulltext)
        else:
            raise ValueError("full text needs the corpus")
    if flagged:
        rows = rows.drop(FULLTEXT_FLAG)
    rows = rows.observe(result._shown, F.count(F.lit(1)).alias("rows"))
    result.rows = rows.orderBy(*order_by) if order_by else rows
    return result


def query_corpus(corpus: DataFrame, fulltext: str = "", mode: str = "all", header_block: bool = False, **channels) -> QueryResult:
    """The same, straight from a corpus; full text is decided per note, without a join."""
    if not fulltext.strip():
        return query(extract_records(corpus, mode, header_block), **channels)
    records = extract_records(mark_fulltext(corpus, fulltext), mode, header_block, keep=[FULLTEXT_FLAG])
    return query(records, fulltext=fulltext, **channels)
