"""The queries.  Each takes ``(spark, sf_dir)`` and returns a table of plain types."""

from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

import recordlake as rl
from recordlake.functions.kinds import column_type
from recordlake.operators import profile as profiles
from recordlake.operators.skew import MIN_ROWS
from recordlake.operators.tasks import is_closed, is_done
from recordlake.sources.notes import within_depth
from recordlake.sources.store import as_json_lines
from recordlake.streaming.ingest import merged_records, store_index, write_batch
from workload import tables as t
from workload.files import scratch, write_text_files

ORDER_TYPES = {
    "order_id": "bigint", "status": "string", "priority": "string", "odate": "date", "kind": "string",
    "total": "double", "customer": "bigint", "tags": "array<string>",
}


def order_rows(records: DataFrame) -> DataFrame:
    wide = rl.widen(records, ORDER_TYPES)
    return wide.select(
        F.col("_note_file").alias("note_file"), F.col("_source_type").alias("source_type"), F.col("_pos").alias("pos"),
        "order_id", "status", "priority", "odate", "kind", "total", "customer", F.array_join("tags", ",").alias("tags"),
    )


def extract(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    return order_rows(rl.extract_records(t.order_notes(spark, sf_dir), mode))


LINE_COLUMNS = ("order_id", "line", "status", "shipped", "kind", "qty", "price", "flag")


def line_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.extract_records(t.line_notes(spark, sf_dir))


def preset(spark: SparkSession, sf_dir: str, *expressions: str) -> DataFrame:
    chosen = rl.apply_presets(line_records(spark, sf_dir), expressions)
    return rl.widen(chosen, t.LINE_TYPES).select(*LINE_COLUMNS)


def where(spark: SparkSession, sf_dir: str, clause: str) -> DataFrame:
    wide = rl.widen(line_records(spark, sf_dir), t.LINE_TYPES)
    return rl.sql_where(wide, clause).select(*LINE_COLUMNS)


def where_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column types come from the records, not from the caller."""
    records = line_records(spark, sf_dir)
    return rl.sql_where(rl.widen(records), "status = 'F' AND qty > 30 AND shipped > '1997-01-01'").select(*LINE_COLUMNS)


def form(spark: SparkSession, sf_dir: str, field: str, op: str, value: str = "") -> DataFrame:
    wide = rl.widen(line_records(spark, sf_dir), t.LINE_TYPES)
    return wide.filter(rl.where_field(wide, field, op, value)).select(*LINE_COLUMNS)


def filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = rl.widen(rl.filter_filename(line_records(spark, sf_dir), " lines/R "), t.LINE_TYPES)
    return rl.sql_where(wide, "qty < 10").select(*LINE_COLUMNS)


def fulltext(spark: SparkSession, sf_dir: str) -> DataFrame:
    corpus = t.prose_notes(spark, sf_dir)
    found = rl.filter_fulltext(rl.extract_records(corpus), corpus, "  ÉTION ")
    return rl.widen(found, {"doc": "bigint", "lang": "string"}).select("doc", "lang")


def fulltext_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows before and after the full-text filter, in one pass over the notes."""
    marked = rl.mark_fulltext(t.prose_notes(spark, sf_dir), "lang: de")
    records = rl.extract_records(marked, keep=["_fulltext"])
    return records.agg(F.count(F.lit(1)).alias("structured"), F.count_if("_fulltext").alias("shown"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Presets, SQL, file name and full text in one query."""
    result = rl.query_corpus(
        t.prose_notes(spark, sf_dir),
        fulltext="ation",
        presets={"english": ["lang=en"], "german": ["lang=de"]},
        active=["english"],
        where='"chars" >= 400 ORDER BY chars DESC',
        filename="src1",
    )
    return result.rows.select("doc", "lang", "chars")


def depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = t.order_notes(spark, sf_dir).unionByName(t.header_notes(spark, sf_dir))
    return notes.filter(within_depth(F.col("_note_file"), "/notes", 1)).select(F.col("_note_file").alias("note_file"))


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source type, stem and base name of page addresses."""
    url = F.col("url")
    return t.table(spark, sf_dir, "pages").select(
        "page_id", rl.source_type(url).alias("source_type"), rl.note_stem(url).alias("stem"),
        rl.source_column(url),
    )


def explode_binder(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = rl.explode_field(rl.parse_jsonl(t.customer_lines(spark, sf_dir)), "binder")
    return rl.widen(members, {"id": "bigint", "binder": "string", "name": "string"}).select("id", "binder", "name")


def merge(spark: SparkSession, sf_dir: str, hot_key_rows: int = MIN_ROWS) -> DataFrame:
    annotations = rl.explode_field(rl.extract_records(t.annotation_notes(spark, sf_dir)), "binder")
    index = rl.explode_field(rl.parse_jsonl(t.customer_lines(spark, sf_dir)), "binder")
    merged = rl.merge_layers(annotations, index, hot_key_rows=hot_key_rows)
    types = {"id": "bigint", "binder": "string", "name": "string", "acctbal": "double", "status": "string"}
    return rl.widen(merged, types).select(F.col("_note_file").alias("note_file"), *types)


def merge_by_binder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merge on the binder alone: few keys, each with very many annotations."""
    annotations = rl.explode_field(rl.extract_records(t.annotation_notes(spark, sf_dir)), "binder")
    index = rl.explode_field(rl.parse_jsonl(t.customer_lines(spark, sf_dir)), "binder")
    merged = rl.merge_layers(annotations, index, keys=["binder"], hot_key_rows=100)
    types = {"id": "bigint", "binder": "string", "name": "string"}
    return rl.widen(merged, types).select(F.col("_note_file").alias("note_file"), *types)


def union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers with different fields in one table."""
    both = rl.union_layers(
        rl.parse_jsonl(t.customer_lines(spark, sf_dir)), rl.parse_jsonl(t.event_lines(spark, sf_dir))
    )
    return rl.widen(both, {"id": "bigint", "k": "bigint", "name": "string"}).select("id", "k", "name")


def array_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = rl.normalize_arrays(rl.parse_jsonl(t.mixed_lines(spark, sf_dir)), ["who", "tags"])
    wide = rl.widen(records, {"id": "bigint", "who": "array<string>", "tags": "array<string>"})
    return wide.select("id", F.array_join("who", "|").alias("who"),
                       F.size("who").cast("bigint").alias("n_who"), F.array_join("tags", "|").alias("tags"))


def json_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.widen(rl.parse_jsonl(t.event_lines(spark, sf_dir))).select(F.col("_pos").alias("event_id"), "k")


def mixed_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates, lists and a field of mixed type, all inferred."""
    wide = rl.widen(rl.parse_jsonl(t.mixed_lines(spark, sf_dir)))
    return wide.select("id", "amount", "day", F.array_join("tags", "+").alias("tags"), "who")


def strict_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = rl.parse_jsonl(t.customer_lines(spark, sf_dir), strict=True)
    return rl.widen(records, {"id": "bigint", "acctbal": "double"}).select("id", "acctbal")


def json_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON lines, read back as records."""
    lines = as_json_lines(rl.parse_jsonl(t.customer_lines(spark, sf_dir))).select(
        F.lit("out.jsonl").alias("_note_file"), F.lit(0).alias("_pos"), F.col("value").alias("line")
    )
    back = rl.widen(rl.parse_jsonl(lines), {"id": "bigint", "name": "string", "binder": "array<string>"})
    return back.select("id", "name", F.array_join("binder", "/").alias("binder"))


def fill_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    profile = rl.column_profile(rl.parse_jsonl(t.mixed_lines(spark, sf_dir)), rate=True)
    return profile.select("key", "present", "non_null", "fill_rate", "column_type")


def field_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.field_keys(rl.extract_records(t.order_notes(spark, sf_dir)))


def best_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns that fit 50 characters, the best filled first."""
    profile = rl.column_profile(rl.parse_jsonl(t.mixed_lines(spark, sf_dir)))
    return profiles.fitting_columns(profile, budget=50, widths={"who": 10}).select("key", "non_null", F.col("rank").cast("bigint").alias("rank"))


def section_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = rl.extract_with_context(t.order_notes(spark, sf_dir))
    return records.select(F.col("_note_file").alias("note_file"), F.col("_pos").alias("pos"), "context")


def context_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context for the records of urgent orders only."""
    corpus = t.order_notes(spark, sf_dir)
    chosen = rl.apply_presets(rl.extract_records(corpus), ["priority^1-", "kind=delivery"])
    return rl.attach_context(chosen, corpus).select(F.col("_note_file").alias("note_file"), "context")


def block_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that lost their position find their block again."""
    corpus = t.order_notes(spark, sf_dir)
    found = rl.locate_blocks(rl.extract_records(corpus).drop("_pos"), corpus)
    return found.select(F.col("_note_file").alias("note_file"), F.col("_pos").alias("pos"),
                        F.try_variant_get(F.col("fields")["kind"], "$", "string").alias("kind"))


def digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.compact_digest(t.order_notes(spark, sf_dir)).select(F.col("_note_file").alias("note_file"), "digest")


def header_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = rl.extract_records(t.header_notes(spark, sf_dir), header_block=True)
    wide = rl.widen(records, {"Name": "string", "Account no": "bigint", "Balance": "double"})
    return wide.select(F.col("Name").alias("name"), F.col("Account no").alias("account_no"), F.col("Balance").alias("balance"))


def sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    soft_hyphen, zero_width = chr(0xAD), chr(0x200B)
    soiled = F.replace("text", F.lit("e "), F.lit(soft_hyphen + "e\t"))
    soiled = F.replace(soiled, F.lit("a"), F.lit(zero_width + "a\r"))
    return t.table(spark, sf_dir, "documents").select("doc_id", rl.sanitize_text(soiled).alias("clean"))


def forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = rl.parse_jsonl(t.customer_lines(spark, sf_dir))
    return records.select(F.col("_pos").alias("id"), rl.record_form(F.col("fields"), F.col("_note_file")).alias("form"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.select_columns(rl.parse_jsonl(t.mixed_lines(spark, sf_dir)), ["id", "amount", "tags", "who"])


def shown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as shown: columns chosen by fill rate within a width."""
    records = rl.parse_jsonl(t.mixed_lines(spark, sf_dir))
    columns, _ = rl.shown_columns(profiles.collect_profile(records), budget=70, lead_width=20)
    return rl.select_columns(records, columns)


def tasks(spark: SparkSession, sf_dir: str, **filters) -> DataFrame:
    chosen = rl.filter_tasks(rl.flatten_tasks(t.task_index(spark, sf_dir)), **filters)
    rows = rl.format_tasks(chosen)
    return rows.select(F.col("Task").alias("task"), F.col("Project").alias("project"), F.col("Tags").alias("tags"), F.col("Note").alias("note"))


def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = rl.flatten_tasks(t.task_index(spark, sf_dir))
    return flat.select(rl.task_location().alias("location"), "status", is_done().alias("done"), is_closed().alias("closed"))


def task_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = rl.flatten_tasks(t.task_index(spark, sf_dir))
    return flat.agg(F.count_if(~is_closed()).alias("pending"), F.count_if(is_done()).alias("done"))


def stored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rl.snapshot(line_records(spark, sf_dir), scratch(spark, "records"))


def store_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL on stored records: the scan reads typed columns only."""
    clause = "status = 'F' AND qty > 30 AND shipped > '1997-01-01'"
    return rl.query(stored_lines(spark, sf_dir), where=clause).rows.select(*LINE_COLUMNS)


def store_preset(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = rl.query(stored_lines(spark, sf_dir), {"open": ["status=O", "flag!A"], "old": ["shipped^1996"]}, where="line <= 2")
    return result.rows.select(*LINE_COLUMNS)


def store_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store knows of its fields, without reading its records."""
    path = scratch(spark, "records")
    rl.snapshot(rl.parse_jsonl(t.mixed_lines(spark, sf_dir)), path)
    return rl.stored_profile(spark, path).select("key", "present", "non_null", column_type(F.col("flags")).alias("column_type"))


def where_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the named fields are inferred."""
    wide = rl.widen(line_records(spark, sf_dir), fields=LINE_COLUMNS)
    return rl.sql_where(wide, "status = 'F' AND qty > 30 AND shipped > '1997-01-01'").select(*LINE_COLUMNS)


def where_bad_cast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A clause that fails on the data leaves all rows and says why."""
    wide = rl.widen(line_records(spark, sf_dir), {"order_id": "bigint", "status": "string"})
    rows, message = rl.sql_where(wide, "status > 1", on_error="passthrough")
    return rows.select("order_id", "status", F.lit(message.startswith("SQL: ")).alias("failed"))


def form_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form with incomplete lines, and two clauses in one."""
    wide = rl.widen(line_records(spark, sf_dir), t.LINE_TYPES)
    given = [("qty", ">", "40"), ("flag", "IN", " , "), ("", "=", "x"), ("price", "<", ""), ("status", "=", "O"), ("kind", "is not null", "")]
    clause = rl.combine("line = 1 OR line = 2  -- first lines", " ", "shipped < '1996-01-01'")
    return rl.sql_where(wide.filter(rl.where_form(wide, given)), clause).select(*LINE_COLUMNS)


def bad_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that give no fields: one of each kind in some notes."""
    orders = t.table(spark, sf_dir, "orders")
    kind = F.col("o_orderkey") % 5
    bad = F.when(kind == 0, "a: 1\na: 2").when(kind == 1, "- just\n- a list").when(kind == 2, "a: [1, 2").when(F.col("o_orderkey") % 500 == 3, F.concat(F.lit("a: "), F.repeat(F.lit("["), 3000), F.repeat(F.lit("]"), 3000))).when(kind == 3, "a: \"open").otherwise("b: [1, {c: 2}]")
    content = t.text("---\nid: ", "$o_orderkey", "\n---\n", t.FENCE_START, "ok: 1\n", t.FENCE_END, t.FENCE_START, bad, "\n", t.FENCE_END)
    notes = orders.select(t.text("/n/", "$o_orderkey", ".md").alias("_note_file"), content.alias("content"))
    return rl.bad_blocks(notes).select(F.col("_note_file").alias("note_file"), F.col("_pos").alias("pos"))


def context_empty_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes with frontmatter and an empty block: both ways to their context agree."""
    orders = t.table(spark, sf_dir, "orders")
    content = t.text("---\nid: ", "$o_orderkey", "\n---\n# Top\n\n## Empty\n\n", t.FENCE_START, t.FENCE_END, "text\n")
    notes = orders.select(t.text("/n/", "$o_orderkey", ".md").alias("_note_file"), content.alias("content"))
    direct = rl.extract_with_context(notes).select("_note_file", F.col("context").alias("direct"))
    joined = rl.attach_context(rl.extract_records(notes), notes).select("_note_file", F.col("context").alias("joined"))
    return direct.join(joined, "_note_file").select(F.col("_note_file").alias("note_file"), "direct", "joined")


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of equal keys in a line the last counts; lines that hold no object are listed."""
    line = F.when(F.col("o_orderkey") % 3 == 0, F.lit("[1]")).otherwise(t.text('{"id": 0, "id": ', "$o_orderkey", "}"))
    lines = t.table(spark, sf_dir, "orders").select(F.lit("/n/c.jsonl").alias("_note_file"), F.col("o_orderkey").alias("_pos"), line.alias("line"))
    good = rl.widen(rl.parse_jsonl(lines), {"id": "bigint"}).select("id", F.lit(False).alias("bad"))
    return good.unionAll(rl.bad_lines(lines).select(F.col("_pos").alias("id"), F.lit(True).alias("bad")))


def refresh_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after edits, deletions and renames, brought up to date without extracting the rest again."""
    notes, store = t.order_notes(spark, sf_dir), scratch(spark, "followed")
    rl.refresh(spark, notes, store)
    order = F.regexp_extract("_note_file", "([0-9]+)[.]", 1).cast("long")
    renamed = F.when(order % 11 == 0, F.replace("_note_file", F.lit("/orders/"), F.lit("/moved/"))).otherwise(F.col("_note_file"))
    edited = F.when(order % 5 == 0, F.replace("content", F.lit("kind: payment"), F.lit("kind: refund"))).otherwise(F.col("content"))
    rl.refresh(spark, notes.filter(order % 7 != 0).select(renamed.alias("_note_file"), edited.alias("content")), store)
    return order_rows(rl.current_records(spark, store)).select("note_file", "pos", "order_id", "kind", "total", "customer")


def ingest_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations that come in three batches, one of them twice; half of the index comes after them."""
    path = scratch(spark, "merged")
    annotations, index = t.annotation_notes(spark, sf_dir), rl.parse_jsonl(t.customer_lines(spark, sf_dir))
    store_index(index.filter(F.col("_pos") % 2 == 0), f"{path}/index")
    batch = F.pmod(F.xxhash64("_note_file"), F.lit(3))
    for number in (0, 1, 2, 1):
        write_batch(rl.extract_records(annotations.filter(batch == number)), number, f"{path}/index", f"{path}/store")
    merged = merged_records(spark, f"{path}/store", index)
    types = {"id": "bigint", "binder": "string", "name": "string", "acctbal": "double", "status": "string"}
    return rl.widen(merged, types).select(F.col("_note_file").alias("note_file"), *types)


def fulltext_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms of one, two, three and twenty characters through the trigram index."""
    path = scratch(spark, "grams")
    rl.write_text_index(t.prose_notes(spark, sf_dir), path)
    found = [
        rl.matching_notes_indexed(spark, path, term).select(F.lit(term).alias("term"), F.regexp_extract("_note_file", "([0-9]+)[.]", 1).cast("long").alias("doc"))
        for term in INDEXED_TERMS
    ]
    return reduce(DataFrame.unionAll, found)


INDEXED_TERMS = ("q", "Zu", "ÉTI", "chars: 4", "in the the of and th")


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One note file per supplier, scanned from where it was written."""
    path = scratch(spark, "notes")
    note = t.text("---\nsupplier: ", "$s_suppkey", "\nnation: ", "$s_nationkey", "\n---\n", t.FENCE_START, "balance: ", "$s_acctbal", "\n", t.FENCE_END)
    write_text_files(t.table(spark, sf_dir, "supplier").select(note.alias("value")), path, ".md", one_each=True)
    records = rl.extract_records(rl.read_corpus(spark, path, depth=0))
    return rl.widen(records, {"supplier": "bigint", "nation": "bigint", "balance": "double"}).select("supplier", "nation", "balance")


def scan_collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON-lines files found in the collections folder of a note tree."""
    path = scratch(spark, "tree")
    write_text_files(t.customer_lines(spark, sf_dir).select("line"), f"{path}/collections", ".jsonl")
    return rl.widen(rl.read_collections(spark, path), {"id": "bigint", "name": "string"}).select("id", "name")


def scan_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task index as JSON files, read back."""
    path = scratch(spark, "tasks")
    t.task_index(spark, sf_dir).select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    flat = rl.flatten_tasks(rl.read_task_index(spark, path, lines=True))
    return flat.select(rl.task_location().alias("location"), "status", is_done().alias("done"), is_closed().alias("closed"))


def scan_task_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A task index as JSON arrays, each read in parts."""
    path = scratch(spark, "arrays")
    notes = t.task_index(spark, sf_dir).withColumn("part", F.pmod(F.xxhash64("file"), F.lit(8)).cast("int"))
    element = F.to_json(F.struct("file", "project", "title", "tasks"))
    numbered = notes.select("part", element.alias("element"), F.row_number().over(Window.partitionBy("part").orderBy("file")).alias("n"))
    opened = F.when(F.col("n") == 1, "[\n").otherwise(",\n")
    closed = F.when(F.col("n") == F.max("n").over(Window.partitionBy("part")), "\n]").otherwise("")
    lines = numbered.select("part", "n", F.concat(opened, "element", closed).alias("value"))
    lines.repartition("part").sortWithinPartitions("part", "n").select("part", "value").write.partitionBy("part").text(path)
    flat = rl.flatten_tasks(rl.read_task_index(spark, f"{path}/*/*.txt", split=True))
    return flat.select(rl.task_location().alias("location"), "status", is_done().alias("done"), is_closed().alias("closed"))


def explicit_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns in a given order: empty and unknown ones are left out, the rest within the width."""
    records = rl.parse_jsonl(t.mixed_lines(spark, sf_dir))
    columns, _ = rl.shown_columns(profiles.collect_profile(records), ["who", "ghost", "id", "nowhere", "amount"], budget=60, lead_width=20)
    return rl.select_columns(records, columns, lead=False)


def all_queries() -> dict:
    return {
        "extract_blocks": partial(extract, mode="all"),
        "extract_frontmatter_only": partial(extract, mode="frontmatter"),
        "extract_blocks_only": partial(extract, mode="blocks_only"),
        "preset_eq": lambda s, d: preset(s, d, "status=F"),
        "preset_contains": lambda s, d: preset(s, d, "shipped~-07-"),
        "preset_prefix": lambda s, d: preset(s, d, "shipped^1997-0"),
        "preset_not": lambda s, d: preset(s, d, "flag!R"),
        "preset_and": lambda s, d: preset(s, d, "status=O", "kind=goods", "qty=17"),
        "where_cmp": where_inferred,
        "where_in": lambda s, d: where(s, d, "flag IN ('A', 'N') AND line NOT IN (1, 2)"),
        "where_like": lambda s, d: where(s, d, "_note_file LIKE '%/R/%' AND kind NOT LIKE '%goo%'"),
        "where_null": lambda s, d: where(s, d, "qty IS NULL AND flag IS NOT NULL"),
        "where_between": lambda s, d: where(s, d, "shipped BETWEEN '1996-01-01' AND '1996-03-31' AND qty != 5"),
        "where_or": lambda s, d: where(s, d, "(qty > 45 OR discount >= 0.09) AND status = 'O'"),
        "where_order": lambda s, d: where(s, d, "price > 90000 ORDER BY price DESC NULLS LAST"),
        "form_eq": lambda s, d: form(s, d, "qty", "=", "12"),
        "form_ne": lambda s, d: form(s, d, "flag", "!=", "A"),
        "form_like": lambda s, d: form(s, d, "kind", "like", "erm"),
        "form_gt": lambda s, d: form(s, d, "price", ">", "80000.5"),
        "form_lt": lambda s, d: form(s, d, "shipped", "<", "1996-02-01"),
        "form_ge": lambda s, d: form(s, d, "line", ">=", "6"),
        "form_le": lambda s, d: form(s, d, "discount", "<=", "0.01"),
        "form_is_null": lambda s, d: form(s, d, "flag", "IS NULL"),
        "form_is_not_null": lambda s, d: form(s, d, "flag", "IS NOT NULL", "ignored"),
        "form_in": lambda s, d: form(s, d, "qty", "IN", "1, 2, ,3"),
        "filename_like": filename,
        "fulltext": fulltext,
        "result_counts": fulltext_counts,
        "query_channels": channels,
        "depth_limit": depth,
        "source_paths": paths,
        "explode_binder": explode_binder,
        "merge_layers": merge,
        "merge_hot_keys": merge_by_binder,
        "union_layers": union,
        "array_normalise": array_fields,
        "json_widen": json_widen,
        "mixed_widen": mixed_widen,
        "jsonl_strict": strict_lines,
        "jsonl_output": json_output,
        "fill_rate": fill_rate,
        "field_keys": field_names,
        "top_columns": best_columns,
        "shown_table": shown_table,
        "section_context": section_context,
        "context_join": context_join,
        "block_positions": block_positions,
        "compact_digest": digest,
        "mmd_header": header_block,
        "sanitize": sanitize,
        "record_form": forms,
        "cell_text": cells,
        "tasks_pending": tasks,
        "tasks_done": partial(tasks, done=True),
        "tasks_by_tag": partial(tasks, tag="today"),
        "tasks_by_project": partial(tasks, project="talk USER"),
        "tasks_search": partial(tasks, search="Ation"),
        "task_states": task_states,
        "task_counts": task_counts,
        "store_where": store_where,
        "store_preset": store_preset,
        "store_profile": store_profile,
        "where_named": where_named,
        "where_bad_cast": where_bad_cast,
        "form_lines": form_lines,
        "bad_blocks": bad_blocks,
        "context_empty_block": context_empty_block,
        "jsonl_duplicate_keys": duplicate_keys,
        "refresh_changed": refresh_changed,
        "ingest_merged": ingest_merged,
        "fulltext_indexed": fulltext_indexed,
        "scan_files": scan_files,
        "scan_collections": scan_collections,
        "scan_tasks": scan_tasks,
        "scan_task_array": scan_task_array,
        "explicit_columns": explicit_columns,
    }
