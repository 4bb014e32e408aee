"""The same results as SQL over the original tables, for DuckDB."""

_NL = "chr(10)"


def _join(*parts: str) -> str:
    """SQL text expression: names start with ``$``, everything else is literal text."""
    out = []
    for part in parts:
        if part.startswith("$"):
            out.append(f"CAST({part[1:]} AS VARCHAR)")
        else:
            out.append("'" + part.replace("'", "''").replace("\n", f"' || {_NL} || '") + "'")
    return "(" + " || ".join(out) + ")"


_ORDER_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
_ORDER_FILE = (
    "'/notes/orders/' || strftime(o_orderdate, '%Y') || '/' || o_orderkey "
    "|| CASE WHEN o_orderpriority = '1-URGENT' THEN '.typ' ELSE '.md' END"
)
_ORDER_TYPE = "CASE WHEN o_orderpriority = '1-URGENT' THEN 'typst' ELSE 'markdown' END"


def _orders(pos: int, front: bool, block: bool) -> str:
    def when(use: bool, expression: str, kind: str) -> str:
        return expression if use else f"CAST(NULL AS {kind})"

    payment, delivery = block and pos == 0, block and pos == 1
    return f"""SELECT {_ORDER_FILE} AS note_file, {_ORDER_TYPE} AS source_type, CAST({pos} AS BIGINT) AS pos,
        {when(front, 'o_orderkey', 'BIGINT')} AS order_id, {when(front, 'o_orderstatus', 'VARCHAR')} AS status,
        {when(front, 'o_orderpriority', 'VARCHAR')} AS priority, {when(front, 'CAST(o_orderdate AS DATE)', 'DATE')} AS odate,
        {when(block, "'payment'" if pos == 0 else "'delivery'", 'VARCHAR')} AS kind,
        {when(payment, 'o_totalprice', 'DOUBLE')} AS total, {when(delivery, 'o_custkey', 'BIGINT')} AS customer,
        {when(delivery, "lower(o_orderstatus) || ',note'", 'VARCHAR')} AS tags FROM orders"""


_LINES = """(SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS line, l_linestatus AS status,
        CAST(l_shipdate AS DATE) AS shipped, kind, CASE WHEN kind = 'goods' THEN l_quantity END AS qty,
        CASE WHEN kind = 'goods' THEN l_extendedprice END AS price, CASE WHEN kind = 'terms' THEN l_returnflag END AS flag,
        CASE WHEN kind = 'terms' THEN l_discount END AS discount, '/notes/lines/' || l_returnflag || '/' || l_orderkey || '-'
        || l_linenumber || '.md' AS _note_file FROM lineitem CROSS JOIN (VALUES ('goods'), ('terms')) k(kind))"""


def _lines(clause: str) -> str:
    return f"SELECT order_id, line, status, shipped, kind, qty, price, flag FROM {_LINES} WHERE {clause}"


_PROSE = _join("---\ndoc: ", "$doc_id", "\nlang: ", "$lang", "\nchars: ", "$n_chars", "\n---\n\n", "$text")
_PROSE_FILE = "'/notes/docs/' || source || '/' || doc_id || CASE WHEN lang = 'en' THEN '.md' ELSE '.typ' END"

_MEMBERS = """(SELECT c_custkey AS id, unnest([c_mktsegment, 'n' || c_nationkey]) AS binder, c_name AS name,
        c_acctbal AS acctbal FROM customer)"""
_ANNOTATED = """(SELECT '/notes/vip/' || c_custkey || '.md' AS note_file, c_custkey AS id, c_mktsegment AS binder,
        CAST(c_nationkey AS DOUBLE) AS acctbal, 'vip' AS status FROM customer WHERE c_acctbal > 5000)"""
_COLLECTION = "'/notes/collections/customers.jsonl'"

_MIXED = """(SELECT event_id AS id, CASE WHEN event_type = 'purchase' THEN value END AS amount,
        CASE WHEN event_type = 'click' THEN CAST(ts AS DATE) END AS day,
        CASE WHEN event_type = 'error' THEN ['error', 'e'] END AS tags,
        CASE WHEN event_type = 'view' THEN '1' ELSE 'u' END AS who FROM events)"""
_MIXED_COUNTS = f"""(SELECT unnest(['id', 'amount', 'day', 'tags', 'who', 'ghost']) AS key,
        unnest([n, amounts, days, lists, n, views]) AS present, unnest([n, amounts, days, lists, n, 0]) AS non_null,
        unnest(['bigint', 'double', 'date', 'array<string>', 'string', 'string']) AS column_type, unnest([n, n, n, n, n, n]) AS n
        FROM (SELECT count(*) AS n, count(amount) AS amounts, count(day) AS days, count(tags) AS lists,
        count(*) FILTER (WHERE who = '1') AS views FROM {_MIXED}))"""

_FRONT = _join(
    "---\norder_id: ", "$o_orderkey", "\nstatus: ", "$o_orderstatus", "\npriority: ", "$o_orderpriority",
    "\nodate: ", "$" + _ORDER_DAY, "\n---",
)
_PAYMENT = _join("```yaml\nkind: payment\ntotal: ", "$o_totalprice", "\n```")
_DELIVERY = _join("```yaml\nkind: delivery\ncustomer: ", "$o_custkey", "\ntags: [", "$lower(o_orderstatus)", ", note]\n```")
_ADDRESS_CONTEXT = f"{_FRONT} || {_join(chr(10) * 2 + '### Address' + chr(10) * 2)} || {_DELIVERY}"
_PAYMENT_CONTEXT = (
    f"{_FRONT} || {_join(chr(10) * 2 + '## Payment' + chr(10) * 2)} || {_PAYMENT} || {_join(chr(10) * 2 + 'Paid in full.')}"
)

_TASKS = f"""(SELECT CASE length(line) % 5 WHEN 0 THEN 'x' WHEN 1 THEN '>' WHEN 2 THEN '-' WHEN 3 THEN '?' ELSE '' END AS status,
        role = 'system' AS tag_done, role <> 'system' AND turn = 3 AS tag_deferred, role <> 'system' AND turn = 2 AS tag_cancelled,
        role = 'assistant' AND turn NOT IN (2, 3) AS tag_waiting, line, i, 'Talk ' || role AS project,
        conv_id || '-' || turn AS note FROM (SELECT *, unnest(string_split(text, {_NL})) AS line,
        generate_subscripts(string_split(text, {_NL}), 1) AS i FROM conversations))"""
_DONE = "(status = 'x' OR tag_done)"
_CLOSED = f"({_DONE} OR status IN ('>', '-') OR tag_deferred OR tag_cancelled)"


def _tasks(clause: str) -> str:
    return f"""SELECT CASE WHEN status = '' THEN line ELSE '[' || status || '] ' || line END AS task, project,
        CASE WHEN tag_done THEN '@done(false)' WHEN tag_deferred THEN '@deferred' WHEN tag_cancelled THEN '@cancelled()'
        WHEN tag_waiting THEN '@n(3)  @today  @waiting(client)' ELSE '' END AS tags, note FROM {_TASKS} WHERE {clause}"""


def _first_index(keys: str) -> str:
    return f"(SELECT DISTINCT ON ({keys}) * FROM {_MEMBERS} ORDER BY {keys}, id)"


def all_oracles() -> dict[str, str]:
    both = " UNION ALL ".join(_orders(pos, True, True) for pos in (0, 1))
    soiled = "replace(replace(text, 'e ', chr(173) || 'e' || chr(9)), 'a', chr(8203) || 'a' || chr(13))"
    base = "regexp_extract(url, '([^/]*)$', 1)"
    ext = f"lower(regexp_extract({base}, '(\\.[^.]*)$', 1))"
    return {
        "extract_blocks": both,
        "extract_frontmatter_only": _orders(-1, True, False),
        "extract_blocks_only": " UNION ALL ".join(_orders(pos, False, True) for pos in (0, 1)),
        "preset_eq": _lines("status = 'F'"),
        "preset_contains": _lines("contains(CAST(shipped AS VARCHAR), '-07-')"),
        "preset_prefix": _lines("starts_with(CAST(shipped AS VARCHAR), '1997-0')"),
        "preset_not": _lines("flag IS DISTINCT FROM 'R'"),
        "preset_and": _lines("status = 'O' AND kind = 'goods' AND qty = 17"),
        "where_cmp": _lines("status = 'F' AND qty > 30 AND shipped > '1997-01-01'"),
        "where_in": _lines("flag IN ('A', 'N') AND line NOT IN (1, 2)"),
        "where_like": _lines("_note_file LIKE '%/R/%' AND kind NOT LIKE '%goo%'"),
        "where_null": _lines("qty IS NULL AND flag IS NOT NULL"),
        "where_between": _lines("shipped BETWEEN '1996-01-01' AND '1996-03-31' AND qty != 5"),
        "where_or": _lines("(qty > 45 OR discount >= 0.09) AND status = 'O'"),
        "where_order": _lines("price > 90000 ORDER BY price DESC NULLS LAST"),
        "form_eq": _lines("qty = 12"),
        "form_ne": _lines("flag != 'A'"),
        "form_like": _lines("kind LIKE '%erm%'"),
        "form_gt": _lines("price > 80000.5"),
        "form_lt": _lines("shipped < '1996-02-01'"),
        "form_ge": _lines("line >= 6"),
        "form_le": _lines("discount <= 0.01"),
        "form_is_null": _lines("flag IS NULL"),
        "form_is_not_null": _lines("flag IS NOT NULL"),
        "form_in": _lines("qty IN (1, 2, 3)"),
        "filename_like": _lines("_note_file LIKE '%lines/R%' AND qty < 10"),
        "fulltext": f"SELECT doc_id AS doc, lang FROM documents WHERE contains(lower({_PROSE}), 'étion')",
        "result_counts": f"""SELECT count(*) AS structured, count(*) FILTER (WHERE contains(lower({_PROSE}), 'lang: de')) AS shown
            FROM documents""",
        "query_channels": f"""SELECT doc_id AS doc, lang, n_chars AS chars FROM documents WHERE lang = 'en' AND n_chars >= 400
            AND {_PROSE_FILE} LIKE '%src1%' AND contains(lower({_PROSE}), 'ation')""",
        "depth_limit": "SELECT '/notes/customers/' || c_custkey || '.md' AS note_file FROM customer",
        "source_paths": f"""SELECT page_id, CASE WHEN {ext} IN ('', '.md', '.markdown') THEN 'markdown'
            WHEN {ext} IN ('.typ', '.typst') THEN 'typst' WHEN {ext} = '.jsonl' THEN 'jsonl' ELSE 'other' END AS source_type,
            regexp_replace({base}, '\\.[^.]*$', '') AS stem, {base} AS source FROM pages""",
        "explode_binder": f"SELECT id, binder, name FROM {_MEMBERS}",
        "merge_layers": f"""SELECT coalesce(a.note_file, {_COLLECTION}) AS note_file, coalesce(a.id, i.id) AS id,
            coalesce(a.binder, i.binder) AS binder, i.name, coalesce(a.acctbal, i.acctbal) AS acctbal, a.status
            FROM {_ANNOTATED} a FULL OUTER JOIN {_first_index('id, binder')} i ON a.id = i.id AND a.binder = i.binder""",
        "merge_hot_keys": f"""SELECT coalesce(a.note_file, {_COLLECTION}) AS note_file, coalesce(a.id, i.id) AS id,
            coalesce(a.binder, i.binder) AS binder, i.name
            FROM {_ANNOTATED} a FULL OUTER JOIN {_first_index('binder')} i ON a.binder = i.binder""",
        "union_layers": """SELECT c_custkey AS id, CAST(NULL AS BIGINT) AS k, c_name AS name FROM customer
            UNION ALL SELECT NULL, CAST(json_extract(props, '$.k') AS BIGINT), NULL FROM events""",
        "array_normalise": f"""SELECT id, who, CAST(1 AS BIGINT) AS n_who, array_to_string(tags, '|') AS tags FROM {_MIXED}""",
        "json_widen": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
        "mixed_widen": f"SELECT id, amount, day, array_to_string(tags, '+') AS tags, who FROM {_MIXED}",
        "jsonl_strict": "SELECT c_custkey AS id, c_acctbal AS acctbal FROM customer",
        "jsonl_output": "SELECT c_custkey AS id, c_name AS name, c_mktsegment || '/n' || c_nationkey AS binder FROM customer",
        "fill_rate": f"""SELECT key, present, non_null, non_null / CAST(n AS DOUBLE) AS fill_rate, column_type
            FROM {_MIXED_COUNTS} WHERE present > 0""",
        "field_keys": """SELECT unnest(['order_id', 'status', 'priority', 'odate', 'kind', 'total', 'customer', 'tags']) AS key
            WHERE EXISTS (SELECT 1 FROM orders)""",
        "top_columns": f"""SELECT key, non_null, rank FROM (SELECT *, sum(CASE WHEN key = 'who' THEN 10 ELSE 20 END)
            OVER (ORDER BY rank) AS used FROM (SELECT key, non_null, row_number() OVER (ORDER BY non_null DESC, key) AS rank
            FROM {_MIXED_COUNTS} WHERE non_null > 0)) WHERE used <= 50 OR rank = 1""",
        "shown_table": f"SELECT 'mixed.jsonl' AS source, CAST(id AS VARCHAR) AS id, who FROM {_MIXED}",
        "section_context": f"""SELECT {_ORDER_FILE} AS note_file, CAST(0 AS BIGINT) AS pos, {_PAYMENT_CONTEXT} AS context FROM orders
            UNION ALL SELECT {_ORDER_FILE}, 1, {_ADDRESS_CONTEXT} FROM orders""",
        "context_join": f"""SELECT {_ORDER_FILE} AS note_file, {_ADDRESS_CONTEXT} AS context FROM orders
            WHERE o_orderpriority = '1-URGENT'""",
        "block_positions": f"""SELECT {_ORDER_FILE} AS note_file, CAST(0 AS BIGINT) AS pos, 'payment' AS kind FROM orders
            UNION ALL SELECT {_ORDER_FILE}, 1, 'delivery' FROM orders""",
        "compact_digest": f"""SELECT {_ORDER_FILE} AS note_file, {_FRONT} || {_join(chr(10) * 2 + '## Payment' + chr(10))}
            || {_PAYMENT} || {_join(chr(10) * 2 + '### Address' + chr(10))} || {_DELIVERY}
            || {_join(chr(10) * 2 + '## Tasks' + chr(10) * 2 + '- call customer ', '$o_custkey')} AS digest FROM orders""",
        "mmd_header": "SELECT c_name AS name, c_custkey AS account_no, c_acctbal AS balance FROM customer",
        "sanitize": f"""SELECT doc_id, regexp_replace(replace({soiled}, chr(9), ' '), '[\\x00-\\x08\\x0b-\\x1a\\x1c-\\x1f\\x7f-\\x{{9f}}'
            || '\\x{{ad}}\\x{{feff}}\\x{{200b}}-\\x{{200f}}\\x{{2028}}-\\x{{202e}}\\x{{2060}}-\\x{{2064}}]', '', 'g') AS clean FROM documents""",
        "record_form": f"""SELECT c_custkey AS id, {_join('acctbal  ', '$c_acctbal', chr(10) + 'binder  ', '$c_mktsegment', ', n',
            '$c_nationkey', chr(10) + 'id  ', '$c_custkey', '.0' + chr(10) + 'name  ', '$c_name', chr(10) * 2 + 'source  ')}
            || {_COLLECTION} AS form FROM customer""",
        "cell_text": f"""SELECT 'mixed.jsonl' AS source, CAST(id AS VARCHAR) AS id,
            coalesce(regexp_replace(CAST(amount AS VARCHAR), '\\.0$', ''), '') AS amount,
            CASE WHEN tags IS NULL THEN '' ELSE '[error e]' END AS tags, who FROM {_MIXED}""",
        "tasks_pending": _tasks(f"NOT {_CLOSED}"),
        "tasks_done": _tasks(_DONE),
        "tasks_by_tag": _tasks(f"NOT {_CLOSED} AND tag_waiting"),
        "tasks_by_project": _tasks(f"NOT {_CLOSED} AND contains(lower(project), 'talk user')"),
        "tasks_search": _tasks(f"NOT {_CLOSED} AND contains(lower(line), 'ation')"),
        "task_states": f"""SELECT '/notes/talks/' || note || '.md:' || i AS location, status, {_DONE} AS done, {_CLOSED} AS closed
            FROM {_TASKS}""",
        "task_counts": f"""SELECT count(*) FILTER (WHERE NOT {_CLOSED}) AS pending, count(*) FILTER (WHERE {_DONE}) AS done
            FROM {_TASKS}""",
        "store_where": _lines("status = 'F' AND qty > 30 AND shipped > '1997-01-01'"),
        "store_preset": _lines("status = 'O' AND flag IS DISTINCT FROM 'A' AND year(shipped) = 1996 AND line <= 2"),
        "store_profile": f"SELECT key, present, non_null, column_type FROM {_MIXED_COUNTS} WHERE present > 0",
        "where_named": _lines("status = 'F' AND qty > 30 AND shipped > '1997-01-01'"),
        "where_bad_cast": f"SELECT order_id, status, true AS failed FROM {_LINES}",
        "form_lines": _lines("qty > 40 AND status = 'O' AND (line = 1 OR line = 2) AND shipped < '1996-01-01'"),
        "bad_blocks": "SELECT '/n/' || o_orderkey || '.md' AS note_file, CAST(1 AS BIGINT) AS pos FROM orders WHERE o_orderkey % 5 < 4",
        "context_empty_block": f"""SELECT *, direct AS joined FROM (SELECT '/n/' || o_orderkey || '.md' AS note_file,
            {_join(chr(45) * 3 + chr(10) + 'id: ', '$o_orderkey', chr(10) + '---' + chr(10) * 2 + '## Empty' + chr(10) * 2
                   + '```yaml' + chr(10) + '```' + chr(10) + 'text')} AS direct FROM orders)""",
        "jsonl_duplicate_keys": "SELECT o_orderkey AS id, o_orderkey % 3 = 0 AS bad FROM orders",
        "refresh_changed": f"""SELECT CASE WHEN order_id % 11 = 0 THEN replace(note_file, '/orders/', '/moved/') ELSE note_file END AS note_file, pos,
            order_id, CASE WHEN order_id % 5 = 0 AND kind = 'payment' THEN 'refund' ELSE kind END AS kind, total, customer
            FROM ({both}) WHERE order_id % 7 <> 0""",
        "ingest_merged": f"""SELECT coalesce(a.note_file, {_COLLECTION}) AS note_file, coalesce(a.id, i.id) AS id,
            coalesce(a.binder, i.binder) AS binder, i.name, coalesce(a.acctbal, i.acctbal) AS acctbal, a.status
            FROM {_ANNOTATED} a FULL OUTER JOIN {_first_index('id, binder')} i ON a.id = i.id AND a.binder = i.binder""",
        "fulltext_indexed": f"""SELECT term, doc_id AS doc FROM documents JOIN (VALUES ('q'), ('Zu'), ('ÉTI'), ('chars: 4'), ('in the the of and th')) v(term)
            ON contains(lower({_PROSE}), lower(term))""",
        "scan_files": "SELECT s_suppkey AS supplier, CAST(s_nationkey AS BIGINT) AS nation, s_acctbal AS balance FROM supplier",
        "scan_collections": "SELECT c_custkey AS id, c_name AS name FROM customer",
        "scan_tasks": f"""SELECT '/notes/talks/' || note || '.md:' || i AS location, status, {_DONE} AS done, {_CLOSED} AS closed
            FROM {_TASKS}""",
        "scan_task_array": f"""SELECT '/notes/talks/' || note || '.md:' || i AS location, status, {_DONE} AS done, {_CLOSED} AS closed
            FROM {_TASKS}""",
        "explicit_columns": f"SELECT who, CAST(id AS VARCHAR) AS id FROM {_MIXED}",
    }
