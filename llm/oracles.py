"""The same results as SQL for DuckDB, for operators that SQL can express."""

from __future__ import annotations

from llm import phrases, substrings, urls, variants

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# crc32 of a text: a table of 256 entries from its rule, then byte by byte.
_CRC_TABLE = """crc_table AS MATERIALIZED (SELECT list(v ORDER BY i) AS entries FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
    lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i)))"""


def _crc32(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::BIGINT, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, entries[(xor(c, b) & 255) + 1])), 4294967295)"""


def _variants() -> str:
    """Near words meet by what is left of them without one letter."""
    return f"""WITH RECURSIVE {_CRC_TABLE},
runs AS (SELECT id, run, count(*) AS times FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id,
    unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= {variants.MIN_LETTERS} GROUP BY ALL),
hashed AS (SELECT *, {_crc32("(id || ':' || run)")} AS h FROM runs, crc_table),
words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM (SELECT times, CASE WHEN h % {variants.DIVISOR} = 0
    THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run) + 2)::BIGINT) ELSE run END AS word FROM hashed)
    WHERE length(word) >= {variants.MIN_LETTERS} GROUP BY word HAVING sum(times) >= {variants.MIN_COUNT}),
less AS MATERIALIZED (SELECT DISTINCT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM words)),
links AS (SELECT DISTINCT * FROM (SELECT x.word, y.word AS near, x.n, y.n AS near_n FROM less x JOIN less y ON x.rest = y.rest AND x.i = y.i AND x.word <> y.word
    UNION ALL SELECT x.word, y.word, x.n, y.n FROM less x JOIN words y ON x.rest = y.word
    UNION ALL SELECT y.word, x.word, y.n, x.n FROM less x JOIN words y ON x.rest = y.word)),
best AS (SELECT word, any_value(n) AS n, count(*) AS n_near, first(near ORDER BY near_n DESC, near) AS near, max(near_n) AS near_n FROM links GROUP BY word),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {variants.FACTOR} * w.n THEN near END AS form,
    CASE WHEN near_n >= {variants.FACTOR} * w.n THEN near_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
steps AS (SELECT word, word AS reached, 0 AS step FROM forms UNION ALL SELECT s.word, f.form, s.step + 1 FROM steps s JOIN forms f ON s.reached = f.word WHERE f.form IS NOT NULL),
ends AS (SELECT word, arg_max(reached, step) AS root FROM steps GROUP BY word)
SELECT f.word, f.n, f.n_near::BIGINT AS n_near, f.form, f.form_n, e.root FROM forms f JOIN ends e ON f.word = e.word"""


def _urls() -> str:
    """Both models with their smoothing, the scores and the threshold."""
    fits = [(v, rule, "ends_with('.' || host, '.{}') AND starts_with(path, '/{}')".format(*rule.split("/", 1))) for v, rule in sorted(urls.RULES, key=lambda r: -len(r[1]))]
    rule = " ".join(f"WHEN {f} THEN '{r}'" for _, r, f in fits)
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for v, _, f in fits)

    def log_p(n: str, total: str, kinds: str) -> str:
        p = f"(1.0::DOUBLE / {urls.ALPHABET})"
        for k in range(urls.ORDER + 1):
            p = f"(CASE WHEN {total}{k} + {kinds}{k} > 0 THEN ({n}{k} + {kinds}{k} * {p}) / ({total}{k} + {kinds}{k}) ELSE {p} END)"
        return f"ln({p})"

    wide = ", ".join(f"coalesce(sum({c}) FILTER (WHERE k = {k}), 0)::DOUBLE AS {c}{k}" for k in range(urls.ORDER + 1) for c in ("a", "na", "ta", "r", "nr", "tr"))
    windows = f"""(SELECT *, substr(text, greatest(i - {urls.ORDER}, 1), least(i - 1, {urls.ORDER})) AS context, substr(text, i, 1) AS ch
        FROM (SELECT *, unnest(range(2, length(text) + 1)) AS i FROM asked_or_not))"""
    ends = "(SELECT *, right(context, k) AS suffix FROM (SELECT *, unnest(range(0, length(context) + 1)) AS k FROM {}))"
    return f"""WITH {_CRC_TABLE},
rest AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
hosts AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM rest),
ruled AS MATERIALIZED (SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS by_rule FROM hosts),
distinct_urls AS (SELECT host, path, by_rule, count(*) AS n, host || path AS whole FROM ruled GROUP BY host, path, by_rule),
asked_or_not AS MATERIALIZED (SELECT host, path, by_rule, chr(2) || whole || chr(3) AS text, CASE WHEN by_rule = 'allow' THEN n ELSE 0 END AS accepted,
    CASE WHEN by_rule = 'block' THEN n ELSE 0 END AS rejected, {_crc32("whole")} % {urls.HELD_OUT} = 0 AS held FROM distinct_urls, crc_table),
windows AS MATERIALIZED (SELECT * FROM {windows}),
seen AS (SELECT context, ch, sum(accepted) AS a, sum(rejected) AS r FROM windows WHERE by_rule IS NOT NULL AND NOT held GROUP BY context, ch),
grams AS MATERIALIZED (SELECT suffix, ch, sum(a) AS a, sum(r) AS r FROM {ends.format("seen")} GROUP BY suffix, ch),
contexts AS MATERIALIZED (SELECT suffix, sum(a) AS na, count(*) FILTER (WHERE a > 0) AS ta, sum(r) AS nr, count(*) FILTER (WHERE r > 0) AS tr FROM grams GROUP BY suffix),
asked AS (SELECT DISTINCT context, ch FROM windows WHERE by_rule IS NULL OR held),
wide AS (SELECT context, ch, {wide} FROM (SELECT e.context, e.ch, e.k, g.a, g.r, c.na, c.ta, c.nr, c.tr FROM {ends.format("asked")} e
    LEFT JOIN grams g ON g.suffix = e.suffix AND g.ch = e.ch LEFT JOIN contexts c ON c.suffix = e.suffix) GROUP BY context, ch),
ratios AS MATERIALIZED (SELECT context, ch, round(({log_p("a", "na", "ta")} - {log_p("r", "nr", "tr")}) * 1e6)::BIGINT AS ratio FROM wide),
scores AS MATERIALIZED (SELECT host, path, w.by_rule, any_value(accepted) AS accepted, any_value(rejected) AS rejected, floor(sum(ratio)::DOUBLE / count(*)) AS score
    FROM windows w JOIN ratios r ON w.context = r.context AND w.ch = r.ch WHERE w.by_rule IS NULL OR held GROUP BY host, path, w.by_rule),
bins AS (SELECT floor(score / {urls.GRID})::BIGINT AS bin, sum(accepted)::HUGEINT AS a, sum(rejected)::HUGEINT AS r FROM scores WHERE by_rule IS NOT NULL GROUP BY 1),
tried AS (SELECT bin, coalesce(sum(a) OVER before, 0) * sum(r) OVER () + (sum(r) OVER () - coalesce(sum(r) OVER before, 0)) * sum(a) OVER () AS errors, sum(a) OVER () > 0 AND sum(r) OVER () > 0 AS two
    FROM bins WINDOW before AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
best AS (SELECT coalesce(first(bin ORDER BY errors, abs(bin), bin) FILTER (WHERE two), 0) * {urls.GRID} AS at FROM tried)
SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.by_rule, CASE WHEN s.score >= best.at THEN 'allow' ELSE 'block' END) AS verdict,
    CASE WHEN r.by_rule IS NULL THEN s.score::BIGINT END AS score FROM ruled r JOIN best ON true LEFT JOIN scores s ON s.host = r.host AND s.path = r.path AND s.by_rule IS NULL"""


def _phrases() -> str:
    m = phrases.MAX_WORDS
    return f"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
lists AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS words FROM pieces),
places AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM lists),
grams AS (SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, {m + 1})) AS k FROM places) WHERE i + k - 1 <= len(words)),
totals AS (SELECT lang, count(*) AS n FROM places GROUP BY lang),
counts AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= {phrases.MIN_COUNT}),
halves AS (SELECT lang, phrase, a, cut, array_to_string(words[1 : cut], ' ') AS head, array_to_string(words[cut + 1 :], ' ') AS tail
    FROM (SELECT *, string_split(phrase, ' ') AS words, unnest(range(1, k)) AS cut FROM counts WHERE k > 1)),
scored AS (SELECT c.lang, c.phrase, c.a, c.cut, x.a AS l, y.a AS r, t.n, (1000::HUGEINT * c.a * t.n) // (x.a::HUGEINT * y.a) AS score FROM halves c
    JOIN counts x ON x.lang = c.lang AND x.phrase = c.head JOIN counts y ON y.lang = c.lang AND y.phrase = c.tail JOIN totals t ON t.lang = c.lang),
least AS (SELECT DISTINCT ON (lang, phrase) * FROM scored ORDER BY lang, phrase, score, cut),
longer AS (SELECT lang, array_to_string(words[i : i + size - 1], ' ') AS phrase, max(a) AS a FROM (SELECT *, unnest(range(1, k - size + 2)) AS i
    FROM (SELECT *, string_split(phrase, ' ') AS words, unnest(range(2, k)) AS size FROM counts WHERE k > 2)) GROUP BY 1, 2),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY s.score DESC, s.a DESC, s.phrase) AS rank FROM least s LEFT JOIN longer g ON g.lang = s.lang AND g.phrase = s.phrase
    WHERE g.a IS NULL OR 100 * g.a < 100 * s.a)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked WHERE rank <= {phrases.TOP}"""


def _substrings() -> str:
    """Windows as texts; words that a window covers which a smaller doc_id has too."""
    m = substrings.WINDOW
    return f"""WITH lists AS MATERIALIZED (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
places AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM lists),
windows AS MATERIALIZED (SELECT doc_id, i, array_to_string(words[i : i + {m - 1}], ' ') AS passage FROM places WHERE i + {m - 1} <= len(words)),
firsts AS (SELECT passage, min(doc_id) AS least FROM windows GROUP BY passage),
covered AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT w.doc_id, w.i, unnest(range({m})) AS k FROM windows w JOIN firsts f ON f.passage = w.passage WHERE w.doc_id > f.least)),
marked AS (SELECT p.doc_id, p.i, p.words[p.i] AS word, c.i IS NOT NULL AS gone FROM places p LEFT JOIN covered c ON c.doc_id = p.doc_id AND c.i = p.i),
kept AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS text FROM marked GROUP BY doc_id)
SELECT l.doc_id, len(l.words) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256 FROM lists l LEFT JOIN kept k ON k.doc_id = l.doc_id"""


def all_oracles() -> dict[str, str]:
    return {"op7_substrings": _substrings(), "op11_variants": _variants(), "op12_urls": _urls(), "op13_phrases": _phrases()}
