"""Benchmark decontamination by template canonicalisation, in DataFrame operations only.

White space counts as one blank.  A text is read twice: as plain words (lower case, marks dropped) and as a template, in which numbers, names and units of measure
are typed placeholders.  Windows of ``WINDOW`` words of documents and benchmark items are joined by hash, plain with plain and template with template.
An item's window is matched by a plain window as it is; by a template only where the slots agree: along one diagonal (the distance of
the places) each value in the changed windows of the item stands for one value in the document's, and the other way round.  So a question asked
again with other numbers is found, a verbatim copy is found whatever its case and blanks, and a text of like shape with unrelated values is not.
A document is contaminated by an item of which it holds ``SIMILARITY`` of the distinct plain windows or more.

A name is a capitalised word after a word without closing mark; a number has digits; units are the fixed list below.  An item of fewer
words than a window is one window of all its words and is found wherever they stand in a document; an item of a single word only as a whole document.

Work: windows of documents are only hashes.  The distinct hashes that a document shares with an item are counted first; slots are looked at only in
documents that can reach the similarity, and an item's window is met at its first place, so rows grow with the document's places, not with places times places.

Defined results: null and empty texts match nothing, nor do null or empty items; rows of equal doc_id are told apart by their text
and give one row an item each; rows without doc_id give null ids; an empty benchmark gives no rows.  Columns besides the ids and texts
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from llm.common import store

WINDOW, SIMILARITY, BROADCAST_WINDOWS, NO_ID = 5, 0.8, 500_000, (1 << 63) - 1
# Units of measure that count as slots.
UNITS = (
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons ounce ounces pound pounds ml l litre litres liter liters gallon gallons "
    "second seconds minute minutes hour hours day days week weeks month months year years cent cents dollar dollars euro euros percent degrees mph kmh"
).split()
_SPACE = "[\\x20\\x09-\\x0D]++"
_KEY, _ITEM = ["own", "no_id", "of_text"], ["item_id", "of_item"]


def _template(text: Column) -> Column:
    """Text with placeholders; words stay where they are.  Patterns start at a word's first character, so that long texts cost one pass each."""
    out = F.regexp_replace(text, "(?<=[\\p{L}\\p{N},;] )\\p{Lu}[\\p{Ll}'-]++(?=[ .,;:!?)]|$)", "<name>")
    out = F.regexp_replace(out, "(?<![^ (])[+-]?+[$€£]?+\\p{N}[\\p{N}.,:/-]*+%?+(?=[ ;:!?)]|$)", "<num>")
    return F.regexp_replace(F.lower(out), "(?<=<num> )(?:" + "|".join(UNITS) + ")(?=[ .,;:!?)]|$)", "<unit>")


def _words(text: Column) -> Column:
    return F.split(F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}<> ]++", ""), " ")


def _read(rows: DataFrame, keys: list[str], with_raw: bool = False) -> DataFrame:
    """keys, plain (hashes of words), template (the same of template words, null where the text has no placeholder), and for slots raw and slot words."""
    blank = F.trim(F.regexp_replace("text", _SPACE, " "))
    rows = rows.select(*keys, blank.alias("text")).filter(F.col("text") != "")
    changes = F.col("text").rlike("\\p{N}|[\\p{L}\\p{N},;] \\p{Lu}")
    rows = rows.select(*keys, "text", F.when(changes, _words(_template(F.col("text")))).alias("slot_words"))
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    raw = [_words(F.col("text")).alias("raw"), "slot_words"] if with_raw else []
    return rows.select(*keys, hashed(_words(F.col("text"))).alias("plain"), hashed("slot_words").alias("template"), *raw)


def _hash_at(words: str, i: Column, size: int) -> Column:
    return F.xxhash64(F.slice(words, i + 1, size))


def _places(size: int) -> Column:
    return F.when(F.size("plain") >= size, F.sequence(F.lit(0), F.size("plain") - size)).otherwise(F.array().cast("array<int>"))


def _keys(sizes: list[int]) -> Column:
    """Hashes of all windows of these sizes: plain ones, and templates where they differ."""
    parts = []
    for size in sizes:
        at = _places(size)
        changed = F.filter(F.transform(at, lambda i: F.when(F.slice("template", i + 1, size) != F.slice("plain", i + 1, size), _hash_at("template", i, size))), lambda h: h.isNotNull())
        parts += [F.transform(at, lambda i: _hash_at("plain", i, size)), F.when(F.col("template").isNotNull(), changed).otherwise(F.array().cast("array<bigint>"))]
    return F.concat(*parts) if parts else F.array().cast("array<bigint>")


def _slots(raw: Column, slot_words: Column) -> Column:
    """The values of a window's placeholders at their places; empty text elsewhere."""
    return F.zip_with(raw, F.coalesce(slot_words, raw), lambda r, s: F.when(s.isin("<num>", "<name>", "<unit>"), r).otherwise(""))


def _windows(read: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place, hash (plain), template (hash), slots of the windows of ``size`` words, a column of ``read``."""
    part = lambda c: F.slice(c, F.col("place") + 1, F.col("size"))
    placed = read.withColumn("place", F.explode(F.when(F.size("plain") >= F.col("size"), F.sequence(F.lit(0), F.size("plain") - F.col("size")))))
    return placed.select(*keys, "place", F.xxhash64(part("plain")).alias("hash"), F.xxhash64(F.coalesce(part("template"), part("plain"))).alias("template"), _slots(part("raw"), part("slot_words")).alias("slots"))


def _item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item_id, of_item, words, size, hash, and place, template, slots at the first place of each distinct plain window."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("long"), F.lit(NO_ID)).alias("item_id"), F.xxhash64("text").alias("of_item"), "text")
    read = _read(rows, _ITEM, with_raw=True).withColumns({"words": F.size("plain"), "size": F.least(F.size("plain"), F.lit(window))})
    keys = [*_ITEM, "words", "size"]
    return _windows(read, keys).groupBy(*keys, "hash").agg(F.min(F.struct("place", "template", "slots")).alias("first")).select(*keys, "hash", "first.*")


def _sized(small: DataFrame) -> DataFrame:
    """Broadcast only what has been counted and is small."""
    return F.broadcast(small) if small.count() <= BROADCAST_WINDOWS else small


def _keyed(docs: DataFrame) -> DataFrame:
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(0)).alias("own"), doc_id.isNull().alias("no_id"), F.xxhash64("text").alias("of_text"), "text")


def _changed(docs: DataFrame, pairs: DataFrame, items: DataFrame, sizes: list[int]) -> DataFrame:
    """pairs: documents and items that may meet.  Keys of both and n_changed: windows that only templates meet, on diagonals whose slots agree."""
    read = _read(docs.join(_sized(pairs.select(*_KEY).distinct()), _KEY, "left_semi"), _KEY, with_raw=True).dropDuplicates(_KEY)
    read = read.withColumn("size", F.explode(F.array(*map(F.lit, sizes))))
    windows = _windows(read, _KEY).withColumnsRenamed({"hash": "own_hash", "slots": "own_slots", "place": "own_place"})
    of_item = items.select(*_ITEM, "hash", "template", "slots", "place")
    both = pairs.select(*_KEY, *_ITEM)
    verbatim = windows.select(*_KEY, F.col("own_hash").alias("hash")).join(_sized(of_item.select(*_ITEM, "hash")), "hash").join(both, [*_KEY, *_ITEM], "left_semi").distinct()
    met = windows.join(_sized(of_item), "template").join(both, [*_KEY, *_ITEM], "left_semi").filter("hash != own_hash").join(verbatim, [*_KEY, *_ITEM, "hash"], "left_anti")
    values = F.filter(F.arrays_zip(F.col("slots").alias("i"), F.col("own_slots").alias("d")), lambda x: x["i"] != "")
    keys = [*_KEY, *_ITEM]
    diagonal = met.groupBy(*keys, (F.col("own_place") - F.col("place")).alias("diagonal")).agg(F.collect_set("hash").alias("hashes"), F.array_distinct(F.flatten(F.collect_set(values))).alias("values"))
    n = F.size("values")
    agree = (n == F.size(F.array_distinct(F.transform("values", lambda x: x["i"])))) & (n == F.size(F.array_distinct(F.transform("values", lambda x: x["d"]))))
    return diagonal.filter(agree).groupBy(*keys).agg(F.size(F.array_distinct(F.flatten(F.collect_list("hashes")))).cast("long").alias("n_changed"))


def _matches(docs: DataFrame, benchmark: DataFrame, window: int, similarity: float) -> DataFrame:
    items = store(_item_windows(benchmark, window), "benchmark-windows")
    totals = items.groupBy(*_ITEM).agg(F.count("*").alias("n_windows"))
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most ``window`` values
    rows = _keyed(docs)
    both = F.explode(F.array_distinct(F.array("hash", "template"))).alias("key")
    read = _read(rows, _KEY).select(*_KEY, F.size("plain").alias("doc_words"), F.explode(_keys(sizes)).alias("key"))
    shared = read.join(_sized(items.select(both).distinct()), "key", "left_semi").distinct()
    # Windows met by either form bound what the slots can leave.
    found = shared.join(_sized(items.select(*_ITEM, "words", "size", "hash", both)), "key").filter((F.col("size") > 1) | (F.col("words") == F.col("doc_words")))
    bound = found.groupBy(*_KEY, *_ITEM).agg(F.count_distinct("hash").alias("bound"), F.count_if(F.col("key") == F.col("hash")).alias("verbatim"))
    bound = store(bound.join(_sized(totals), _ITEM).filter(F.col("bound") >= similarity * F.col("n_windows")), "benchmark-candidates")
    changed = _changed(rows, bound.filter("bound > verbatim"), items, sizes) if sizes else None
    judged = bound.withColumn("n_changed", F.lit(0)) if changed is None else bound.join(changed, [*_KEY, *_ITEM], "left")
    judged = judged.withColumn("n_matched", F.col("verbatim") + F.coalesce("n_changed", F.lit(0)))
    return judged.withColumn("similarity", F.col("n_matched") / F.col("n_windows")).filter(F.col("similarity") >= similarity)


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, of_text (hash of the row's text), item_id, n_matched, n_windows, similarity of every contamination."""
    doc_id = F.when(~F.col("no_id"), F.col("own")).alias("doc_id")
    return _matches(docs, benchmark, window, similarity).select(doc_id, "of_text", F.nullif("item_id", F.lit(NO_ID)).alias("item_id"), "n_matched", "n_windows", "similarity")


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, similarity: float = SIMILARITY) -> DataFrame:
    """The whole rows of documents that hold no item."""
    found = store(_matches(docs, benchmark, window, similarity).select(*_KEY).distinct(), "contaminated")
    row = F.struct(*docs.columns).alias("row")  # so that no column of the documents clashes with the keys
    doc_id = F.col("doc_id").cast("long")
    keyed = docs.select(row, F.coalesce(doc_id, F.lit(0)).alias("own"), doc_id.isNull().alias("no_id"), F.xxhash64("text").alias("of_text"))
    return keyed.join(_sized(found), _KEY, "left_anti").select("row.*")
