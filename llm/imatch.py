"""I-Match fingerprints with randomised lexicons, in DataFrame operations only.

Terms are a text's lower-cased words.  Document frequencies are counted in ``TERM_SLOTS`` slots of term hashes (terms that share a slot share its
frequency), and the lexicon is the slots whose inverse document frequency lies in the band: in at least ``LEAST`` and at most ``MOST`` of all
documents, and in two at least.  It is a bit map of TERM_SLOTS / 8 bytes whatever the corpus.  A text's distinct lexicon terms are sorted and hashed
once whole and once for every randomised subset of the lexicon: ``SERIES`` of nested subsets down to a 1024th of it, so that
texts of any length meet subsets that hold just a few of their terms, whose hash survives edits of the others.
A text without lexicon terms uses all its terms.

The likeness of two fingerprints is the share of equal hashes among the subsets in which either text has a term.

Defined results: null texts count as empty; empty texts have a fingerprint of empty marks, and likeness 1 to each other; rows of equal
doc_id are ordered by their texts' hashes, rows without doc_id come last in descending order; in a table of one row that row is its own next document.
Columns besides doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from llm.common import store

TERM_SLOTS, LEAST, MOST, LEVELS = 1 << 20, 0.0005, 0.1, (2, 3, 4, 5, 6, 7, 8, 10)
#: Which bit of a term's hash each series of subsets begins at; the highest bits choose the term's slot.
SERIES = (0, 5, 10, 15, 20, 24, 29, 33)
QUANTILES, GROUP_ROWS = 256, 512


def _terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def _slot(term: Column) -> Column:
    return F.shiftrightunsigned(term, 65 - TERM_SLOTS.bit_length())


def lexicon(docs: DataFrame) -> DataFrame:
    """One row: bits, an array of TERM_SLOTS / 64 longs.  Stored, since every fingerprint reads it."""
    slots = docs.select(F.explode(F.array_distinct(F.transform(_terms(F.col("text")), _slot))).alias("slot"))
    counted = slots.groupBy("slot").count()
    total = docs.count()
    kept = counted.filter((F.col("count") >= max(2.0, LEAST * total)) & (F.col("count") <= max(2.0, MOST * total)))
    words = kept.groupBy(F.shiftright("slot", 6).alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 as int))")).alias("bits"))
    every = docs.sparkSession.range(TERM_SLOTS // 64).join(words, "id", "left").select("id", F.coalesce("bits", F.lit(0)).alias("bits"))
    ordered = every.groupBy().agg(F.sort_array(F.collect_list(F.struct("id", "bits"))).alias("x"))
    return store(ordered.select(F.transform("x", lambda x: x["bits"]).alias("bits")), "lexicon")


def _low_bits_zero(at: int, n: int) -> Callable[[Column], Column]:
    return lambda term: F.shiftrightunsigned(term, at).bitwiseAND(F.lit((1 << n) - 1)) == 0


def with_fingerprint(rows: DataFrame, text: str, bits: DataFrame, to: str) -> DataFrame:
    """Adds the array of hashes; null where a subset has none of the text's terms."""
    others = rows.columns
    rows = rows.select(*others, _terms(F.col(text)).alias("_terms"), bits.scalar().alias("_bits"))
    inside = F.filter(
        "_terms", lambda t: F.get("_bits", F.shiftrightunsigned(t, 71 - TERM_SLOTS.bit_length()).cast("int")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), _slot(t).bitwiseAND(F.lit(63)).cast("int"))) != 0
    )
    rows = rows.select(*others, "_terms", inside.alias("_known"))
    rows = rows.select(*others, F.array_sort(F.when(F.size("_known") > 0, F.col("_known")).otherwise(F.col("_terms"))).alias("_s"))
    hashes, series = ["_h"], [f"_s{r}" for r in range(len(SERIES))]
    rows = rows.select(*others, F.when(F.size("_s") > 0, F.hash("_s")).alias("_h"), *[F.col("_s").alias(s) for s in series])
    done = 0
    for level in LEVELS:
        cut = [F.filter(s, _low_bits_zero(SERIES[r] + done, level - done)).alias(s) for r, s in enumerate(series)]
        rows = rows.select(*others, *hashes, *cut)
        rows = rows.select(*others, *hashes, *[F.when(F.size(s) > 0, F.hash(s)).alias(f"_h{level}_{r}") for r, s in enumerate(series)], *series)
        hashes += [f"_h{level}_{r}" for r in range(len(SERIES))]
        done = level
    return rows.select(*others, F.array(*hashes).alias(to))


def likeness(a: str, b: str) -> Column:
    n = 1 + len(SERIES) * len(LEVELS)
    both = [(F.get(a, F.lit(i)), F.get(b, F.lit(i))) for i in range(n)]
    equal = sum((F.coalesce((x == y).cast("int"), F.lit(0)) for x, y in both), F.lit(0))
    either = sum(((x.isNotNull() | y.isNotNull()).cast("int") for x, y in both), F.lit(0))
    return F.when(either == 0, F.lit(1.0)).otherwise(equal / either)


def as_text(fingerprint: str) -> Column:
    return F.array_join(F.transform(fingerprint, lambda h: F.coalesce(F.lower(F.right(F.lpad(F.hex(h), 8, "0"), F.lit(8))), F.lit("-"))), ":")


def _grouped(docs: DataFrame) -> DataFrame:
    """Adds ``part`` and ``group``, both rising with doc_id: ranges between quantiles, each in even steps of about GROUP_ROWS rows."""
    known = docs.filter(F.col("doc_id").isNotNull())
    row = known.agg(F.percentile_approx("doc_id", [k / QUANTILES for k in range(QUANTILES + 1)], 10_000).alias("q"), F.count("*").alias("n")).first()
    bounds = sorted(set(row["q"] or [0]))
    steps = [max(1.0, (b - a) * QUANTILES * GROUP_ROWS / max(1, row["n"])) for a, b in zip(bounds, bounds[1:])] + [float(GROUP_ROWS)]
    q, s = F.array(*[F.lit(b).cast("long") for b in bounds]), F.array(*[F.lit(x) for x in steps])
    docs = docs.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.greatest(F.size(F.filter(q, lambda b: b <= F.col("doc_id"))) - 1, F.lit(0))))
    return docs.withColumn("group", F.when(F.col("part") < 0, F.lit(0).cast("long")).otherwise(F.floor((F.col("doc_id").cast("double") - F.get(q, F.col("part"))) / F.get(s, F.col("part")))))


def compare(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    bits = lexicon(docs)
    own = with_fingerprint(_grouped(docs), "text", bits, "print")
    order = Window.partitionBy("part", "group").orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    lined = own.select("*", F.lag("part").over(order).isNull().alias("is_first"), F.lead("text").over(order).alias("next_text"), F.lead("print").over(order).alias("next_print"))

    # The last row of a group goes on with the first of the next group below; groups are few, and lined up in their parts.
    first = lined.filter("is_first").select("part", "group", F.struct("text", "print").alias("top"))
    groups = own.select("part", "group").distinct()
    inside = Window.partitionBy("part").orderBy(F.col("group").desc())
    groups = groups.select("part", "group", F.lead("group").over(inside).alias("below"))
    parts = groups.groupBy("part").agg(F.max("group").alias("top_group"))  # at most QUANTILES + 1 rows
    line = Window.orderBy(F.col("part").desc())
    highest = F.max(F.struct("part", "top_group")).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = F.coalesce(F.lead(F.struct("part", "top_group")).over(line), highest)
    parts = parts.select("part", after.alias("after"))
    follow = groups.join(F.broadcast(parts), "part")
    follow = follow.select("part", "group", F.when(F.col("below").isNotNull(), F.col("part")).otherwise(F.col("after.part")).alias("next_part"), F.coalesce("below", "after.top_group").alias("next_group"))
    tops = follow.join(first.select(F.col("part").alias("next_part"), F.col("group").alias("next_group"), "top"), ["next_part", "next_group"]).select("part", "group", "top")

    inner = lined.filter(F.col("next_print").isNotNull()).select("doc_id", "text", "print", "next_text", "next_print")
    edge = lined.filter(F.col("next_print").isNull()).join(tops, ["part", "group"]).select("doc_id", "text", "print", F.col("top.text").alias("next_text"), F.col("top.print").alias("next_print"))
    rows = inner.unionAll(edge).withColumn("n_chars", F.length("text").cast("long"))
    half = F.expr("cast(n_chars div 2 as int)")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half))
    rows = rows.select("doc_id", "n_chars", "print", edited.alias("edited"), likeness("print", "next_print").alias("near_next"))
    rows = with_fingerprint(rows, "edited", bits, "edited_print")
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text("print").alias("fingerprint"), as_text("edited_print").alias("edited_fingerprint"), likeness("print", "edited_print").alias("near_edited"), "near_next")
